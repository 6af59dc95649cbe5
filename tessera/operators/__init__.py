"""Operators as functions of DataFrames and arguments."""

from tessera.operators.agent import ask, brief
from tessera.operators.apply import apply
from tessera.operators.calls import bounded_calls
from tessera.operators.routes import history, status
from tessera.operators.search import fused, page, search

__all__ = ["apply", "ask", "bounded_calls", "brief", "fused", "history", "page", "search", "status"]
