"""Registered queries: name -> plan, name -> DuckDB SQL."""

from __future__ import annotations

from tessera.plans import money, near, phrases, relational, scalar, signals, sketches, temporal, texts, vectors
from tessera.plans.dialect import DUCK, plan
from tessera.sources import files, paged, published, stored

BOTH = relational.QUERIES | scalar.QUERIES | signals.QUERIES | money.QUERIES | texts.QUERIES | vectors.QUERIES


def _duck(sql: str) -> str:
    return sql.replace(" AS STRING)", " AS VARCHAR)")


def queries():
    from tessera.functions import fit, training
    from tessera.operators import agent, routes
    from tessera.streaming import delivery, folds, keyed

    return {name: plan(q) for name, q in BOTH.items()} | scalar.PLANS | phrases.PLANS | near.PLANS | temporal.PLANS | sketches.PLANS | vectors.PLANS | folds.PLANS | keyed.PLANS | delivery.PLANS | training.PLANS | fit.PLANS | published.PLANS | files.PLANS | stored.PLANS | paged.PLANS | agent.PLANS | routes.PLANS


def oracle_sql():
    from tessera.functions import fit
    from tessera.operators import agent, routes
    from tessera.streaming import delivery, folds, keyed

    return {name: _duck(q(DUCK)) for name, q in (BOTH | published.ORACLES | files.ORACLES | stored.ORACLES | paged.ORACLES | folds.ORACLES | keyed.ORACLES | delivery.ORACLES | fit.ORACLES | agent.ORACLES | routes.ORACLES | texts.ORACLES | phrases.ORACLES | near.ORACLES | temporal.ORACLES | sketches.ORACLES | scalar.ORACLES | vectors.ORACLES).items()}
