"""Bounded parallel calls of a service from tasks.

Defined cases: a call that takes longer than its time is given up (its thread may go on, its slot is counted until it
ends); a call that fails is a row with the failure's name, never a failed job; an empty table makes no call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame


def bounded_calls(rows: DataFrame, call: Callable[[dict], str | None], key: str, slots: int = 4, seconds: float = 10.0) -> DataFrame:
    """key, status (ok, timeout, failed), answer: call(row) for each row, at most ``slots`` at once a task, each waited for ``seconds`` at most."""
    kind = dict(rows.dtypes)[key]

    def one(row: dict) -> tuple[str, str | None]:
        try:
            return "ok", call(row)
        except TimeoutError:
            return "timeout", None
        except Exception as e:  # whatever a service throws is a row
            return "failed", type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(slots)
        try:
            for batch in batches:
                given = batch.to_pylist()
                out: list[tuple[str, str | None]] = []
                for at in range(0, len(given), slots):
                    waiting = [pool.submit(one, r) for r in given[at : at + slots]]
                    for w in waiting:
                        try:
                            out.append(w.result(timeout=seconds))
                        except Late:
                            w.cancel()
                            out.append(("timeout", None))
                keys = batch.column(batch.schema.get_field_index(key))
                yield pa.RecordBatch.from_arrays([keys, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], [key, "status", "answer"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return rows.mapInArrow(run, f"{key} {kind}, status string, answer string")
