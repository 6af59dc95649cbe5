"""What the corpus operators share: the shared folder, written tables, byte tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes A-Z to a-z, all else as it is: never touches a byte of a longer UTF-8 sequence.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Besides, every ASCII byte that is neither a letter nor a digit becomes a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_written: list[tuple[object, object]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, local mode) one of our own."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    forget_at_exit(spark, own)
    return own


def forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_forget_all)
    _written.append((spark, path))


def _forget_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone by now, and the cluster's folder outlives us
            return


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, reread: lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a maker of functions on one batch; make runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return run


def mapped(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], *added: StructField) -> DataFrame:
    """per_batch over all columns of docs, whatever their names, by position; what comes back are docs' columns and the added ones."""
    fields = [*docs.schema.fields, *added]
    names = [f"c{k}" for k in range(len(fields))]

    def named():
        one = make()
        return lambda batch: pa.RecordBatch.from_arrays(one(batch).columns, names)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    return docs.toDF(*names[: len(docs.columns)]).mapInArrow(per_batch(named), schema).toDF(*(f.name for f in fields))
