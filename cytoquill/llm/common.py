"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cytoquill.sources.tables import own_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: Spark's 64 MB would stand in the executor and in the worker several times over.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with small batches; the session's limit is lowered if it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "64m").lower().removesuffix("b").replace("m", "000000").replace("k", "000").replace("g", "000000000")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, idle, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU allocator keeps so much and can be told
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, at_end: Callable[[], None] | None = None, most: int = 1 << 20) -> DataFrame:
    """Run ``fn`` over Arrow batches as dicts of Python lists; ``fn`` returns columns of ``schema``; ``at_end`` runs after the last.

    Long batches are cut by bytes as well as by rows, so that a batch of very long texts
    never stands in memory as Python objects at once.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most):
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)
        if at_end is not None:
            at_end()

    return map_batches(df, run, schema)


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes each, one row at least."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        at = own_folder(spark)
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage; a lost executor costs only the unfinished tasks of later stages.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cytoquill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more; other tables are left alone."""
    for df in tables:
        if at := getattr(df, "written_at", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
