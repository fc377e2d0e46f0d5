"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow task function handles at a time, whatever Spark hands over.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or our own where it is unset (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None:
        have = sc._jsc.sc().getCheckpointDir()
        where = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="quillstone-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Cuts the lineage by writing Parquet under the shared folder; :func:`forget` deletes it."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.stashed_at = where
    return out


def forget(*stashed: DataFrame) -> None:
    """Deletes what :func:`stash` has written for frames that nothing reads any more."""
    for df in stashed:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hide(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1 and so on, and these names by the old ones: no name of ours clashes then."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def hide_but(docs: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """The same for all columns but ``kept``, which keep their names."""
    names = {c: c if c in kept else f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that memory doesn't follow Arrow's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Returns what a worker has freed to the system: workers outlive their tasks, and would keep it while they wait."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = SLICE_ROWS, lean: bool = False) -> DataFrame:
    """mapInArrow with a function of one slice; ``make`` is called once a task and returns that function.

    The function takes a RecordBatch and returns a dict of columns (or None for no rows) by the names in ``schema``.
    With ``lean`` a worker gives memory back when its task ends.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        step = make()
        for b in slices(batches, rows):
            got = step(b)
            if got is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t, from_pandas=True) for c, t in ((got[f.name], f.type) for f in arrow)],
                    schema=arrow,
                )
        if lean:
            give_back()

    return df.mapInArrow(run, out)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hold(df: DataFrame, left: str, mod: int) -> F.Column:
    """crc32 of an id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(df[left].cast("string"), F.lit("")).cast("binary")) % mod
