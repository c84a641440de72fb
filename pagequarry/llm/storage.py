"""Tables in the folder that driver and executors share.

``materialize`` cuts a plan's lineage by writing it once as Parquet below
``spark.checkpoint.dir``.  Unlike a local checkpoint the files outlive any
executor.  The setting is read from the session; only where it is unset, and
only on a local master (tests), a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/pagequarry-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows at most while a table is written, for rows hold whole texts and both sides of the
    pipe to Python hold a batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(setting)
    if 0 < int(had) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(setting, had)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` or ``bucketed`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str, ordered: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder in buckets of ``key`` and read it back: joining or grouping by ``key``
    moves none of its rows.  ``ordered``: each bucket is one file, sorted by ``key``."""
    spark = df.sparkSession
    path, count = new_path(spark, name), partitions(spark)
    called = f"pagequarry_{uuid.uuid4().hex}"
    writer = (df.repartition(count, key) if ordered else df).write.bucketBy(count, key).format("parquet").option("path", path)
    with small_batches(spark):
        (writer.sortBy(key) if ordered else writer).saveAsTable(called)
    out = spark.table(called)
    spark.sql(f"DROP TABLE {called}")  # from the catalog; the files stay
    out.stored_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def stripped(col):
    return F.btrim(col, F.lit(SPACES))


def space_words(col):
    """Runs of other than ASCII white space, as an array; null gives none."""
    bare = stripped(F.coalesce(col, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def slices(batches, rows: int = 500):
    """Arrow batches of at most ``rows`` rows, so that a worker holds few texts twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8_rows(batch, column: str = "text"):
    """The UTF-8 bytes of a string column of an Arrow batch; null gives b''."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    return [v if v is not None else b"" for v in col.cast(pa.binary()).to_pylist()]


def lean(run):
    """``run`` (an iterator of batches to one of batches), giving freed memory back to the system when a task ends, so
    that idle Python workers stay small."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied
