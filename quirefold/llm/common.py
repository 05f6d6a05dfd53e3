"""What the operators share: reading tables, folds by checksum, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts are large, so batches are short.
BATCH_ROWS = 1000
#: And its bytes, unless one text is longer.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of a few small files is dealt out to the cores."""
    from quirefold.sources import readers  # not in workers, which import this module too

    return readers.parquet(spark, f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds Arrow batches by rows and by bytes, unless the session was given bounds of its own. Spark reads these when a
    plan is run, so they belong to the session."""
    for name, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.sparkContext.getConf().get(key, None) is None:
            spark.conf.set(key, str(bound))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast, under fixed names: other columns cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where the session names none and all of it runs
    in one process, as in tests; elsewhere each executor would write to a disk of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else "")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quirefold-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for frame in frames:
        spark, path = frame.sparkSession, frame._written_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
