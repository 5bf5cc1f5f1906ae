"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: What ``bytes.split`` with no argument splits at is the same set.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(text, F.lit(""))


#: Rows that go to Python at a time: texts may be long.
ROWS_A_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Have the session pass texts to Python in batches of so few rows that their texts fit a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS_A_BATCH or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, ROWS_A_BATCH)


def words(text: Column) -> Column:
    """Array of the words of a text; of a null none."""
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of checkpoints. Where none is set, one is made on a single machine, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-"))
    return folder or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder all executors share; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to a new folder within the shared one, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_by(df: DataFrame, name: str, by: str) -> DataFrame:
    """As ``stored``, in parts by a column of few values, so that a filter on it reads its parts only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table whose rows hold a few numbers is broadcast up to so many rows, counted first; a larger one is joined by a shuffle.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A checkpointed table, marked for broadcast if its rows (or the sum of their weights) are few enough."""
    df = checkpointed(df)
    n = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= MOST_BROADCAST else df
