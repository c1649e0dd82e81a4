"""Tables that a job writes to cut its lineage, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: As in the contract: space and U+0009..U+000D separate words.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Text whose hashes one range takes: some 48 MB of postings, ten times that while they are sorted.
BUCKET_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, safe if executors go.

    narrow: rows of a few numbers, for which an eighth of the usual partitions do.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(4, n_partitions(spark) // 8))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets_for(texts: DataFrame) -> int:
    """Hash ranges for the words of column text: twice the shuffle partitions, and more where a range would hold the words
    of over BUCKET_BYTES of text, so that what a Python worker holds at once does not grow with the corpus."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * n_partitions(texts.sparkSession), -(-size // BUCKET_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: str | Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WORD_GAP), "")
