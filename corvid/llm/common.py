"""Small helpers shared by the corpus operators: shared-folder tables, bounded
Arrow batches, text columns and word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import scratch_dir

#: Rows that go to a Python worker at once.  Texts can be long, so a batch is
#: kept to a few hundred of them.
BATCH_ROWS = 400

#: Rule of the contracts: a word is a run of anything but these six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches of text small in this session (never raises the
    session's own setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut
    there and a lost executor costs nothing that was written."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(col: str | Column) -> Column:
    """A text column where null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids: null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def byte_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text: ``bytes.split()`` splits at exactly the six
    characters of WORD_GAP."""
    return text.encode("utf-8").split() if text else []
