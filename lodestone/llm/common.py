"""Helpers that the corpus operators share: sized broadcasts, words, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.tables import Scratch, shared_dir  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a side that may be broadcast at most; every broadcast here has rows of a bounded width.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has `rows` rows at most; else Spark shuffles (and splits skewed keys).

    Give it a table that is cheap to count, such as a written one.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
