"""Folders and line files: what is there, what it is, and its text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TYPES = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text"}


def suffix(path):
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def source_type(path):
    """The kind of a file by its suffix; fails at run time on one that isn't supported."""
    known = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    kind = F.try_element_at(known, suffix(path))
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported file type; supported: " + ", ".join(sorted(TYPES)) + ": "), path)))


def below(path, folder: str):
    """A file's path within a folder."""
    bare = F.regexp_replace(path, "^[a-z]+:", "")
    top = folder.split(":", 1)[-1].rstrip("/").replace("//", "/")
    return F.regexp_replace(bare, "^/*" + re.escape(top.strip("/")) + "/", "")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_type, content, content_hash of supported files below a folder; hidden folders and files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    shown = files.withColumn("_rel", below(F.col("path"), folder)).where(~F.col("_rel").rlike(r"(^|/)\.") & suffix(F.col("path")).isin(list(TYPES)))
    return shown.select("path", source_type(F.col("path")).alias("source_type"), "content", F.sha2("content", 256).alias("content_hash"))


@F.pandas_udf(StringType())
def _western(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else b.decode("cp1252", errors="replace"))


def decoded(content):
    """UTF-8 without its mark, or Windows-1252 where it is no UTF-8."""
    c = F.col(content)
    text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(_western(c))
    return F.regexp_replace(text, "^﻿", "")


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One object a line; fails at run time on a line that is none, or on a key that stands twice."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    counted = df.withColumn("_n", F.count("*").over(W.partitionBy(key)))
    once = F.assert_true(F.col("_n") == 1, F.concat(F.lit("key stands twice: "), F.col(key).cast("string")))
    return counted.where(once.isNull()).drop("_n")
