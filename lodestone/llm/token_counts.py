"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import Scratch

#: Most frequent pre-tokens whose counts every task gets (262,144 of 64 characters at most: 70 MB at the very most, 5 MB in practice).
HEAD_ENTRIES, HEAD_CHARS = 1 << 18, 64
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 300_000


def _vocabulary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = bpe.load(path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "uses"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(tok.split(text)[0])
                    if len(seen) >= HELD:
                        yield flush()
        if seen:
            yield flush()

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        for batch in batches:
            pieces = batch.column("piece")
            counts = tok.n_pieces(pieces.to_pylist())
            yield pa.RecordBatch.from_arrays([pieces, batch.column("uses"), pa.array(counts, pa.int64())], names=["piece", "uses", "n"])

    return run


def _frequencies(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = bpe.load(path), head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, sums, keys, uses = [], [], [], []
            for text in batch.column(1).to_pylist():
                pieces, total = tok.split(text) if text else ((), 0)
                rare: dict[str, int] = {}
                for piece, n in Counter(pieces).items():
                    if (k := known.get(piece)) is None:
                        rare[piece] = n
                    else:
                        total += k * n
                # a digit after U+0000 is never one pre-token, so this key meets nothing and falls anywhere
                keys.append(list(rare) or [f"\x00{row}"])
                uses.append(list(rare.values()) or [0])
                rows.append(row)
                sums.append(total)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(2), pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(uses, pa.list_(pa.int64()))],
                names=["_row", "_id", "_bytes", "_sum", "_keys", "_uses"],
            )

    return run


def piece_table(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """piece, uses, n: every distinct pre-token of the corpus, how often it stands there, its number of tokens."""
    seen = docs.select(text_col).mapInArrow(_vocabulary(path), "piece string, uses long")
    return seen.groupBy("piece").agg(F.sum("uses").alias("uses")).mapInArrow(_count(path), "piece string, uses long, n long")


def _head(pieces: DataFrame) -> dict[str, int]:
    """The counts of the most frequent pre-tokens: all above a frequency that leaves HEAD_ENTRIES of them at most."""
    sized = pieces.where(F.length("piece") <= HEAD_CHARS).withColumn("bin", F.floor(F.log2("uses") * 8).cast("int"))
    room, least = HEAD_ENTRIES, None
    for r in sorted(sized.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # 500 bins at the very most
        room -= r["count"]
        if room < 0:
            break
        least = r["bin"]
    if least is None:
        return {}
    return {r.piece: r.n for r in sized.where(F.col("bin") >= least).select("piece", "n").collect()}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`, over whole texts.

    Each distinct pre-token of the corpus is tokenised once. The most frequent ones (a bounded table) are looked up
    where the text is read; each document's other pre-tokens meet the table in a shuffled join, and their counts sum
    up by row. No ids are kept. Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    give one row each; an empty table gives none; other columns are ignored, whatever their names.
    """
    spark, path = docs.sparkSession, path or bpe.default_path()
    scratch = Scratch(spark)
    pieces = scratch.write(piece_table(docs, text_col, path), "pieces")
    head = spark.sparkContext.broadcast(_head(pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    each = source.mapInArrow(_frequencies(path, head), f"_row long, _id {kind}, _bytes long, _sum long, _keys array<string>, _uses array<long>")
    long = each.select("_row", "_id", "_bytes", "_sum", F.posexplode(F.arrays_zip("_keys", "_uses")).alias("_at", "_rare"))
    long = long.select("_row", "_id", "_bytes", F.when(F.col("_at") == 0, F.col("_sum")).otherwise(0).alias("_sum"), F.col("_rare._keys").alias("piece"), F.col("_rare._uses").alias("_n"))
    met = long.join(pieces.select("piece", "n").hint("merge"), "piece", "left")
    total = F.sum(F.col("_sum") + F.col("_n") * F.coalesce("n", F.lit(0)))
    out = met.groupBy("_row", "_id", "_bytes").agg(total.alias("n_tokens"))
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
