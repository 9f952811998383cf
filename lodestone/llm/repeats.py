"""Substring dedup: word k-mers as De Bruijn edges, sampled by minimizers, compacted into spans with source coordinates.

1. Edges: of the 16-word k-mers of each 50-word window the least hash is kept, so every repeated window has an edge
   that its copies keep too, and one k-mer in eighteen is kept. Edges that stand in one text alone end there.
2. Windows over a repeated edge are grouped by their hash; each gets the coordinates (least id, place) of its first
   document. Runs of neighbouring windows whose sources are neighbours as well are nonbranching paths: where the next
   window's source is not the next one, a path ends, and each path compacts into one span.
3. The words at a span's own and at its source's coordinates are compared, by 128-bit digests of the words themselves:
   what 64-bit hashes took for equal and isn't is grouped again by such digests of its windows.
4. Spans whose source is another document are what repeats. Their words are taken out.
Copies of whole texts, told by 128-bit digests, are one text throughout; all but those with the least id are one span each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import bloom, textvec
from lodestone.llm.common import Scratch

#: Words of a window and of an edge.
WINDOW, EDGE = 50, 16
#: Bits of a window's hash, and spans that one row asks a text for.
HASH_BITS, ASKS = 64, 1000
#: Repeated edges that a Bloom filter tells well from others; with more, texts are moved to their edges.
FILTER_EDGES = bloom.MOST_BITS // 16


def _words(text: bytes) -> bytes:
    return b" ".join(text.split())


def _texts(data, bounds, salt: int = 0):
    """Each row's words joined by a space, the 16-byte digest of that, and the long that names the text (see _numbered)."""
    raw = data.tobytes()
    joined = [_words(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    digests = [hashlib.blake2b(w, digest_size=16).digest() for w in joined]
    names = digests if not salt else [hashlib.blake2b(d, digest_size=8, salt=salt.to_bytes(4, "little")).digest() for d in digests]
    return joined, digests, np.frombuffer(b"".join(d[:8] for d in names), "<i8")


def _windows(data, bounds, window: int, edge: int, mask: int):
    """Row, first word in the row, least edge and hash of each window."""
    _, _, row, h = textvec.words(data, bounds)
    n = np.bincount(row, minlength=len(bounds) - 1)
    at, g = textvec.ngrams(row, h, window)
    if not len(at):
        return n, at, at, g, g
    g = g & np.uint64(mask)
    _, edges = textvec.ngrams(np.zeros(len(h), np.int64), h, edge)  # across rows too: windows look at those inside them
    least = textvec.sliding_min(edges, window - edge + 1)[at]
    first = np.r_[0, np.cumsum(n)]
    return n, row[at], at - first[row[at]], least, g


def _sampled(window: int, edge: int, salt: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, sums, sizes, edges = [], [], [], []
            for _, data, bounds in textvec.blocks(batch.column(1)):
                _, digests, text = _texts(data, bounds, salt)
                sums += digests
                n, row, _, least, _ = _windows(data, bounds, window, edge, mask)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                row, least = row[new], least[new]
                start = np.searchsorted(row, np.arange(len(bounds)))
                keys.append(text)
                sizes.append(n)
                for i, key in enumerate(text.tolist()):
                    edges.append(None if key in seen or start[i] == start[i + 1] else np.unique(least[start[i] : start[i + 1]]).view(np.int64))
                    seen.add(key)
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat(keys), pa.int64()), pa.array(sums, pa.binary()), pa.array(flat(sizes), pa.int64()), pa.array(edges, pa.list_(pa.int64()))], names=["_id", "text", "digest", "n", "edges"])

    return run


def _suspects(window: int, edge: int, salt: int, mask: int, repeated, told=None):
    """_id, text, at, window: the windows over an edge that may be repeated (in the filter, or, without one, among the row's
    edges); of them, where told is given, those whose hash is among it, with the digest of their words in place of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in textvec.blocks(batch.column(1)):
                joined, _, text = _texts(data, bounds, salt)
                _, row, at, least, g = _windows(data, bounds, window, edge, mask)
                ok = bloom.holds(repeated.value, least) if repeated is not None else _among(row, least, batch.column(2).slice(first, len(bounds) - 1))
                if told is not None:
                    ok &= bloom.holds(told.value, textvec.mix(g))
                row, at, g = row[ok], at[ok], g[ok]
                for a in range(0, len(row), 1 << 18):
                    part = slice(a, a + (1 << 18))
                    keys = pa.array(g[part].view(np.int64), pa.int64()) if told is None else pa.array(_window_digests(joined, row[part], at[part], window), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[part])), pa.array(text[row[part]], pa.int64()), pa.array(at[part], pa.int32()), keys], names=["_id", "text", "at", "window"])

    return run


def _among(row: np.ndarray, edges: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which edges are in their row's list."""
    starts = np.searchsorted(row, np.arange(len(lists) + 1))
    ok = np.zeros(len(row), bool)
    for i, held in enumerate(lists):
        a, b = starts[i], starts[i + 1]
        if b > a and held.is_valid:
            ok[a:b] = np.isin(edges[a:b], held.values.to_numpy().view(np.uint64))
    return ok


def _named(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in textvec.blocks(batch.column(1)):
                joined, _, text = _texts(data, bounds, salt)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(joined)), pa.array([w.decode() for w in joined], pa.string()), pa.array(text, pa.int64())], names=["_id", "words", "text"])

    return run


def _window_digests(joined: list[bytes], rows: np.ndarray, at: np.ndarray, window: int) -> list[bytes]:
    out, held, words = [], -1, []
    for row, a in zip(rows.tolist(), at.tolist()):
        if row != held:
            held, words = row, joined[row].split(b" ")
        out.append(hashlib.blake2b(b" ".join(words[a : a + window]), digest_size=16).digest())
    return out


def _plain(spotted, salt: int):
    """Rows that no span touches are finished where they are read; the others, and those that spans point to, take their words along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sums, texts = [], [], [], []
            for _, data, bounds in textvec.blocks(batch.column(1)):
                joined, _, text = _texts(data, bounds, salt)
                hit = bloom.holds(spotted.value, textvec.mix(text.view(np.uint64)))
                for w, key, h in zip(joined, text.tolist(), hit):
                    keys.append(key)
                    sizes.append(w.count(b" ") + 1 if w else 0)
                    sums.append(None if h else hashlib.sha256(w).hexdigest())
                    texts.append(w.decode() if h else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["_id", "text", "n", "sum", "words"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, start, end, digest of the words there, for rows (text, words, asks)."""
    for batch in batches:
        out: list[tuple] = []
        for text, words, asks in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "asks"))):
            words = words.encode().split(b" ")
            out += [(text, x["start"], x["end"], hashlib.blake2b(b" ".join(words[x["start"] : x["end"]]), digest_size=16).digest()) for x in asks]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["text", "start", "end", "digest"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for n, done, text, spans in zip(*(batch.column(c).to_pylist() for c in ("n", "sum", "words", "spans"))):
            if text is None:
                removed.append(0)
                kept.append(done)
                continue
            words, out, at, gone = text.split(" ") if text else [], [], 0, 0
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                if b > at:
                    out += words[at:a]
                    gone += b - max(a, at)
                    at = b
            removed.append(gone)
            kept.append(hashlib.sha256(" ".join(out + words[at:]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["_id", "n_words", "n_removed", "kept_sha256"])


def _numbered(known: DataFrame, scratch: Scratch, kind: str, window: int, edge: int, mask: int) -> tuple[DataFrame, int]:
    """(_id, text, digest, n, edges per row, salt). A text is named by eight bytes of its digest; should two texts meet in
    them, by eight others, made with the next salt."""
    salt = 0
    while True:
        rows = scratch.write(known.mapInArrow(_sampled(window, edge, salt, mask), f"_id {kind}, text long, digest binary, n long, edges array<long>"), "edges")
        if not rows.groupBy("text").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").limit(1).count():
            return rows, salt
        scratch.drop(rows)
        salt += 1


def _paths(suspects: DataFrame, scratch: Scratch) -> DataFrame:
    """_id, text, at, window, source_id, source_text, source_start, _path: windows that a lesser id holds too, numbered by path."""
    source = suspects.groupBy("window").agg(F.min("_id").alias("source_id"), F.max("_id").alias("_last"), F.count_if(F.col("_id").isNull()).alias("_none"))
    source = source.where("source_id < _last OR (_none > 0 AND source_id IS NOT NULL)").select("window", "source_id")
    # written, so that the joins' sides are plain exchanges and Spark can split a window that very many documents hold
    dup = scratch.write(suspects.join(scratch.write(source, "sources"), "window"), "repeats")
    places = dup.where("_id = source_id").groupBy("window").agg(F.min(F.struct("at", "text")).alias("p"))
    places = scratch.write(places.select("window", F.col("p.at").alias("source_start"), F.col("p.text").alias("source_text")), "places")
    dup = dup.where("_id > source_id OR _id IS NULL").join(places, "window")
    # a place names its window, so its hash is no key here: rows are dealt anew, and the join before may split a hot window
    dup = dup.select("_id", "text", "at", "window", "source_id", "source_text", "source_start").dropDuplicates(["_id", "text", "at"])
    # nonbranching: the next window of the text follows the same source; paths end where it doesn't
    by = W.partitionBy("_id", "text").orderBy("at")
    same = (F.lag("source_id").over(by) == F.col("source_id")) & (F.lag("source_text").over(by) == F.col("source_text"))
    follows = (F.lag("at").over(by) == F.col("at") - 1) & same & (F.lag("source_start").over(by) == F.col("source_start") - 1)
    return dup.withColumn("_path", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))


def _compacted(paths: DataFrame, window: int) -> DataFrame:
    spans = paths.groupBy("_id", "text", "_path").agg(F.min("at").alias("start"), (F.max("at") + window).alias("end"), F.first("source_id").alias("source_id"), F.first("source_text").alias("source_text"), F.min("source_start").alias("source_start"))
    return spans.select("_id", "text", "_path", "start", "end", "source_id", "source_text", "source_start")


def _differing(spans: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """_id, text, _path of the spans whose words are not those at their source's coordinates."""
    asks = spans.select("text", "start", "end").unionByName(spans.select(F.col("source_text").alias("text"), F.col("source_start").alias("start"), (F.col("source_start") + F.col("end") - F.col("start")).alias("end")))
    asks = scratch.write(asks.distinct(), "asks")
    parts = asks.groupBy("text").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))  # a text that very many spans point to is asked by several rows
    asks = asks.join(parts, "text").groupBy("text", F.pmod(F.xxhash64("start", "end"), F.col("parts")).alias("p")).agg(F.collect_list(F.struct("start", "end")).alias("asks"))
    words = rows.where("words IS NOT NULL").select("text", "words").dropDuplicates(["text"])
    told = words.join(asks, "text").select("text", "words", "asks").mapInArrow(_answers, "text long, start int, end int, digest binary")
    told = scratch.write(told, "answers")
    there = told.select(F.col("text").alias("source_text"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.col("digest").alias("there"))
    met = spans.withColumn("source_end", F.col("source_start") + F.col("end") - F.col("start")).join(told, ["text", "start", "end"]).join(there, ["source_text", "source_start", "source_end"])
    return met.where("digest <> there").select("_id", "text", "_path")


def _spread(df: DataFrame, col: str) -> np.ndarray:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(textvec.mix(x).view(np.int64), pa.int64())], names=["key"])

    return bloom.build(df.select(col).mapInArrow(spread, "key long"), "key")


def _found(docs: DataFrame, id_col: str, text_col: str, window: int, edge: int) -> tuple[DataFrame, DataFrame]:
    """(spans, rows): spans as in repeated_spans, rows (_id, text, n, sum, words) as in _plain."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    mask = (1 << HASH_BITS) - 1
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.select(F.col(id_col).alias("_id"), text_col)
    rows, salt = _numbered(known, scratch, kind, window, edge, mask)
    edges = rows.where("edges IS NOT NULL").select("text", F.explode("edges").alias("edge"))
    twice = edges.groupBy("edge").agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x < y").select("edge")
    twice = scratch.write(twice, "repeated")
    few = twice.count() <= FILTER_EDGES
    repeated = spark.sparkContext.broadcast(bloom.build(twice, "edge")) if few else None

    ids = rows.where("n > 0").groupBy("text").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    copies = scratch.write(ids.where("first < last").select("text", "first"), "copies")
    whole = rows.where(F.col("n") >= window).select("_id", "text", "n").join(copies, "text").where("_id > first OR _id IS NULL")
    whole = whole.select("_id", "text", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.col("first").alias("source_id"), F.lit(0).alias("source_start"))

    suspected = known
    if not few:  # more than a filter holds: texts meet their own repeated edges in a shuffled join instead
        held = edges.join(twice, "edge").groupBy("text").agg(F.collect_list("edge").alias("edges"))
        named = known.mapInArrow(_named(salt), f"_id {kind}, words string, text long")
        suspected = named.join(scratch.write(held, "held"), "text").select("_id", "words", "edges")

    def suspects(told=None) -> DataFrame:
        found = suspected.mapInArrow(_suspects(window, edge, salt, mask, repeated, told), f"_id {kind}, text long, at int, window {'long' if told is None else 'binary'}")
        return scratch.write(found.join(copies.withColumnRenamed("text", "t"), F.col("text") == F.col("t"), "left").where("first IS NULL OR _id = first").drop("t", "first"), "windows")

    paths = _paths(suspects(), scratch)
    spans = scratch.write(_compacted(paths, window), "spans")
    # the filter goes by text: copies with the least id pass in vain and lose nothing
    touched = scratch.write(spans.select("text").union(spans.select("source_text")).union(whole.select("text")).distinct(), "touched")
    plain = known.mapInArrow(_plain(spark.sparkContext.broadcast(_spread(touched, "text")), salt), f"_id {kind}, text long, n long, sum string, words string")
    plain = scratch.write(plain, "plain")
    wrong = scratch.write(_differing(spans, plain, scratch), "differing")
    if wrong.limit(1).count():
        same = F.col("_id").eqNullSafe(F.col("w._id")) & (F.col("text") == F.col("w.text")) & (F.col("_path") == F.col("w._path"))
        wrong = wrong.select(F.struct("*").alias("w"))
        hashes = scratch.write(paths.join(wrong, same, "left_semi").select("window").distinct(), "unsure")
        told = spark.sparkContext.broadcast(_spread(hashes, "window"))
        again = _compacted(_paths(suspects(told), scratch), window)
        spans = spans.join(wrong, same, "left_anti").unionByName(again)
    return spans.select("_id", "text", "start", "end", "source_id", "source_start").unionByName(whole), plain


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """_id, text (a hash of the words), start, end, source_id, source_start: spans of words, end exclusive, that repeat
    a document with a smaller id. A word is covered by one of them exactly if it is in a window that starts there too."""
    return _found(docs, id_col, text_col, window, edge)[0]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs`.

    Null text has no words. Documents of fewer than `window` words lose none. Rows with equal ids do not repeat each
    other; null ids come after all others, and rows of null id do not repeat each other either. An empty table gives
    no rows; very long texts are read whole; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans, rows = _found(docs, id_col, text_col, window, edge)
    each = spans.groupBy(F.col("_id").alias("_i"), F.col("text").alias("_t")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = rows.join(each, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("text") == F.col("_t")), "left").select("_id", "n", "sum", "words", "spans")
    return met.mapInArrow(_cut, f"_id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("_id", id_col)
