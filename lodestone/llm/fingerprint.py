"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame expressions only.

A document's vector is the sum of its paragraphs' vectors. A paragraph's is SUMS 32-bit hashes of it, added modulo
2^32, and one-bit counters, added modulo 2^20, of the hashes of its pieces (what stands between punctuation, 120 code
points at most), LANES of 63 bits with three counters each. So the order of paragraphs does not count, paragraphs come
and go by adding and subtracting vectors, equal multisets have equal vectors, and the counters tell how alike two are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: 32-bit sums; hashes of a piece and shifts of each: 2 * 21 lanes of 3 counters make 126 counters.
SUMS, HASHES, SHIFTS = 16, 2, 21
LANES = HASHES * SHIFTS
#: One bit, the 20 bits and the guard bit of each of a lane's three counters.
ONE = 1 | 1 << 21 | 1 << 42
KEEP, GUARD = ONE * ((1 << 20) - 1), ONE << 20
PIECE = r"[^\n.!?;,|]{1,120}[.!?;,|]*|[.!?;,|]+"


def with_vector(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds `name`, array<long>: LANES lanes, SUMS sums, the number of pieces. Null text counts as empty, which has no paragraph."""
    kept = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p != "")
    d = df.withColumn("_pieces", F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).withColumn("_pars", paragraphs)
    d = d.select(*kept, "_pars", F.size("_pieces").cast("long").alias("_n"), *(F.expr(f"transform(_pieces, p -> xxhash64(p, {k}L))").alias(f"_h{k}") for k in range(HASHES)))
    lanes = [f"aggregate(_h{k}, 0L, (a, x) -> (a + (shiftrightunsigned(x, {j}) & {ONE}L)) & {KEEP}L)" for k in range(HASHES) for j in range(SHIFTS)]
    sums = [f"aggregate(_pars, 0L, (a, p) -> (a + (xxhash64(p, {k}L, 32L) & 4294967295L)) & 4294967295L)" for k in range(SUMS)]
    return d.select(*kept, F.expr(f"array({', '.join(lanes + sums)}, _n)").alias(name))


def plus(a: str, b: str) -> Column:
    """The vector of both documents' paragraphs together."""
    return F.expr(f"transform({a}, (x, i) -> CASE WHEN i < {LANES} THEN (x + {b}[i]) & {KEEP}L WHEN i < {LANES + SUMS} THEN (x + {b}[i]) & 4294967295L ELSE x + {b}[i] END)")


def minus(a: str, b: str) -> Column:
    """The vector of document a without b's paragraphs."""
    return F.expr(f"transform({a}, (x, i) -> CASE WHEN i < {LANES} THEN ((x | {GUARD}L) - {b}[i]) & {KEEP}L WHEN i < {LANES + SUMS} THEN (x - {b}[i]) & 4294967295L ELSE x - {b}[i] END)")


def fingerprint(vector: str) -> Column:
    """The vector as hexadecimal text."""
    return F.expr(f"array_join(transform(slice({vector}, 1, {LANES}), x -> lpad(hex(x), 16, '0')), '') || array_join(transform(slice({vector}, {LANES + 1}, {SUMS}), x -> lpad(hex(x), 8, '0')), '')")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds `name`: 1 for equal vectors, else the cosine of their counters about their means, 0 where that is negative.

    It estimates the share of common pieces, to about 0.09.
    """
    counts = lambda v: f"transform(flatten(transform(slice({v}, 1, {LANES}), x -> array(x & 1048575, shiftright(x, 21) & 1048575, shiftright(x, 42) & 1048575))), c -> 2D * c - {v}[{LANES + SUMS}])"
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> u * v), 0D, (s, t) -> s + t)"
    d = df.withColumn("_ca", F.expr(counts(a))).withColumn("_cb", F.expr(counts(b)))
    d = d.withColumn("_aa", F.expr(dot("_ca", "_ca"))).withColumn("_bb", F.expr(dot("_cb", "_cb"))).withColumn("_ab", F.expr(dot("_ca", "_cb")))
    cosine = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))))).otherwise(F.lit(0.0))
    return d.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine)).drop("_ca", "_cb", "_aa", "_bb", "_ab")


def with_next(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Adds _part and _last to rows, dealt by ranges of ids: each part ends with copies (_last) of the next part's first rows.

    Parts are cut at approximate quantiles, so they are even whatever the ids; null ids come first, in a part of their
    own. The bounds and each part's least id are all that the driver sees: `parts` numbers.
    """
    cuts = sorted(set(docs.approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []

    def place(low: int, high: int) -> Column:
        """1 + how many of cuts[low:high] are below the id, by halving."""
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(F.col(id_col) <= F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    part = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(place(0, len(cuts)))
    d = docs.withColumn("_part", part)
    least = {r["p"]: r["i"] for r in d.groupBy(F.col("_part").alias("p")).agg(F.min(id_col).alias("i")).collect()}
    order = sorted(least)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    kind = docs.schema[id_col].dataType
    of_part = lambda values, to: F.element_at(F.array(*(F.lit(values.get(p)).cast(to) for p in range(len(cuts) + 2))), F.col("_part") + 1)
    first = F.col(id_col).eqNullSafe(of_part(least, kind))
    home = of_part(before, "int")
    own, copy = F.struct(F.col("_part").alias("part"), F.lit(False).alias("last")), F.struct(home.alias("part"), F.lit(True).alias("last"))
    d = d.withColumn("_to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    return d.withColumn("_part", F.col("_to.part")).withColumn("_last", F.col("_to.last")).drop("_to")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`.

    The edited text has its last quarter of code points (floor) replaced by the first as many of the next row's text.
    Rows follow each other by id (numbers), then text; null ids come first; the last is followed by the first, a lone
    row by itself. Null text counts as empty. Repeated rows follow each other. An empty table gives none; other
    columns are ignored. Each row is moved once, to the range of its id.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts = min(4096, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = with_next(d, "_id", parts).repartition("_part")
    d = with_vector(d, "_text", "_v")
    by = W.partitionBy("_part").orderBy("_last", F.col("_id").asc_nulls_first(), "_text")
    d = d.withColumn("_next", F.lead(F.struct("_text", "_v")).over(by)).where("NOT _last")
    n = F.length("_text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - k), F.substring(F.col("_next._text"), F.lit(1), k))
    d = d.select("_id", n.cast("long").alias("n_chars"), "_v", F.col("_next._v").alias("_nv"), edited.alias("_edited"))
    d = with_vector(d.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "_ev")
    d = with_likeness(with_likeness(d, "_v", "_ev", "near_edited"), "_v", "_nv", "near_next")
    return d.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", fingerprint("_v").alias("fingerprint"), fingerprint("_ev").alias("edited_fingerprint"), "near_edited", "near_next")
