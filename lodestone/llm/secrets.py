"""Secret scans: fixed patterns, and a battery of randomness tests under length-aware false-discovery control.

Everything is DataFrame expressions; spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Kind, pattern, and the least length of the whole match (of group 2 for assign). Spans list in this order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)]
#: The same matches as the patterns above that are long enough, found without stopping at every short run.
QUICK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Candidates for the battery: whole runs of 20 or more encoding characters with a digit and a letter.
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings by what the run holds; the first that fits is inferred.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: Share of false discoveries that a stratum (encoding and power of two of the length) may have; p-value bins of its histogram.
FALSE_SHARE, P_BINS = 0.1, 50
#: Random tokens, and others, that a stratum is given beside its own.
PRIOR = 2.0


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """array<struct<kind, at, gap, found>>: the pattern's matches and how many code points stand before each since the last."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(found.alias("found"), gaps.alias("gap")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("gap"), x["found"].alias("found")))
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x["found"].isNotNull()))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _id, kind, start, end, found: a row per match long enough, and one with null kind per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_matches(F.col("_t"), k, QUICK.get(name, pattern)) for k, (name, pattern, _) in enumerate(KINDS)] + [_matches(F.col("_t"), len(KINDS), RANDOM)]
    empty = F.expr("CAST(array() AS array<struct<kind: int, at: int, gap: int, found: string>>)")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_t"))
    none = F.expr("array(CAST(struct(NULL, 0, 0, NULL) AS struct<kind: int, at: int, gap: int, found: string>))")
    d = d.select("_row", "_id", F.concat(none, *(F.coalesce(k, empty) for k in kinds)).alias("_m"))
    d = d.select("_row", "_id", F.inline("_m"))
    before = W.partitionBy("_row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).over(before)).withColumn("start", F.col("end") - F.coalesce(F.length("found"), F.lit(0)))
    size = F.when(F.col("kind") == 0, F.length(F.regexp_extract("found", ASSIGN, 2))).otherwise(F.length("found"))
    least = F.when(F.col("kind") == 0, KINDS[0][2]).when(F.col("kind") == 1, KINDS[1][2]).when(F.col("kind") == 2, KINDS[2][2]).otherwise(20)
    return d.where(F.col("kind").isNull() | (size >= least)).select("_row", "_id", "kind", "start", "end", "found")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, to 0.0002."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def battery(tokens: DataFrame, token_col: str = "found") -> DataFrame:
    """Adds encoding, stratum and p to rows with a token: three tests' smallest p-value, times three (Bonferroni), 1 at most.

    Chi-squared: uniformity over the encoding's alphabet, standardised with the multinomial's exact mean and variance.
    Runs: places above and below the alphabet's middle. Serial correlation: neighbours' places, lag one. A small p
    speaks against randomness. The inferred encoding is the narrowest that holds every character.
    """
    body = F.rtrim(F.col(token_col), F.lit("="))
    enc, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, chars in reversed(ENCODINGS[:-1]):
        fits = F.col(token_col).rlike(pattern)
        enc, alphabet = F.when(fits, F.lit(name)).otherwise(enc), F.when(fits, F.lit(chars)).otherwise(alphabet)
    t = tokens.withColumn("encoding", enc).withColumn("_abc", alphabet).withColumn("_chars", F.split(body, ""))
    t = t.withColumn("_x", F.expr("transform(_chars, c -> CAST(instr(_abc, c) - 1 AS DOUBLE))")).withColumn("_n", F.size("_x").cast("double")).withColumn("_k", F.length("_abc").cast("double"))
    t = t.withColumn("_sq", F.expr("aggregate(sequence(0, CAST(_k AS INT) - 1), 0D, (a, j) -> a + power(CAST(size(filter(_x, v -> v = j)) AS DOUBLE), 2))"))
    chi = F.col("_k") / F.col("_n") * F.col("_sq") - F.col("_n")
    t = t.withColumn("_z1", (chi - (F.col("_k") - 1)) / F.sqrt(2 * (F.col("_k") - 1) * (1 - 1 / F.col("_n"))))
    t = t.withColumn("_hi", F.expr("transform(_x, v -> CASE WHEN v >= _k / 2 THEN 1D ELSE 0D END)")).withColumn("_n1", F.expr("aggregate(_hi, 0D, (a, v) -> a + v)"))
    t = t.withColumn("_runs", F.expr("1D + aggregate(zip_with(_hi, slice(_hi, 2, size(_hi)), (u, v) -> CASE WHEN v IS NULL OR u = v THEN 0D ELSE 1D END), 0D, (a, v) -> a + v)"))
    t = t.withColumn("_m", F.expr("aggregate(_x, 0D, (a, v) -> a + v) / _n")).withColumn("_v", F.expr("aggregate(_x, 0D, (a, v) -> a + (v - _m) * (v - _m))"))
    t = t.withColumn("_c", F.expr("aggregate(zip_with(_x, slice(_x, 2, size(_x)), (u, v) -> coalesce((u - _m) * (v - _m), 0D)), 0D, (a, v) -> a + v)"))
    both = 2 * F.col("_n1") * (F.col("_n") - F.col("_n1"))
    spread = F.sqrt(both * (both - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1)))
    z2 = F.when((both > F.col("_n")) & (spread > 0), F.abs((F.col("_runs") - 1 - both / F.col("_n")) / spread)).otherwise(F.lit(12.0))
    z3 = F.when(F.col("_v") > 0, F.abs(F.col("_c") / F.col("_v") + 1 / F.col("_n")) * F.sqrt(F.col("_n"))).otherwise(F.lit(12.0))
    p = F.least(F.lit(1.0), 3 * F.least(_upper_tail(F.col("_z1")), 2 * _upper_tail(z2), 2 * _upper_tail(z3)))
    return t.select(*tokens.columns, "encoding", F.floor(F.log2("_n")).cast("int").alias("stratum"), p.alias("p"))


def cut_points(tested: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """encoding, stratum, least_bin: tokens from that p-value bin on are held to be random.

    In a stratum, tokens that are random spread evenly over p (Storey's estimate counts them from the upper half) and
    others crowd near 0, the more so the longer they are. Of the tokens from a bin on, those beyond the random share
    (and beyond its chance spread, the square root of their number) are false discoveries; the lowest of all bins is
    taken whose share of them is at most `false_share`. A stratum borrows half the counts of the next shorter and the
    next longer one of its encoding, and PRIOR tokens of either sort: random ones, and others that thin out by a factor
    of four a bin for 16 characters, and four times that for each doubling. So one token alone is judged by its p, and
    many by each other. Strata are few (encodings times powers of two), so is this table, whatever the corpus.
    """
    histogram = tested.groupBy("encoding", "stratum", F.least(F.floor(F.col("p") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    near = F.inline(F.array(*(F.struct((F.col("stratum") + d).alias("s"), (F.col("n") * w).alias("w")) for d, w in ((0, 1.0), (-1, 0.5), (1, 0.5)))))
    lent = histogram.select("encoding", "bin", near).groupBy("encoding", F.col("s").alias("stratum"), "bin").agg(F.sum("w").alias("w"))
    every = histogram.select("encoding", "stratum").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(P_BINS - 1))))
    by = W.partitionBy("encoding", "stratum")
    h = every.join(lent, ["encoding", "stratum", "bin"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    h = h.withColumn("_even", (2 * F.sum(F.when(F.col("bin") >= P_BINS // 2, F.col("w")).otherwise(0.0)).over(by) + PRIOR) / F.lit(float(P_BINS)))
    h = h.withColumn("_above", F.sum("w").over(by.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)))
    others = PRIOR * F.pow(F.lit(4.0), -F.col("bin") * F.greatest(F.col("stratum") - 3, F.lit(1)))
    false = F.greatest(F.lit(0.0), F.col("_above") - F.col("_even") * (P_BINS - F.col("bin")) - F.sqrt("_above")) + others
    total = F.col("_above") + PRIOR * (1 - F.col("bin") / F.lit(float(P_BINS))) + others
    return h.where(false <= false_share * total).groupBy("encoding", "stratum").agg(F.min("bin").alias("least_bin"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """_row, _id, spans (array of start, kind number, kind, end) per row of `docs`: fixed patterns, and random tokens beside them.

    A random token that overlaps a span of a fixed pattern is not told again. Null text counts as empty; null ids
    stay; repeated rows are scanned each; an empty table gives none; very long texts are scanned whole; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(matches(docs, id_col, text_col), "matches")
    tested = battery(found.where(F.col("kind") == len(KINDS)))
    cut = cut_points(tested, false_share).select(F.col("encoding").alias("_e"), F.col("stratum").alias("_s"), "least_bin")
    random = tested.join(F.broadcast(cut), (F.col("encoding") == F.col("_e")) & (F.col("stratum") == F.col("_s")) & (F.floor(F.col("p") * P_BINS) >= F.col("least_bin")))
    rows = found.where(F.col("kind").isNull() | (F.col("kind") < len(KINDS))).select("_row", "_id", "kind", "start", "end").unionByName(random.select("_row", "_id", "kind", "start", "end"))
    base = F.col("kind") < len(KINDS)
    by = W.partitionBy("_row").orderBy("start", "kind")
    rows = rows.withColumn("_left", F.max(F.when(base, F.col("end"))).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("_right", F.min(F.when(base, F.col("start"))).over(by.rowsBetween(0, W.unboundedFollowing)))
    free = F.coalesce(F.col("_left") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_right") >= F.col("end"), F.lit(True))
    names = F.element_at(F.array(*(F.lit(k) for k, _, _ in KINDS), F.lit("random")), F.col("kind") + 1)
    rows = rows.where(F.col("kind").isNull() | base | free)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", F.col("kind").alias("no"), names.alias("kind"), "end"))
    return rows.groupBy("_row", "_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of `docs` (see scan)."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["no"] == k)).cast("long")
    return scan(docs, id_col, text_col).select(
        F.col("_id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda x: x["no"] < len(KINDS))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), n(3).alias("n_random"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """The rows of `docs`, all columns, with each span that scan() finds replaced by `mark` (overlapping spans by one).

    `chars_col`, where given, then counts the new text. Null text stays null; rows without a span stay as they are; an
    empty table gives none; other columns pass through, whatever their names; very long texts are scanned whole.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), h.alias("h")).alias("k"), F.col(text_col).alias("text"))
    found = scan(keyed, "k", "text", false_share).where(F.size("spans") > 0)
    found = found.groupBy(F.col("_id.i").alias("_i"), F.col("_id.h").alias("_h")).agg(F.first("spans").alias("_spans"))
    # the rows go along as one struct, so that none of their names meets these
    met = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), h.alias("_text_h"))
    met = met.join(found, F.col("_own").eqNullSafe(F.col("_i")) & (F.col("_text_h") == F.col("_h")), "left").withColumn("_text", F.col("_row")[text_col])
    fold = f"""aggregate(_spans, struct(0 AS at, array('') AS parts),
        (a, x) -> CASE WHEN x.start >= a.at THEN struct(CAST(x.end AS INT) AS at, concat(a.parts, array(substring(_text, a.at + 1, CAST(x.start AS INT) - a.at), '{mark}')) AS parts)
                       ELSE struct(CAST(greatest(a.at, x.end) AS INT) AS at, a.parts AS parts) END,
        a -> array_join(a.parts, '') || substring(_text, a.at + 1))"""
    met = met.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.expr(fold)))
    own = lambda c: F.col("_row")[c]
    chars = F.when(F.col("_spans").isNull(), own(chars_col)).otherwise(F.length("_new").cast(docs.schema[chars_col].dataType)) if chars_col else None
    return met.select(*(F.col("_new").alias(c) if c == text_col else chars.alias(c) if c == chars_col else own(c).alias(c) for c in docs.columns))
