"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, n_words, small_side, words

#: Weights by the order of sources (code points, null last), repeating; words taken per 100 words of all documents; most passes over a source.
WEIGHTS, PER_CENT, PASSES = (3, 1, 2), 150, 2
#: Words of a block at most; blocks of a source of mean target at least, so that small inputs are dealt as finely.
BLOCK_WORDS, BLOCKS = 256, 1000
#: Parts into which a source's shuffled documents, and runs of slots, are dealt for running sums: none grows with one hot source.
PARTS, RUN = 1024, 1 << 16
#: Fixed value: the golden ratio's fraction times 2^32. Point t is t * GOLDEN mod 2^32, over 2^32.
GOLDEN = 2654435769


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, per_cent: int = PER_CENT, passes: int = PASSES) -> DataFrame:
    """_source, source_size, target for a table with one row per source. One row per source is all that is ever sorted here.

    Water-filling in closed form: in the order of size over weight, a source is full (passes times its size) exactly
    if that is at most what its share would be once all before it are full.
    """
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("_weight", weight).withColumn("_full", passes * F.col("source_size"))
    first = W.orderBy(F.col("_full") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = (per_cent * F.sum("source_size").over(everything)).cast("double") / 100 - F.coalesce(F.sum("_full").over(first), F.lit(0))
    weights_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(first), F.lit(0))
    s = s.withColumn("_level", left / weights_left)
    share = F.col("_level") * F.col("_weight")
    s = s.withColumn("_is_full", F.col("_full") <= share)
    level = F.min(F.when(~F.col("_is_full"), F.struct((F.col("_full") / F.col("_weight")).alias("o"), F.col("_level").alias("l")))).over(everything)["l"]
    return s.select("_source", "source_size", F.when(F.col("_is_full"), F.col("_full").cast("double")).otherwise(level * F.col("_weight")).alias("target"))


def laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _source, size and the shuffle: _part and _order by a hash of the id, _key a place of its own among equals."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_h"), h.alias("_order"), F.conv(F.substring(h, 1, 8), 16, 10).cast("long").alias("_h")).withColumn("_part", (F.col("_h") % PARTS).cast("int"))


def shuffled(sized: DataFrame) -> DataFrame:
    """Adds _at, where a document starts in its source's shuffled stream of words, and _nth, its row among its part's.

    Running sums run within parts of a source; the parts' own sums are a table of PARTS rows a source.
    """
    sums = sized.groupBy("_source", "_part").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    within = W.partitionBy("_source", "_part").orderBy("_order", F.col("_id").asc_nulls_last(), "size", "_text_h")
    d = sized.withColumn("_nth", F.row_number().over(within)).withColumn("_in", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    met = d.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("_at", F.col("_from") + F.col("_in")).drop("_s", "_p", "_from", "_in", "_order", "_h")


def schedule(goal: DataFrame, block: int, slots: int, cells: int = 4096) -> DataFrame:
    """_source, _rank: the sources' turns. Slot t goes to the source whose share of [0, 1) holds the golden-ratio point t.

    Sources' shares are cut at the bounds of `cells` cells, so that slots meet them in an equi-join on evenly filled
    keys; ranks run within runs of RUN slots, whose counts per source add up before.
    """
    order = W.orderBy(F.col("_source").asc_nulls_last())
    total = F.sum("target").over(W.partitionBy())
    shares = goal.where("target > 0").select(F.col("_source"), (F.coalesce(F.sum("target").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / total).alias("_lo"), (F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0)) / total).alias("_hi"))
    last = F.row_number().over(order) == F.count("*").over(W.partitionBy())
    shares = shares.withColumn("_hi", F.when(last, F.lit(1.0)).otherwise(F.col("_hi")))
    cut = shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells).cast("long"), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)).cast("long"))))
    point = F.pmod((F.col("id") % (1 << 31)) * GOLDEN, F.lit(1 << 32))
    t = goal.sparkSession.range(slots).select(F.col("id").alias("_t"), (point / float(1 << 32)).alias("_u"), F.floor(point / (float(1 << 32) / cells)).cast("long").alias("_cell"))
    met = t.join(small_side(cut), "_cell").where((F.col("_lo") <= F.col("_u")) & (F.col("_u") < F.col("_hi"))).select("_t", "_source", F.floor(F.col("_t") / RUN).cast("long").alias("_run"))
    runs = met.groupBy("_source", "_run").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_source").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(F.col("_source").alias("_s"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = met.withColumn("_in", F.row_number().over(W.partitionBy("_source", "_run").orderBy("_t")) - 1)
    return ranked.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r"))).select("_source", (F.col("_from") + F.col("_in")).alias("_rank"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, per_cent: int = PER_CENT, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix as (rows, taken). rows: _source, _part, _nth (the key of a row), _id, size, source_size, target. taken:
    the key with _pass, _from, _to: words that a block which the schedule calls takes from the document in that pass."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(laid_out(docs, id_col, text_col, source_col), "sized")
    goal = scratch.write(targets(sized.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, per_cent, passes), "targets")
    facts = goal.agg(F.sum("target").alias("words"), F.count("*").alias("sources")).first()
    total = facts["words"] or 0.0
    block = int(max(1, min(block_words, total // (BLOCKS * max(1, facts["sources"])))))
    rows = scratch.write(shuffled(sized).join(small_side(goal.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"), "stream")
    turns = schedule(goal, block, int(-(-total // block)))
    passed = rows.where("size > 0 AND target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"))
    start = F.col("_at") + F.col("_pass") * F.col("source_size")
    passed = passed.withColumn("_start", start).withColumn("_rank", F.explode(F.sequence(F.floor(start / block).cast("long"), F.floor((start + F.col("size") - 1) / block).cast("long"))))
    called = passed.join(turns.withColumnRenamed("_source", "_s").withColumnRenamed("_rank", "_turn"), (F.col("_rank") == F.col("_turn")) & F.col("_source").eqNullSafe(F.col("_s")))
    low = F.greatest(F.col("_rank") * block - F.col("_start"), F.lit(0))
    high = F.least((F.col("_rank") + 1) * block - F.col("_start"), F.col("size"))
    return rows, called.select("_source", "_part", "_nth", "_pass", low.cast("long").alias("_from"), high.cast("long").alias("_to"))


KEY = ["_source", "_part", "_nth"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, per_cent: int = PER_CENT, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    taken: words that the mix takes of the document, at most `passes` times its size. Null text has size 0; null
    source is a source, the last; repeated rows each have a place in the stream; sources without a word have target 0;
    an empty table gives none; other columns are ignored. The order within a source hangs on ids alone: reruns agree.
    """
    rows, taken = spans(docs, id_col, text_col, source_col, weights, per_cent, passes, block_words)
    got = taken.groupBy(*KEY).agg(F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    out = rows.alias("a").join(got.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._part") == F.col("b._part")) & (F.col("a._nth") == F.col("b._nth")), "left")
    return out.select(F.col("a._id").alias(id_col), F.col("a.size").alias("size"), F.col("a.source_size").alias("source_size"), F.col("a.target").alias("target"), F.coalesce(F.col("b._taken"), F.lit(0)).cast("long").alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: tuple = WEIGHTS, per_cent: int = PER_CENT, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, once for each pass that takes words of them.

    A row taken in part has its text cut to those words, joined by one space, and `chars_col`, where given, counts
    them; a row of which nothing is taken goes (so do rows without words, null texts among them). Repeated rows are
    taken each on its own; an empty table gives none; other columns pass through, whatever their names.
    """
    rows, taken = spans(docs, id_col, text_col, source_col, weights, per_cent, passes, block_words)
    parts = taken.groupBy(*KEY, "_pass").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    keyed = rows.select(*KEY, "_id", "_text_h", "size", F.row_number().over(W.partitionBy("_id", "_source", "_text_h").orderBy("_part", "_nth")).alias("_copy"))
    met = parts.alias("a").join(keyed.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._part") == F.col("b._part")) & (F.col("a._nth") == F.col("b._nth")))
    keys = lambda i, src, h: [F.xxhash64(i, src, h).alias("_k1"), F.xxhash64(h, src, i, F.lit(1)).alias("_k2")]  # noqa: E731  never null, so rows are dealt once
    takes = met.select(*keys(F.col("b._id"), F.col("b._source"), F.col("b._text_h")), F.struct(F.col("b._copy").alias("copy"), F.col("a._pass").alias("pass"), F.col("a._from").alias("from"), F.col("a._to").alias("to"), F.col("b.size").alias("size")).alias("t"))
    takes = takes.groupBy("_k1", "_k2").agg(F.collect_list("t").alias("_takes"))
    # the rows go along as one struct, so that none of their names meets these
    d = docs.select(F.struct("*").alias("_row"), *keys(F.col(id_col), F.col(source_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    d = d.withColumn("_copy", F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0)))).join(takes, ["_k1", "_k2"])
    d = d.withColumn("_take", F.explode(F.filter("_takes", lambda x: x["copy"] == F.col("_copy"))))
    d = d.withColumn("_text", F.col("_row")[text_col])
    whole = (F.col("_take.from") == 0) & (F.col("_take.to") == F.col("_take.size"))
    cut = F.array_join(F.slice(words(F.col("_text")), F.col("_take.from").cast("int") + 1, (F.col("_take.to") - F.col("_take.from")).cast("int")), " ")
    d = d.withColumn("_new", F.when(whole, F.col("_text")).otherwise(cut))
    own = lambda c: F.col("_row")[c]
    chars = F.when(whole, own(chars_col)).otherwise(F.length("_new").cast(docs.schema[chars_col].dataType)) if chars_col else None
    return d.select(*(F.col("_new").alias(c) if c == text_col else chars.alias(c) if c == chars_col else own(c).alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for mix() over documents: a source's called blocks are its stream's first ones, so words follow from their number."""
    return rf'''
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    weighed AS (SELECT *, {PASSES} * source_size AS full_size, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM sums),
    filled AS (SELECT *, (({PER_CENT} * sum(source_size) OVER ())::DOUBLE / 100 - coalesce(sum(full_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
        WINDOW w AS (ORDER BY full_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goal AS (SELECT source, source_size, CASE WHEN full_size <= level * weight THEN full_size::DOUBLE ELSE weight * (SELECT arg_min(level, full_size / weight::DOUBLE) FROM filled WHERE full_size > level * weight) END AS target FROM filled),
    facts AS (SELECT sum(target) AS words, greatest(1, least({BLOCK_WORDS}, floor(sum(target) / ({BLOCKS} * count(*)))))::BIGINT AS block FROM goal),
    shares AS (SELECT source, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS lo,
        CASE WHEN row_number() OVER (ORDER BY source NULLS LAST) = count(*) OVER () THEN 1.0 ELSE sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () END AS hi FROM goal WHERE target > 0),
    slots AS (SELECT ((t % 2147483648) * {GOLDEN} % 4294967296) / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(CAST(ceil(words / block) AS BIGINT))) AS t FROM facts)),
    turns AS (SELECT source, count(*) * (SELECT block FROM facts) AS called FROM slots JOIN shares ON lo <= u AND u < hi GROUP BY source),
    stream AS (SELECT d.*, source_size, target, coalesce(called, 0) AS called, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || h[1:8])::BIGINT % {PARTS}, h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
        FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source LEFT JOIN turns ON d.source IS NOT DISTINCT FROM turns.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(greatest(0, least(size, called - begins)) + greatest(0, least(size, called - begins - source_size)) AS BIGINT) AS taken FROM stream'''
