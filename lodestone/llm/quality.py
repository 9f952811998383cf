"""Quality rules: a fixed base, then cuts per language and source read off mergeable histogram sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, Scratch, small_side, words

SYMBOLS = "#*$%&|<>"
#: Feature -> least width of its fence. Rates are per 10,000; word_length is in thousandths of a code point.
#: The cut of a group is its upper quartile and three times its interquartile range, that taken as this width at least.
WIDTH = {"symbol_rate": 100, "dup_line_rate": 1500, "repeat_rate": 1000, "upper_rate": 500, "shout_rate": 100, "word_length": 1000}
#: Bins of a sketch are this wide below 2 * TOP, and twice as wide from each doubling on: 2,000 bins a doubling.
BIN, TOP = 5, 10_000
#: Features that may also be too low; rates may not.
LOW = ("word_length",)
#: Documents like the wider group's that a group's sketch is joined by.
PRIOR = 16


def _count(text: Column, chars: str) -> Column:
    """Code points of a character class. Taking out what is rare is cheap, taking out all else is not."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rates of WIDTH to `docs`.

    Null text counts as empty. Three-word windows are compared by their 64-bit hashes within a document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_t", text).withColumn("_w", words(F.col("_t")))
    d = d.withColumn("_n", F.size("_w").cast("long"))
    three = F.when(F.col("_n") >= 3, F.expr("transform(sequence(0, CAST(_n AS INT) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS i))"))
    d = d.withColumn("_g", F.sort_array(three))
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_g, (x, i) -> coalesce(get(_g, i - 1).h = x.h, false) OR coalesce(get(_g, i + 1).h = x.h, false)), x -> x.i))"))
    repeated = F.expr("coalesce(aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)")
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("_l", lines)
    d = d.select(
        *docs.columns,
        F.col("_n").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_lines"),
        _count(F.col("_t"), "A-ZÀ-ÖØ-Þ").alias("_upper"),
        _count(F.col("_t"), "!").alias("_shouts"),
    )
    rate = lambda a, b: F.expr(f"CAST({a} * 10000 DIV greatest({b}, 1) AS LONG)")
    return d.select(
        *docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("_upper", "word_chars").alias("upper_rate"), rate("_shouts", "word_chars").alias("shout_rate"), F.expr("CAST(word_chars * 1000 DIV greatest(n_words, 1) AS LONG)").alias("word_length"),
    )


def _bin_width(value: str) -> str:
    return f"shiftleft(1L, greatest(length(bin({value} DIV {TOP})) - 1, 0))"


def sketches(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, bin, n: a histogram per group and feature. Sketches of parts merge by adding n.

    A bin is named by its least value over BIN, whatever its width; values up to 2 * TOP are known to BIN, larger ones
    to a two-thousandth. There is no top.
    """
    stack = ", ".join(f"'{f}', {f}" for f in WIDTH)
    long = features.where("NOT base_failed").select(*keys, F.expr(f"stack({len(WIDTH)}, {stack}) AS (feature, value)"))
    return long.groupBy(*keys, "feature", F.expr(f"value DIV {BIN} - value DIV {BIN} % {_bin_width('value')}").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))


def _ranked(sketch: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys, "feature")
    return sketch.withColumn("_up", F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(by))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, bins: the bins of the middles of PRIOR equal parts of each sketch, ascending."""
    middles = F.array(*(F.lit(2 * i + 1) for i in range(PRIOR)))
    held = _ranked(sketch, keys).withColumn("_i", F.explode(F.filter(middles, lambda i: (2 * PRIOR * F.col("_up") >= i * F.col("docs")) & (2 * PRIOR * (F.col("_up") - F.col("n")) < i * F.col("docs")))))
    return held.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list("bin")).alias("bins"))


def with_prior(sketch: DataFrame, keys: list[str], wider: DataFrame, wider_keys: list[str]) -> DataFrame:
    """The sketch, each group's joined by PRIOR documents like those of a wider group (quantiles): few documents of its own
    hardly move those, many outweigh them, and no size in between switches anything."""
    same = wider.withColumnsRenamed({c: c + "2" for c in [*wider_keys, "feature"]})
    groups = sketch.select(*keys, "feature").distinct()
    on = F.col("feature") == F.col("feature2")
    for c in wider_keys:
        on = on & F.col(c).eqNullSafe(F.col(c + "2"))
    lent = groups.join(same, on).select(*keys, "feature", F.explode("bins").alias("bin"), F.lit(1).cast("long").alias("n"))
    return merged(sketch.unionByName(lent), keys)


def cuts(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, low, high: the quartiles less, and plus, 3 * max(interquartile range, width); high from the end of its bin."""
    at = lambda quarter: F.min(F.when(4 * F.col("_up") >= quarter * F.col("docs"), F.col("bin"))) * BIN
    width = F.create_map(*(F.lit(x) for kv in WIDTH.items() for x in kv))[F.col("feature")]
    q = _ranked(sketch, keys).groupBy(*keys, "feature").agg(at(1).alias("q1"), at(3).alias("q3"))
    margin = 3 * F.greatest(F.col("q3") - F.col("q1"), width)
    return q.select(*keys, "feature", (F.col("q1") - margin).alias("low"), (F.col("q3") + BIN * F.expr(_bin_width("q3")) - 1 + margin).alias("high"))


def thresholds(features: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row per language and source with both cuts for each feature.

    A source's sketch is joined by PRIOR documents like its language's, and a language's by as many like all documents.
    """
    leaf = sketches(features.select(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), "base_failed", *WIDTH), ["_lang", "_source"])
    lang = with_prior(merged(leaf, ["_lang"]), ["_lang"], quantiles(merged(leaf, []), []), [])
    own = cuts(with_prior(leaf, ["_lang", "_source"], quantiles(lang, ["_lang"]), ["_lang"]), ["_lang", "_source"])
    of = lambda f, side: F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"_{side}_{f}")
    return own.groupBy("_lang", "_source").agg(*(of(f, "high") for f in WIDTH), *(of(f, "low") for f in LOW))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    kept: not base_failed, and no rate above (nor word_length below) its language's and source's cut. Null text counts
    as empty; null language or source is a group of its own; repeated rows are judged alike, each on its own row; very
    long texts are read whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    features = scratch.write(base_features(narrow, "_text").drop("_text"), "quality")
    cut = scratch.write(thresholds(features, "_lang", "_source"), "cuts").withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    met = features.join(small_side(cut), F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    odd = F.lit(False)
    for f in WIDTH:
        odd = odd | F.coalesce(F.col(f) > F.col(f"_high_{f}"), F.lit(False))
    for f in LOW:
        odd = odd | F.coalesce(F.col(f) < F.col(f"_low_{f}"), F.lit(False))
    return met.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, that judge() keeps. Rows alike in id, language, source and text share their verdict.

    Null text counts as empty, and goes; an empty table gives none; other columns pass through, whatever their names.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keys = docs.select(F.struct(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(source_col).alias("s"), h.alias("h")).alias("k"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stay = judge(keys, "k", "text", "lang", "source").where("kept").select("k.*").distinct()
    # the rows go along as one struct, so that none of their names meets these
    met = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), h.alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("i")) & F.col("_l").eqNullSafe(F.col("l")) & F.col("_s").eqNullSafe(F.col("s")) & (F.col("_h") == F.col("h"))
    return met.join(stay, same, "left_semi").select("_row.*")


_RATES = {
    "symbol_rate": "n_symbols * 10000 // greatest(word_chars, 1)", "dup_line_rate": "n_dup_lines * 10000 // greatest(n_lines, 1)", "repeat_rate": "n_repeat_words * 10000 // greatest(n_words, 1)",
    "upper_rate": "n_upper * 10000 // greatest(word_chars, 1)", "shout_rate": "n_shouts * 10000 // greatest(word_chars, 1)", "word_length": "word_chars * 1000 // greatest(n_words, 1)",
}


def oracle_sql() -> str:
    """DuckDB SQL for judge() over documents."""
    space = r"[^\x20\x09-\x0D]+"
    rates = ", ".join(f"{v} AS {k}" for k, v in _RATES.items())
    wide = lambda v: f"(1::BIGINT << greatest(length(bin({v} // {TOP})) - 1, 0))"
    long = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {f} // {BIN} - ({f} // {BIN}) % {wide(f)} AS bin FROM rated WHERE NOT base_failed" for f in WIDTH)
    widths = " ".join(f"WHEN '{f}' THEN {w}" for f, w in WIDTH.items())
    ranked = lambda src, keys: f"SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS up, sum(n) OVER (PARTITION BY {keys}) AS docs FROM {src}"
    middles = lambda src, keys: f"SELECT {keys}, bin FROM (SELECT *, unnest(range(1, {2 * PRIOR}, 2)) AS i FROM ({ranked(src, keys)})) WHERE {2 * PRIOR} * up >= i * docs AND {2 * PRIOR} * (up - n) < i * docs"
    cut = lambda f, side: f"max({side}) FILTER (WHERE feature = '{f}') AS {side}_{f}"
    fine = " AND ".join([f"coalesce({f} <= high_{f}, true)" for f in WIDTH] + [f"coalesce({f} >= low_{f}, true)" for f in LOW])
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}') AS w FROM documents),
    lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM d),
    grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
    covered AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
    counted AS (SELECT doc_id, lang, source, len(w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(l) AS n_lines, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_shouts FROM lined LEFT JOIN covered USING (r)),
    rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM counted),
    long AS ({long}),
    leaf AS (SELECT lang, source, feature, bin, count(*) AS n FROM long GROUP BY ALL),
    every AS (SELECT feature, bin, sum(n) AS n FROM leaf GROUP BY ALL),
    langs AS (SELECT lang, feature, bin, sum(n) AS n FROM (SELECT lang, feature, bin, n FROM leaf UNION ALL
        SELECT g.lang, g.feature, m.bin, 1 FROM (SELECT DISTINCT lang, feature FROM leaf) g JOIN ({middles('every', 'feature')}) m ON g.feature = m.feature) GROUP BY ALL),
    own AS (SELECT lang, source, feature, bin, sum(n) AS n FROM (SELECT lang, source, feature, bin, n FROM leaf UNION ALL
        SELECT g.lang, g.source, g.feature, m.bin, 1 FROM (SELECT DISTINCT lang, source, feature FROM leaf) g JOIN ({middles('langs', 'lang, feature')}) m ON g.lang IS NOT DISTINCT FROM m.lang AND g.feature = m.feature) GROUP BY ALL),
    quartiles AS (SELECT lang, source, feature, min(bin) FILTER (WHERE 4 * up >= docs) * {BIN} AS q1, min(bin) FILTER (WHERE 4 * up >= 3 * docs) * {BIN} AS q3 FROM ({ranked('own', 'lang, source, feature')}) GROUP BY ALL),
    fences AS (SELECT lang, source, feature, q1 - 3 * greatest(q3 - q1, CASE feature {widths} END) AS low, q3 + {BIN} * {wide('q3')} - 1 + 3 * greatest(q3 - q1, CASE feature {widths} END) AS high FROM quartiles),
    cuts AS (SELECT lang, source, {', '.join([cut(f, 'high') for f in WIDTH] + [cut(f, 'low') for f in LOW])} FROM fences GROUP BY ALL)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
        base_failed, NOT base_failed AND {fine} AS kept
    FROM rated LEFT JOIN cuts ON rated.lang IS NOT DISTINCT FROM cuts.lang AND rated.source IS NOT DISTINCT FROM cuts.source"""
