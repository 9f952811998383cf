"""Cuts of groups whose words are longer than any rate can be."""

from lodestone.llm import quality


def test_long_words_are_cut_by_their_own_group(spark):
    """120 texts of words of 20 to 26 code points (as in prose without spaces), and one of words twenty times as long."""
    word = lambda i, j, n: "".join(chr(0x4E00 + (i * 7919 + j * 104729 + k * 31) % 20000) for k in range(n))
    rows = [(i, " ".join(word(i, j, 20 + i % 7) for j in range(60)), "zh", "books") for i in range(120)]
    rows += [(900, " ".join(word(900, j, 500) for j in range(60)), "zh", "books")]
    rows += [(1000 + i, " ".join(word(i, j, 4 + i % 3) for j in range(60)), "en", "books") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {900}


def test_bins_have_no_top_and_a_relative_width(spark):
    values = [0, 4, 5, 9_999, 10_000, 19_999, 20_000, 20_009, 1_000_003, 10**9 + 7, 2**31 * 1000]
    rows = [(v, False, *([0] * (len(quality.WIDTH) - 1)), v) for v in values]
    features = spark.createDataFrame(rows, "v long, base_failed boolean, " + ", ".join(f"{f} long" for f in quality.WIDTH))
    low = {r.v: r.bin * quality.BIN for r in quality.sketches(features, ["v"]).where("feature = 'word_length'").collect()}
    for v in values:
        assert low[v] == v - v % 5 if v < 20_000 else 0 <= v - low[v] <= v / 2000


def test_a_language_without_spaces_is_kept(spark):
    """110 documents of 60 lines each, all of one shape, beside as many in words."""
    line = lambda i, j: "".join(chr(0x4E00 + (i * 7919 + j * 104729 + k * 31) % 20000) for k in range(18 + (i + j) % 5))
    rows = [(i, "\n".join(line(i, j) for j in range(60)), "zh", "web") for i in range(110)]
    rows += [(1000 + i, " ".join(f"{'abcdefgh'[i % 8 :]}{'xyz'[: j % 3]}q" + chr(97 + i % 26) + chr(97 + j % 26) for j in range(80)), "en", "web") for i in range(300)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept for r in got if r.doc_id < 110) and not any(r.base_failed for r in got)


def test_small_groups_are_drawn_to_the_wider_one(spark):
    """One shouting document of its own source goes; where a source has nothing else, thirty of them stay; letters one by one go."""
    calm = lambda i: " ".join(f"word{chr(97 + j % 26)}{chr(97 + (i + j // 26) % 26)}" for j in range(70))
    loud = lambda i: " ".join(f"WORD{chr(97 + j % 26)}{chr(97 + (i + j // 26) % 26)}!" for j in range(70))
    rows = [(i, calm(i), "en", "a") for i in range(200)] + [(500, loud(1), "en", "b")] + [(600 + i, loud(i), "en", "c") for i in range(30)]
    rows += [(900, " ".join("abcdefghijklmnopqrstuvwxyz"[(j * j + j // 7) % 26] for j in range(90)), "en", "a"), (901, None, None, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900].base_failed
    assert {i for i, r in got.items() if not r.kept} == {500, 900, 901}


def test_names_do_not_clash(spark, no_docs):
    cols = "doc_id long, text string, lang string, source string, _h string, i string, k long, _row long, kept string"
    text = " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(70))
    rows = [(1, text, "en", "a", "h", "i", 3, 4, "x"), (2, "short", "en", "a", "h", "i", 3, 4, "x"), (None, text, None, None, None, None, None, None, None)]
    kept = quality.keep(spark.createDataFrame(rows, cols))
    assert kept.columns == [c.split()[0] for c in cols.split(", ")]
    assert {tuple(r) for r in kept.collect()} == {rows[0], rows[2]}
    assert quality.keep(no_docs).collect() == []
