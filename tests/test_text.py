import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first().y


def test_terms(spark):
    assert one(spark, "Zoë–Löwe: how 7B SENSORS drift; the crème's 2nd batch?", T.terms) == ["zoe", "lowe", "7b", "sensors", "drift", "creme", "s", "2nd", "batch"]
    assert one(spark, "the and of", T.terms) == []
    assert one(spark, None, T.terms) is None


@pytest.mark.parametrize("t", ["Ünïcödé naïve façade Ångström", "Straße ñandú Żółć İstanbul", "Ελλάδα й ё", "éà"])
def test_fast_terms_equal_exact_terms(spark, t):
    df = spark.createDataFrame([(t,)], "x string").select(T.terms("x").alias("a"), T.exact_terms("x").alias("b")).first()
    assert df.a == df.b


def test_exact_terms_fold_compatibility_forms(spark):
    assert one(spark, "ﬁne ① Ⅳ", T.exact_terms) == ["fine", "1", "iv"]
    assert one(spark, "é", T.composed) == unicodedata.normalize("NFC", "é")


def test_token_counts(spark):
    assert [one(spark, t, T.token_count) for t in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]
    assert one(spark, "abcdefghij", lambda c: T.token_windows(c, 1)) == ["abcd", "efgh", "ij"]
    assert one(spark, "", lambda c: T.token_windows(c, 1)) == []


def test_clean(spark):
    assert one(spark, "\x07 a \t b\r\n\r\n\r\n\r\nc​ ", T.clean) == "a b\n\nc"
    assert one(spark, "\n  a\r\n", lambda c: T.clean(c, keep_spaces=True)) == "  a"


def test_sentences(spark):
    assert one(spark, 'One. Two! "Three" four? é five. 6', T.sentences) == ["One.", "Two!", '"Three" four? é five.', "6"]
    text = "Alpha beta gamma. Delta epsilon. Zeta eta."
    assert one(spark, text, lambda c: T.sentence_tail(c, 8)) == "Delta epsilon. Zeta eta."
    assert one(spark, text, lambda c: T.sentence_tail(c, 2)) == "eta."
    assert one(spark, text, lambda c: T.sentence_tail(c, 0)) == ""


def test_key_terms(spark):
    assert set(one(spark, "Which torque did lot 88-C reach at 300rpm, and which did R7 in 1999?", T.key_terms)) == {"88-c", "300rpm", "r7", "1999"}
    assert one(spark, "no digits", T.key_terms) == []


def test_markers(spark):
    assert one(spark, "1,3-4", T.marker_numbers) == [1, 3, 4]
    assert one(spark, "2–3", T.marker_numbers) == [2, 3]
    assert one(spark, "1-90", T.marker_numbers) == [1, 90]
    assert one(spark, "5-2", T.marker_numbers) == [5, 2]
    assert one(spark, "b [2] a [1, 2] [2026]", T.cited) == [2, 1]
    text = "Tin melts early [4, 2, 30]! Lead later [12], zinc last [1]."
    assert one(spark, text, lambda c: T.valid_markers(c, F.array(F.lit(1), F.lit(2)))) == "Tin melts early [2]! Lead later, zinc last [1]."


def test_judgements(spark):
    assert one(spark, "  Hello there!! ", T.is_greeting) and not one(spark, "hello, what is X1?", T.is_greeting)
    assert one(spark, '"I couldn’t find  this in your documents." More', T.is_refusal) and not one(spark, "I found this.", T.is_refusal)


def test_secrets(spark):
    assert one(spark, "k AIza" + "b" * 22 + " ghp_" + "c" * 20 + " Bearer " + "d" * 16, T.scrub) == "k *** *** ***"
    df = spark.createDataFrame([("api_key", "x"), ("my_TOKEN", "x"), ("question", "abc"), ("n", "7")], "k string, v string")
    assert [r[0] for r in df.select(T.redact("k", "v")).collect()] == ["***", "***", "<redacted 3 chars>", "7"]


def test_identities(spark):
    assert one(spark, " https://a.b/c#d ", T.source_key) == "https://a.b/c"
    assert one(spark, "docs\\a#b.txt", T.source_key) == "docs/a#b.txt"
    assert one(spark, "d", lambda c: T.parent_id(c, F.lit(3))) == "d-p0003" and one(spark, "d", lambda c: T.chunk_id(c, F.lit(12))) == "d-c00012"
