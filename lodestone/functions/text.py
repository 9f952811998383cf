"""Text primitives as column expressions: tokens, cleaning, terms, sentences, markers.

Arguments are columns or column names; results stay in whole-stage code where Spark has such code. Null in, null out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for
from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not of off on once only or
other our ours ourselves out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your yours
yourself yourselves
""".split()  # fmt: skip
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u200b\\ufeff]"
INLINE_SPACE = "[ \\t\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]+"
SENTENCE_GAP = r"""(?<=[.!?])\s+(?=["'(\[]?[A-Z0-9])"""
TERM = r"[a-z0-9]+(?:[-./][a-z0-9]+)*"
GREETING = r"(?i)^\s*((hi|hello|hey|hiya|yo)( there| all| everyone)?|good (morning|afternoon|evening)|thanks( a lot| so much)?|thank you( so much)?|thx|cheers|ok(ay)?|cool|great|bye|goodbye|see you)[\s!.,:)]*$"
REFUSAL = "I couldn't find this in your documents."
SECRETS = [r"AIza[0-9A-Za-z_\-]{20,}", r"\bhf_[A-Za-z0-9]{20,}", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{16,}"]
SECRET_KEYS = ["api_key", "password", "secret", "token", "authorization", "credentials"]
SECRET_SUFFIXES = ["_key", "_secret", "_password", "_token"]
CONTENT_KEYS = ["text", "content", "contents", "prompt", "query", "queries", "question", "answer", "chunk", "document", "context"]

#: Characters of a token, by the counting rule that needs no vocabulary.
CHARS_PER_TOKEN = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _plain_letters() -> tuple[str, str]:
    """Letters that are one base letter with marks, and those base letters, over the blocks of Latin, Greek and Cyrillic."""
    pairs = []
    for i in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if base != chr(i) and len(base) == 1 and unicodedata.normalize("NFKD", chr(i)) != base:
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _plain_letters()


def token_count(text) -> Column:
    return F.ceil(F.length(_c(text)) / F.lit(float(CHARS_PER_TOKEN))).cast("long")


def first_tokens(text, n: int) -> Column:
    return F.substring(_c(text), 1, CHARS_PER_TOKEN * n)


def token_windows(text, n: int) -> Column:
    """Consecutive pieces of n tokens; none of an empty text."""
    t, width = _c(text), CHARS_PER_TOKEN * n
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(width))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(width)))


def clean(text, keep_spaces: bool = False) -> Column:
    """No control characters, one kind of line end; unless keep_spaces, single spaces, trimmed lines, one blank line at most."""
    t = F.regexp_replace(_c(text), CONTROL, "")
    t = F.regexp_replace(t, "\\r\\n?", "\n")
    if keep_spaces:
        return F.regexp_replace(t, r"\A\n+|\n+\z", "")
    t = F.regexp_replace(F.regexp_replace(t, INLINE_SPACE, " "), "(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def fold(text) -> Column:
    """Lower case without accents: exact for letters of the blocks named above and for combining marks."""
    return F.regexp_replace(F.translate(F.lower(_c(text)), MARKED, BARE), r"\p{Mn}+", "")


def terms(text) -> Column:
    """Words for keyword search, stop words left out; the fast form of exact_terms."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


@F.pandas_udf(ArrayType(StringType()))
def exact_terms(text: pd.Series) -> pd.Series:
    """Words for keyword search with compatibility forms folded too, for scripts that `terms` doesn't cover."""
    import re

    word, stop = re.compile(r"\w+"), frozenset(STOPWORDS)

    def of(t):
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        return [w for w in word.findall(bare) if w not in stop]

    return text.map(of)


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC, for texts that don't come in it."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def sentences(text) -> Column:
    return F.filter(F.split(_c(text), SENTENCE_GAP, -1), lambda s: F.trim(s) != "")


def sentence_tail(text, n: int) -> Column:
    """The last whole sentences within n tokens, else the last words within them."""
    t = _c(text)

    def tail(parts: Column, costs) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.expr("CAST(array() AS array<string>)").alias("out"))

        def step(s, x):
            cost = costs(s, x)
            stop = s["full"] | (cost > n)
            return F.struct(F.when(stop, s["used"]).otherwise(cost).cast("long").alias("used"), stop.alias("full"), F.when(stop, s["out"]).otherwise(F.concat(F.array(x), s["out"])).alias("out"))

        return F.aggregate(F.reverse(parts), state, step, lambda s: F.array_join(s["out"], " "))

    by_sentence = tail(sentences(F.regexp_replace(t, "\n", " ")), lambda s, x: s["used"] + token_count(x))
    by_word = tail(F.filter(F.split(t, r"\s+", -1), lambda w: w != ""), lambda s, x: F.ceil((F.length(x) + F.when(F.size(s["out"]) > 0, F.length(F.array_join(s["out"], " ")) + 1).otherwise(0)) / 4.0).cast("long"))
    return F.when(F.lit(n <= 0), F.lit("")).when(by_sentence != "", by_sentence).otherwise(by_word)


def key_terms(text) -> Column:
    """Distinct terms with a digit, sorted."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t.rlike("[0-9]"))))


def quotable(text) -> Column:
    """For finding quotes: straight quotes, no Markdown marks, single spaces, lower case."""
    t = F.translate(_c(text), "‘’“”", "''\"\"")
    t = F.regexp_replace(t, r"[|*_`#>]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def is_greeting(text) -> Column:
    return _c(text).rlike(GREETING)


def is_refusal(text) -> Column:
    t = F.regexp_replace(_c(text), "^[\\s]+|[\\s]+$", "")
    t = F.regexp_replace(t, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    t = F.lower(F.regexp_replace(F.translate(t, "’", "'"), r"\s+", " "))
    return t.startswith(REFUSAL.rstrip(".").lower())


def scrub(text) -> Column:
    t = _c(text)
    for pattern in SECRETS:
        t = F.regexp_replace(t, pattern, "***")
    return t


def redact(key, value, show_content: bool = False) -> Column:
    """A log field's value: secrets masked by the key's name, content by its length, else scrubbed."""
    k, v = F.lower(_c(key)), _c(value)
    secret = k.isin(SECRET_KEYS)
    for s in SECRET_SUFFIXES:
        secret = secret | k.endswith(s)
    out = F.when(secret, F.lit("***"))
    if not show_content:
        out = out.when(_c(key).isin(CONTENT_KEYS), F.format_string("<redacted %d chars>", F.length(v)))
    return out.otherwise(scrub(v))


# -- citation markers: [1], [1, 2], [2-4]

MARKER = r"\[\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*\]"
#: A range of more numbers than this names its ends alone.
LONGEST_RANGE = 20


def marker_numbers(body) -> Column:
    """The numbers that one marker's inside names, in order."""
    parts = F.split(F.regexp_replace(F.trim(_c(body)), r"\s+", ""), ",", -1)

    def numbers(p):
        ends = F.transform(F.split(p, "[-–]", -1), lambda x: F.expr("0") + x.cast("int"))
        a, b = ends[0], F.get(ends, F.lit(1))
        return F.when(F.size(ends) == 2, F.when((a <= b) & (b - a <= LONGEST_RANGE), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))).otherwise(F.array(a))

    return F.flatten(F.transform(F.filter(parts, lambda p: p != ""), numbers))


def cited(text) -> Column:
    """Distinct cited numbers in order of first mention."""
    found = F.regexp_extract_all(_c(text), F.lit(MARKER), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, lambda m: marker_numbers(F.regexp_replace(m, r"[\[\]]", "")))))


def valid_markers(text, valid) -> Column:
    """The text with markers as [a][b], numbers outside the array `valid` dropped, and blanks before markers left empty."""
    t = _c(text)
    found = F.regexp_extract_all(t, F.lit(MARKER), F.lit(0))
    gaps = F.split(t, MARKER, -1)

    def piece(gap, mark):
        kept = F.array_distinct(F.filter(marker_numbers(F.regexp_replace(mark, r"[\[\]]", "")), lambda n: F.array_contains(valid, n)))
        shown = F.array_join(F.transform(kept, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
        return F.when(mark.isNull(), gap).when(F.size(kept) == 0, F.regexp_replace(gap, r"[ \t]+$", "")).otherwise(F.concat(gap, shown))

    return F.array_join(F.zip_with(gaps, found, piece), "")


# -- identities


def short_hash(text, n: int = 16) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, n)


def source_key(key) -> Column:
    k = F.translate(F.trim(_c(key)), "\\", "/")
    return F.when(k.rlike("^https?://"), F.split_part(k, F.lit("#"), F.lit(1))).otherwise(k)


def document_id(key) -> Column:
    return short_hash(source_key(key))


def parent_id(doc_id, index) -> Column:
    return F.concat(_c(doc_id).cast("string"), F.lit("-p"), F.lpad(_c(index).cast("string"), 4, "0"))


def chunk_id(doc_id, index) -> Column:
    return F.concat(_c(doc_id).cast("string"), F.lit("-c"), F.lpad(_c(index).cast("string"), 5, "0"))


def embedding_key(model: str, dim: int, title, text) -> Column:
    return short_hash(F.concat_ws("|", F.lit(model), F.lit(str(dim)), _c(title), _c(text)))

