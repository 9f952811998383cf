import functools
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import language
from lodestone.llm.fingerprint import fingerprint, fingerprints, minus, plus, with_likeness, with_vector
from lodestone.llm.language import identify


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + after[:k]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out)


def test_edited_texts_equal_brute_force(spark, odd_docs, real_docs, no_docs):
    lone = spark.createDataFrame([(4, "just one text")], "doc_id long, text string")
    for docs in (odd_docs, real_docs, lone):
        got = fingerprints(docs).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == edits([(r.doc_id, r.text) for r in docs.collect()])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints(no_docs).collect() == []


def test_equal_texts_and_likeness(real_docs):
    got = {r.doc_id: r for r in fingerprints(real_docs).collect()}
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [got[d] for d, t in texts.items() if len(t or "") > 1000]
    assert sum(r.near_edited > r.near_next + 0.2 for r in long) >= 0.95 * len(long)


def test_order_and_increments(spark):
    rng = random.Random(1)
    pars = ["".join(rng.choice("abc def.") for _ in range(60)) for _ in range(9)]
    texts = {"all": pars, "turned": pars[::-1], "some": pars[:5], "rest": pars[5:], "none": []}
    df = spark.createDataFrame([tuple("\n".join(v) for v in texts.values())], list(texts))
    for name in texts:
        df = with_vector(df, name, "v_" + name)
    row = df.select(fingerprint("v_all").alias("a"), fingerprint("v_turned").alias("b"), (plus("v_some", "v_rest") == F.col("v_all")).alias("c"), (minus("v_all", "v_rest") == F.col("v_some")).alias("d"), (minus("v_all", "v_all") == F.col("v_none")).alias("e")).first()
    assert row.a == row.b and row.c and row.d and row.e
    near = with_likeness(with_likeness(df, "v_all", "v_turned", "x"), "v_all", "v_none", "y").select("x", "y").first()
    assert near.x == 1.0 and near.y == 0.0


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if got[r.doc_id].held_out and any(c.isalpha() for c in r.text)]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    odd = identify(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2)} == {"und"}
    assert identify(no_docs).collect() == []
    assert {r.lang_pred for r in identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_vector(text):
    """Lanes, sums and number of pieces, piece by piece in Python."""
    h = lambda s, *seeds: functools.reduce(lambda seed, k: xxhash.xxh64_intdigest(struct.pack("<q", k), seed), seeds, xxhash.xxh64_intdigest(s.encode(), 42))
    pieces = re.findall(r"[^\n.!?;,|]{1,120}[.!?;,|]*|[.!?;,|]+", text or "")
    lanes = []
    for k in range(2):
        hashes = [h(p, k) for p in pieces]
        for j in range(21):
            lanes.append(sum((sum(x >> j + 21 * c & 1 for x in hashes) % (1 << 20)) << 21 * c for c in range(3)))
    sums = [sum(h(p, k, 32) & 0xFFFFFFFF for p in (text or "").split("\n") if p) % (1 << 32) for k in range(16)]
    return lanes, sums, len(pieces)


def test_vectors_and_likeness_equal_brute_force(spark, odd_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id is not None and r.doc_id != 3), key=lambda r: r)
    rows += [(50 + i, f"One line, two parts; number {i}.\n\nAnother line\n" * (i + 1)) for i in range(4)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def likeness(a, b):
        if a == b:
            return 1.0
        x, y = (np.array([2.0 * (lane >> 21 * c & (1 << 20) - 1) - v[2] for lane in v[0] for c in range(3)]) for v in (a, b))
        return max(0.0, min(1.0, x @ y / np.sqrt((x @ x) * (y @ y)))) if x.any() and y.any() else 0.0

    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        own, edited, follows = brute_vector(t), brute_vector(t[: len(t) - k] + after[:k]), brute_vector(after)
        told = lambda v: "".join(f"{x:016X}" for x in v[0]) + "".join(f"{x:08X}" for x in v[1])
        assert got[d].fingerprint == told(own) and got[d].edited_fingerprint == told(edited)
        assert got[d].near_edited == pytest.approx(likeness(own, edited), abs=1e-9) and got[d].near_next == pytest.approx(likeness(own, follows), abs=1e-9)


def test_scores_equal_the_kernel_regression(spark):
    """The folded matrix against the kernels themselves, pair by pair."""
    rng = random.Random(6)
    words = {"x": "aba bab abba".split(), "y": "xyz zyx yyx".split(), "z": "éà àé èè".split()}
    rows = [(str(i), " ".join(rng.choice(words[c]) for _ in range(rng.randrange(2, 9))), c) for i, c in enumerate("xyz" * 15)]
    labelled = spark.createDataFrame(rows, "key string, text string, lang string")
    langs, weights = language.fit(labelled, rows=12, landmarks=5, ridge=0.05)
    first = labelled.select("*", F.pmod(F.xxhash64("key"), F.lit(1 << 32)).alias("h")).collect()
    chosen = [r for c in "xyz" for r in sorted((r for r in first if r.lang == c), key=lambda r: (r.h, r.key))[:12]]
    marks = [r for c in "xyz" for r in [r for r in chosen if r.lang == c][:5]]

    def held(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return frozenset(np.flatnonzero(language.features(data, np.array([0, len(data)]))[0]).tolist())

    kernel = lambda a, b: np.array([[len(held(x) & held(y)) / np.sqrt(len(held(x)) * len(held(y))) for y in b] for x in a])
    m = [r.text for r in marks]
    values, vectors = np.linalg.eigh(kernel(m, m))
    ok = values > 1e-8 * values.max()
    half = vectors[:, ok] / np.sqrt(values[ok])
    z = kernel([r.text for r in chosen], m) @ half
    y = np.array([[float(r.lang == c) for c in "xyz"] for r in chosen])
    w = np.linalg.solve(z.T @ z + 0.05 * len(chosen) * np.eye(z.shape[1]), z.T @ y)
    texts = ["aba abba", "zyx", "éà aba", "nothing alike"]
    want = kernel(texts, m) @ half @ w
    for t, row in zip(texts, want):
        at = sorted(held(t))
        assert langs == ["x", "y", "z"] and weights[at].sum(axis=0) / np.sqrt(len(at)) == pytest.approx(row, abs=1e-3)


def test_many_languages_share_the_landmarks(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANDMARKS", 6)
    rows = [(str(i), f"{c * 3} {c * 2} {c}{i % 3}", c) for i, c in enumerate("abcd" * 20)]
    langs, weights = language.fit(spark.createDataFrame(rows, "key string, text string, lang string"))
    assert langs == list("abcd") and weights.shape == (language.DIMS, 4) and np.isfinite(weights).all()
