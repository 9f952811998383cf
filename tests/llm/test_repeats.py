import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import repeats
from lodestone.llm.repeats import remove, repeated_spans


def brute(rows, w):
    split = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for r, words in zip(rank, split):
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            first[key] = min(first.get(key, r), r)
    out = []
    for (d, _), r, words in zip(rows, rank, split):
        gone = set()
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < r:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((str(d), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(docs, **args):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove(docs, **args).collect())


def test_odd_and_real_rows(odd_docs, real_docs, no_docs):
    for docs in (odd_docs, real_docs):
        assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert remove(no_docs).collect() == []


@pytest.mark.parametrize("bits, asks, filtered", [(64, 1000, True), (8, 1000, True), (3, 2, False), (64, 1000, False)])
def test_tangled_repeats(spark, bits, asks, filtered, monkeypatch):
    """With few bits most windows meet others' hashes: only the words at the sources' coordinates tell."""
    if not filtered:
        monkeypatch.setattr(repeats, "FILTER_EDGES", 0)
    monkeypatch.setattr(repeats, "HASH_BITS", bits)
    monkeypatch.setattr(repeats, "ASKS", asks)
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 4)
            words += p[a:] if rng.random() < 0.6 else [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(9)]
        rows.append((rng.choice([i, i, None, 7]), "\n ".join(words) if i % 2 else " ".join(words) + " "))
    docs = spark.createDataFrame(rows + rows[:10], "doc_id long, text string")
    assert got(docs, window=10, edge=4) == brute(rows + rows[:10], 10)


def test_spans_name_their_source(spark):
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = new(80)
    a, b = new(20) + shared + new(5), new(33) + shared + new(60)
    docs = spark.createDataFrame([(5, " ".join(a)), (9, " ".join(b))], "doc_id long, text string")
    (s,) = repeated_spans(docs).collect()
    assert (s._id, s.start, s.end, s.source_id, s.source_start) == (9, 33, 113, 5, 20)


def test_texts_have_other_names_with_another_salt():
    data, bounds = np.frombuffer(b"a b  c d", np.uint8), np.array([0, 3, 3, 8])
    plain, salted = repeats._texts(data, bounds), repeats._texts(data, bounds, 1)
    assert plain[0] == salted[0] == [b"a b", b"", b"c d"] and plain[1] == salted[1]
    assert not (plain[2] == salted[2]).any() and len(set(salted[2].tolist())) == 3
