import random
import re

import pytest

from lodestone.llm import near
from lodestone.llm.near import similar


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows))


def got(docs, k, percent):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar(docs, k=k, percent=percent).collect())


def test_odd_rows(odd_docs, no_docs):
    assert got(odd_docs, 3, 90) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 3, 90)
    assert similar(no_docs).collect() == []


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_real_rows(real_docs, k, percent):
    assert got(real_docs, k, percent) == brute([(r.doc_id, r.text) for r in real_docs.collect()], k, percent)


@pytest.mark.parametrize(
    "k, percent, seed, forced",
    [(3, 90, 1, {}), (5, 80, 2, {"SMALL": 0}), (2, 70, 3, {"SMALL": 2, "FAR": 0.6}), (3, 90, 4, {"SMALL": 0, "FAR": 0.3}), (3, 85, 5, {"SMALL": 100, "FAR": 1.2}), (3, 85, 6, {"SMALL": 1, "CROWD": 2, "BLOCK": 2000}), (4, 75, 7, {"SMALL": 1, "DEAR": 0, "ROUNDS": 4, "BLOCK": 500}), (3, 80, 8, {"SMALL": 1, "ROUNDS": 0}), (3, 80, 9, {"SMALL": 1, "MOST_HOT": 8})],
)
def test_families_around_the_threshold(spark, k, percent, seed, forced, monkeypatch):
    """Chains and families whose members are all near the threshold, from a few common words and shared lines."""
    for name, value in forced.items():
        monkeypatch.setattr(near, name, value)
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for f in range(6):
        base = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(4000)}" for _ in range(rng.randrange(20, 90))]
        base += "all rights reserved by the holders of this very long licence line".split() * (f % 2)
        grown = base
        for _ in range(22):
            edited = list(base if rng.random() < 0.5 else grown)
            for _ in range(rng.randrange(0, 3)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(40)}"
            grown = edited
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + i, rows[i][1].upper()) for i in range(0, 60, 3)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k, percent) == brute(rows, k, percent)


def test_one_large_family(spark):
    """A family of two thousand near copies, many of them at the threshold of the others, and a passage that strangers share."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(2000):
        edited = list(base)
        for _ in range(rng.randrange(1, 4)):
            edited[rng.randrange(80)] = f"e{rng.randrange(25)}"
        rows.append((i, " ".join(edited)))
    passage = [f"p{i}" for i in range(30)]
    rows += [(2000 + i, " ".join([f"s{rng.randrange(10**6)}" for _ in range(20)] + passage)) for i in range(300)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    held = {}
    for i, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in held[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    found = {r.doc_id: r.component_id for r in similar(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()}
    assert found == {i: find(i) for i in range(len(rows))}
    assert len({found[i] for i in range(2000)}) > 20


def test_names_do_not_clash(spark):
    cols = ["doc_id", "text", "_k1", "_k2", "_nth", "r", "_h", "key"]
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, "x", 8, 9), (2, "a b c d e f", 5, 6, 7, "y", 8, 9), (3, None, 1, 2, 3, None, 4, 5)], "doc_id long, text string, _k1 long, _k2 long, _nth long, r string, _h long, key long")
    kept = near.representatives(docs)
    assert kept.columns == cols
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", 5, 6, 7, "x", 8, 9), (3, None, 1, 2, 3, None, 4, 5)]
