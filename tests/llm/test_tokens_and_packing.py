import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe
from lodestone.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from lodestone.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFFF), st.sampled_from(" \n\t\r\x1c\x85\xa0​　'stre09aAéß<|>")), max_size=60))
def test_fast_ids_and_split_equal_the_library(text):
    tok = bpe.load(bpe.default_path())
    want = tok.library.encode(text, add_special_tokens=False).ids
    assert tok.ids(text).tolist() == want
    pieces, special = tok.split(text)
    assert sum(tok.n_pieces(pieces)) + special == len(want)


def test_ids_of_long_runs(library):
    tok = bpe.load(bpe.default_path())
    for text in ("a" * 200_000, " " * 50_000 + "x", "\n" * 30_000, "<|endoftext|>" * 50):
        assert tok.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents(spark, library):
    tok = bpe.load(bpe.default_path())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert tok.ids(r.text or "").tolist() == library.encode(r.text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, library, odd_docs, real_docs, no_docs):
    for docs in (odd_docs, real_docs):
        got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs).collect()), key=str)
        want = []
        for r in docs.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n, n > 1024))
        assert got == sorted(want, key=str)
    assert count_tokens(no_docs).collect() == []


def test_rare_pre_tokens_meet_the_shuffled_table(real_docs, monkeypatch):
    from lodestone.llm import token_counts

    want = sorted(map(tuple, count_tokens(real_docs).collect()))
    monkeypatch.setattr(token_counts, "HEAD_ENTRIES", 5)
    assert sorted(map(tuple, count_tokens(real_docs).collect())) == want


def held(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for at in bins.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= size
    return len(bins)


def test_packing_keeps_every_piece_once(library, odd_docs, real_docs, no_docs):
    for docs in (odd_docs, real_docs):
        rows = pack_documents(docs).collect()
        want = []
        for r in docs.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            stops = list(range(len(ids), 0, -2048))[::-1]
            for piece, (a, b) in enumerate(zip([0, *stops], stops)):
                want.append((str(r.doc_id), piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        assert held(rows, 2048) <= 1.02 * lower_bound(np.array([r.length for r in rows]), 2048) + 1
    assert pack_documents(no_docs).collect() == []


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, int(x), i) for i, x in enumerate(rng.integers(1, 64, 900))]
    pieces = spark.createDataFrame(rows, "_id long, piece int, start long, length long, ids_crc32 long")
    out, told = pack(pieces, 64, group_items=30)
    n = held(out.collect(), 64)
    assert len(told) > 1 and told[0]["gap_groups"] > 0 and n <= told[0]["bins"]
    assert n >= lower_bound(np.array([r[3] for r in rows]), 64)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_never_exceeds_the_optimum(lengths):
    def optimum(rest, free):
        if not rest:
            return len(free)
        best = len(lengths)
        for i in range(len(free) + 1):
            if i == len(free):
                best = min(best, optimum(rest[1:], [*free, 20 - rest[0]]))
            elif free[i] >= rest[0] and free[i] not in free[:i]:
                best = min(best, optimum(rest[1:], [*free[:i], free[i] - rest[0], *free[i + 1 :]]))
        return best

    x = np.array(lengths, np.int64)
    assert lower_bound(x, 20) <= optimum(sorted(lengths, reverse=True), [])
    bins, offsets = best_fit_decreasing(x, 20)
    assert len(bins) == len(x) and all(offsets + x <= 20)
