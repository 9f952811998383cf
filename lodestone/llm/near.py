"""N-gram Jaccard join: sets of word shingles, frequency-ordered prefixes, pivots, and adaptive multi-match prefixes.

1. Shingles of each distinct word sequence are ordered by the count of their rarest word, taken from a fixed-size
   count sketch of all words; those that turn out to stand in many prefixes move to the end, the most frequent last, and
   prefixes that held them are made anew (any one order is correct; rare first makes prefixes meet seldom). Sequences
   whose sets agree to the wanted degree share a shingle in the prefixes that the degree calls for.
2. A sequence's prefix is longer, the more candidates its shingles' counts let expect: by one or two tokens, and as
   many more prefix shingles must then be shared. Shingles of SMALL members or fewer give their pairs, which are counted
   and compared if they share enough. The members of any other shingle have a pivot, the one of them that leads the
   most such shingles. It is compared with the members that it leads in enough of them: as many comparisons as members,
   not as their square. What is compared gets its difference from the pivot's set. Members that are not compared with
   the pivot are listed with the others and counted as in small shingles; in shingles of CROWD members there are none.
3. The members near a pivot are its family. Two of them differ in what one of their differences holds and the other does
   not, so the differences, small next to the sets, say whether they agree. Most of a family are in one component by
   then; the others are a set of queries that meets the whole family in blocks of BLOCK bytes, dealt over tasks. A block
   gives no pairs but one link for each two components that it joins. (Families whose members are all at the threshold
   of each other keep many such queries: no shared tokens tell them apart, and only that work grows faster than rows.)
   Members that are FAR from their pivot, by the size of the difference, are listed by their shared prefix shingles
   instead, and must share enough of them. (A pair that agrees is never part far and part near: its differences are
   nearly of a size, and the two ranges overlap by that much.)
Copies of a sequence are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import bloom, textvec
from lodestone.llm.common import Scratch, small_side
from lodestone.llm.components import components

#: Counters of the word sketch (8 MB in all) and how many of them a row carries.
COUNTERS, ROW_COUNTERS = 1 << 20, 1 << 10
#: Members of a shingle whose pairs are listed; members beyond which all are compared with their pivot, however few
#: shingles it leads them in; mean count of a prefix's shingles beyond which three must be shared.
SMALL, CROWD, DEAR = 8, 64, 64
#: A difference from the pivot of more than so many times a member's own tokens is far. (Sets that meet by chance differ
#: by both their sizes, so by more than one.)
FAR = 0.95
#: Rounds in which costly shingles move to the end of the order, how many of them at most (nine bytes each, to all tasks),
#: and bytes of one side of a family's members that are compared at once.
ROUNDS, MOST_HOT, BLOCK = 2, 1 << 20, 4 << 20
_NO_HEAT = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, data, bounds in textvec.blocks(batch.column(0)):
            h = textvec.words(data, bounds, fold=True)[3]
            counts += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    parts = counts.reshape(-1, ROW_COUNTERS)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].astype("<i8").tobytes() for i in some], pa.binary())], names=["part", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums[part] + np.frombuffer(counts, "<i8") if part in sums else np.frombuffer(counts, "<i8").copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])


def word_sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all words by hash, in a vector of a fixed size; tasks' vectors add up by parts."""
    kind = "part int, counts binary"
    rows = docs.select(text_col).mapInArrow(_count_words, kind).repartition("part").mapInArrow(_add_up, kind).collect()
    out = np.zeros((COUNTERS // ROW_COUNTERS, ROW_COUNTERS), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, "<i8")
    return np.minimum(out.reshape(-1), (1 << 31) - 1).astype(np.int32)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.translate(_FOLD).split()), digest_size=16).digest()


def _sets(data, bounds, k, sketch=None):
    """Row, hash (and least word count) of each row's distinct shingles, by row and hash. Rows of fewer words: all of them as one."""
    _, _, row, h = textvec.words(data, bounds, fold=True)
    at, g = textvec.ngrams(row, h, k)
    rows = row[at]
    freq = None
    if sketch is not None:
        c = sketch[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
        freq = c[at]
        for j in range(1, k):
            freq = np.minimum(freq, c[at + j])
    n = np.bincount(row, minlength=len(bounds) - 1)
    for m in range(1, k):
        if (n == m).any():
            short, sg = textvec.ngrams(row, h, m)
            ok = n[row[short]] == m
            rows, g = np.r_[rows, row[short][ok]], np.r_[g, sg[ok]]
            if freq is not None:
                freq = np.r_[freq, np.zeros(int(ok.sum()), freq.dtype)]
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], g[new], freq[order][new] if freq is not None else None


def _prefixes(data, bounds, k: int, percent: int, counts, hot, dear: int):
    """Of each row: its shingles, the prefix's length and need, and all rows' shingles in order (with the rows' bounds in them)."""
    rows, g, freq = _sets(data, bounds, k, counts)
    n = np.bincount(rows, minlength=len(bounds) - 1)
    level = _level(hot, g)
    freq = np.where(level > 0, np.int64(1) << level.astype(np.int64), freq)
    order = np.lexsort((g, freq, level, rows))
    start = np.r_[0, np.cumsum(n)]
    most = (percent * n + 99) // 100  # tokens that it must share at least
    wanted = n - most + 1
    cost = np.r_[0, np.cumsum(np.maximum(freq[order] - 1, 0))]
    cost = cost[start[:-1] + np.minimum(wanted, n)] - cost[start[:-1]]
    need = np.minimum(1 + (cost > 0) + (cost > dear * wanted), np.maximum(most, 1))
    return n, wanted + need - 1, need, g[order], start


def _level(hot, tokens: np.ndarray) -> np.ndarray:
    """The power of two of each token's postings where it is among the hot ones, else 0."""
    if not len(hot[0]):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(hot[0], tokens), len(hot[0]) - 1)
    return np.where(hot[0][at] == tokens, hot[1][at], np.uint8(0))


def _index(k: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, number = sketch.value, set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            digests, sizes, prefixes, needs = [], [], [], []
            for _, data, bounds in textvec.blocks(batch.column(1)):
                n, wanted, need, g, start = _prefixes(data, bounds, k, percent, counts, _NO_HEAT, DEAR)
                needs += need.tolist()
                raw = data.tobytes()
                for i in range(len(bounds) - 1):
                    sizes.append(int(n[i]))
                    if not n[i]:
                        digests.append(None)
                        prefixes.append(None)
                        continue
                    d = _digest(raw[bounds[i] : bounds[i + 1]])
                    digests.append(d)
                    prefixes.append(None if d in seen else g[start[i] : start[i] + wanted[i]].view(np.int64))
                    seen.add(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(sizes)), pa.int64()), batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["row", "_id", "_h", "digest", "n", "need", "prefix"],
            )
            number += len(sizes)

    return run


def _anew(k: int, percent: int, sketch, heat, wanted_keys):
    """key, need, prefix of the rows whose key may be wanted, their shingles in the order of heat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in _chosen(batches, wanted_keys):
            needs, prefixes = [], []
            for _, data, bounds in textvec.blocks(batch.column(0)):
                _, wanted, need, g, start = _prefixes(data, bounds, k, percent, counts, heat.value, DEAR)
                needs += need.tolist()
                prefixes += [g[a : a + w].view(np.int64) for a, w in zip(start[:-1], wanted)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(needs, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], names=["key", "need", "prefix"])

    return run


def _chosen(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The rows (text, key) whose key may be in the filter."""
    for batch in batches:
        ok = bloom.holds(wanted.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if ok.any():
            yield batch.filter(pa.array(ok))


def _warm(heat):
    """row, key of the index rows whose prefix holds a token that is hot by now: their prefixes are out of order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            rows = np.unique(lists.value_parent_indices().to_numpy()[_level(heat.value, lists.flatten().to_numpy().view(np.uint64)) > 0])
            yield batch.select([0, 1]).take(pa.array(rows))

    return run


def _live(heats):
    """row, token of the prefixes without a token of later heats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            owner, tokens = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
            stale = np.zeros(batch.num_rows, bool)
            for heat in heats:
                stale[owner[_level(heat.value, tokens.view(np.uint64)) > 0]] = True
            ok = ~stale[owner]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[ok])), pa.array(tokens[ok])], names=["row", "token"])

    return run


def _packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes, eight bytes each."""
    return hashes.astype("<u8").tobytes()


def _unpacked(packed) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _chosen_sets(k: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in _chosen(batches, wanted):
            digests, sets = [], []
            for _, data, bounds in textvec.blocks(batch.column(0)):
                raw = data.tobytes()
                rows, g, _ = _sets(data, bounds, k)
                start = np.searchsorted(rows, np.arange(len(bounds)))
                for i in range(len(bounds) - 1):
                    d = _digest(raw[bounds[i] : bounds[i + 1]])
                    if start[i + 1] > start[i] and d not in seen:
                        seen.add(d)
                        digests.append(d)
                        sets.append(_packed(g[start[i] : start[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return run


def _compare(percent: int):
    """For rows (a, b, star, set_a, set_b): whether the sets agree, and (where a leads b and b is not far) what is in one alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            linked, sizes, apart, heads = [], [], [], []
            for x, y, star in zip(batch.column("set_a"), batch.column("set_b"), batch.column("star").to_pylist()):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                both = np.sort(np.concatenate((x, y)), kind="stable")
                same = both[1:] == both[:-1]
                common = int(same.sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
                sizes.append(len(y))
                apart.append(len(x) + len(y) - 2 * common)
                alone = np.ones(len(both), bool)
                alone[1:] &= ~same
                alone[:-1] &= ~same
                heads.append(both[alone].view(np.int64) if star and apart[-1] <= FAR * len(y) else None)
            cols = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(apart, pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "linked", "nb", "apart", "difference"])

    return run


def _family(percent: int):
    """Links between a block of a pivot's unsettled members and a block of all its members, from their differences alone.

    Two members' sets differ in what is in one of their differences from the pivot and not in both, so the shared tokens
    of the differences say whether they agree. One link for two labels is enough; labels that a link joins are one from then on.
    """

    def run(some: pa.Table, all_: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if some.num_rows and all_.num_rows:
            some, all_ = some.combine_chunks(), all_.combine_chunks()
            x, y = ({c: t.column(c).to_numpy() for c in ("b", "nb", "apart", "label")} for t in (some, all_))
            labels = np.unique(np.concatenate((x["label"], y["label"])), return_inverse=True)[1]
            lx, ly = labels[: len(x["b"])], labels[len(x["b"]) :]
            lists = all_.column("difference").combine_chunks()
            tokens, owner = lists.flatten().to_numpy(), lists.value_parent_indices().to_numpy()
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            mine = some.column("difference").combine_chunks()
            bounds = np.asarray(mine.offsets)
            mine = np.asarray(mine.values)
            for i in range(len(lx)):
                total = x["nb"][i] + y["nb"]
                most = total * (100 - percent) // (100 + percent)  # tokens that two sets of these sizes may differ in
                if not ((ly != lx[i]) & (np.abs(x["apart"][i] - y["apart"]) <= most)).any():
                    continue
                t = mine[bounds[i] : bounds[i + 1]]
                first, n = np.searchsorted(tokens, t), np.searchsorted(tokens, t, side="right")
                n -= first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(ly))
                hit = np.flatnonzero((ly != lx[i]) & (x["apart"][i] + y["apart"] - 2 * common <= most))
                while len(hit):
                    j, old = hit[0], ly[hit[0]]
                    out.append((int(x["b"][i]), int(y["b"][j])))
                    lx[lx == old], ly[ly == old] = lx[i], lx[i]
                    hit = hit[ly[hit] != lx[i]]
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Two rows link if percent * |union| <= 100 * |intersection| of their sets of distinct k-word shingles (A-Z folded;
    rows of fewer words: the words as one shingle). component_id is the least id reachable by links. Rows without a
    word link with nothing. Null ids are passed over when the least is sought, and stay where there is no other;
    repeated rows link with each other; an empty table gives none; other columns are ignored; long texts are read whole.
    """
    rows = classes(docs, id_col, text_col, k, percent)
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, less all but one of each component: the one with the least id (ties: a hash of
    the text). Rows without a word (null texts among them) all stay, but for repeats of the same row; rows of null id come
    last in a component; an empty table gives none; other columns pass through, whatever their names."""
    rows = classes(docs, id_col, text_col, k, percent)
    lone = rows.where("component IS NULL").select("_id", "_h")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id"), F.col("_h"))).alias("r")).select("r._id", "r._h")
    keys = lambda i, h: [F.xxhash64(i, h).alias("_k1"), F.xxhash64(h, i, F.lit(1)).alias("_k2")]  # noqa: E731  never null, so rows are dealt once
    stay = lone.unionByName(first).distinct().select(*keys(F.col("_id"), F.col("_h")))
    d = docs.select(F.struct("*").alias("r"), *keys(F.col(id_col), text_hash(text_col)))  # a struct, so that no name of docs meets these
    nth = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0)))
    return d.join(stay, ["_k1", "_k2"], "left_semi").withColumn("_nth", nth).where("_nth = 1").select("r.*")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _postings(pieces: list[DataFrame], later: list[list]) -> DataFrame:
    parts = [t.where("prefix IS NOT NULL").select("row", "prefix").mapInArrow(_live(heats), "row long, token long") for t, heats in zip(pieces, later)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ordered(docs: DataFrame, index: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int, sketch):
    """(tables with prefixes, for each the heats that came after it, row and _need of rows whose prefix is new or None).

    Shingles in more than SMALL prefixes are hot, and go to the end of the order, the hottest last. Prefixes that held
    one are made anew, which brings others in; so there are ROUNDS of it. Which shingles are hot is the same for all
    texts, so the order is one; a prefix without a shingle that became hot is what it was.
    """
    spark = docs.sparkSession
    pieces, later, needs, heat = [index], [[]], None, _NO_HEAT
    for _ in range(ROUNDS):
        counts = _postings(pieces, later).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > SMALL)
        counts = scratch.write(counts.select("token", F.floor(F.log2("c")).cast("int").alias("level")), "hot")
        least = _least_level(counts)
        got = counts.where(F.col("level") >= least).toArrow()
        scratch.drop(counts)
        tokens, levels = got["token"].to_numpy().view(np.uint64), got["level"].to_numpy().astype(np.uint8)
        if len(tokens) < 2 or len(heat[0]) + len(tokens) > MOST_HOT:
            break
        order = np.argsort(tokens)
        new = spark.sparkContext.broadcast((tokens[order], levels[order]))
        tokens, levels = np.r_[heat[0], tokens], np.r_[heat[1], levels]
        order = np.argsort(tokens)
        heat = tokens[order], levels[order]
        warm = None
        for piece, heats in zip(pieces, later):
            key = F.col("key") if "key" in piece.columns else F.xxhash64("_id", "_h")
            part = piece.where("prefix IS NOT NULL").select("row", key.alias("key"), "prefix").mapInArrow(_warm(new), "row long, key long")
            warm = part if warm is None else warm.unionByName(part)
        warm = scratch.write(warm.dropDuplicates(["key"]), "warm")
        for heats in later:
            heats.append(new)
        wanted = spark.sparkContext.broadcast(bloom.build(warm, "key"))
        anew = texts.mapInArrow(_anew(k, percent, sketch, spark.sparkContext.broadcast(heat), wanted), "key long, need int, prefix array<long>")
        anew = scratch.write(anew.join(small_side(warm), "key").dropDuplicates(["key"]), "anew")
        pieces.append(anew)
        later.append([])
        needs = anew if needs is None else anew.select("row", "need").unionByName(needs.select("row", "need").join(anew.select("row"), "row", "left_anti"))
    return pieces, later, needs.select("row", F.col("need").alias("_need")) if needs is not None else None


def _least_level(counts: DataFrame) -> int:
    """The lowest level from which MOST_HOT tokens at most are on: of some sixty levels' counts."""
    seen, least = 0, 64
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        seen += r.n
        if seen > MOST_HOT // (ROUNDS + 1):
            break
        least = r.level
    return least


def classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """_id, _h (text_hash), n, component (a number of its own for each, null without words), component_id per row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = spark.sparkContext.broadcast(word_sketch(docs, text_col))
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), text_hash(text_col)).alias("key"))
    index = scratch.write(docs.select(F.col(id_col).alias("_id"), text_col, text_hash(text_col).alias("_h")).mapInArrow(_index(k, percent, sketch), f"row long, _id {kind}, _h long, digest binary, n long, need int, prefix array<long>"), "index")
    pieces, later, needs = _ordered(docs, index, texts, scratch, k, percent, sketch)
    reps = index.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id"), F.col("row"))).alias("r")).select("digest", F.col("r.row").alias("node"))
    reps = scratch.write(reps, "reps")  # written, so that Spark can split the rows of one text that very many documents have
    nodes = scratch.write(index.select("row", "_id", "_h", "digest", "n", "need").join(reps, "digest", "left"), "nodes")
    own = nodes.where("row = node").select("node", "digest", F.col("n").alias("size"), F.xxhash64("_id", "_h").alias("key"))

    # 1. prefix shingles that two texts share, and 2. each member's pivot
    posted = _postings(pieces, later)
    often = scratch.write(posted.groupBy("token").agg(F.count("*").alias("_c")).where("_c > 1").select("token"), "often")
    often_ = posted.join(often, "token").join(nodes.select("row", "node", "n", "need"), "row")
    if needs is not None:
        often_ = often_.join(small_side(needs), "row", "left").withColumn("need", F.coalesce("_need", "need"))
    often_ = scratch.write(often_.select("token", "node", "n", "need").distinct(), "postings")
    groups = scratch.write(often_.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("a")).where("c > 1"), "groups")
    marked = scratch.write(often_.join(groups, "token"), "marked")
    for t in (*pieces, often, often_, groups):
        scratch.drop(t)

    large = marked.where(F.col("c") > SMALL)
    leads = large.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("leads"))
    lead = large.join(leads, "node", "left").groupBy("token").agg(F.max(F.struct(F.coalesce("leads", F.lit(0)).alias("l"), (-F.col("node")).alias("n"))).alias("_l")).select("token", (-F.col("_l.n")).alias("a"))
    large = large.drop("a").join(scratch.write(lead, "lead"), "token")
    led = scratch.write(large, "large").where("a <> node").groupBy("a", "node").agg(F.count("*").alias("times"), F.max("c").alias("most"), F.first("need").alias("need")).where(F.expr("times >= need") | (F.col("most") > CROWD)).select("a", "node", F.lit(True).alias("star"))
    large = scratch.write(large.join(led, ["a", "node"], "left").withColumn("light", (F.col("a") != F.col("node")) & F.col("star").isNull()), "large")

    def shared_tokens(x: DataFrame, y: DataFrame, which: str) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(f"{which} AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
        return both.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("x.need", "y.need")).alias("need"))

    small = marked.where(F.col("c") <= SMALL)
    few = shared_tokens(small, small, "x.node < y.node").unionByName(shared_tokens(large.where("light"), large, "x.node <> y.node AND (x.node < y.node OR NOT y.light)"))
    few = scratch.write(few.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("need").alias("need")), "pairs")
    listed = few.where("c >= need").select("a", "b", F.lit(False).alias("star"))
    star = led.withColumnRenamed("node", "b").unionByName(listed).groupBy("a", "b").agg(F.max("star").alias("star"))
    a_, b_ = (own.select(F.col("node").alias(x), F.col("digest").alias("d" + x), F.col("key").alias("k" + x)) for x in "ab")
    star = scratch.write(star.join(a_, "a").join(b_, "b"), "star")
    chosen = scratch.write(star.select(F.col("ka").alias("key")).union(star.select("kb")).distinct(), "chosen")
    wanted = spark.sparkContext.broadcast(bloom.build(chosen, "key"))
    sets = scratch.write(texts.mapInArrow(_chosen_sets(k, wanted), "digest binary, set binary").dropDuplicates(["digest"]), "sets")
    sets_a, sets_b = (sets.select(F.col("digest").alias("d" + x), F.col("set").alias("set_" + x)) for x in "ab")
    pairs = star.join(sets_a, "da").join(sets_b, "db").select("a", "b", "star", "set_a", "set_b")
    compared = scratch.write(pairs.mapInArrow(_compare(percent), "a long, b long, linked boolean, nb long, apart long, difference array<long>"), "compared")
    links = compared.where("linked").select("a", "b")
    labels = scratch.write(components(links), "labels")

    # 3. members near their pivot whose component is not the one of most of its members, against all its members
    m = compared.where("difference IS NOT NULL").join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("component", "b")).drop("component", "linked")
    m = scratch.write(m, "members")
    sizes = F.sum(8 * F.size("difference") + 64).alias("size"), F.count("*").alias("c")
    held = m.groupBy("a", "label").agg(*sizes)
    held = held.groupBy("a").agg(F.max(F.struct("c", "label", "size")).alias("top"), F.sum("size").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    held = scratch.write(held.select("a", F.col("top.label").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("size") - F.col("top.size")) / BLOCK).cast("int").alias("some")), "families")
    met = m.join(held, "a")
    own_part = lambda parts: F.pmod(F.xxhash64("b"), F.col(parts)).cast("int")
    each_part = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    fields = ["a", "b", "nb", "apart", "label", "difference"]
    rest = met.where("label <> main").select(*fields, own_part("some").alias("s"), each_part("parts").alias("p"))
    rest = rest.toDF(*rest.columns)  # columns of its own, so that it can be grouped with the table that it comes from
    whole = met.select(*fields, own_part("parts").alias("p"), each_part("some").alias("s"))
    inside = rest.groupBy("a", "s", "p").cogroup(whole.groupBy("a", "s", "p")).applyInArrow(_family(percent), "a long, b long")
    inside = scratch.write(inside, "inside")

    # and members far from their pivot, by the prefix shingles that they share
    beyond = percent / 100 * (FAR - (100 - percent) / percent)
    distant = large.join(compared.select("a", F.col("b").alias("node"), "apart"), ["a", "node"]).where(F.col("star") & (F.col("apart") > beyond * F.col("n"))).select("token", "node", "n", "need")
    distant = scratch.write(distant, "distant")
    far = shared_tokens(distant, distant, "x.node < y.node").withColumnRenamed("c", "cf").join(few.select("a", "b", "c"), ["a", "b"], "left")
    far = far.where(F.col("cf") + F.coalesce("c", F.lit(0)) >= F.col("need")).select("a", "b", F.lit(False).alias("star"))
    labels_ = scratch.write(components(links.unionByName(inside)), "labels")
    la, lb = (labels_.select(F.col("node").alias(x), F.col("component").alias("l" + x)) for x in "ab")
    far = far.join(compared.select("a", "b"), ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where("NOT coalesce(la, a) <=> coalesce(lb, b)").select("a", "b", "star")
    far = scratch.write(far, "candidates")
    pairs = far.join(a_, "a").join(b_, "b").join(sets_a, "da").join(sets_b, "db").select("a", "b", "star", "set_a", "set_b")
    verified = pairs.mapInArrow(_compare(percent), "a long, b long, linked boolean, nb long, apart long, difference array<long>").where("linked").select("a", "b")
    labels = scratch.write(components(links.unionByName(inside).unionByName(scratch.write(verified, "verified"))), "labels")
    for t in (marked, large, few, star, chosen, sets, compared, m, held, distant, far):
        scratch.drop(t)

    # every row's class: its own id, its copies' and its component's least id
    groups = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("least")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    return nodes.join(groups.join(top, "component"), "node", "left").select("_id", "_h", "n", "component", "component_id")
