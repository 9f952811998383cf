"""Best-fit packing whose bin counts are certified by dual-feasible lower bounds, with exchange between partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import Scratch

#: Pieces that one task packs, about; rounds of exchange at most (a round that saves no bin is the last).
GROUP_ITEMS, ROUNDS = 20_000, 6


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of the volume bound, Martello-Toth's L2 and the functions u(k), k to 20."""
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    up = lambda a, b: -(-int(a) // int(b))
    best = up((n * x).sum(), size)
    many, held = np.cumsum(n), np.cumsum(n * x)
    for a in range(size // 2 + 1):  # pieces over size - a stand alone; those over size / 2 take one bin each
        large = many[size] - many[size - a]
        middle, room = many[size - a] - many[size // 2], size * (many[size - a] - many[size // 2]) - (held[size - a] - held[size // 2])
        small = held[size // 2] - (held[a - 1] if a else 0)
        best = max(best, int(large + middle) + max(0, up(small - room, size)))
    for k in range(1, 21):
        u = np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size)
        best = max(best, up((n * u).sum(), k * size))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its place there. Of bins with room, the fullest takes it; ties: the latest opened."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    there, opened = 0, 0  # bit r: some bin has r left
    for i in order.tolist():
        need = int(lengths[i])
        if fits := there >> need:
            left = need + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                there &= ~(1 << left)
        else:
            b, left, opened = opened, size, opened + 1
        bins[i], offsets[i] = b, size - left
        if rest := left - need:
            free[rest].append(b)
            there |= 1 << rest
    return bins, offsets


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(tok.ids(text or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for piece in range(-(-len(ids) // size)):
                    stop = start + (size if piece else (len(ids) - 1) % size + 1)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(ids[start:stop]))
                    start = stop
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pieces, pa.int32()), *(pa.array(v, pa.int64()) for v in (starts, lengths, sums))], names=["_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, end_id: int = 0) -> DataFrame:
    """_id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut only where longer than `size`."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), text_col).mapInArrow(_cut(path, size, end_id), f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int, group_items: int = GROUP_ITEMS) -> tuple[DataFrame, list[dict]]:
    """Adds sequence_id, offset and certified to `pieces` (which has `length`), and says per round: groups, bins, gap groups.

    certified: the sequence is full, or its group has as few as the lower bound allows; else the group kept a gap.

    Round 0 deals the pieces shorter than `size` over groups of about `group_items`, each packed best-fit decreasing
    and certified by `lower_bound`. Full bins, and all bins of groups at their bound, are closed. Groups with a gap
    hand in what their open bins hold; it is dealt anew, by another hash, over fewer groups, and packed again. What a
    round does not improve keeps its bins. Each round is a written table, and only counts reach the driver.
    """
    scratch = Scratch(pieces.sparkSession)
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = ["length", "ids_crc32", "_id", "piece", "start"]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in order if c in pdf], ascending=[False] + [True] * (len([c for c in order if c in pdf]) - 1), kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, size)
        loads = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(loads) - lower_bound(lengths, size)
        return pdf.assign(_bin=bins, offset=offsets, _gap=gap, _first=offsets == 0, _closed=(loads[bins] == size) | (gap == 0))

    done = [pieces.where(F.col("length") >= size).select(*columns, F.lit(0).alias("_round"), F.xxhash64("_id", "piece", "ids_crc32").alias("_group"), F.monotonically_increasing_id().alias("_bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    open_, told, groups, before = pieces.where(F.col("length") < size), [], None, None
    for k in range(1, ROUNDS + 1):
        wanted = max(1, -(-open_.count() // group_items))
        groups = wanted if groups is None else min(wanted, max(1, groups // 2))
        key = F.pmod(F.xxhash64("_id", "piece", "length", F.lit(k)), F.lit(groups)).cast("int")
        dealt = open_.select(*columns, key.alias("_group")).groupBy("_group").applyInPandas(packed, f"{schema}, _group int, _bin long, offset long, _gap long, _first boolean, _closed boolean")
        now = scratch.write(dealt, "packing")
        seen = now.agg(F.sum(F.col("_first").cast("long")).alias("bins"), F.sum(F.when(F.col("_first") & ~F.col("_closed"), 1).otherwise(0)).alias("open_bins"), F.sum(F.when(~F.col("_closed"), 1).otherwise(0)).alias("open_pieces"), F.countDistinct(F.when(F.col("_gap") > 0, F.col("_group"))).alias("gap_groups")).first()
        if before is not None and seen.bins is not None and seen.bins >= before:  # nothing saved: the last round's bins stand
            done.append(kept)
            break
        told.append({"round": k, "groups": groups, "bins": seen.bins or 0, "gap_groups": seen.gap_groups})
        as_done = lambda t, r: t.select(*columns, F.lit(r).alias("_round"), F.col("_group").cast("long"), "_bin", "offset", F.col("_closed").alias("certified"))  # noqa: B023, E731
        done.append(as_done(now.where("_closed"), k))
        kept, before = as_done(now.where("NOT _closed"), k), seen.open_bins
        if not seen.open_pieces:
            break
        if groups == 1 and k > 1 or k == ROUNDS:
            done.append(kept)
            break
        open_ = now.where("NOT _closed").select(*columns)
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    number = F.when(F.col("_round") == 0, F.col("_bin")).otherwise(F.col("_round").cast("long") * (1 << 58) + F.col("_group") * (1 << 32) + F.col("_bin"))
    return out.select(*columns, number.alias("sequence_id"), "offset", "certified"), told


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = 2048, end_id: int = 0, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece of every document, placed in sequences of at most `size` tokens without holes.

    A document is its token ids and `end_id`. Only longer ones are cut; all pieces but the first then have `size`
    tokens. Null text counts as empty (one piece, `end_id` alone); a null id stays null; each repeated row is a
    document of its own; an empty table gives no row; very long texts are encoded whole; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(cut_documents(docs, id_col, text_col, path or bpe.default_path(), size, end_id), "pieces")
    out, _ = pack(pieces, size, group_items)
    return out.withColumnRenamed("_id", id_col)
