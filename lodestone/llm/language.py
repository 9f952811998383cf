"""Language ID by string kernels: blended-spectrum presence kernels, Nystrom landmarks, kernel ridge regression.

A text's features are which 1-, 2- and 3-grams of its UTF-8 bytes (ASCII folded to lower case, all but letters one
space) it holds, hashed into DIMS places. The kernel of two texts is the number of features in both over the root of
the product of their numbers. Texts are compared with landmarks; ridge regression on the Nystrom features, one
language against the rest, gives a weight per landmark and language. As the kernel is linear in a text's features,
weights fold into one DIMS x languages matrix, and batches of texts are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import Scratch, small_side

#: Feature places; labelled rows a language gives at most, and those of them that are landmarks; ridge.
DIMS, ROWS, LANDMARKS, RIDGE = 1 << 15, 300, 60, 0.01
#: Landmarks of all languages together at most (128 KB each to the driver's matrix): of many languages, each has fewer.
MOST_LANDMARKS = 1500
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32


def features(data: np.ndarray, bounds: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """rows x dims, uint8: which n-grams of one to three bytes each row holds."""
    rows = len(bounds) - 1
    out = np.zeros((rows, dims), np.uint8)
    flat = out.reshape(-1)
    b = _FOLD[data]
    row = np.repeat(np.arange(rows, dtype=np.int64) * dims, np.diff(bounds))
    code = b
    for n in range(1, 4):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        place = ((code * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
        own = row[: len(place)]
        same = own == row[n - 1 :] if n > 1 else slice(None)
        flat[(own + place)[same]] = 1
    return out


def _batches(column, rows: int = 128, size: int = 1 << 20):
    for first, data, bounds in textvec.blocks(column, size):
        for a in range(0, len(bounds) - 1, rows):
            part = bounds[a : a + rows + 1]
            yield first + a, data[part[0] : part[-1]], part - part[0]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [f.tobytes() for _, data, bounds in _batches(batch.column("text")) for f in np.packbits(features(data, bounds), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())], names=["lang", "place", "bits"])


def fit(labelled: DataFrame, rows: int = ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the DIMS x languages matrix, from `labelled` (key, text, lang): the `rows` rows of each language
    whose keys hash least (ties: key, text), so from languages x rows texts at most, of which the driver gets 4 KB each. It
    unpacks the landmarks, MOST_LANDMARKS at most, and the others 256 at a time."""
    spread = 1 << 32
    hashed = labelled.withColumn("_h", F.pmod(F.xxhash64("key"), F.lit(spread)))
    # rows that can't be among the first are left where they are: four times as many as wanted pass, about
    limits = hashed.groupBy(F.col("lang").alias("_l")).agg((4.0 * rows * spread / F.count("*")).alias("_most"))
    near = hashed.join(small_side(Scratch(labelled.sparkSession).write(limits, "limits")), F.col("lang") == F.col("_l")).where(F.col("_h") <= F.col("_most"))
    order = W.partitionBy("lang").orderBy("_h", "key", F.xxhash64("text"))
    some = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    got = some.select("lang", "place", "text").mapInArrow(_featurize, "lang string, place int, bits binary").orderBy("lang", "place").collect()
    if not got:
        return [], np.zeros((DIMS, 0), np.float32)
    langs = sorted({r.lang for r in got})

    def unpacked(rows_: list) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows_), np.uint8).reshape(len(rows_), -1), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    each = min(landmarks, max(1, MOST_LANDMARKS // len(langs)))
    marks = unpacked([r for r in got if r.place <= each])
    y = np.array([[1.0 if r.lang == c else 0.0 for c in langs] for r in got])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = values > 1e-8 * values.max()
    half = vectors[:, ok] / np.sqrt(values[ok])  # K_mm^-1/2, so that z = k(x, landmarks) @ half
    z = np.concatenate([(unpacked(got[a : a + 256]) @ marks.T).astype(np.float64) @ half for a in range(0, len(got), 256)])
    w = np.linalg.solve(z.T @ z + ridge * len(got) * np.eye(z.shape[1]), z.T @ y)
    return langs, (marks.T @ (half @ w)).astype(np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = model.value
        for batch in batches:
            best, score = [], []
            for _, data, bounds in _batches(batch.column("_text")):
                x = features(data, bounds).astype(np.float32)
                s = (x @ weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                top = s.argmax(axis=1)
                best += [langs[i] for i in top]
                score += np.clip(s[np.arange(len(top)), top], 0, 1).astype(float).tolist()
            letters = batch.column("_letters").to_pylist()
            best = [b if a else "und" for a, b in zip(letters, best)]
            score = [b if a else 0.0 for a, b in zip(letters, score)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`.

    held_out: crc32 of the id's text (null: empty) mod `folds` is 0; such rows are never learned from. A text that is
    null or has no letter is `und` with score 0, and so is every text where no row is labelled. Only texts are looked
    at for a prediction. Repeated rows each give one; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("lang"))
    d = d.withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.lit(""))).withColumn("held_out", F.crc32(F.col("_key")) % folds == 0).withColumn("_letters", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)))
    learned = d.where("NOT held_out AND lang IS NOT NULL AND _letters").select(F.col("_key").alias("key"), F.col("_text").alias("text"), "lang")
    langs, weights = fit(learned)
    kind = docs.schema[id_col].dataType.simpleString()
    if not langs:
        return d.select(F.col("_id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = spark.sparkContext.broadcast((langs, weights))
    out = d.select("_id", "held_out", "_letters", "_text").mapInArrow(_score(model), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)
