"""Language identification by the nearest of several centroids for each language.

A text is lower-cased; its UTF-8 bytes (other ASCII than letters become a blank) give 3-byte grams, hashed to DIMS
dimensions. A vector is log(1 + count) times the inverse document frequency of all training documents, normalised.
Document frequencies and language counts cover every training document. Centroids are fitted by spherical k-means, a
task for each language, on a sample of about SAMPLE training documents of each (chosen by a hash of doc_id; the bound is
a parameter). A text's language is that of the centroid with the greatest cosine. Each centroid keeps the cosine below
which the least similar QUANTILE of its sample lies; a text below its centroid's is marked as rejected, its nearest
language still being told.

Cases: a null text or one without a letter is `und` with score 0; a null lang or doc_id isn't learned from; without any
training document everything is `und`; equal cosines go to the language that is first by code point; rows that repeat
count as often; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed, written
from .words import slices, text_bytes

DIMS = 4096
CENTROIDS = 4
SAMPLE = 500
#: Languages of a model at most.
LANGUAGES = 2000
QUANTILE = 0.005
#: Bytes of text that a task turns into vectors at once.
SLICE = 1 << 18
_KEEP = np.full(256, 32, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """One row of DIMS counts for each text; blanks stand before and after a text, and three blanks are no gram."""
    raw, bound = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n, docs = len(raw), len(bound) - 1
    spread = np.full(n + 2 * docs, 32, np.uint32)
    owner = np.repeat(np.arange(docs), np.diff(bound))
    spread[np.arange(n) + 2 * owner + 1] = _KEEP[raw]
    if len(spread) < 3:
        return np.zeros((docs, DIMS), np.float32)
    gram = spread[:-2] | spread[1:-1] << np.uint32(8) | spread[2:] << np.uint32(16)
    starts = bound + 2 * np.arange(docs + 1)
    valid = np.ones(len(gram), bool)
    for back in (1, 2):
        at = starts[1:] - back
        valid[at[at < len(gram)]] = False
    valid &= gram != 0x202020
    place = (gram * np.uint32(2654435761)) >> np.uint32(20)
    doc = np.repeat(np.arange(docs), np.diff(starts))[: len(gram)]
    return np.bincount(doc[valid] * DIMS + place[valid], minlength=docs * DIMS).reshape(docs, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts.astype(np.float32)) * idf
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(length, 1e-12)


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the first is the mean's direction's nearest point, the next are the farthest from all so far."""
    mean = points.mean(axis=0)
    chosen = [int((points @ mean).argmax())]
    while len(chosen) < min(k, len(points)):
        chosen.append(int((points @ points[chosen].T).max(axis=1).argmin()))
    centroids = points[chosen].copy()
    for _ in range(rounds):
        own = (points @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                v = points[own == c].mean(axis=0)
                centroids[c] = v / max(np.sqrt((v * v).sum()), 1e-12)
    return centroids


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    for batch in batches:
        for part in slices(batch, most=SLICE):
            total += (gram_counts(part.column("text")) > 0).sum(axis=0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["dim", "n"])


def _vectorised(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                found = vectors(gram_counts(part.column("text")), idf)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.tobytes() for x in found], pa.binary())], names=["lang", "v"])

    return run


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    points = np.frombuffer(b"".join(sorted(pdf["v"])), np.float32).reshape(len(pdf), DIMS)
    centroids = spherical_kmeans(points, CENTROIDS)
    near = points @ centroids.T
    own, best = near.argmax(axis=1), near.max(axis=1)
    floors = [float(np.quantile(best[own == c], QUANTILE)) if (own == c).any() else 1.0 for c in range(len(centroids))]
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": range(len(centroids)), "v": [c.tobytes() for c in centroids], "floor": floors})


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, floors, centroids, idf = model.value
        for batch in batches:
            for part in slices(batch, most=SLICE):
                near = vectors(gram_counts(part.column("text")), idf) @ centroids.T
                best = near.argmax(axis=1)
                score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
                lettered = np.asarray(part.column("lettered"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.where(lettered, names[best], "und").tolist(), pa.string()),
                        pa.array(np.where(lettered, score, 0.0)),
                        pa.array(~lettered | (score < floors[best])),
                    ],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def fit(train: DataFrame, languages: int = LANGUAGES):
    """The model of train (doc_id, text, lang): names, floors and vectors of the centroids, and the inverse document frequencies.

    What comes to the driver is DIMS counts, and CENTROIDS vectors for each language; more than `languages` of them are an error.
    """
    known = train.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    sizes = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    total, found = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if found > languages:
        raise ValueError(f"lang has {found} values; a model takes {languages} languages at most")
    total = total or 0
    df = np.zeros(DIMS)
    for r in known.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(sizes, "lang").where(drawn < SAMPLE / F.col("n")).select("lang", "text")
    rows = sample.mapInArrow(_vectorised(idf), "lang string, v binary").groupBy("lang").applyInPandas(_fitted, "lang string, c int, v binary, floor double")
    rows = sorted(rows.collect(), key=lambda r: (r.lang, r.c))
    centroids = np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float32).reshape(len(rows), DIMS)
    return np.array([r.lang for r in rows], object), np.array([r.floor for r in rows]), centroids, idf


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text)."""
    rows = keyed(docs).select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if not len(model[0]):
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicted(held), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
