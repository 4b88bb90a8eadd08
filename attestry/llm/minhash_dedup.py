"""MinHash near-dedup with fast similarity sketching.

The sketch of a set has BINS bins. In round i < BINS every element is thrown into a bin by its own hash, carrying the
value i + hash; in round BINS + i every element is thrown into bin i. A bin keeps its smallest value, and a set stops
when no bin is empty, which the second half guarantees; each bin then agrees between two sets with the probability of
their similarity, and agreements concentrate as those of independent draws do.

A sketch keeps 16 bits of each bin, 4 bins to a word: BANDS words, each of which names a bucket. A pair of similarity
0.85 shares no bucket with a probability of (1 - 0.85**4)**28, below 1e-7.

Documents with equal shingle sets are one node. Every link is confirmed on full sets, in two steps, so that no bucket
emits all its pairs:

1. each node meets one node: the smallest of the bucket in which most of its bands agree;
2. buckets that still hold several components are read in blocks, and every pair of nodes of different components meets
   once, in the first bucket that it shares, inside a task. A bucket whose nodes all share an earlier bucket is left to
   that one. A bucket has up to FEW blocks of about BLOCK nodes, a larger one blocks of up to MANY, so that a node is
   copied FEW times, or a MANY-th of its bucket's size. A pair goes on to the full sets
   only where enough bins agree, first of the sketch and then of a finer one (a byte from each of FINE bins, made for
   nodes that share a bucket); enough is the binomial quantile that a linked pair misses once in a million.

Cases: null, empty and blank texts have no shingles and no links; a text of fewer words than a shingle is one shingle;
rows repeated in full and rows with one doc_id fall together; a row with a null doc_id has a null component and is kept;
further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import keyed, written
from .words import Key, fresh_key, mix, rolling, slices, trimmed, word_hashes

ROWS, BANDS = 4, 28
BINS = ROWS * BANDS
FINE = 512
BLOCK, FEW, MANY = 512, 8, 16384
#: Chance that a pair at the threshold has fewer agreeing bins than asked for.
MISS = 1e-6


@cache
def least_bins(similarity: float, bins: int) -> int:
    """The most of these bins that a pair of this similarity reaches with probability 1 - MISS."""
    total, k = 0.0, -1
    while total <= MISS:
        k += 1
        total += comb(bins, k) * similarity**k * (1 - similarity) ** (bins - k)
    return k


def shingle_sets(batch: pa.RecordBatch, width: int, key: Key) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle names of each row, ascending, and where each row's begin (one more for the end)."""
    words, first = word_hashes(batch.column("text"), key, lower=True)
    sizes = np.diff(first)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    bound = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(bound[-1], np.uint64)
    full = rolling(words, width, key)
    for k in np.flatnonzero(counts):
        own = out[bound[k] : bound[k + 1]]
        if sizes[k] >= width:
            own[:] = full[first[k] : first[k] + counts[k]]
            own.sort()
        else:
            own[0] = rolling(words[first[k] : first[k + 1]], sizes[k], key, lane=1)[0]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bound[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bound]


def sketch(elements: np.ndarray, bound: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of `bins` values for each set; all ones for the empty set."""
    sets = len(bound) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(sets * bins, empty, np.uint64)
    sizes = np.diff(bound)
    owner = np.repeat(np.arange(sets), sizes)
    for i in range(2 * bins):
        thrown = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((thrown >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        value = (thrown & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        np.minimum.at(out, owner * bins + place, value)
        open_sets = (out.reshape(sets, bins) == empty).any(axis=1)
        more = open_sets[owner]
        if not more.any():
            break
        elements, owner = elements[more], owner[more]
    return out.reshape(sets, bins)


def packed(sketches: np.ndarray) -> np.ndarray:
    """16 bits of each bin, ROWS of them to a word: one word a band."""
    short = (mix(sketches) >> np.uint64(48)).astype(np.uint16)
    return short.view(np.uint64)


def _sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bound[1:]] - total[bound[:-1]]


def _signatures(width: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Key(key)
        for batch in batches:
            for part in slices(batch):
                sets, bound = shingle_sets(part, width, own)
                keys = packed(sketch(sets, bound))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_th"),
                        part.column("doc_id"),
                        pa.array(np.diff(bound)),
                        pa.array(_sums(mix(sets + np.uint64(0x2545F4914F6CDD1D)), bound).view(np.int64)),
                        pa.array(_sums(mix(sets ^ np.uint64(0xDA942042E4DD58B5)), bound).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["_id", "_th", "doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _sets(width: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Key(key)
        for batch in batches:
            for part in slices(batch):
                sets, bound = shingle_sets(part, width, own)
                fine = (mix(sketch(sets, bound, FINE)) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(sets.view(np.int64))),
                        pa.array([x.tobytes() for x in fine], pa.binary()),
                    ],
                    names=["node", "set", "fine"],
                )

    return run


def _pairs_of(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block pair that may be linked: of different components, and not in an earlier common bucket."""
    band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
    node, comp, size, block = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles", "block"))
    words = np.asarray(rows.column("bands").combine_chunks().flatten()).view(np.uint64).reshape(len(node), BANDS)
    bins = words.view(np.uint16)
    fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint8).reshape(len(node), FINE)
    least, least_fine = least_bins(percent / 100, BINS), least_bins(percent / 100, FINE)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    ones, others = [], []
    for k in left:
        due = right[(comp[right] != comp[k]) & (100 * np.minimum(size[k], size[right]) >= percent * np.maximum(size[k], size[right]))]
        if i == j:
            due = due[node[due] > node[k]]
        if band:
            due = due[~(words[due, :band] == words[k, :band]).any(axis=1)]
        due = due[(bins[due] == bins[k]).sum(axis=1) >= least]
        due = due[(fine[due] == fine[k]).sum(axis=1) >= least_fine]
        ones.append(np.full(len(due), node[k]))
        others.append(node[due])
    return np.concatenate([*ones, np.zeros(0, np.int64)]), np.concatenate([*others, np.zeros(0, np.int64)])


def _block_pairs(percent: int):
    """Reads rows that are sorted by block pair; holds one block pair and one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def told(table: pa.Table) -> pa.RecordBatch:
            a, b = _pairs_of(table, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            names = np.stack([table.column(c).to_numpy() for c in ("band", "word", "i", "j")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            for x, y in zip([0, *cuts[:-1]], cuts, strict=False):
                yield told(table.slice(x, y - x))
            held = table.slice(cuts[-1]).combine_chunks() if len(cuts) else table
        if held is not None and held.num_rows:
            yield told(held)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): _id and _th (its key), doc_id, n_shingles, component_id, kept.

    Rows are linked where 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles.
    """
    rows, key = keyed(docs), fresh_key()
    signed = written(
        rows.select("_id", "_th", "doc_id", "text").mapInArrow(
            trimmed(_signatures(width, key)), "_id long, _th long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
        )
    )
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = full.join(reps, ["f1", "f2", "n_shingles"]).where("doc_id = node").select("node", "_id", "_th", "n_shingles", "bands")
    nodes = written(nodes)
    bucket = ["band", "word"]
    places = nodes.select("node", F.posexplode("bands").alias(*bucket))
    pivots = places.groupBy(*bucket).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    shared = written(places.join(pivots.drop("last"), bucket))

    best = shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = best.groupBy("node").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    texts = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "_id", "_th")
    texts = rows.select("_id", "_th", "text").join(texts, ["_id", "_th"]).select("node", "text")
    sets = written(texts.mapInArrow(trimmed(_sets(width, key)), "node long, set array<long>, fine binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are close enough."""
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a")
        met = met.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        common, n, m = F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t")
        return met.where(100 * F.least(n, m) >= percent * F.greatest(n, m)).where(100 * common >= percent * (n + m - common)).select("a", "b")

    links = written(confirmed(best.select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
    first = components(links)
    labelled = written(shared.join(first, "node", "left").select(*bucket, "node", F.coalesce("component", "node").alias("component")))
    mixed = labelled.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("n") / MANY), F.least(F.ceil(F.col("n") / BLOCK), F.lit(FEW)))
    met = labelled.join(mixed.where("low <> high").select(*bucket, "pivot", blocks.alias("blocks")), bucket)
    loaded = met.join(nodes.select("node", "n_shingles", "bands"), "node").join(nodes.select(F.col("node").alias("pivot"), F.col("bands").alias("pivot_bands")), "pivot")
    earlier = F.aggregate(F.sequence(F.lit(0), F.lit(BANDS - 1)), F.lit(0), lambda bits, k: bits + F.when((k < F.col("band")) & (F.get("bands", k) == F.get("pivot_bands", k)), F.call_function("shiftleft", F.lit(1), k)).otherwise(0))
    loaded = written(loaded.withColumn("earlier", earlier).drop("pivot", "pivot_bands"))
    again = loaded.groupBy(*bucket).agg(F.bit_and("earlier").alias("earlier")).where("earlier <> 0").select(*bucket)
    spread = loaded.join(again, bucket, "left_anti").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    spread = spread.join(sets.select("node", "fine"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    loaded = spread.select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n_shingles", "bands", "fine")
    dealt = loaded.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
    late = confirmed(written(dealt.mapInArrow(trimmed(_block_pairs(percent)), "a long, b long")))
    final = components(links.union(late))

    return (
        signed.join(reps, ["f1", "f2", "n_shingles"], "left")
        .join(final, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")))
        .select("_id", "_th", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
