"""Removes long passages that occur more than once, by recompression.

A text is a row of symbols, at first its words' names. In each of ROUNDS rounds a run of equal neighbours becomes one
symbol, and so does a pair of neighbours whose names fall in a left and in a right class of that round (a run on either
side of such a pair goes with it). A new symbol is named by what it replaces, so a name is the same wherever it arises,
no dictionary is shuffled and no round waits for another machine. Symbols grow by a third a round, without a bound for
runs.

Whether two neighbours merge depends on these two symbols only. Of a window (a run of words of one document) the symbols
at its ends may reach outside; each round can spoil one symbol more at either end. `interior` follows that bound through
the rounds for every window: between its two ends, equal windows have equal symbols, wherever they stand.

Spark then runs two rounds, each with one shuffle that is combined before it:

1. the last symbols, in pairs of neighbours (the symbols of the next round, some six words), are counted over all
   documents; a window with a pair inside its interior that occurs once cannot repeat;
2. the windows whose interior symbols are all shared are counted by 128 keyed bits of all their words; those that occur
   once are taken out.

What is left are the windows that start somewhere else too. Nothing is gathered in one task: a passage in a third of all
documents is one row for each task after the partial count. Texts are not shuffled: they lie in chunk files, and what is
found out goes to their chunks as word positions.

Cases: null, empty and short texts keep all their words; a row repeated in full is a second document; rows with one
doc_id and different texts are different documents; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chunks import dealt, fetch, stored, told
from .shared import keyed, written
from .words import Key, fresh_key, mix, rolling, trimmed, word_hashes

#: Four rounds leave some three words a symbol and half of a 35-word window as its interior.
ROUNDS = 4
#: A place in one number: the chunk's number, then the word's position in it (a text of 2**31 bytes has fewer words).
WITHIN_CHUNK = 30
_A, _B, _C = (np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0xA0761D6478BD642F))


def one_round(name: np.ndarray, head: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The names after a round, and which old symbols begin a new one. head: symbols that begin a document."""
    right = (mix(name ^ np.uint64(0x1F83D9ABFB41BD6B + number)) >> np.uint64(63)).astype(bool)
    same = (name[1:] == name[:-1]) & ~head[1:]
    joins = ~right[:-1] & right[1:] & ~head[1:]
    begins = np.ones(len(name), bool)
    begins[1:] = ~(same | joins)
    at = np.flatnonzero(begins)
    count = np.diff(at, append=len(name)).astype(np.uint64)
    lefts = count.copy()  # a new symbol is a run, or a run of one name and then a run of another
    seam = np.flatnonzero(joins)
    group = np.cumsum(begins)[seam] - 1
    lefts[group] = (seam + 1 - at[group]).astype(np.uint64)
    last = np.append(at[1:], len(name)) - 1
    new = mix(name[at] * _A + mix(name[last] + lefts * _C) * _B + count)
    return np.where(count > np.uint64(1), new, name[at]), begins


def interior(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After all rounds: the symbols' names, the word each begins at, and where the interior of each window begins and ends.

    The third gives for each word the first sure bound of a window that begins there, the fourth for each word the last
    sure bound of a window that ends before it.
    """
    n = len(words)
    name, at = words, np.arange(n)
    is_head = np.zeros(n, bool)
    is_head[first[first < n]] = True
    low, high = np.arange(n + 1), np.arange(n + 1)
    for number in range(ROUNDS):
        name, begins = one_round(name, is_head[at], number)
        at = at[begins]
        bound = np.zeros(n + 1, np.int64)
        bound[at] = 1
        bound[n] = 1
        upto = np.cumsum(bound)  # bounds at or before a word
        ends = np.append(at, [n, n])
        low = ends[upto[low]]  # the next bound
        high = np.where(high > 0, ends[np.maximum(upto[np.maximum(high - 1, 0)] - 1, 0)], 0)  # the one before
    return name, at, low, high


def _window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """The word indices at which a window begins that ends in the same document."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    total = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - total, counts) + np.arange(counts.sum())


def _long_places(chunk: int, at: np.ndarray) -> pa.Array:
    return pa.array((chunk << WITHIN_CHUNK) | at)


def _pairs(key: int, window: int):
    """h, place of each pair of neighbouring last symbols; place is the bound between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Key(key)
        for batch in batches:
            for k in range(batch.num_rows):
                words, first = word_hashes(fetch(batch, k).column("text"), own)
                if np.diff(first).max(initial=0) < window:
                    continue
                name, at, _, _ = interior(words, first, window)
                doc = np.searchsorted(first, at, side="right") - 1
                met = np.flatnonzero((doc[1:] == doc[:-1]) & (np.diff(first)[doc[1:]] >= window)) + 1
                h = mix(name[met - 1] * _A + name[met] * _B)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _long_places(batch.column("chunk")[k].as_py(), at[met])], names=["h", "place"])

    return run


def _flags(places: pa.Scalar, n: int) -> np.ndarray:
    flag = np.zeros(n, bool)
    if places.is_valid:
        flag[np.asarray(places.values)] = True
    return flag


def _candidates(key: int, window: int):
    """Adds to each chunk the starts of its windows whose interior symbols are all shared, as compressed bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Key(key)
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                words, first = word_hashes(fetch(batch, k).column("text"), own)
                _, _, low, high = interior(words, first, window)
                start = _window_starts(first, window)
                alone = np.concatenate([[0], np.cumsum(_flags(batch.column("alone")[k], len(words)))])
                low, high = low[start], high[start + window]
                inside = low < high
                unique = np.zeros(len(start), bool)
                unique[inside] = alone[high[inside]] > alone[low[inside] + 1]
                flag = np.zeros(len(words), bool)
                flag[start[~unique]] = True
                kept.append(zlib.compress(np.packbits(flag).tobytes(), 1) if flag.any() else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk", "file", "offset", "length")), pa.array(kept, pa.binary())], names=["chunk", "file", "offset", "length", "candidates"])

    return run


def _starts(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))) if bits else np.zeros(0, np.int64)


def _windows(key: int, window: int):
    """h, g, place of each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Key(key)
        for batch in batches:
            for k in range(batch.num_rows):
                at = _starts(batch.column("candidates")[k].as_py())
                if len(at):
                    words, _ = word_hashes(fetch(batch, k).column("text"), own)
                    h, g = (rolling(words, window, own, lane)[at].view(np.int64) for lane in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), _long_places(batch.column("chunk")[k].as_py(), at)], names=["h", "g", "place"])

    return run


def _kept(window: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = fetch(batch, k)
                own = [(text.as_py() or "").encode().split() for text in rows.column("text")]
                sizes = np.array([len(x) for x in own], np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                step = np.zeros(first[-1] + 1, np.int64)
                at = _starts(batch.column("candidates")[k].as_py())
                at = at[~_flags(batch.column("single")[k], len(step))[at]]
                step[at] += 1
                step[at + window] -= 1
                gone = np.cumsum(step)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[first[1:]] - removed[first[:-1]]
                for d in np.flatnonzero(removed).tolist():
                    own[d] = compress(own[d], (~gone[first[d] : first[d + 1]]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in ("_id", "_th", "doc_id")),
                        pa.array(sizes),
                        pa.array(removed),
                        pa.array([b" ".join(x) for x in own], pa.binary()).cast(pa.string()),
                        *(rows.column(c) for c in carry),
                    ],
                    names=["_id", "_th", "doc_id", "n_words", "n_removed", "kept_text", *carry],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = 35, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): _id and _th (its key), doc_id, n_words, n_removed, kept_text (kept words, one space between).

    carry names columns of docs that come along, the text itself too.

    A word goes if a run of `window` words that holds it, all in one document, also starts anywhere else.
    """
    rows = keyed(docs, *(c for c in carry if c != "text"))
    key = fresh_key()
    chunks = stored(rows)

    def once(found: DataFrame, by: list[str], name: str) -> DataFrame:
        """Of what occurs once: its places, by chunk."""
        single = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")).where("n = 1")
        at = F.col("place").bitwiseAND(F.lit((1 << WITHIN_CHUNK) - 1).cast("long")).cast("int")
        return single.groupBy(F.shiftright("place", WITHIN_CHUNK).alias("chunk")).agg(F.collect_list(at).alias(name))

    alone = once(dealt(chunks).mapInArrow(trimmed(_pairs(key, window)), "h long, place long"), ["h"], "alone")
    asked = told(chunks, alone).select("chunk", "file", "offset", "length", "alone")
    asked = written(asked.mapInArrow(trimmed(_candidates(key, window)), "chunk long, file string, offset long, length long, candidates binary"))
    single = once(dealt(asked).mapInArrow(trimmed(_windows(key, window)), "h long, g long, place long"), ["h", "g"], "single")
    both = told(asked, single).select("file", "offset", "length", "candidates", "single")
    out = StructType.fromDDL("_id long, _th long, doc_id long, n_words long, n_removed long, kept_text string")
    return both.mapInArrow(trimmed(_kept(window, carry)), StructType([*out.fields, *(rows.schema[c] for c in carry)]))


def op10(spark, sf_dir: str) -> DataFrame:
    """The digest of remove_repeats over documents."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
