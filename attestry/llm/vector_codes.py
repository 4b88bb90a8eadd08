"""Product codes of vectors: codebooks by member-resident Lloyd rounds.

A vector of whole numbers floor(256 * c) is cut into PARTS equal parts, and each part position has a codebook of up to
ENTRIES entries, at first that part of the vectors with the smallest ids. After the first assignment the parts live in a
table dealt by (position, entry, salt): an owner holds the parts that belong to its entry, and the salt spreads an entry that
most rows share over many owners. In a round every owner adds up its residents, one row an entry and task; the new
codebooks (at most PARTS x ENTRIES rows, whatever the input) go to all owners, which measure their residents again. Parts
that keep their entry stay in the files they are in; only those that change it go through the next exchange, to their new
owner. At the end each row's codes and errors are put together by row.

A row has a number of its own from the time that the slim table was written; distances are whole numbers, in doubles while
these are exact, else in 64-bit or Python integers.

Cases: null vectors and those with null or non-finite entries (or beyond 2**50) are dropped, as are those of another length
than the table's most common one that PARTS divides; rows that repeat are rows of the result each; null ids sort last, equal
ids by their vectors; fewer than 64 rows give fewer entries; null labels are one label; an error that 64 bits may not hold
is null; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.tables import lookup

from .shared import written
from .vectors import blobs, dimension, joined, scaled
from .words import trimmed

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: An owner's salt is one of so many; a part position has PARTS of the rows' parts, so a few are enough to even out a hot entry.
TASKS_A_SALT = 8
RESIDENT = "position int, entry int, row long, part binary"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest entry of a codebook (the lower of equal ones) and the squared distance, a row a part."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if most * most * 4 * parts.shape[1] < 1 << 52:
        a, b = parts.astype(np.float64), book.astype(np.float64)
        distances = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        kind = np.int64 if most * most * 4 * parts.shape[1] < 1 << 62 else object
        a, b = parts.astype(kind), book.astype(kind)
        distances = np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(parts)), best]


def _slim(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in scaled(batch, d, SCALE):
                span = np.abs(x).max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), blobs(x.astype("<i8")), pa.array(span)], ["vec_id", "label", "x", "span"])

    return run


def _dealt_in(books: np.ndarray, kind: str) -> Callable:
    """The parts of each row with the nearest entry of the first codebooks."""
    d = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = joined(batch.column("x")).view("<i8").reshape(-1, len(books), d // len(books))
                for position, book in enumerate(books):
                    entry, _ = nearest(x[:, position], book)
                    yield _rows(np.full(len(x), position), entry, batch.column("row"), x[:, position], kind)

    return run


def _rows(position: np.ndarray, entry: np.ndarray, row: pa.Array, parts: np.ndarray, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), row, blobs(parts.astype(kind))], ["position", "entry", "row", "part"])


def _residents(batch: pa.RecordBatch, kind: str, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part position, places and parts of a batch, by position."""
    positions = batch.column("position").to_numpy()
    parts = joined(batch.column("part")).view(kind).reshape(-1, width).astype(np.int64)
    for position in np.unique(positions).tolist():
        own = np.flatnonzero(positions == position)
        yield position, own, parts[own]


def _summed(residents: DataFrame, books: np.ndarray, kind: str) -> np.ndarray:
    """The codebooks with each entry replaced by the floored mean of its residents; an entry without any stays."""
    count, entries, width = books.shape
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((count, entries, width), object if kind == "<i8" else np.int64), np.zeros((count, entries), np.int64)
        for batch in batches:
            for position, own, parts in _residents(batch, kind, width):
                entry = batch.column("entry").to_numpy()[own]
                np.add.at(total[position], entry, parts.astype(total.dtype))
                n[position] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(n)
        sums = [pa.array(list(map(int, total[p, e, j])), pa.decimal128(38, 0)) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *sums], ["position", "entry", "n", *names])

    parts = residents.mapInArrow(trimmed(run), ", ".join(["position int, entry int, n long", *[f"{c} decimal(38,0)" for c in names]]))
    out = books.copy()
    for r in parts.groupBy("position", "entry").agg(F.sum("n"), *[F.sum(c) for c in names]).collect():
        out[r[0], r[1]] = [int(s) // r[2] for s in r[3:]]
    return out


def _measured(books: np.ndarray, kind: str) -> Callable:
    """Residents with the entry that is nearest now, whether that is another one, and the squared distance to it (null beyond 2**57)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
                for position, own, parts in _residents(batch, kind, books.shape[2]):
                    entry[own], error[own] = nearest(parts, books[position])
                moved = entry != batch.column("entry").to_numpy()
                errors = pa.array([int(e) if e < 1 << 57 else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(entry), batch.column("row"), batch.column("part"), pa.array(moved), errors], ["position", "entry", "row", "part", "moved", "error"])

    return run


def _owned(parts: DataFrame) -> DataFrame:
    """Parts dealt to the owners of their entries."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("row"), F.lit(-(-tasks // TASKS_A_SALT)))
    return written(parts.withColumn("salt", salt).repartition(tasks, "position", "entry", "salt").drop("salt"), "zstd")


def encode(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each row that counts, and the codebooks (position, entry, component). rows: vec_id, embedding, label."""
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    d = dimension(slim, multiple=PARTS)
    label = slim.schema["label"].dataType.simpleString()
    if not d:
        none = rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long")
        return none, np.zeros((PARTS, 0, 0), np.int64)
    slim = slim.mapInArrow(trimmed(_slim(d)), f"vec_id long, label {label}, x binary, span long").withColumn("row", F.monotonically_increasing_id())
    slim = written(slim, "zstd")
    first = slim.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    books = np.array([np.frombuffer(r["x"], "<i8") for r in first], np.int64).reshape(len(first), PARTS, d // PARTS).transpose(1, 0, 2)
    span = slim.agg(F.max("span")).first()[0] or 0
    kind = next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if span < most)
    if len(first):
        residents = _owned(slim.select("row", "x").mapInArrow(trimmed(_dealt_in(books, kind)), RESIDENT))
    else:
        residents = rows.sparkSession.createDataFrame([], RESIDENT)
    for k in range(rounds):
        books = _summed(residents, books, kind)
        if k + 1 < rounds:
            measured = written(residents.mapInArrow(trimmed(_measured(books, kind)), RESIDENT + ", moved boolean, error long"), "zstd").drop("error")
            stay, go = measured.where("not moved").drop("moved"), measured.where("moved").drop("moved")
            residents = stay.union(_owned(go))
    last = residents.mapInArrow(trimmed(_measured(books, kind)), RESIDENT + ", moved boolean, error long").select("row", "position", "entry", "error")
    half = lambda low: F.bit_or(F.when(F.col("position").between(low, low + 7), F.call_function("shiftleft", F.col("entry").cast("long"), 8 * (low + 7 - F.col("position")))).otherwise(0))
    whole = last.groupBy("row").agg(half(0).alias("high"), half(8).alias("low"), F.when(F.count("error") == PARTS, F.sum("error")).alias("error"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    code = F.concat(digits("high"), digits("low"))
    return slim.select("row", "vec_id", "label").join(whole, "row").select("vec_id", "label", code.alias("code"), "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error) with label_error, the errors summed over equal labels, nulls together. The sums are a row a label, looked up by size."""
    coded = coded.withColumn("_none", F.col("label").isNull())
    safe = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = coded.withColumn("_label", safe(F.col("label")))
    sums = written(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")))
    return lookup(keyed, sums, ["_none", "_label"]).drop("_none", "_label")


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def op12(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest: Column = F.lit(hashlib.sha256(books_text(books).encode()).hexdigest())
    return label_errors(written(coded)).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


_ASSIGN = """
  SELECT id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT a.id, a.p, b.e, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS d FROM parts a JOIN {book} b ON a.p = b.p) GROUP BY id, p"""
_MEANS = """
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY j) AS v FROM (
      SELECT a.p, s.e, j, CAST(floor(sum(a.v[j]) / count(*)) AS BIGINT) AS m FROM parts a JOIN {assigned} s ON a.id = s.id AND a.p = s.p, range(1, len(a.v) + 1) AS t(j) GROUP BY ALL) GROUP BY ALL) m ON m.p = b.p AND m.e = b.e"""
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER () AS id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT id, vec_id, CAST(p AS INT) AS p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM kept, range(16) AS t(p)),
smallest AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN smallest USING (id)),
near0 AS MATERIALIZED ({_ASSIGN.format(book="book0")}), book1 AS MATERIALIZED ({_MEANS.format(book="book0", assigned="near0")}),
near1 AS MATERIALIZED ({_ASSIGN.format(book="book1")}), book2 AS MATERIALIZED ({_MEANS.format(book="book1", assigned="near1")}),
near2 AS MATERIALIZED ({_ASSIGN.format(book="book2")}),
coded AS (SELECT id, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (id), digest
"""
