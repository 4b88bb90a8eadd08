"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of BITS bits is cut into segments; the index holds a row for each distinct code and segment. Two codes at distance
d = m * r + a or less (m segments, a < m) agree within r in one of the first a + 1 segments or within r - 1 in one of the
others. So once those segment radii are probed, every code within d has been found. The radii grow round by round, and a
round probes only the shell that is new: the segment values at a distance not probed before.

Each query keeps the codes up to its bound, the least distance within which it knows k + 1 rows, and at first a reach: the
distance within which a query has FEW rows a neighbour if codes were random, so that what leaves the join with the index
doesn't grow with the table. The bound is a condition of that join. A query leaves the rounds once the covered radius reaches
its bound: its k-th distance is then provably covered, ties included. Queries that are open when the reach is covered start
again with a reach that is WIDER greater. Only when the shells together have touched SPEND times as many codes as there are
(on small tables, or codes without near neighbours) are the queries still open compared with all codes, QUERIES of them at a
time, and what lies within a reach leaves that join; the reach grows by STEP until it holds enough. `way` tells which.

Equal codes are one index row with their count and their k + 1 least ids, and equal queries are one query; a code that a
third of all rows share costs one comparison. Segments have about log2(rows) - 8 bits, 8 at least and 22 at most, so that
a bucket of the index stays a few hundred codes at any size. The table of masks of a shell is made by Spark and has at
most as many rows as a segment has values.

Cases: a null id or code is in neither side; a query isn't its own neighbour, other rows with its code are; ties are
ordered by id; ids that repeat count once; fewer than k other rows give them all; further columns are ignored; no rows or
no queries give no rows.
"""

from __future__ import annotations

import math
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BITS = 64
#: Queries that are compared with all codes at once, where shells no longer pay.
QUERIES = 50_000
STEP = 2
FEW, WIDER, SPEND = 8, 4, 3.0


def sign_code(vector: Column) -> Column:
    """A bit for each of the first 64 coordinates: whether it is above 0. Null vectors and those with a null coordinate have none."""
    bits = F.aggregate(F.slice(vector, 1, BITS), F.lit(0).cast("long"), lambda code, x: F.shiftleft(code, 1).bitwiseOR((x > 0).cast("long")))
    return F.when(F.size(vector) > 0, bits)


def segments(rows: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    width = min(22, max(8, round(log2(max(rows, 2))) - 8))
    count = -(-BITS // width)
    cuts = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def radii(m: int):
    """The radii covered round by round: one and two bits of every segment, then two more each time."""
    d = m - 1
    yield d
    d = 2 * m - 1
    while d < BITS:
        yield d
        d += 2
    yield BITS


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def first_reach(rows: int, k: int) -> int:
    """The greatest distance within which a query has at most FEW * (k + 1) of so many random codes."""
    within = reach = 0
    for d in range(BITS + 1):
        within += math.comb(BITS, d)
        if within * rows > FEW * (k + 1) * 2**BITS:
            break
        reach = d
    return reach


def planned(cuts: list[tuple[int, int]], reach: int) -> list[tuple[int, list]]:
    """(radius covered, new shell) of the rounds up to the first that covers the reach."""
    out, probed = [], [-1] * len(cuts)
    for d in radii(len(cuts)):
        r, a = divmod(min(d, BITS - 1), len(cuts))
        shell = [(s, *cut, probed[s] + 1, min(cut[1], r if s <= a else r - 1)) for s, cut in enumerate(cuts)]
        probed = [max(x[4], was) for x, was in zip(shell, probed, strict=True)]
        out.append((d, shell))
        if d >= reach:
            break
    return out


def touched(shell: list[tuple[int, int, int, int, int]], total: int) -> float:
    """Probes of a shell and the codes that they meet, for one query."""
    return sum(comb(width, ones) * (1 + total / (1 << width)) for _, _, width, low, high in shell for ones in range(low, high + 1))


def _probed(asking: DataFrame, index: DataFrame, shell: list[tuple[int, int, int, int, int]], distance: Column) -> DataFrame:
    """q, code, n, distance of the codes in the shell (segment, shift, width, least and most bits that differ) of each query."""
    widest = max(width for _, _, width, _, _ in shell)
    masks = asking.sparkSession.range(1 << widest).select(F.col("id").alias("mask"), F.bit_count("id").alias("ones"))
    masks = masks.where(F.col("ones").between(min(x[3] for x in shell), max(x[4] for x in shell)))
    starts = [F.struct(F.lit(s).alias("s"), F.lit(1 << w).alias("limit"), F.sequence(F.lit(low), F.lit(high)).alias("shells"), _value(F.col("q"), shift, w).alias("own")) for s, shift, w, low, high in shell if low <= high]
    probes = asking.select("q", "bound", F.explode(F.array(*starts)).alias("p")).select("q", "bound", "p.*").withColumn("ones", F.explode("shells"))
    probes = probes.join(F.broadcast(masks), "ones").where("mask < limit").select("q", "bound", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    return probes.join(index, ["s", "value"]).where(distance <= F.col("bound")).select("q", "code", "n", distance.alias("distance"))


def _scanned(codes: DataFrame, asking: DataFrame, distance: Column) -> DataFrame:
    """The same from all codes; asking holds a bounded number of queries."""
    return codes.select("code", "n").join(F.broadcast(asking.select("q", "bound")), distance <= F.col("bound")).select("q", "code", "n", distance.alias("distance"))


def _bounds(held: DataFrame, k: int) -> DataFrame:
    """q, bound: the least distance within which a query has k + 1 rows; none if it has fewer. A query has BITS + 1 distances."""
    each = held.groupBy("q", "distance").agg(F.sum("n").alias("n")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "n"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bound"))
    step = lambda acc, x: F.when(acc["n"] > k, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), x["distance"].alias("bound")))
    return each.select("q", F.aggregate("x", start, step, lambda acc: F.when(acc["n"] > k, acc["bound"])).alias("bound"))


def search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance, way (rounds or scan). base, queries: id long, code long."""
    spark = base.sparkSession
    rows = base.where("id is not null and code is not null").select("id", "code").distinct()
    first = Window.partitionBy("code").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = written(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(least, "code"))
    asked = written(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct())
    cuts = segments(codes.count())
    m = len(cuts)
    pieces = F.array(*[F.struct(F.lit(s).alias("s"), _value(F.col("code"), *cut).alias("value")) for s, cut in enumerate(cuts)])
    index = written(codes.select("code", "n", F.explode(pieces).alias("p")).select("p.s", "p.value", "code", "n"))
    total = codes.count()
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    none = spark.createDataFrame([], "q long, code long, n long, distance int")
    done, reach, spent = none, first_reach(total, k), 0.0
    asking = written(asked.select("q").distinct())
    while asking.take(1):
        rounds = planned(cuts, reach)
        spent += sum(touched(shell, total) for _, shell in rounds)
        if spent > SPEND * total:
            break
        asking, held = asking.select("q").withColumn("bound", F.lit(reach)), none
        for d, shell in rounds:
            held = written(held.union(_probed(asking, index, shell, distance)).distinct())
            known = asking.join(_bounds(held, k).withColumnRenamed("bound", "known"), "q", "left")
            asking = written(known.select("q", F.coalesce("known", F.lit(reach)).alias("bound"), (F.col("known") <= d).alias("over")))
            held = held.join(asking, "q").where("distance <= bound")
            done = done.union(held.where("over").select("q", "code", "n", "distance"))
            held = written(held.where("over is null or not over").select("q", "code", "n", "distance"))
            asking = written(asking.where("over is null or not over").drop("over"))
            if not asking.take(1):
                break
        if reach == BITS:
            break
        reach = min(BITS, reach + WIDER)
    asking = written(asking.select("q"))
    done = done.withColumn("way", F.lit("rounds"))
    count = asking.count()
    for k_part in range(ceil(count / QUERIES)):
        some = written(asking.where(F.pmod(F.xxhash64("q"), F.lit(ceil(count / QUERIES))) == k_part).select("q"))
        reach = max(0, first_reach(total, k) - STEP)
        while some.take(1):  # all codes within `reach`, which grows until it holds enough of them
            reach = min(BITS, reach + STEP)
            met = written(_scanned(codes, some.withColumn("bound", F.lit(reach)), distance))
            found = _bounds(met, k).where("bound is not null").select("q", "bound")
            if reach == BITS:
                found = some.select("q", F.lit(BITS).alias("bound"))
            done = done.union(met.join(found, "q").where("distance <= bound").select("q", "code", "n", "distance", F.lit("scan").alias("way")))
            some = written(some.join(found, "q", "left_anti"))
    near = done.select("q", "code", "distance", "way")
    ids = near.join(codes.select("code", "ids"), "code").select("q", "distance", "way", F.explode("ids").alias("neighbor_id"))
    top = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("r") <= k + 1).drop("r")
    mine = asked.join(top, "q").where("neighbor_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return mine.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance", "way")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by sign codes, of every embedding whose vec_id is divisible by 50."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return search(base, base.where("id % 50 = 0")).drop("way")


ORACLE = """
WITH codes AS (
  SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         CAST(list_sum([CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END FOR z IN list_zip(a.bits, b.bits)]) AS INT) AS distance
  FROM codes a JOIN codes b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
