"""Exact nearest neighbours by cosine, over blocks of vectors that are left out where they cannot hold a near one.

Vectors of length one lie at a distance of sqrt(2 - 2 cos) from each other, for which the triangle inequality holds.
Candidates are dealt to their nearest pivot (a bounded sample) and packed in order of their distance to it: a block knows
between which distances its rows lie, a pivot how far its rows reach. A query first meets the blocks of its own pivot, which
gives a bound for its k-th neighbour; then only blocks that the bound lets in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.plans.durable import scratch, written

#: Rows of a block of candidates and of queries, and pivots at most: 64 dimensions make 2 MB, 0.1 MB and 2 MB of them.
BLOCK_ROWS, QUERY_ROWS, MOST_PIVOTS = 4096, 256, 4096
#: Fewer candidates than this meet all queries block by block.
PRUNE_FROM = 100_000
#: Slots over which blocks of queries are dealt to meet few candidates.
SLOTS = 16
#: What rounding may do to a distance, and digits to which similarities are told apart.
SLACK, DIGITS = 1e-6, 12
#: Labels of a candidate: not labelled, labelled with what goes with any; others are numbers from 2. Of a query, 0 is none.
UNLABELLED, ANY, NONE = -1, 1, 0
_ALWAYS, _NEVER = -(1 << 62), 1 << 62
#: The moment of a query that has none: all candidates are from before it.
AFTER_ALL = _NEVER + 1


def rows_of(rows: DataFrame, at: Column | None = None, label: Column | None = None) -> DataFrame:
    """(id, vector, at, label) with moments in microseconds; rows without a vector are in none."""
    return rows.where("vector is not null and size(vector) > 0").select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), (F.lit(0).cast("long") if at is None else at).alias("at"), (F.lit(NONE) if label is None else label).cast("int").alias("label")
    )


def moment(c: Column, missing: int) -> Column:
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(missing).cast("long"))


def undated_first(c: Column) -> Column:
    """Of candidates: one without a moment is before all others."""
    return moment(c, _ALWAYS)


def undated_last(c: Column) -> Column:
    """Of candidates: one without a moment is behind all others, so that it answers no dated query."""
    return moment(c, _NEVER)


def _units(part: pa.RecordBatch):
    """For each dimension that occurs: which rows have it, and their vectors brought to length one."""
    sizes = pc.list_value_length(part.column("vector")).to_numpy(zero_copy_only=False)
    flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        own = sizes == d
        unit = flat[np.repeat(own, sizes)].reshape(-1, d)
        yield np.flatnonzero(own), unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _pivots(candidates: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, a sample of the candidates' directions: the square root of their number, ``MOST_PIVOTS`` at most."""
    wanted = min(MOST_PIVOTS, max(1, math.isqrt(n)))
    taken: dict[int, list] = {}
    for r in candidates.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(wanted).collect():
        taken.setdefault(len(r.vector), []).append(r.vector)
    return {d: (x := np.array(v)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for d, v in taken.items()}


_PLACED = "id long, at long, label int, bound double, unit binary, dim int, pivot int, away double"


def _placed(rows: DataFrame, held) -> DataFrame:
    """Each vector with its nearest pivot (-1 where its dimension has none) and the distance to it."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for own, unit in _units(part):
                    pivots = held.value.get(unit.shape[1])
                    if pivots is None:
                        pivot, away = np.full(len(own), -1, np.int32), np.zeros(len(own))
                    else:
                        d = _away(unit, pivots)
                        pivot = d.argmin(1).astype(np.int32)
                        away = d[np.arange(len(own)), pivot]
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in ("id", "at", "label", "bound")], pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(np.full(len(own), unit.shape[1], np.int32)), pa.array(pivot), pa.array(away)], names=[f.split()[0] for f in _PLACED.split(", ")])

    bounded = rows if "bound" in rows.columns else rows.withColumn("bound", F.lit(float("inf")))
    return bounded.select("id", "vector", "at", "label", "bound").mapInArrow(run, _PLACED)


_BLOCK = "block string, dim int, pivot int, lo double, hi double, n int, bound double, ids binary, ats binary, labels binary, bounds binary, units binary"
_BLOCK_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]


def _blocks(placed: DataFrame, size: int) -> DataFrame:
    """Rows of one pivot packed in order of their bound and distance, so many to a block. A block is named by its first row. Rows
    are dealt by range, so a pivot with most of them is many tasks."""

    def pack(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        away, dim, pivot, bounds = col("away"), int(t.column("dim")[0].as_py()), int(t.column("pivot")[0].as_py()), col("bound")
        name = f"{dim}.{pivot}.{t.column('id')[0].as_py()}.{len(t)}"
        values = [name, dim, pivot, float(away.min()), float(away.max()), len(t), float(bounds.max()), col("id").tobytes(), col("at").tobytes(), col("label").astype(np.int32).tobytes(), bounds.tobytes(), b"".join(t.column("unit").to_pylist())]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_BLOCK_NAMES)

    def run(batches):
        held, n, now = [], 0, None
        for batch in batches:
            key = batch.column("dim").to_numpy().astype(np.int64) << 32 | (batch.column("pivot").to_numpy().astype(np.int64) & 0xFFFFFFFF)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and key[lo] != now:
                    yield pack(held)
                    held, n = [], 0
                now = key[lo]
                while lo < hi:
                    m = min(hi - lo, size - n)
                    held.append(batch.slice(lo, m))
                    lo, n = lo + m, n + m
                    if n == size:
                        yield pack(held)
                        held, n = [], 0
        if held:
            yield pack(held)

    return placed.repartitionByRange("dim", "pivot", "bound", "away", "id").sortWithinPartitions("dim", "pivot", "bound", "away", "id").mapInArrow(run, _BLOCK)


def _opened(row: dict, side: str):
    get = lambda c, kind: np.frombuffer(row[f"{side}_{c}"], kind)
    return get("ids", np.int64), get("ats", np.int64), get("labels", np.int32), get("bounds", np.float64), get("units", np.float64).reshape(row[f"{side}_n"], -1)


def _as(blocks: DataFrame, side: str, *names: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in (names or _BLOCK_NAMES)])


def _met(pairs: DataFrame, k: int, past_only: bool, rule: str | None) -> DataFrame:
    """(query_id, id, similarity): of each pair of blocks every query's k best within its bound, ties at the last place all."""

    def run(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                (row,) = batch.slice(lo, 1).to_pylist()
                (q, q_at, q_label, q_bound, q_unit), (c, c_at, c_label, _, c_unit) = _opened(row, "q"), _opened(row, "c")
                s = np.round(q_unit @ c_unit.T, DIGITS)  # a product's last bits depend on where a row stands in its block
                bad = q[:, None] == c[None, :]
                if past_only:
                    bad |= c_at[None, :] >= q_at[:, None]
                if rule:
                    fits = (c_label[None, :] > 0) & ((q_label[:, None] == NONE) | (c_label[None, :] == ANY) | (c_label[None, :] == q_label[:, None]))
                    bad |= ~fits if rule == "labelled" else fits & ((c_at[None, :] < q_at[:, None]) | (c_at[None, :] == _NEVER))
                s[bad] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                least = np.maximum(least, 1.0 - (np.minimum(q_bound, 4.0) + SLACK) ** 2 / 2.0)
                r, at = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(c[at]), pa.array(s[r, at])], names=["query_id", "id", "similarity"])

    return pairs.mapInArrow(run, "query_id long, id long, similarity double")


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


_PAYLOAD = ("block", "n", "ids", "ats", "labels", "bounds", "units")


def reachable(queries: DataFrame, candidates: DataFrame, held, reach: dict) -> DataFrame:
    """(q_block, c_block) that may hold a neighbour within a query's bound, but for those of the queries' own pivot. ``queries``
    and ``candidates`` are blocks, ``held`` the pivots, ``reach`` by (dim, pivot) how far its rows lie."""
    far = queries.sparkSession.sparkContext.broadcast(reach)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                unit = np.frombuffer(r["units"], np.float64).reshape(r["n"], -1)
                d, own = r["dim"], r["pivot"]
                out += [(r["block"], d, p, 0.0, math.inf) for (e, p) in far.value if e == d and p == -1 and own != -1]
                pivots = held.value.get(d)
                if pivots is None:
                    continue
                away = _away(unit, pivots)  # of each query: a block may be wide, its queries are not
                bound = np.frombuffer(r["bounds"], np.float64)[:, None] + SLACK
                for p in range(len(pivots)):
                    if p != own and (d, p) in far.value:
                        lo, hi = away[:, p] - bound[:, 0], away[:, p] + bound[:, 0]
                        fits = lo <= far.value[d, p]
                        if fits.any():
                            out.append((r["block"], d, p, float(lo[fits].min()), float(hi[fits].max())))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["q_block", "dim", "pivot", "from", "to"])

    wanted = queries.select("block", "dim", "pivot", "n", "bounds", "units").mapInArrow(run, "q_block string, dim int, pivot int, from double, to double")
    return wanted.join(candidates.select(F.col("block").alias("c_block"), "dim", "pivot", "lo", "hi"), ["dim", "pivot"]).where("lo <= `to` and hi >= `from`").select("q_block", "c_block")


def pruned(queries: DataFrame, candidates: DataFrame, k: int, past_only: bool = False, rule: str | None = None, report: dict | None = None) -> DataFrame:
    """``nearest`` over rows (id, vector, at, label), by pivots and bounds. ``report`` gets how many pairs of blocks there are and met."""
    spark = queries.sparkSession
    with scratch(spark, "neighbours") as folder:
        held = spark.sparkContext.broadcast(_pivots(candidates, candidates.count()))
        c_blocks = written(_blocks(_placed(candidates, held), BLOCK_ROWS), "candidates", folder)
        q_rows = written(_placed(queries, held), "queries", folder)
        q_blocks = written(_blocks(q_rows, QUERY_ROWS), "query-blocks", folder)
        home = _as(q_blocks, "q").join(_as(c_blocks, "c"), (F.col("q_dim") == F.col("c_dim")) & (F.col("q_pivot") == F.col("c_pivot")))
        near = written(_first(_met(home, k, past_only, rule), k), "near", folder)
        kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).where(F.col("n") == k)
        bound = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("s")))
        bounded = q_rows.drop("bound").join(kth.select(F.col("query_id").alias("id"), bound.alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(4.0)))
        again = written(_blocks(bounded.select(*q_rows.columns), QUERY_ROWS), "bounded", folder)
        reach = {(r.dim, r.pivot): r.hi for r in c_blocks.groupBy("dim", "pivot").agg(F.max("hi").alias("hi")).collect()}
        pairs = written(reachable(again, c_blocks, held, reach), "pairs", folder)
        if report is not None:
            report |= {"all": q_blocks.count() * c_blocks.count(), "met": home.count() + pairs.count()}
        met = pairs.join(_as(again, "q", *_PAYLOAD), "q_block").join(_as(c_blocks, "c", *_PAYLOAD), "c_block")
        return written(_first(near.drop("place").unionByName(_met(met, k, past_only, rule)), k), "nearest")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, past_only: bool = False, rule: str | None = None, prune: bool | None = None) -> DataFrame:
    """Exact cosine neighbours (query_id, id, similarity, place) of rows (id, vector, at, label) as ``rows_of`` gives
    them; ties to the smaller id; a row is not its own. With ``past_only`` only candidates from before a query count. By
    ``rule`` 'labelled' only candidates with a label that goes with the query's, by 'rest' all but those. Many candidates are
    pruned by ``pruned``, few meet all queries, a matrix product for each pair of blocks."""
    if prune or (prune is None and candidates.limit(PRUNE_FROM).count() == PRUNE_FROM):
        return pruned(queries, candidates, k, past_only, rule)
    none = queries.sparkSession.sparkContext.broadcast({})
    q, c = _as(_blocks(_placed(queries, none), QUERY_ROWS), "q"), _as(_blocks(_placed(candidates, none), BLOCK_ROWS), "c")
    # the few blocks of candidates stand in every slot, the blocks of queries in one each
    q, c = q.withColumn("slot", F.pmod(F.hash("q_block"), F.lit(SLOTS))), c.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return _first(_met(q.join(c, (F.col("q_dim") == F.col("c_dim")) & (q["slot"] == c["slot"])).drop("slot"), k, past_only, rule), k)
