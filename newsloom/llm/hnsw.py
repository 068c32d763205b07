"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt by hash into shards of about ``SHARD_ROWS`` distinct vectors.
A shard's graph is a flat array of neighbour positions for each layer; whole
batches of points are searched and linked in step, by numpy. Every query goes
to every shard of its dimension, shards return their nearest with the exact
score in double precision, and a window keeps the ``k`` best.

Nearness is the inner product. A shard appends one component to its vectors
that brings all to one length, and a zero to queries: inner products stay, and
the order by distance becomes the order by inner product.

Defined results. Vectors that are null, empty, zero, or hold a null or a
non-finite component take no part, neither as query nor as candidate; nor does a
row without id, which no result could name. An empty table has no neighbours.
Further columns are not read, whatever their names. Copies of
a vector are one node that knows its ``k + 1`` smallest ids, which is all that
``k`` results without the query's own can need. Ties go to the smaller id. A
query meets vectors of its own dimension. With fewer than ``k`` candidates all
are returned. Repeated ids are rows of their own; a query's own id is left out.

Cost. A shard is built in time n log n; queries are searched in every shard, so
searching costs queries times shards. Recall at 20 is least for vectors without
any structure (independent Gaussian components): the README has figures.

Bounds. The built index of a shard has the size of its vectors and neighbour
arrays; queries come in groups of ``QUERY_ROWS``, each with its copy of the
shard. No table is broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.plans.durable import written

SHARD_ROWS = 8_192
QUERY_ROWS = 50_000
#: Neighbours of a node above the lowest layer and on it, width of the search when building, and when querying.
M, M0, EF_BUILD, EF = 24, 48, 96, 192
BATCH = 256
EXPAND = 4
SEED = 11


class Graph:
    """Layers of neighbour arrays over one shard."""

    def __init__(self, vectors: np.ndarray):
        norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        lift = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.vectors = np.concatenate([vectors, lift[:, None]], axis=1).astype(np.float32)
        n = len(vectors)
        levels = np.minimum(np.floor(-np.log(1 - np.random.default_rng(SEED).random(n)) / np.log(M)).astype(int), 12)
        #: Nodes in order of insertion, those of higher levels first: layer l holds the first sizes[l].
        self.order = np.argsort(-levels, kind="stable")
        self.vectors = self.vectors[self.order]
        top = int(levels.max(initial=0))
        self.sizes = [int((levels >= level).sum()) for level in range(top + 1)]
        self.layers: list[np.ndarray] = [np.full((0, 0), -1, np.int32)] * (top + 1)
        for level in range(top, -1, -1):
            self.layers[level] = np.full((self.sizes[level], M0 if level == 0 else M), -1, np.int32)
            self._fill(level)

    def _fill(self, level: int) -> None:
        size, width = self.layers[level].shape
        at, step = 0, 64
        while at < size:
            batch = np.arange(at, min(size, at + step))
            step = BATCH
            near = self.vectors[batch] @ self.vectors[batch].T
            np.fill_diagonal(near, -np.inf)
            own = np.argsort(-near, axis=1)[:, :EF_BUILD]
            found, score = batch[own], np.take_along_axis(near, own, axis=1)
            found = np.where(np.isfinite(score), found, -1)
            if at:
                ids, sims = self._search(self.vectors[batch], EF_BUILD, level, at)
                found, score = np.concatenate([ids, found], axis=1), np.concatenate([sims, score], axis=1)
                best = np.argsort(-score, axis=1, kind="stable")[:, :EF_BUILD]
                found, score = np.take_along_axis(found, best, axis=1), np.take_along_axis(score, best, axis=1)
            chosen = self._diverse(batch, found, score, max(2, width // 2))
            self.layers[level][batch, : chosen.shape[1]] = chosen
            self._back(level, batch, chosen)
            at = batch[-1] + 1

    def _back(self, level: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen neighbours to the new nodes; a full list keeps a diverse best."""
        layer = self.layers[level]
        width = layer.shape[1]
        to, rank = np.nonzero(chosen >= 0)
        target, new = chosen[to, rank], batch[to]
        keep = ~(layer[target] == new[:, None]).any(axis=1)
        target, new = target[keep], new[keep]
        if not len(target):
            return
        sim = np.einsum("ij,ij->i", self.vectors[target], self.vectors[new])
        order = np.lexsort((-sim, target))
        target, new, sim = target[order], new[order], sim[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        more = np.full((len(nodes), min(width, int(count.max()))), -1, np.int64)
        fits = place < more.shape[1]
        more[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = new[fits]
        found = np.concatenate([layer[nodes].astype(np.int64), more], axis=1)
        score = np.where(found >= 0, np.matmul(self.vectors[found], self.vectors[nodes][:, :, None])[:, :, 0], -np.inf)
        best = np.argsort(-score, axis=1, kind="stable")
        found, score = np.take_along_axis(found, best, axis=1), np.take_along_axis(score, best, axis=1)
        easy = (found >= 0).sum(axis=1) <= width
        out = found[:, :width].copy()
        if (~easy).any():
            out[~easy] = -1
            some = self._diverse(nodes[~easy], found[~easy], score[~easy], width)
            out[np.flatnonzero(~easy)[:, None], np.arange(some.shape[1])[None, :]] = some
        layer[nodes, : out.shape[1]] = out

    def _diverse(self, nodes: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, best first: those nearer to the node than to any chosen before, then the best of the rest."""
        among = self.vectors[np.maximum(found, 0)]
        pairs = np.matmul(among, among.transpose(0, 2, 1))
        rows, width = found.shape
        blocked, chosen, n = found < 0, np.zeros((rows, width), bool), np.zeros(rows, int)
        for c in range(width):
            take = ~blocked[:, c] & (n < most)
            chosen[take, c] = True
            n += take
            blocked |= take[:, None] & (pairs[:, c, :] >= score) & ~chosen
        rank = np.where(chosen, 0, np.where(found >= 0, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(found, best, axis=1)

    def _search(self, queries: np.ndarray, ef: int, down_to: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest found among the first ``size`` nodes of a layer, best first, -1 where there are fewer."""
        entry = np.zeros(len(queries), np.int64)
        for level in range(len(self.layers) - 1, down_to, -1):
            if self.sizes[level]:
                entry = self._beam(queries, entry[:, None], 4, self.layers[level])[0][:, 0]
        return self._beam(queries, np.minimum(entry, size - 1)[:, None], ef, self.layers[down_to][:size])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, ef: int, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = len(queries)
        rows = np.arange(q)
        seen = np.full((q, len(layer)), -1, np.int16)
        ids = np.full((q, ef), -1, np.int64)
        sims = np.full((q, ef), -np.inf, np.float32)
        open_ = np.zeros((q, ef), bool)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.matmul(self.vectors[entry], queries[:, :, None])[:, :, 0]
        open_[:, : entry.shape[1]] = True
        seen[rows[:, None], entry] = 0
        live = rows
        while len(live):
            rank = np.where(open_[live], np.arange(ef), ef)
            pick = np.sort(rank, axis=1)[:, : min(EXPAND, ef)] if ef > EXPAND else np.sort(rank, axis=1)
            going = pick[:, 0] < ef
            live, pick = live[going], pick[going]
            if not len(live):
                break
            at = np.minimum(pick, ef - 1)
            nodes = np.where(pick < ef, ids[live[:, None], at], -1)
            r, c = np.nonzero(pick < ef)
            open_[live[r], pick[r, c]] = False
            near = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            good = (near >= 0) & (near < len(layer))
            near = np.where(good, near, 0)
            good &= seen[live[:, None], near] < 0
            place = np.broadcast_to(np.arange(near.shape[1], dtype=np.int16), near.shape)
            r, c = np.nonzero(good)
            seen[live[r], near[r, c]] = place[r, c]
            good[r, c] = seen[live[r], near[r, c]] == place[r, c]  # a node that comes twice counts once
            r, c = np.nonzero(good)
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", self.vectors[near[r, c]], queries[live[r]])
            all_ids, all_sims = np.concatenate([ids[live], np.where(good, near, -1)], axis=1), np.concatenate([sims[live], sim], axis=1)
            all_open = np.concatenate([open_[live], good], axis=1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sims, top, axis=1), axis=1), axis=1)
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_open))
        return ids, sims

    def nearest(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Positions of vectors as they were given, best first, -1 where there are fewer."""
        if not len(self.vectors):
            return np.full((len(queries), ef), -1)
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        out = [self._search(lifted[i : i + BATCH], ef, 0, self.sizes[0])[0] for i in range(0, len(lifted), BATCH)]
        found = np.concatenate(out)
        return np.where(found >= 0, self.order[np.maximum(found, 0)], -1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def build(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The index, written: a row (shard, blob) for each shard; and by dimension, its first shard and how many."""
    by_vector = Window.partitionBy("v").orderBy("id")
    nodes = vectors.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sizes = sorted(vectors.groupBy(F.size("v").alias("d")).count().collect())
    shards: dict[int, tuple[int, int]] = {}
    for d, n in sizes:
        shards[d] = (sum(s for _, s in shards.values()), max(1, -(-n // shard_rows)))
    total = max(1, sum(s for _, s in shards.values()))
    if not shards:
        return vectors.sparkSession.createDataFrame([], "shard int, blob binary"), shards
    first = F.create_map(*[F.lit(x) for d, (a, _) in shards.items() for x in (d, a)])
    many = F.create_map(*[F.lit(x) for d, (_, s) in shards.items() for x in (d, s)])
    shard = (first[F.size("v")] + F.pmod(F.xxhash64("v"), many[F.size("v")])).cast("int")

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            names = batch.column(0).to_numpy()
            for s in np.unique(names):
                own = batch.filter(pa.array(names == s))
                parts.setdefault(int(s), []).append((_matrix(own.column(1)), own.column(2).to_pylist()))
        for s, held in parts.items():
            matrix, ids = np.concatenate([m for m, _ in held]), [x for _, many in held for x in many]
            # the order of arrival may differ from run to run; that of the ids does not
            order = sorted(range(len(ids)), key=lambda i: ids[i])
            matrix, ids = matrix[order], [ids[i] for i in order]
            graph = Graph(matrix.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pickle.dumps((graph, matrix, ids))], pa.binary())], names=["shard", "blob"])

    dealt = nodes.select(shard.alias("shard"), "v", "ids").repartitionById(total, F.col("shard"))
    return written(dealt.mapInArrow(run, "shard int, blob binary"), "hnsw"), shards


def search(embeddings: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF) -> DataFrame:
    """For each row of ``embeddings`` that ``queries`` holds for: query_id, rank, the neighbour's id, score."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(usable(F.col("v"))).where("id is not null")
    index, shards = build(rows.select("id", "v"), k, shard_rows)
    asked = rows.where("asked").select("id", "v")
    total = max(1, sum(s for _, s in shards.values()))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    own = F.lit(None).cast("array<int>")
    for d, (a, s) in shards.items():
        own = F.when(F.size("v") == d, F.array([F.lit(x) for x in range(a, a + s)]) if s < 256 else F.sequence(F.lit(a), F.lit(a + s - 1))).otherwise(own)
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    sent = asked.select(F.explode(own).alias("shard"), group.alias("g"), "id", "v").select("shard", "g", "id", "v", F.lit(None).cast("binary").alias("blob"))
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), "blob")
    parts = min(total * groups, 65_536)

    def run(batches):
        blobs: dict[tuple, bytes] = {}
        waiting: dict[tuple, list] = {}
        for batch in batches:
            for s, g, i, v, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if blob is not None:
                    blobs[s, g] = blob
                else:
                    waiting.setdefault((s, g), []).append((i, v))
        for at, wanted in waiting.items():
            if at not in blobs:
                continue
            graph, matrix, ids = pickle.loads(blobs[at])
            for lo in range(0, len(wanted), BATCH):
                some = wanted[lo : lo + BATCH]
                q = np.array([v for _, v in some], np.float64)
                found = graph.nearest(q, min(max(ef, k + 1), max(k + 1, len(ids))))
                score = np.where(found >= 0, np.einsum("qcd,qd->qc", matrix[np.maximum(found, 0)].astype(np.float64), q), -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                out = [(some[r][0], near, score[r, c]) for r in range(len(some)) for c in best[r] if found[r, c] >= 0 for near in ids[found[r, c]] if near != some[r][0]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "near", "score"]) if out else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "near", "score"])

    dealt = sent.unionByName(held).select("shard", "g", "id", "v", "blob").repartitionById(parts, F.pmod(F.col("shard") * F.lit(groups) + F.col("g"), F.lit(parts)).cast("int"))
    pairs = dealt.mapInArrow(run, f"query_id {kind}, near {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("near").alias(id_col), "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract: queries are ids divisible by 20, twenty neighbours each."""
    return search(embeddings, F.col("vec_id") % 20 == 0, 20)
