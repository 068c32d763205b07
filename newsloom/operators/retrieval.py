"""Similar articles, and events joined into storylines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import vocab
from newsloom.functions import score as X
from newsloom.functions import text as T
from newsloom.operators import neighbours as N
from newsloom.plans.durable import written
from newsloom.plans.graph import components
from newsloom.plans.joins import top_per

#: Vectors that stand together as one row when all of a table are compared: 0.5 MB at 64 dimensions.
BLOCK_ROWS = 1024
#: Digits to which similarities are told apart.
SIMILARITY_DIGITS = 9


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def packed(rows: DataFrame, prefix: str) -> DataFrame:
    """Blocks of (id, vector, at), a row each: ``{prefix}_ids``, ``_at`` and ``_unit`` as bytes (vectors brought to length
    one), ``_dim``, and ``_lo`` and ``_hi``, the bounds of ``at``. Rows without a vector are in none."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                ids, at, sizes = part.column(0).to_numpy(), part.column(2).to_numpy(), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                flat, ends = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)
                for d in np.unique(sizes).tolist():
                    own = sizes == d
                    unit = flat[np.repeat(own, sizes)].reshape(-1, d)
                    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((ids[own].tobytes(), pa.binary()), (at[own].tobytes(), pa.binary()), (unit.tobytes(), pa.binary()), (d, pa.int32()), (int(at[own].min()), pa.int64()), (int(at[own].max()), pa.int64()))], names=[f"{prefix}_{c}" for c in ("ids", "at", "unit", "dim", "lo", "hi")])

    schema = ", ".join(f"{prefix}_{c} {t}" for c, t in (("ids", "binary"), ("at", "binary"), ("unit", "binary"), ("dim", "int"), ("lo", "long"), ("hi", "long")))
    return rows.where("vector is not null and size(vector) > 0").select("id", "vector", "at").mapInArrow(run, schema)


def _opened(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{prefix}_ids"], np.int64), np.frombuffer(row[f"{prefix}_at"], np.int64), np.frombuffer(row[f"{prefix}_unit"]).reshape(-1, row[f"{prefix}_dim"])


def label_of(category: Column) -> Column:
    """A category as a label that ``neighbours`` compares: what is both topics goes with either; null is none."""
    known = F.create_map(*[x for k, c in enumerate(vocab.CATEGORIES) for x in (F.lit(c), F.lit(N.ANY if c == vocab.BOTH_CATEGORIES else 2 + k))])
    return F.coalesce(known[category], F.lit(N.NONE))


def memory_examples(queries: DataFrame, reviewed: DataFrame, others: DataFrame, k: int, overfetch: int = 3) -> DataFrame:
    """(query_id, id, score, place, reviewed): for each query the nearest rows that a person has labelled; what they lack
    of ``k`` comes from rows that a model has labelled, the usable ones among so many times ``k`` nearest.

    Only the past may answer, as what comes later knows how the story went on: rows from before the query, and reviewed ones
    without a moment; a query without a moment is answered by all. Where a query has a category, reviewed rows must have
    it, or both topics. Rows that may answer as reviewed ones don't answer as a model's. A query without a vector gets
    reviewed rows by titles alone. ``queries``: id, vector, title, at, category; ``reviewed``: id, vector, title, at, category;
    ``others`` (canonical articles): id, vector, at, usable."""
    q_at, label = N.moment(F.col("at"), N.AFTER_ALL), label_of(F.col("category"))
    q, r = N.rows_of(queries, q_at, label), N.rows_of(reviewed, N.undated_first(F.col("at")), label)
    first = N.nearest(q, r, k, past_only=True, rule="labelled").withColumn("reviewed", F.lit(True))
    marked = others.select("id", "vector", "at").join(reviewed.select("id", "category"), "id", "left")
    rest = N.rows_of(marked, N.undated_last(F.col("at")), F.coalesce(F.when(F.col("category").isNotNull(), label), F.lit(N.UNLABELLED)))
    second = N.nearest(q, rest, overfetch * k, past_only=True, rule="rest").join(others.where("usable").select("id"), "id", "left_semi").withColumn("reviewed", F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("reviewed"), F.desc("similarity"), F.asc("id"))
    near = first.unionByName(second).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumnRenamed("similarity", "score")
    blind = queries.where("vector is null or size(vector) = 0").withColumns({"at": q_at, "label": label})
    titled = similar_titles(blind, reviewed.withColumns({"at": N.undated_first(F.col("at")), "label": label}), k, True)
    placed = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return near.unionByName(titled.withColumns({"place": F.row_number().over(placed), "reviewed": F.lit(True)}))


def close_pairs(rows: DataFrame, least: float, seconds: int) -> DataFrame:
    """(l_id, e_id, similarity) of rows (id, vector, at) and earlier ones (ties: of smaller id) no more than ``seconds``
    before, with a cosine of ``least`` or more. Rows stand in blocks in order of time; blocks meet where their times allow,
    by buckets as wide as the radius, and only pairs that are close leave them."""
    radius = 1_000_000 * seconds
    timed = rows.select(F.col("id").cast("long").alias("id"), "vector", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    ordered = timed.where("at is not null and vector is not null").repartitionByRange("at").sortWithinPartitions("at")
    bucket = lambda c: F.floor(F.col(c) / radius)
    late = packed(ordered, "l").withColumn("b", F.explode(F.sequence(bucket("l_lo") - 1, bucket("l_hi"))))
    early = packed(ordered, "e").withColumn("b", F.explode(F.sequence(bucket("e_lo"), bucket("e_hi"))))
    first = F.greatest(bucket("l_lo") - 1, bucket("e_lo"))  # two blocks that share several buckets meet in the first
    met = late.join(early, "b").where((F.col("b") == first) & (F.col("e_lo") <= F.col("l_hi")) & (F.col("e_hi") >= F.col("l_lo") - radius) & (F.col("l_dim") == F.col("e_dim")))

    def run(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                (row,) = batch.slice(lo, 1).to_pylist()
                (l_ids, l_at, l_unit), (e_ids, e_at, e_unit) = _opened(row, "l"), _opened(row, "e")
                s = l_unit @ e_unit.T
                gap = l_at[:, None] - e_at[None, :]
                r, c = np.nonzero((s >= least - 1e-9) & (gap <= radius) & ((gap > 0) | ((gap == 0) & (e_ids[None, :] < l_ids[:, None]))))
                yield pa.RecordBatch.from_arrays([pa.array(l_ids[r]), pa.array(e_ids[c]), pa.array(s[r, c])], names=["l_id", "e_id", "similarity"])

    return met.mapInArrow(run, "l_id long, e_id long, similarity double")


def close_vectors(vectors: DataFrame, least: float, radius: int) -> DataFrame:
    """(l_v, e_v, s): names of vectors with a cosine of ``least`` or more, each with itself, where one of l's moments may lie no more
    than ``radius`` after one of e's. ``vectors``: v, vector, lo, hi (first and last moment), each different vector once. Blocks
    in order of time meet where their times allow."""
    ordered = vectors.select("v", "vector", "lo", "hi").repartitionByRange("lo").sortWithinPartitions("lo")

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                v, first, last = (part.column(c).to_numpy() for c in ("v", "lo", "hi"))
                sizes = pc.list_value_length(part.column("vector")).to_numpy(zero_copy_only=False)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float)
                for d in np.unique(sizes).tolist():
                    own = sizes == d
                    unit = flat[np.repeat(own, sizes)].reshape(-1, d)
                    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
                    yield pa.RecordBatch.from_pylist([{"vs": v[own].tobytes(), "los": first[own].tobytes(), "his": last[own].tobytes(), "unit": unit.tobytes(), "dim": d, "lo": int(first[own].min()), "hi": int(last[own].max())}], schema=block)

    block = pa.schema([(c, pa.binary()) for c in ("vs", "los", "his", "unit")] + [("dim", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
    blocks = written(ordered.mapInArrow(pack, "vs binary, los binary, his binary, unit binary, dim int, lo long, hi long"), "vectors")
    bucket = lambda c: F.floor(F.col(c) / radius)
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    late = side("l").withColumn("b", F.explode(F.sequence(bucket("l_lo") - 1, bucket("l_hi"))))
    early = side("e").withColumn("b", F.explode(F.sequence(bucket("e_lo"), bucket("e_hi"))))
    first = F.greatest(bucket("l_lo") - 1, bucket("e_lo"))  # two blocks that share several buckets meet in the first
    met = late.join(early, "b").where((F.col("b") == first) & (F.col("l_dim") == F.col("e_dim")))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                get = lambda c, r=r: np.frombuffer(r[c], np.int64)
                unit = lambda s, r=r: np.frombuffer(r[f"{s}_unit"]).reshape(-1, r[f"{s}_dim"])
                # the last bits of a product depend on where a row stands in its block
                s = np.round(unit("l") @ unit("e").T, SIMILARITY_DIGITS)
                a, b = np.nonzero((s >= least) & (get("e_los")[None, :] <= get("l_his")[:, None]) & (get("e_his")[None, :] >= get("l_los")[:, None] - radius))
                yield pa.RecordBatch.from_arrays([pa.array(get("l_vs")[a]), pa.array(get("e_vs")[b]), pa.array(s[a, b])], names=["l_v", "e_v", "s"])

    return met.drop("b").mapInArrow(run, "l_v long, e_v long, s double")


#: Titles that stand together as one row, of queries and of candidates, and slots over which blocks of candidates are dealt.
QUERY_TITLES, TITLES, SLOTS = 1024, 4096, 64


def _codes(key: str) -> np.ndarray:
    """The trigrams of a key without spaces (``text.trigrams``) as numbers, three code points of 21 bits each; a shorter key is its own."""
    c = np.frombuffer(key.encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.pad(c, (0, 3 - len(c))) if 0 < len(c) < 3 else c
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _titles(rows: DataFrame, side: str, size: int, postings: bool) -> DataFrame:
    """Titles in blocks, a row each: ids, numbers of trigrams, moments and labels; and the trigrams, title by title or, as
    ``postings``, each with the places of the titles that have it. Titles without trigrams are in none."""
    names = [f"{side}_{c}" for c in ("ids", "sizes", "ats", "labels", "codes", "starts", "places")]

    def pack(held: list[tuple]) -> pa.RecordBatch:
        ids, codes, ats, labels = zip(*held, strict=True)
        sizes = np.array([len(c) for c in codes], np.int32)
        flat, starts, places = np.concatenate(codes), np.zeros(0, np.int32), np.zeros(0, np.int16)
        if postings:
            order = np.argsort(flat, kind="stable")
            places = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)[order]
            flat, first = np.unique(flat[order], return_index=True)
            starts = np.append(first, len(places)).astype(np.int32)
        values = (np.array(ids, np.int64), sizes, np.array(ats, np.int64), np.array(labels, np.int32), flat, starts, places)
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=names)

    def run(batches):
        held = []
        for batch in batches:
            for k, key, at, label in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if key:
                    held.append((k, _codes(key), at, label))
                if len(held) == size:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    key = F.replace(T.title_key(F.col("title")), F.lit(" "), F.lit(""))
    own = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(0)).cast(kind)
    return rows.select(F.col("id").cast("long"), key.alias("key"), own("at", "long").alias("at"), own("label", "int").alias("label")).mapInArrow(run, ", ".join(f"{c} binary" for c in names))


def _closest(q_ids, q_sizes, q_ats, q_labels, q_codes, c, k: int, labelled: bool):
    """Of a block of queries and one of candidates: (query_id, id, score), each query's k best, ties to the smaller id."""
    ids, sizes, ats, labels, codes, starts, places = c
    at = np.minimum(np.searchsorted(codes, q_codes), len(codes) - 1)
    has = codes[at] == q_codes
    lo, hi = starts[at], starts[at + 1]
    ends = np.cumsum(q_sizes)
    for row, end in enumerate(ends):
        own = slice(end - q_sizes[row], end)
        found = [places[a:b] for a, b in zip(lo[own][has[own]].tolist(), hi[own][has[own]].tolist(), strict=True)]
        if not found:
            continue
        shared = np.bincount(np.concatenate(found), minlength=len(ids))
        score = shared / (int(q_sizes[row]) + sizes - shared)
        score[ids == q_ids[row]] = 0.0
        if labelled:
            score[(ats >= q_ats[row]) | ((q_labels[row] != N.NONE) & (labels != N.ANY) & (labels != q_labels[row]))] = 0.0
        least = np.partition(score, -k)[-k] if len(score) > k else 0.0
        best = np.flatnonzero((score >= least) & (score > 0.0))
        for x in best[np.lexsort((ids[best], -score[best]))][:k].tolist():
            yield int(q_ids[row]), int(ids[x]), float(score[x])


def similar_titles(queries: DataFrame, candidates: DataFrame, k: int, labelled: bool = False) -> DataFrame:
    """C11 without vectors: (query_id, id, score), each query's k titles of most similar trigrams, no floor (Q5) but for titles that
    share none; ties to the smaller id. ``labelled`` lets only candidates from before a query (``at``) answer whose ``label`` goes
    with the query's, as ``label_of`` gives them.

    Queries meet all candidates by nature, block by block: a block of candidates is a list of titles for each trigram, a query adds
    up those of its own, and only its k best of a block leave it. Candidates stand in one slot each, queries in every slot."""
    types = (np.int64, np.int32, np.int64, np.int32, np.int64, np.int32, np.int16)
    q = _titles(queries, "q", QUERY_TITLES, False).drop("q_starts", "q_places").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    c = _titles(candidates, "c", TITLES, True).withColumn("slot", F.pmod(F.xxhash64("c_ids"), F.lit(SLOTS)).cast("int"))

    def run(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                part = batch.slice(lo, 1)
                get = lambda side, names, part=part: [np.frombuffer(part.column(f"{side}_{c}")[0].as_py(), t) for c, t in zip(names, types, strict=False)]
                out = list(_closest(*get("q", ("ids", "sizes", "ats", "labels", "codes")), get("c", ("ids", "sizes", "ats", "labels", "codes", "starts", "places")), k, labelled))
                cols = list(zip(*out, strict=True)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    found = q.join(c, "slot").drop("slot").mapInArrow(run, "query_id long, id long, score double")
    return top_per(found, ["query_id"], k, F.desc("score"), F.asc("id"))


def link_strength(similarity: Column, shared: Column, same_topic: Column) -> Column:
    """Null where not linked, else closer text and more shared items win; text that is not close counts for nothing."""
    s = F.coalesce(similarity, F.lit(0.0))
    linked = (s >= 0.85) | ((s >= 0.75) & (shared >= 1)) | ((shared >= 2) & same_topic)
    return F.when(linked, s + 0.1 * shared)


def storied(events: DataFrame) -> DataFrame:
    """What may belong to a storyline: of a category other than '' and other, and not withdrawn."""
    return events.where("coalesce(category, '') not in ('', 'other') and status <> 'withdrawn'")


#: Events of a stretch of time that seek in one task.
STRETCH_EVENTS = 65_536


def storylines(events: DataFrame, tags: DataFrame, days: int = 14) -> DataFrame:
    """(event_id, storyline_id) of linked events; a storyline is named by its smallest event.

    Every event goes where its strongest earlier event is (ties: the earliest), and that choice does not depend on where
    others went: so storylines are the trees of those choices, which components give without walking events in order.
    ``events``: id, event_time, category, vector (or null); ``tags``: event_id, item.

    Vectors are compared once for each different one (``close_vectors``). Events then travel with the name of their vector, those
    that are close to it, their topic and items, to the stretches of time that may need them, where each finds its strongest
    (``_strongest``): no pair of events leaves a task.
    """
    radius = 1_000_000 * days * 86_400
    named = tags.where("item is not null").groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    timed = events.where("event_time is not null").withColumns({"at": F.unix_micros(F.col("event_time").cast("timestamp")), "topic": X.event_topic(F.col("category")), "vector": F.when(F.size("vector") > 0, F.col("vector"))})
    timed = timed.withColumn("v", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    vectors = timed.where("v is not null").groupBy("v", "vector").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    near = close_vectors(vectors, 0.75, radius).groupBy("l_v").agg(F.collect_list(F.struct("e_v", "s")).alias("near"))
    known = timed.select(F.col("id").cast("long").alias("id"), "at", "topic", "v").join(named, "id", "left").join(near.withColumnRenamed("l_v", "v"), "v", "left")
    placed = written(known.withColumn("own", F.floor(F.col("at") / radius)), "storied")
    parts = placed.groupBy(F.col("own").alias("bucket")).agg(F.ceil(F.count("*") / STRETCH_EVENTS).cast("int").alias("parts"))
    ahead = placed.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1))).join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seeks = (F.col("bucket") == F.col("own")) & (F.col("part") == F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = ahead.select("bucket", "part", "at", "id", "topic", "v", "items", F.when(seeks, F.coalesce("near", F.array().cast("array<struct<e_v:long,s:double>>"))).alias("near"))
    parent = _strongest(dealt, radius)
    return components(parent, "l_id", "e_id").select(F.col("node").alias("event_id"), F.col("component").alias("storyline_id"))


def _strongest(dealt: DataFrame, radius: int) -> DataFrame:
    """(l_id, e_id): of each event that seeks (``near`` is set) the strongest earlier one in its stretch of time, by ``link_strength``.
    ``dealt``: bucket, part, at, id, topic, v, items, near. Text that is close is looked at vector by vector; shared items alone
    only for events that have more than would lose to what was found."""

    def of(group: pa.Table):
        at, ids = group.column("at").to_numpy(), group.column("id").to_numpy()
        order = np.lexsort((ids, at))
        group, at, ids = group.take(pa.array(order)), at[order], ids[order]
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        v = whole(group.column("v"))
        has_v, v = v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy(zero_copy_only=False)
        topic = whole(group.column("topic")).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        items = whole(group.column("items"))
        sizes = pc.list_value_length(items).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = items.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        seeks = whole(group.column("near")).is_valid().to_numpy(zero_copy_only=False)
        first, slot = np.searchsorted(at, at - radius), np.full(int(flat.max()) + 1 if len(flat) else 1, -1)

        def entries(rows):
            n = sizes[rows]
            place = np.repeat(np.arange(len(rows)), n)
            return place, flat[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[rows], n)]

        def shared(left, right):
            place, what = entries(left)
            used = np.unique(what)
            if not len(used):
                return np.zeros((len(left), len(right)), np.float32)
            slot[used] = np.arange(len(used))
            a, b = np.zeros((len(left), len(used)), np.float32), np.zeros((len(right), len(used)), np.float32)
            a[place, slot[what]] = 1
            place, what = entries(right)
            own = slot[what] >= 0
            b[place[own], slot[what[own]]] = 1
            slot[used] = -1
            return a @ b.T

        best, found = np.zeros(len(ids)), np.full(len(ids), -1)

        def meet(left, right, s):
            """Takes for ``left`` the strongest of ``right`` (places in order), of similarities ``s``, where stronger or as strong and earlier."""
            for lo in range(0, len(left), n := max(1, 2_000_000 // len(right))):
                some = left[lo : lo + n]
                n_shared = shared(some, right).astype(np.float64)
                same = (topic[some][:, None] == topic[right][None, :]) & (topic[some] >= 0)[:, None]
                linked = (s >= 0.85) | ((s >= 0.75) & (n_shared >= 1)) | ((n_shared >= 2) & same)
                past = (right[None, :] >= first[some][:, None]) & (right[None, :] < some[:, None])
                strength = np.where(linked & past, s + 0.1 * n_shared, 0.0)
                k = strength.argmax(1)
                most = strength[np.arange(len(some)), k]
                better = (most > best[some]) | ((most == best[some]) & (most > 0) & (right[k] < found[some]))
                best[some[better]], found[some[better]] = most[better], right[k[better]]

        looking = np.flatnonzero(seeks & has_v)
        by_v = np.argsort(v, kind="stable")
        by_v = by_v[has_v[by_v]]
        held = v[by_v]
        for part in np.split(order_ := looking[np.argsort(v[looking], kind="stable")], np.flatnonzero(np.diff(v[order_])) + 1) if len(looking) else ():
            near = group.column("near")[int(part[0])].as_py()
            places = [by_v[np.searchsorted(held, x["e_v"]) : np.searchsorted(held, x["e_v"], "right")] for x in near]
            if not near or not sum(map(len, places)):
                continue
            right, s = np.concatenate(places), np.repeat([x["s"] for x in near], [len(x) for x in places])
            along = np.argsort(right)
            meet(part, right[along], s[along])
        rest = np.flatnonzero(seeks & (sizes >= 2) & (0.1 * sizes >= best - 1e-9))
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            right = np.arange(first[some].min(), some.max() + 1)
            meet(some, right, np.zeros(len(right)))
        out = np.flatnonzero(found >= 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[found[out]])], names=["l_id", "e_id"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            key = np.stack([batch.column("bucket").to_numpy(), batch.column("part").to_numpy().astype(np.int64)])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and tuple(key[:, lo]) != now:
                    yield of(pa.Table.from_batches(held))
                    held = []
                now = tuple(key[:, lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield of(pa.Table.from_batches(held))

    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, "l_id long, e_id long")
