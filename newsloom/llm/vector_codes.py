"""Vector code compression by product quantisation in exact integers.

Each component x becomes floor(4096 * x), and a vector falls into equal parts.
Every part position has a codebook of integer entries, broadcast each round; an
Arrow batch finds all its distances as |x|^2 - 2 x.c + |c|^2 by int64 matrix
products and takes the first least one. A task sums the parts of each entry, a
grouped shuffle adds those sums, and an entry becomes the componentwise floor of
its mean; an entry without parts stays.

Defined results. Vectors that are null, or hold null or non-finite components,
give no row; nor do empty ones, or ones whose length is not that of the vector
with the smallest vec_id or no multiple of the parts. A component of 2^15 or
more would leave exact int64 and ends in an error. Codebooks start from the
smallest distinct vec_ids that are not null (of repeated ones, from the
smallest vector); where those are fewer than the entries, there are fewer
entries. Rows with a null or repeated vec_id are coded like all others. An empty
table gives no row. Further columns are not read, whatever their names.

At scale: a round reads the vectors once and shuffles a row for each task and
used entry; the driver sees one row for each entry (128 by default). The errors
of a label are summed before the shuffle and joined back from a table, whose
skewed side Spark splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import portions
from newsloom.plans.durable import scratch, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Scaled components stay below this, so that distances and their sum over the parts are exact in 64 bits.
MOST = 1 << 27


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, x) that take part, as far as their components decide."""
    x = F.col(vector_col)
    infinite = F.lit(float("inf"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(x.isNotNull() & (F.size(x) > 0) & ~bad)


def whole(column: pa.Array) -> np.ndarray:
    """Vectors of one length as integers."""
    x = np.floor(pc.cast(column.flatten(), pa.float64()).to_numpy() * SCALE)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component of {MOST // SCALE} or more is beyond exact codes")
    return x.astype(np.int64).reshape(len(column), -1)


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of every part of ``x`` (rows, parts, width) in ``book`` (parts, entries, width), and the squared distance to it."""
    least, error = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        own, entries = x[:, p], book[p]
        away = (own * own).sum(1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(1)[None, :]
        least[:, p] = away.argmin(1)
        error[:, p] = away.min(1)
    return least, error


def _first(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks to start with: (parts, entries, width); None without vectors."""
    ids = [r.id for r in rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    taken = [r.x for r in rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()]
    taken = [x for x in taken if len(x) == len(taken[0])]
    if not taken or len(taken[0]) % parts:
        return None
    start = whole(pa.array(taken, pa.list_(pa.float64())))
    return np.ascontiguousarray(start.reshape(len(taken), parts, -1).swapaxes(0, 1))


def _summed(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = book.shape
    held = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        book = held.value
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for part in portions(batch, 4096):
                x = whole(part.column(0)).reshape(-1, parts, width)
                at = (assign(x, book)[0] + entries * np.arange(parts)).ravel()
                order = np.argsort(at, kind="stable")
                own = np.bincount(at, minlength=parts * entries)
                used = np.flatnonzero(own)
                total[used] += np.add.reduceat(x.reshape(-1, width)[order], (np.cumsum(own) - own)[used])
                count += own
        used = np.flatnonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), sums], names=["entry", "n", "sums"])

    sums = rows.select("x").mapInArrow(run, "entry int, n long, sums array<long>")
    # A mean lies among its components, so a sum of more than 2^63 / 2^27 parts of one entry is added as decimals.
    merged = sums.groupBy("entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    out = book.reshape(-1, width).copy()
    for r in merged.collect():
        out[r.entry] = [int(r[f"s{k}"]) // int(r.n) for k in range(width)]
    held.destroy()
    return out.reshape(book.shape)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> np.ndarray | None:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over all vectors; None where no vector takes part."""
    rows = _kept(vectors, id_col, vector_col, label_col)
    book = _first(rows, parts, entries)
    if book is not None:
        rows = rows.where(F.size("x") == book.shape[0] * book.shape[2])
        for _ in range(rounds):
            book = _summed(rows, book)
    return book


def encode(vectors: DataFrame, book: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: its id, label, codes (the entry of every part) and error."""
    parts, _, width = book.shape
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    held = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for batch in batches:
            for part in portions(batch, 4096):
                codes, error = assign(whole(part.column(2)).reshape(-1, parts, width), held.value)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int32).ravel()), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(error.sum(1))], names=["id", "label", "codes", "error"])

    rows = _kept(vectors, id_col, vector_col, label_col).where(F.size("x") == parts * width)
    out = rows.mapInArrow(run, f"id {types[id_col]}, label {types[label_col]}, codes array<int>, error long")
    return out.withColumnsRenamed({"id": id_col, "label": label_col})


def decode(codes: DataFrame, book: np.ndarray, codes_col: str = "codes") -> DataFrame:
    """``codes`` with the vector that they stand for, as ``decoded``."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(c) / SCALE) for c in entry]) for entry in part]) for part in book])
    return codes.withColumn("decoded", F.flatten(F.transform(codes_col, lambda c, p: entries[p][c])))


def sha(book: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's row for each vector that takes part."""
    vectors = vectors.select("vec_id", "embedding", "label")
    book = fit(vectors)
    if book is None:
        empty = "vec_id {vec_id}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty.format(vec_id=vectors.schema["vec_id"].dataType.simpleString()))
    hexes = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    with scratch(vectors.sparkSession, "codes") as folder:
        coded = written(encode(vectors, book).select("vec_id", "label", hexes.alias("code"), "error"), "coded", folder)
        labels = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels", folder)
        out = coded.join(labels, coded["label"].eqNullSafe(labels["of"])).select("vec_id", "code", "error", "label_error", F.lit(sha(book)).alias("codebooks_sha256"))
        return written(out, "vector-codes")


def brute(rows: list[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[tuple], str]:
    """(vec_id, code, error, label_error) of the rows (vec_id, vector, label), sorted, and the digest of the codebooks, with Python's integers."""
    kept = [(k, [int(np.floor(float(c) * SCALE)) for c in x], label) for k, x, label in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    by_id: dict = {}
    for k, x, _ in kept:
        if k is not None:
            by_id[k] = min(by_id.get(k, x), x)
    start = [by_id[k] for k in sorted(by_id)[:entries]]
    kept = [r for r in kept if start and len(r[1]) == len(start[0])]
    width = len(start[0]) // parts if start else 0
    books = [[x[p * width : p * width + width] for x in start] for p in range(parts)]

    def near(p: int, x: list[int]) -> tuple[int, int]:
        own = x[p * width : p * width + width]
        return min((sum((a - b) ** 2 for a, b in zip(own, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for _, x, _ in kept:
                members.setdefault(near(p, x)[1], []).append(x[p * width : p * width + width])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[p])]
    found = [(k, [near(p, x) for p in range(parts)], label) for k, x, label in kept]
    by_label: dict = {}
    for _, ds, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in ds)
    flat = [c for part in books for entry in part for c in entry]
    out = [(k, "".join(f"{e:02x}" for _, e in ds), sum(d for d, _ in ds), by_label[label]) for k, ds, label in found]
    return sorted(out, key=repr), hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def _sql() -> str:
    out = [
        """WITH v AS (SELECT vec_id, label, embedding AS e, len(embedding) // 8 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        """x AS MATERIALIZED (SELECT vec_id, label, (k - 1) // w AS part, (k - 1) % w AS place, CAST(floor(4096 * CAST(e[k] AS DOUBLE)) AS BIGINT) AS x FROM v, unnest(range(1, 8 * w + 1)) AS t(k))""",
        """c0 AS MATERIALIZED (SELECT part, entry, place, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16) USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS away FROM x JOIN c{r} USING (part, place) GROUP BY vec_id, part, entry)")
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, entry, away FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY away, entry) = 1)")
        if r < ROUNDS:
            out.append(f"s{r} AS (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY part, entry, place)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, place, CAST(coalesce((s - ((s % n) + n) % n) // n, c) AS BIGINT) AS c FROM c{r} LEFT JOIN s{r} USING (part, entry, place))")
    return (
        ",\n".join(out)
        + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{ROUNDS}) AS codebooks_sha256
FROM f JOIN v USING (vec_id)
"""
    )


SQL = _sql()
