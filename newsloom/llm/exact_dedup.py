"""Exact dedup by deterministic block naming.

A text, A-Z in lower case, falls into blocks of ``BLOCK`` bytes. Distinct blocks
are sorted and their places in that order are integer names; then the names of
adjacent blocks are paired and distinct pairs are named in the same way, level
by level, until a document has one name. Level and name are the document's
identity. Names stand for contents, never for hashes, so two texts have the same
identity if and only if they are equal.

Defined results. A null text counts as empty; all empty texts are one group. Of
equal texts the row with the largest doc_id stays, a null doc_id counting as the
smallest; of rows repeated under that doc_id one stays, whichever is read first.
Very long texts are named block by block, in as many rounds as the number of
their blocks has binary digits. An empty table gives no row. Further columns
are not read, whatever their names.

At scale: a task names the blocks of a portion of rows locally, so a block that
a third of all documents share is one row for each portion. Text is shuffled
once, dealt by content and sorted on disk; above that only integers travel. A
text's blocks are sent back by portion and pairs by equi-joins whose skewed side
Spark splits; groups are counted with partial sums and joined back from a table.

``documents`` must give the same rows in the same tasks when computed again,
as a table read from files or from a checkpoint does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import portions
from newsloom.llm.names import free
from newsloom.plans.durable import scratch, written

BLOCK = 4096
#: Rows of a portion, and the bits that count them; portions of a task take the next 26.
PORTION_BITS = 12
_TASK_BITS = 26
#: Parts in which pairs are put in order for naming.
BUCKETS = 4096
#: Names of a task of the first level.
_NAME_BITS = 38

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, A-Z in lower case, and where each text begins and ends."""
    column = pc.cast(column, pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    text = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    return _LOWER[text], ends - ends[0]


def _blocks(text: np.ndarray, ends: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """All blocks as an Arrow column, and where each text's blocks begin and end among them; an empty text has one empty block."""
    count = np.maximum(1, -(-np.diff(ends) // size))
    first = np.concatenate([[0], np.cumsum(count)])
    begins = np.repeat(ends[:-1], count) + size * (np.arange(first[-1]) - np.repeat(first[:-1], count))
    offsets = np.concatenate([begins, ends[-1:]]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), first.astype(np.int32)


def _read(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Two kinds of rows: distinct blocks of a portion with their places in it, and documents with the places of their blocks.
    ``row`` numbers documents; of a block, it is the number of its portion's first."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        at = TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            for part in portions(batch, 1 << PORTION_BITS):
                text, ends = _lowered(part.column(1))
                blocks, first = _blocks(text, ends, size)
                coded = blocks.dictionary_encode()
                held = pc.cast(coded.dictionary, pa.binary())
                deal = np.array([xxhash.xxh3_64_intdigest(b) for b in held.to_pylist()], np.uint64).view(np.int64)
                n, start, lone = len(held), at << PORTION_BITS, pa.nulls
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(deal), pa.array(np.full(n, start)), held, pa.array(np.arange(n, dtype=np.int32)), lone(n, ids.type), lone(n, pa.list_(pa.int32())), lone(n, pa.binary())],
                    names=["deal", "row", "block", "place", "id", "places", "sha"],
                )
                n, view = len(ids), memoryview(text)
                sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                rows = start + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(rows), lone(n, pa.binary()), lone(n, pa.int32()), ids, pa.ListArray.from_arrays(pa.array(first), coded.indices), pa.array(sha, pa.binary())],
                    names=["deal", "row", "block", "place", "id", "places", "sha"],
                )
                at += 1

    named = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return named.mapInArrow(run, f"deal long, row long, block binary, place int, id {kind}, places array<int>, sha binary")


def _name(read: DataFrame) -> DataFrame:
    """Blocks dealt by content and sorted, each replaced by its place in that order; documents pass through."""
    kind = read.schema["id"].dataType.simpleString()

    def run(batches):
        name, last = (TaskContext.get().partitionId() << _NAME_BITS) - 1, None
        for batch in batches:
            block, columns = batch.column("block"), [batch.column(c) for c in ("row", "place", "id", "places", "sha")]
            names = np.zeros(len(block), np.int64)
            held = block.null_count  # nulls are sorted to the front
            if held < len(block):
                own = block.slice(held)
                new = np.ones(len(own), bool)
                new[0] = own[0].as_py() != last
                if len(own) > 1:
                    new[1:] = pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)
                names[held:] = name + np.cumsum(new)
                name, last = int(names[-1]), own[-1].as_py()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, mask=np.arange(len(block)) < held)], names=["row", "place", "id", "places", "sha", "name"])

    return read.repartition("deal").sortWithinPartitions("block").mapInArrow(run, f"row long, place int, id {kind}, places array<int>, sha binary, name long")


def _paired(level: DataFrame) -> DataFrame:
    """The next level of (row, at, n, name): pairs of adjacent names, distinct pairs sorted and numbered; an odd last name pairs with -1."""
    odd = F.col("at").bitwiseAND(1) == 1
    pairs = level.groupBy("row", F.shiftright("at", 1).alias("at"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
        F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).cast("long").alias("b")
    )
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("a", "b"))
    names = pairs.select("a", "b").distinct().withColumn("bucket", bucket).select("a", "b", (place.cast("long") * BUCKETS + F.col("bucket")).alias("name"))
    return pairs.join(names, ["a", "b"]).select("row", "at", "n", "name")


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 (of the text in lower case)."""
    spark = documents.sparkSession
    with scratch(spark, "exact") as folder:
        known = written(_name(_read(documents, id_col, text_col, block)), "blocks", folder)
        rows = known.where("places is not null").select("row", "id", "places", "sha")
        portion = F.shiftright("row", PORTION_BITS).alias("portion")
        names = known.where("name is not null").select(portion, "place", "name")
        seats = rows.select("row", portion, F.size("places").alias("n"), F.posexplode("places").alias("at", "place"))
        level = written(seats.join(names, ["portion", "place"]).select("row", "at", "n", "name"), "level", folder)
        most = level.agg(F.max("n")).first()[0] or 1
        done = [level.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
        for k in range(1, (most - 1).bit_length() + 1):
            level = written(_paired(level.where("n > 1")), "level", folder)
            done.append(level.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
        one = done[0]
        for more in done[1:]:
            one = one.unionByName(more)
        one = written(one.join(rows.select("row", "id", "sha"), "row"), "identities", folder)
        same = one.groupBy("level", "name").agg(F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("stays")).where("size > 1")
        same = written(same, "groups", folder)
        alone = F.col("size").isNull()
        out = one.join(same, ["level", "name"], "left").select(
            F.col("id").alias(id_col),
            F.when(alone, F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("row") == F.col("stays.row"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        return written(out, "exact-groups")


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each group, all its columns as they were."""
    text = free("text_sha256", documents.columns)
    keys = groups(documents, id_col, text_col).where("kept").select(F.col(id_col).alias("k_id"), F.col("text_sha256").alias("k_sha"))
    normal = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = documents.withColumn(text, F.sha2(normal.cast("binary"), 256))
    stay = rows.join(keys, rows[id_col].eqNullSafe(F.col("k_id")) & (rows[text] == F.col("k_sha")), "left_semi")
    return stay.dropDuplicates([id_col, text]).select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return groups(documents.select("doc_id", "text"))


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept count of that doc_id, sha) of each row, sorted, by a dictionary of whole texts."""
    same: dict[bytes, list] = {}
    for k, t in rows:
        same.setdefault((t or "").encode().translate(bytes(_LOWER)), []).append(k)
    out = []
    for t, ids in same.items():
        keep = max(ids, key=lambda k: (k is not None, k or 0))
        out += [(k, keep, len(ids), hashlib.sha256(t).hexdigest()) for k in ids]
    return sorted(out, key=repr)


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
