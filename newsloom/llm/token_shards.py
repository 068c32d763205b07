"""Training-order materialisation: fixed-stride token shards in a keyed random order.

Texts become ids, an end id closes each, and ids are cut into sequences of
``length`` (the last one padded). Sequences are numbered 0..N-1 without gaps, in
the order of a hash of document and text; a keyed Feistel network over the next
even power of two, walked along its cycle until it falls below N, sends each
number to a slot of its own. Slots are dealt to partitions by range, and each
partition writes its records one behind the other, all of one stride: a reader
seeks to ``(slot - first) * stride`` in the shard that begins at ``first`` and goes
on from there.

Recovery. Ids are written once to the shared folder, in order; every number
follows from the rows themselves, so a task that runs again makes the same
records, and other splits of the input make the same order. Only the number of
sequences of each partition reaches the driver.

Defined results. A null or empty text has no sequence. Repeated rows each have
their own, side by side in number. A null id is an id like any other. The empty
table has no shard. Very long texts are encoded chunk by chunk and cut into as
many sequences as they need. Further columns are not read, whatever their names.
Key, rows and ``length`` decide the order, nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import portions
from newsloom.llm.pieces import packer
from newsloom.plans.durable import written

LENGTH = 512
SHARD_SLOTS = 4096
#: Ranges of the hash that orders documents; partitions take runs of them, so their number does not show in the order.
BUCKETS = 1 << 16
KEY = b"training order"
ROUNDS = 6
#: Ranges of whole shards that one shuffle deals to; with more shards than that, each range has several.
MOST_PARTS = 65_536


class Permutation:
    """A bijection of 0..n-1 that a key decides."""

    def __init__(self, n: int, key: bytes = KEY):
        self.n = n
        bits = max(2, (max(1, n) - 1).bit_length())
        self.half = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little")) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = x ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _rounds(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = (right ^ self._mix(left, key), left) if back else (right, left ^ self._mix(right, key))
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        out = self._rounds(np.asarray(x, np.uint64), keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._rounds(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def tokens(documents: DataFrame, model_file: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """Written to the shared folder: part, the number of its first sequence within the part, id, and the ids as 16-bit numbers."""
    kind = documents.schema[id_col].dataType.simpleString()
    parts = min(BUCKETS, 8 * max(1, documents.rdd.getNumPartitions()))

    def encode(batches):
        pack, end = packer(model_file)
        for batch in batches:
            for rows in portions(batch):
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([x + end for x in pack(rows.column(3).to_pylist())], pa.binary())], names=["part", "h", "id", "ids"])

    h = F.xxhash64(id_col, text_col)
    part = F.floor(F.pmod(h, F.lit(BUCKETS)) * parts / F.lit(BUCKETS)).cast("int")
    rows = documents.where(F.col(text_col) != "").select(part.alias("part"), h.alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    before = Window.partitionBy("part").orderBy(F.pmod("h", F.lit(BUCKETS)), "h", "id").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.mapInArrow(encode, f"part int, h long, id {kind}, ids binary").withColumn("n", F.ceil(F.length("ids") / (2 * length)))
    return written(held.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n", "id", "ids"), "tokens")


def materialise(documents: DataFrame, model_file: str, length: int = LENGTH, key: bytes = KEY, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sequence, dealt by slot and sorted by it: shard, slot, number, doc_id, seq_no, n_tokens, and the record of ``2 * length`` bytes."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    held = tokens(documents, model_file, length, id_col, text_col)
    sizes = sorted(held.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("n")).collect())
    total = sum(r.n for r in sizes)
    start = dict(zip([r.part for r in sizes], np.cumsum([0, *[r.n for r in sizes]]).tolist(), strict=False))
    starts = spark.sparkContext.broadcast(start)
    stride = 2 * length

    def run(batches):
        order = Permutation(total, key)
        for batch in batches:
            for rows in portions(batch, 256):
                ids, n = rows.column(4).to_pylist(), rows.column(2).to_numpy()
                which = np.repeat(np.arange(len(n)), n)
                base = np.array([starts.value[p] for p in rows.column(0).to_pylist()], np.int64) + rows.column(1).to_numpy()
                seq = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                number = base[which] + seq
                slot = order.slots(number)
                records = [ids[w][s * stride : (s + 1) * stride] for w, s in zip(which.tolist(), seq.tolist(), strict=True)]
                size = np.array([len(r) // 2 for r in records], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // shard_slots), pa.array(slot), pa.array(number), rows.column(3).take(pa.array(which)), pa.array(seq), pa.array(size), pa.array([r.ljust(stride, b"\0") for r in records], pa.binary())],
                    names=["shard", "slot", "number", "id", "seq_no", "n_tokens", "record"],
                )

    out = held.mapInArrow(run, f"shard long, slot long, number long, id {kind}, seq_no long, n_tokens int, record binary")
    shards = max(1, -(-total // shard_slots))
    parts = min(shards, MOST_PARTS)
    return out.repartitionById(parts, F.floor(F.col("shard") * F.lit(parts) / F.lit(shards)).cast("int")).sortWithinPartitions("slot").withColumnRenamed("id", id_col)


def write_shards(records: DataFrame, path: str) -> None:
    """``path``/records: a file for each range of slots, its records of one stride (their bytes and a newline) in slot order;
    ``path``/index: for each file its number, first slot, slots and stride."""
    spark = records.sparkSession
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    files = records.groupBy(F.spark_partition_id().alias("file")).agg(F.min("slot").alias("first"), F.count("*").alias("slots"), (F.max(F.length("record")) + 1).alias("stride"))
    spark.createDataFrame(files.collect(), files.schema).coalesce(1).write.parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str, slot: int = 0, most: int | None = None) -> Iterator[bytes]:
    """The records from ``slot`` on, in order, for one reader: it seeks to the first and reads on, in whatever store Spark can reach."""
    fs = spark._jvm.org.apache.hadoop.fs
    store = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = {int(x.getPath().getName().split("-")[1]): x.getPath() for x in store.listStatus(fs.Path(f"{path}/records")) if x.getPath().getName().startswith("part-")}
    for shard in spark.read.parquet(f"{path}/index").where(F.col("first") + F.col("slots") > slot).orderBy("first").toLocalIterator():
        stream = store.open(names[shard.file])
        try:
            at = max(0, slot - shard.first)
            stream.seek(at * shard.stride)
            while at < shard.slots and most != 0:
                n = min(shard.slots - at, max(1, (1 << 20) // shard.stride), most or shard.slots)
                held = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * shard.stride))
                yield from (held[k * shard.stride : (k + 1) * shard.stride - 1] for k in range(n))
                at += n
                most = most and most - n
        finally:
            stream.close()
