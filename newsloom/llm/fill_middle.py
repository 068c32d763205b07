"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are brought together and verified by content. Each distinct
text's code point boundaries (byte offsets in UTF-8) are listed once, as an
Elias-Fano list; its documents are joined back to it, and each selects its two
seeded cuts from that list, so a cut costs a look at a few bytes of it.

Cuts and forms follow the hex sha256 of ``seed:`` and the decimal doc_id: its
first four groups of eight digits are h1 to h4. With n code points, prefix and
middle end after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1).
A text that is empty or holds a sentinel, and one in ten others (h3), stays
plain; of the rest one in five (h4) goes suffix first (spm), the others prefix
first (psm).

Defined results. A null text counts as empty; a null doc_id is seeded by
``seed:`` alone. Repeated rows come out alike, each in its own row. Texts of any
length are one list, made piece by piece. An empty table gives no row. Further columns are not read,
whatever their names.

At scale: a task first groups a portion of rows by text, so a text that a third
of all documents hold is one row for each portion. Text is shuffled once. A text
with more than ``1 / HOT_PARTS`` of all rows (there are fewer than ``HOT_PARTS``
of those, and only their hashes and counts are collected) is dealt over as many
groups as it has such shares and listed once in each, so its documents are not
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import portions

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HOT_PARTS = 4096
#: Fewer rows than this are never dealt over several groups.
LEAST_HOT = 512
#: Rows of a portion, and bytes of a text that are looked at together.
PORTION, PIECE = 2048, 1 << 20
#: Ones of the upper bits between two entries of the directory, and bytes that a look takes at a time.
STRIDE, LOOK = 256, 256


class Boundaries:
    """An Elias-Fano list of ascending numbers: lower bits packed, upper bits in unary, and a directory of every ``STRIDE``-th one."""

    def __init__(self, chunks: Iterable[np.ndarray], count: int, most: int):
        """``count`` numbers up to ``most``, in chunks, of which only one need stand in memory."""
        self.count, self.low_bits = count, max(0, (most // count).bit_length() - 1)
        self.upper = np.zeros((most >> self.low_bits) + count + 15 >> 3, np.uint8)
        self.lower = np.zeros(count * self.low_bits + 15 >> 3, np.uint8)
        directory, first = [], 0
        for values in chunks:
            ones = (values >> self.low_bits) + np.arange(first, first + len(values))
            begin = int(ones[0]) & ~7
            bits = np.zeros(int(ones[-1]) - begin + 1, np.uint8)
            bits[ones - begin] = 1
            _put(self.upper, begin, bits)
            if self.low_bits:
                begin = first * self.low_bits
                low = ((values[:, None] >> np.arange(self.low_bits)) & 1).astype(np.uint8).ravel()
                _put(self.lower, begin & ~7, np.concatenate([np.zeros(begin & 7, np.uint8), low]))
            directory.append(ones[-first % STRIDE :: STRIDE])
            first += len(values)
        self.directory = np.concatenate(directory)

    def __len__(self) -> int:
        return self.count

    def nbytes(self) -> int:
        return self.upper.nbytes + self.directory.nbytes + self.lower.nbytes

    def __getitem__(self, i: int) -> int:
        one, left = int(self.directory[i // STRIDE]), i % STRIDE
        byte, skip = one >> 3, one & 7
        while True:
            bits = np.unpackbits(self.upper[byte : byte + LOOK])
            bits[:skip] = 0
            places = np.flatnonzero(bits)
            if left < len(places):
                break
            left, byte, skip = left - len(places), byte + LOOK, 0
        value = 8 * byte + int(places[left]) - i << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.lower[bit >> 3]) >> (7 - (bit & 7)) & 1) << k
        return value


def _put(into: np.ndarray, at: int, bits: np.ndarray) -> None:
    """Sets bits from a bit place on that begins a byte."""
    packed = np.packbits(bits)
    into[at >> 3 : (at >> 3) + len(packed)] |= packed


def boundaries(text: bytes) -> Boundaries:
    """The byte offsets at which code points of a UTF-8 text begin, and its end."""
    raw = np.frombuffer(text, np.uint8)
    pieces = range(0, len(raw), PIECE)
    begins = lambda at: (raw[at : at + PIECE] & 0xC0) != 0x80

    def chunks():
        for at in pieces:
            if len(found := np.flatnonzero(begins(at)) + at):
                yield found
        yield np.array([len(raw)])

    return Boundaries(chunks(), 1 + sum(int(np.count_nonzero(begins(at))) for at in pieces), len(raw))


def seeds(seed: int, doc_id) -> list[int]:
    """h1 to h4."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()


def cut(text: bytes, held: Boundaries, h: list[int], plain: bool) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and of middle, and the transformed text."""
    n = len(held) - 1
    if plain or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at, past = held[a], held[b]
    prefix, middle, suffix = text[:at], text[at:past], text[past:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, b"".join((_S, suffix, _P, prefix, _M, middle))
    return "psm", a, b - a, b"".join((_P, prefix, _S, suffix, _M, middle))


def _hot(documents: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of texts with more than a ``1 / HOT_PARTS`` share of the rows (fewer than ``HOT_PARTS``), and over how many groups
    each is dealt so that none has a larger share."""
    counts = documents.groupBy(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h")).count()
    least = max(LEAST_HOT, documents.count() // HOT_PARTS)
    found = sorted((r.h, -(-r["count"] // least)) for r in counts.where(F.col("count") > least).collect())
    return np.array([h for h, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Per row: the id, n (code points), form, prefix_chars, middle_chars and output."""
    kind = documents.schema[id_col].dataType.simpleString()
    hot, spread = _hot(documents, text_col)

    def gathered(batches):
        """Distinct texts of each portion with the ids that hold them."""
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in portions(batch, PORTION):
                coded = pc.cast(part.column(2), pa.large_binary()).dictionary_encode()
                own = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                first = np.searchsorted(own[order], np.arange(len(coded.dictionary) + 1))
                h = part.column(1).to_numpy()[order[first[:-1]]]
                ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), part.column(0).take(pa.array(order)))
                salt = np.zeros(len(h), np.int32)
                for k in np.flatnonzero(np.isin(h, hot)).tolist():
                    salt[k] = task % spread[np.searchsorted(hot, h[k])]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pc.cast(coded.dictionary, pa.binary()), ids], names=["h", "salt", "t", "ids"])
                task += 1

    def cuts(batches):
        """Sorted distinct texts, listed once for each run that is equal in content."""
        last = held = plain = None
        for batch in batches:
            for part in portions(batch, 256):
                out = []
                for text, ids in zip(part.column("t").to_pylist(), part.column("ids").to_pylist(), strict=True):
                    if text != last:
                        last, held = text, boundaries(text)
                        plain = not text or _P in text or _S in text or _M in text
                    out += [(k, len(held) - 1, *cut(text, held, seeds(seed, k), plain)) for k in ids]
                ids, n, form, before, inside, text = zip(*out, strict=True) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.column("ids").type.value_type), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    text = F.coalesce(text_col, F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    distinct = rows.mapInArrow(gathered, f"h long, salt int, t binary, ids array<{kind}>").repartition("h", "salt").sortWithinPartitions("h", "salt", "t")
    return distinct.mapInArrow(cuts, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output, form):
    """The text as a column, rebuilt from a transformed one and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    out = transform(documents.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def brute(doc_id, text: str | None, seed: int = 1) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one document, by slices of the decoded text."""
    t, (h1, h2, h3, h4) = text or "", seeds(seed, doc_id)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}") if h4 % 100 < 20 else (len(t), "psm", a, b - a, f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS x FROM documents),
h AS (SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
