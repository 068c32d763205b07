"""Exact substring dedup with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier,
in a document of smaller doc_id or further up in its own. Strings are judged on
the input; matches never cross documents.

Sorting every suffix of a corpus in one order is out of reach, and most of them
meet no equal. So text is cut where its content says, and only what can repeat
is sorted:

1. Anchors. In each string of LENGTH bytes, the positions of the least hash of
   ``GRAM`` bytes are anchors, so equal strings have equal anchors at equal
   places. An anchor's snippet is all of the strings whose least hash it is,
   which follow each other: up to LENGTH - GRAM bytes to the left, LENGTH to the
   right. Snippets alike, byte for byte, are later copies but for the first: all
   of their bytes go.
2. Shards. Anchors whose hash has several different snippets are dealt by the
   hash. A shard sorts the suffixes of its snippets (Larsson-Sadakane
   refinement, up to LENGTH bytes and within a snippet),
   takes common prefixes by Kasai's rule in all snippets in step, and in each
   run of suffixes that share LENGTH bytes all but the earliest are later
   copies.
3. Merging. An anchor with more than ``SHARD_SNIPPETS`` snippets is dealt over
   several shards; each gives its distinct strings, sorted, with the earliest
   start, and the sorted runs are merged by binary search.

Defined results. Texts are UTF-8 bytes; null is empty. Fewer than LENGTH bytes
have no such string. A doc_id is a number; null counts as the smallest. Rows
alike in doc_id and text are one document, each row with its result; texts that
differ under one doc_id are ordered by a hash of the text. Overlaps count, within
a document too. An empty table gives no row. Very long texts are read in pieces.
Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm import bloom
from newsloom.llm.arrow import as_bytes, portions
from newsloom.llm.bloom import mix
from newsloom.plans.durable import written

LENGTH = 100
GRAM = 24
SHARD_SNIPPETS = 8192
#: Bytes of a text whose anchors are sought at once, about 72 times as many of memory.
PIECE = 1 << 20
BLOOM_BITS = 1 << 27
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8, 16)]


def suffix_array(text: np.ndarray, left: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Positions of the suffixes of ``text`` (uint8) in order, by Larsson-Sadakane refinement: after a first ranking by as
    many bytes as a number holds, only groups that are still tied are sorted, by the rank of what stands as far ahead as
    is known.

    With ``left`` (for each position, the bytes to the end of its piece of the text) and ``depth``, only the suffixes with
    ``depth`` bytes left, in order of those bytes and then of place. A round passes over what has fewer bytes left than it
    ranks by: nothing that has enough looks at it again."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    if left is None:
        left, depth = np.full(n, n), n
    bits = n.bit_length()
    packed, low = 3 * bits < 64, (1 << bits) - 1
    # the bytes that occur, numbered from 1; 0 stands past the end
    used = np.bincount(text, minlength=256) > 0
    code = np.cumsum(used)
    width = int(code[-1]).bit_length()
    h = min((63 - bits) // width, depth)
    padded = np.concatenate([code[text], np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << width) | padded[k : k + n]
    pos = np.flatnonzero(left >= h)
    known = np.sort((key[pos] << bits) | pos)
    pos, known = known & low, known >> bits
    place = np.arange(len(pos))
    rank = np.zeros(n + 1, np.int32)  # from 1; past the end 0
    while len(pos):
        starts = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
        sizes = np.diff(starts, append=len(pos))
        was = np.repeat(place[starts] + 1, sizes)
        rank[pos] = was
        if h >= depth:
            break
        step = min(h, depth - h)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes) & (left[pos] >= h + step))
        # a group's places are its own, also if some of it is passed over
        pos, place = pos[tied], place[tied]
        known = (was[tied] << bits) | rank[np.minimum(pos + step, n)]
        if packed:  # rank, rank ahead and position in one number: sorting it needs no index
            known = np.sort((known << bits) | pos)
            pos, known = known & low, known >> bits
        else:
            order = np.argsort(known)
            pos, known = pos[order], known[order]
        h += step
    whole = np.flatnonzero(left >= depth)
    return np.sort((rank[whole].astype(np.int64) << bits) | whole) & low


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in ``order`` but the first, the bytes (``most`` at most) that its suffix shares with the one before.

    Kasai's rule: going from a position to the next, no more than one byte of the common prefix is lost, if what follows
    the one before is in the order too, and still before. (It may be missing, or behind where ties were ordered by place.)
    The positions in the order are runs (from ``begins``, ``sizes`` long), which each go from left to right, all in step.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.full(n + 1, n)
    place[order] = np.arange(len(order))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray(n + 1, ">u8", padded, strides=(1,)).astype(np.uint64)  # the eight bytes from each position on
    limits = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
    shared = np.zeros(n, np.int32)
    by_size = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by_size], sizes[by_size]
    carry = np.zeros(len(begins), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        at = begins[:live] + step
        other = before[at]
        h = np.where(other < 0, 0, np.maximum(carry[:live] - 1, 0))
        going = np.flatnonzero((other >= 0) & (h < most))
        while len(going):
            x, y = at[going] + h[going], other[going] + h[going]
            differ = eight[np.minimum(x, n)] ^ eight[np.minimum(y, n)]
            grown = np.minimum(8 - np.searchsorted(limits, differ, side="right"), np.minimum(n - x, n - y))
            h[going] += grown
            going = going[(grown == 8) & (h[going] < most)]
        h = np.minimum(h, most)
        carry[:live] = np.where(place[other + 1] < place[at + 1], h, 0)
        shared[at] = h
    return shared[order[1:]]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The positions of anchors, their hashes, and their snippets [a, b); of long texts piece by piece, each with all the
    strings that hold its positions."""
    if len(text) <= PIECE:
        return _anchors(text)
    found = []
    for lo in range(0, len(text), PIECE):
        begin = max(0, lo - LENGTH)
        at, h, a, b = _anchors(text[begin : lo + PIECE + 2 * LENGTH])
        own = (at + begin >= lo) & (at + begin < lo + PIECE)
        found.append((at[own] + begin, h[own], a[own] + begin, b[own] + begin))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(text), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    x1 = _BYTE[np.frombuffer(text, np.uint8)]
    x2 = x1[:-1] + _P[0] * x1[1:]
    x4 = x2[:-2] + _P[1] * x2[2:]
    x8 = x4[:-4] + _P[2] * x4[4:]
    x16 = x8[:-8] + _P[3] * x8[8:]
    h = mix(x16[: n - GRAM + 1] + _P[4] * x8[16 : 16 + n - GRAM + 1])

    def sliding(x: np.ndarray, f) -> np.ndarray:
        k = 1
        while 2 * k <= width:
            x = f(x[:-k], x[k:])
            k *= 2
        return f(x[: len(x) - (width - k)], x[width - k :])

    least = sliding(h, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    served = sliding(np.concatenate([edge, least, edge]), np.maximum)
    at = np.flatnonzero(served == h)
    name = h[at]
    # The strings in a row with one least hash are a run. Runs and the anchors that they have come in the same order, and
    # neighbours among the runs differ in the hash; a run's anchors, if the hash is there again, share its strings.
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    run = np.cumsum(np.concatenate([[False], name[1:] != name[:-1]]))
    past = np.append(starts[1:], len(least))
    return at, name, np.maximum(starts[run], at - (width - 1)), np.minimum(past[run] - 1, at) + LENGTH


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where they touch, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # ends count only within a document
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) << 40
    reach = np.maximum.accumulate(base + end)
    first = np.concatenate([[True], (base + start)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], (reach - base)[last]


def _snippets(rows: list[bytes | None], wanted=None):
    """Of each text, its anchors: (row, anchor, hash, first byte, past the last, hash of the snippet); of all, or of
    those whose hash is ``wanted``."""
    which, at, name, a, b, f = [], [], [], [], [], []
    for i, text in enumerate(rows):
        q, h, lo, hi = anchors(text or b"")
        if wanted is not None and len(q):
            keep = wanted(h)
            q, h, lo, hi = q[keep], h[keep], lo[keep], hi[keep]
        if not len(q):
            continue
        which.append(np.full(len(q), i))
        at.append(q)
        name.append(h)
        a.append(lo)
        b.append(hi)
        digest = xxhash.xxh3_64_intdigest
        f.append(np.fromiter((digest(text[x:y], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (q - lo).tolist(), strict=True)), np.uint64, len(q)))
    if not which:
        return None
    return tuple(map(np.concatenate, (which, at, name, a, b, f)))


def occurrences(documents: DataFrame) -> DataFrame:
    """(h, f, id, kid, a, b, own): each anchor's snippet [a, b) once in a batch, its earliest there; own marks bytes that
    a batch knows to be a later copy of its own."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, 1024):
                ids, kids = part.column(0).to_numpy(), part.column(1).to_numpy()
                found = _snippets(as_bytes(part.column(2)))
                if found is None:
                    continue
                which, _, h, a, b, f = found
                place = np.empty(len(ids), np.int64)
                place[np.lexsort((kids, ids))] = np.arange(len(ids))
                order = np.lexsort((a, place[which], f, h))
                which, h, a, b, f = (x[order] for x in (which, h, a, b, f))
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
                group = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = ~new & ((ids[which] != ids[which[group]]) | (kids[which] != kids[which[group]]) | (a != a[group])) & (b - a >= LENGTH)
                w, x, y = _merged(which[later], a[later], b[later])
                own = np.concatenate([np.zeros(new.sum(), bool), np.ones(len(w), bool)])
                which, a, b = (np.concatenate(z) for z in ((which[new], w), (a[new], x), (b[new], y)))
                spread = mix(kids[w].view(np.uint64) + x.astype(np.uint64))
                h, f = np.concatenate([h[new], spread]), np.concatenate([f[new], spread])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[which]), pa.array(kids[which]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(own)], names=["h", "f", "id", "kid", "a", "b", "own"])

    return documents.select("id", "kid", "text").mapInArrow(run, "h long, f long, id long, kid long, a int, b int, own boolean")


def texts(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """(h, f, snippet) of the hashes in ``mixed``, once in a batch."""
    # what passes by mistake meets no first snippet and falls out
    held = bloom.gather(mixed, BLOOM_BITS)

    def run(batches):
        for batch in batches:
            for part in portions(batch, 1024):
                rows = as_bytes(part.column(0))
                found = _snippets(rows, lambda h: bloom.may_hold(held.value, h))
                if found is None:
                    continue
                which, _, h, a, b, f = found
                _, at = np.unique(h ^ mix(f), return_index=True)
                cut = [rows[i][x:y] for i, x, y in zip(which[at].tolist(), a[at].tolist(), b[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(f[at].view(np.int64)), pa.array(cut, pa.binary())], names=["h", "f", "snippet"])

    return documents.select("text").mapInArrow(run, "h long, f long, snippet binary")


def sorted_strings(pieces: list[bytes], ids: np.ndarray, kids: np.ndarray, a: np.ndarray):
    """Per string of LENGTH bytes in the pieces, in suffix order: its piece, its start in it, its class, and whether an
    earlier equal is among them. (ids, kids, a) say where each piece starts."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(pieces), np.uint8)
    order = suffix_array(text, np.repeat(begins + sizes, sizes) - np.arange(len(text)), LENGTH)
    shared = common_prefixes(text, order, begins, np.maximum(sizes - (LENGTH - 1), 0))
    group = np.concatenate([[0], np.cumsum(shared < LENGTH)])
    piece = np.repeat(np.arange(len(pieces)), sizes)[order]
    start = order - begins[piece]
    pos = a[piece] + start
    by_doc = np.lexsort((kids, ids))
    doc = np.empty(len(ids), np.uint64)
    doc[by_doc] = np.cumsum(np.concatenate([[0], (ids[by_doc][1:] != ids[by_doc][:-1]) | (kids[by_doc][1:] != kids[by_doc][:-1])])) if len(ids) else 0
    bits = [np.uint64(int(x.max(initial=0)).bit_length()) for x in (doc, pos)]
    if int(bits[0]) + int(bits[1]) + int(group.max(initial=0)).bit_length() <= 64:
        rank = np.argsort((((group.astype(np.uint64) << bits[0]) | doc[piece]) << bits[1]) | pos.astype(np.uint64))
    else:
        rank = np.lexsort((pos, doc[piece], group))
    piece, start, group, pos = piece[rank], start[rank], group[rank], pos[rank]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.empty(0, np.int64)
    later = (doc[piece] != doc[piece[first]]) | (pos != pos[first])
    return piece, start, new, later


def _shard(rows: list[tuple]) -> tuple[list[np.ndarray], list[tuple]]:
    """rows: (h, f, id, kid, a, parts, snippet). Returns what is a later copy, and the sorted strings of split anchors."""
    pieces = [r[6] for r in rows]
    ids, kids, a = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    piece, start, new, later = sorted_strings(pieces, ids, kids, a)
    some = np.flatnonzero(later)
    doc, x, y = _merged(piece[some], start[some], start[some] + LENGTH)
    runs = []
    if any(r[5] > 1 for r in rows):
        # for every split anchor, its distinct strings in order, each with the earliest start that is known here
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        seen = set()
        for k in np.flatnonzero(np.array([r[5] > 1 for r in rows])[piece]).tolist():
            p, q = piece[k], piece[first[k]]
            if (rows[p][0], first[k]) not in seen:
                seen.add((rows[p][0], first[k]))
                runs.append((rows[p][0], pieces[p][start[k] : start[k] + LENGTH], ids[q], kids[q], a[q] + start[first[k]]))
    return [ids[doc], kids[doc], a[doc] + x, a[doc] + y], runs


def compare(firsts: DataFrame, snippets: DataFrame) -> DataFrame:
    """(id, kid, a, b, h, run, string): bytes that are later copies; with a string instead, the earliest start of it in one run, of an anchor's shards."""
    shard = F.xxhash64("h", F.pmod("f", F.col("parts")))
    empty = F.lit(None).cast("binary")
    left = firsts.select("h", "f", "id", "kid", "a", "parts", empty.alias("snippet"))
    sizes = firsts.groupBy("h").agg(F.max("parts").alias("parts"))
    right = snippets.join(sizes, "h").select("h", "f", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("kid"), F.lit(None).cast("int").alias("a"), "parts", "snippet")
    dealt = left.unionByName(right).withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "h", "f")

    def out(source, marks, runs):
        n, m = len(marks[0]), len(runs)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(marks[0], pa.int64()), pa.array([r[2] for r in runs], pa.int64())]),
                pa.concat_arrays([pa.array(marks[1], pa.int64()), pa.array([r[3] for r in runs], pa.int64())]),
                pa.concat_arrays([pa.array(marks[2].astype(np.int32)), pa.array([r[4] for r in runs], pa.int32())]),
                pa.concat_arrays([pa.array(marks[3].astype(np.int32)), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([r[0] for r in runs], pa.int64())]),
                pa.array([source] * (n + m), pa.int64()),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([r[1] for r in runs], pa.binary())]),
            ],
            names=["id", "kid", "a", "b", "h", "run", "string"],
        )

    def run(batches):
        ready, at, first, snippet = [], None, [], None
        current = None

        def close():
            for r in first:
                if snippet is not None and len(snippet) >= LENGTH:
                    ready.append((*at, *r, snippet))

        for batch in batches:
            h, f, ids, kids, a, parts, cut, shards = (c.to_pylist() for c in batch.columns)
            for k in range(batch.num_rows):
                if (h[k], f[k]) != at:
                    close()
                    at, first, snippet = (h[k], f[k]), [], None
                    if shards[k] != current:
                        if len(ready) >= SHARD_SNIPPETS // 2:
                            yield out(current, *_shard(ready))
                            ready = []
                        current = shards[k]
                if cut[k] is None:
                    first.append((ids[k], kids[k], a[k], parts[k]))
                else:
                    snippet = cut[k]
        close()
        if ready:
            yield out(current, *_shard(ready))

    return dealt.select("h", "f", "id", "kid", "a", "parts", "snippet", "shard").mapInArrow(run, "id long, kid long, a int, b int, h long, run long, string binary")


def merge(runs: DataFrame) -> DataFrame:
    """(id, kid, a, b) of strings that start earlier in another shard of their anchor: sorted runs, merged by binary search."""

    def run(batches):
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return
        text = np.array(table["string"].to_pylist(), f"S{LENGTH}")
        ids, kids, a, h, source = (table[c].to_numpy() for c in ("id", "kid", "a", "h", "run"))
        where = list(zip(ids.tolist(), kids.tolist(), a.tolist(), strict=True))
        lost: set[int] = set()
        for anchor in np.unique(h):
            of = np.flatnonzero(h == anchor)
            held = np.empty(0, np.int64)
            for one in np.unique(source[of]):
                new = of[source[of] == one]
                new = new[np.argsort(text[new], kind="stable")]
                at = np.searchsorted(text[held], text[new])
                known = np.zeros(len(new), bool)
                inside = np.flatnonzero(at < len(held))
                known[inside] = text[held[at[inside]]] == text[new[inside]]
                for k in np.flatnonzero(known).tolist():
                    x, y = held[at[k]], new[k]
                    if where[y] < where[x]:
                        lost.add(x)
                        held[at[k]] = y
                    elif where[x] < where[y]:
                        lost.add(y)
                held = np.insert(held, at[~known], new[~known])
        some = np.array(sorted(lost), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(kids[some]), pa.array(a[some].astype(np.int32)), pa.array((a[some] + LENGTH).astype(np.int32))], names=["id", "kid", "a", "b"])

    dealt = runs.select("id", "kid", "a", "h", "run", "string").repartition(F.col("h"), F.xxhash64("string"))
    return dealt.mapInArrow(run, "id long, kid long, a int, b int")


def marks(rows: DataFrame) -> DataFrame:
    """(id, kid, a, b): bytes [a, b) of a document that later copies cover. ``rows``: id, kid, text, none null but the text."""
    by_hash = Window.partitionBy("h")
    same = Window.partitionBy("h", "f").orderBy("id", "kid", "a")
    # rows alike in id and kid are one document: they share a place, and only a larger place is a later copy
    found = occurrences(rows).withColumns({"r": F.row_number().over(same), "place": F.rank().over(same), "low": F.min("f").over(by_hash), "high": F.max("f").over(by_hash)})
    found = found.withColumn("n", F.sum(F.when(F.col("r") == 1, 1).otherwise(0)).over(by_hash))
    kept = found.where("own or place > 1 or (r = 1 and low <> high)").select("h", "f", "id", "kid", "a", "b", "own", "r", "place", F.ceil(F.col("n") / SHARD_SNIPPETS).cast("int").alias("parts"), (F.col("low") != F.col("high")).alias("mixed"))
    kept = written(kept, "anchors")
    copies = kept.where(f"own or (place > 1 and b - a >= {LENGTH})").select("id", "kid", "a", "b")
    firsts = kept.where("not own and r = 1 and mixed")
    compared = written(compare(firsts, texts(rows, firsts.select("h"))), "compared")
    split = compared.where("string is not null")
    out = copies.unionByName(compared.where("string is null").select("id", "kid", "a", "b"))
    return out.unionByName(merge(split)) if split.limit(1).count() else out


def spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, kid, text, spans): the document's bytes that go, as disjoint sorted [a, b)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(F.col(id_col).alias("_id"), key.alias("id"), F.xxhash64(key, text_col).alias("kid"), F.col(text_col).alias("text"))
    gone = marks(rows).groupBy("id", "kid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return rows.join(gone, ["id", "kid"], "left").select("_id", "text", "spans")


def _disjoint(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in found or ():
        if out and x["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["b"]))
        else:
            out.append((x["a"], x["b"]))
    return out


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in gone:
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]])


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the bytes that are left (a character may be cut), and the spans that went."""
    kind = documents.schema[id_col].dataType.simpleString()
    pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in portions(batch):
                gone = [_disjoint(x) for x in part.column(2).to_pylist()]
                kept = [_kept(t or b"", g) for t, g in zip(as_bytes(part.column(1)), gone, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array([[{"a": a, "b": b} for a, b in g] for g in gone], pairs)], names=["id", "kept", "spans"])

    return spans(documents, id_col, text_col).mapInArrow(run, f"id {kind}, kept binary, spans array<struct<a:int,b:int>>").withColumnRenamed("id", id_col)


def digest(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""

    def run(batches):
        for batch in batches:
            for part in portions(batch):
                text = [t or b"" for t in as_bytes(part.column(1))]
                gone = [_disjoint(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, text), pa.int64()), pa.array([sum(b - a for a, b in g) for g in gone], pa.int64()), pa.array(map(len, gone), pa.int64()), pa.array([hashlib.sha256(_kept(t, g)).hexdigest() for t, g in zip(text, gone, strict=True)])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return spans(documents).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The contract read literally, for tests; doc_ids are distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        hit = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            x = t[s : s + length]
            if x in seen:
                hit[s : s + length] = True
            seen.add(x)
        edge = np.diff(np.concatenate([[0], hit.astype(int)]))
        out[i] = (len(t), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, h in zip(t, hit[:-1], strict=True) if not h)).hexdigest())
    return out
