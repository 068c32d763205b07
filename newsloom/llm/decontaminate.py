"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring, in words, of the test items. A document
is streamed through it word by word; the state and the matching length say at
each word which item windows end there. Windows are ``n`` consecutive item
words; an item of fewer words (but not none) is one window.

Defined results. A null or empty text has no words, no hits, and is kept as it
is. Repeated items count once per item_id; an item whose item_id is null is
named ``null``. Repeated documents are judged alike, each in its own row. An
empty benchmark hits nothing. Only the named columns are read, so further
columns of whatever name pass through ``remove`` and do not reach ``match``.
Very long texts are streamed whole, in memory in proportion to their words; a
null doc_id is a row like any other.

Bounds. An automaton takes ``BLOCK_CHARS`` of items, and ``MOST_BLOCKS`` of them
stand in memory at once. Documents are streamed through all automata in one
pass, or, for a larger benchmark, in as many passes as it takes; between passes
they stand in the shared folder with what they have hit so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import as_bytes, portions, settled
from newsloom.plans.durable import scratch, written

#: The word class of the contract, [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z, over UTF-8 bytes.
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FOLD = bytes(b if b in WORD_BYTES else 0x20 for b in bytes(range(256)).lower())
WORD_RUN = re.compile(rb"[^ ]+")

#: Characters of items held by one automaton, about 60 MB of Python objects; and how many automata a worker may hold.
BLOCK_CHARS, MOST_BLOCKS = 2_000_000, 4


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over sequences of words, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], n: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(name, w) for name, w in items if w]
        for _, w in items:
            last = 0
            for word in w:
                last = self._extend(last, word)
        own: list[dict[int, set[str]]] = [{} for _ in self.next]
        for name, w in items:
            size = min(n, len(w))
            state = 0
            for i, word in enumerate(w):
                state = self.next[state][word]
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own[at].setdefault(size, set()).add(name)
        self.n = n
        #: Per state, the windows that end in it, {length: items}, and the nearest state up its suffix links that has some: names are held once.
        self.windows = own
        self.above = [-1] * len(own)
        self.least = [1 << 60] * len(own)
        for v in sorted(range(len(own)), key=self.length.__getitem__):
            if v:
                up = self.link[v]
                self.above[v] = up if own[up] else self.above[up]
                self.least[v] = min([self.least[up], *own[v]])

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def stream(self, doc: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The merged spans [first word, past the last, whether a whole item of fewer than n words is in it] that windows cover,
        and the items that have one."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        spans: list[list[int]] = []
        met: set[tuple[int, int]] = set()
        s = matched = 0
        for i, word in enumerate(doc):
            t = nxt[s].get(word)
            if t is None:
                while s:
                    s = link[s]
                    t = nxt[s].get(word)
                    if t is not None:
                        break
                if t is None:
                    matched = 0
                    continue
                matched = length[s]
            s = t
            matched += 1
            if matched >= least[s]:
                fits, at = [], s if self.windows[s] else self.above[s]
                while at > 0:
                    own = [k for k in self.windows[at] if k <= matched]
                    fits += own
                    met.update((at, k) for k in own)
                    at = self.above[at]
                start, short = i + 1 - max(fits), min(fits) < self.n
                while spans and spans[-1][0] >= start:
                    short |= spans.pop()[2]
                if spans and spans[-1][1] >= start:
                    spans[-1][1:] = [i + 1, spans[-1][2] or short]
                else:
                    spans.append([start, i + 1, short])
        return spans, set().union(*(self.windows[at][k] for at, k in met))


def union(spans: list[list[int]], more: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b, short in sorted([*spans, *more]):
        if out and a <= out[-1][1]:
            out[-1][1:] = [max(out[-1][1], b), out[-1][2] or short]
        else:
            out.append([a, b, short])
    return out


def automata(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, of: tuple[int, int] = (0, 1)) -> list:
    """Broadcast automata, each over a block of items of a bounded size: the number of blocks follows the benchmark's size. ``of``
    (k, m) gives the blocks of the k-th of m equal parts."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("t")).where("t is not null")
    blocks = block_count(benchmark, text_col, block_chars)
    out = []
    for k in range(of[0], blocks, of[1]):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "t"), F.lit(blocks)) == k)
        out.append(spark.sparkContext.broadcast(Automaton(((r.name, words(r.t.encode())) for r in part.select(F.col("name").alias("name"), "t").toLocalIterator()), n)))
    return out


def block_count(benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> int:
    return 1 + (benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0) // block_chars


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("short", pa.bool_())]))


def gathered(documents: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, into: str, most_blocks: int, block_chars: int) -> DataFrame:
    """Written: (row, spans, items) of ``documents``, for a benchmark of more blocks than may stand in memory at once: rows are read
    once for each ``most_blocks`` of them, and what they hit is added to what they had hit."""
    rounds = -(-block_count(benchmark, "text", block_chars) // most_blocks)
    at = documents.columns.index(text_col)
    found = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.array().cast("array<struct<first:long,past:long,short:boolean>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = found.schema
    for k in range(rounds):
        held = automata(benchmark, n, item_col, block_chars=block_chars, of=(k, rounds))

        def run(batches, held=held):
            blocks = [b.value for b in held]
            for batch in batches:
                for part in portions(batch):
                    spans, names = [], []
                    for text, had, items in zip(as_bytes(part.column(0).field(at)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        _, new, more = hits(text, blocks)
                        both = union([[x["first"], x["past"], x["short"]] for x in had], [[a, b, bool(short)] for a, b, short in new])
                        spans.append([{"first": a, "past": b, "short": bool(short)} for a, b, short in both])
                        names.append(sorted({*items, *more}))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], names=["row", "spans", "items"])

        found = written(found.mapInArrow(run, kind), "gathered", into)
        for b in held:
            b.destroy()
    return found


def hits(text: bytes | None, held: list) -> tuple[list[bytes], list[list[int]], set[str]]:
    doc = words(text)
    spans, found = [], set()
    for a in held:
        more, names = a.stream(doc)
        spans, found = union(spans, more) if spans else more, found | names
    return doc, spans, found


def match(documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: the id, n_words, n_hit, the spans of hit words and the items found (sorted as strings)."""
    if block_count(benchmark) > MOST_BLOCKS:
        return _match_in_rounds(documents, benchmark, n, id_col, text_col, item_col)
    held = automata(benchmark, n, item_col)
    spans = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        blocks = [b.value for b in held]
        for batch in batches:
            rows = [hits(t, blocks) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(d) for d, _, _ in rows], pa.int64()), pa.array([sum(b - a for a, b, _ in s) for _, s, _ in rows], pa.int64()), pa.array([[{"first": a, "past": b} for a, b, _ in s] for _, s, _ in rows], spans), pa.array([sorted(f) for _, _, f in rows], pa.list_(pa.string()))],
                names=["id", "n_words", "n_hit", "spans", "items"],
            )

    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_hit long, spans array<struct<first:long,past:long>>, items array<string>")
    return out.withColumnRenamed("id", id_col)


def _match_in_rounds(documents: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, most_blocks: int = MOST_BLOCKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``match`` for a benchmark of any size."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def count(batches):
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row.field(0), pa.array([len(words(t)) for t in as_bytes(row.field(1))], pa.int64()), batch.column(1), batch.column(2)], names=["id", "n_words", "spans", "items"])

    with scratch(documents.sparkSession, "decontaminate") as folder:
        found = gathered(rows, benchmark, n, "t", item_col, folder, most_blocks, block_chars)
        out = found.mapInArrow(count, f"id {kind}, n_words long, spans array<struct<first:long,past:long,short:boolean>>, items array<string>")
        hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["past"] - x["first"])
        bare = F.transform("spans", lambda x: F.struct(x["first"].alias("first"), x["past"].alias("past")))
        return written(out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), bare.alias("spans"), "items"), "matched")


def _without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """A text without its words in ``cut``."""
    places = [m.span() for m in WORD_RUN.finditer(text.translate(FOLD))]
    left, pieces = 0, []
    for a, b in cut:
        pieces.append(text[left : places[a][0]])
        left = places[b - 1][1]
    return b"".join([*pieces, text[left:]])


def _remove_in_rounds(documents: DataFrame, benchmark: DataFrame, n: int, min_span: int, max_coverage: float, text_col: str, item_col: str, most_blocks: int = MOST_BLOCKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``remove`` for a benchmark of any size."""
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep, texts, row = [], [], batch.column(0)
            for text, spans in zip(as_bytes(row.field(at)), batch.column(1).to_pylist(), strict=True):
                keep.append(sum(x["past"] - x["first"] for x in spans) <= max_coverage * len(words(text)))
                cut = [(x["first"], x["past"]) for x in spans if x["short"] or x["past"] - x["first"] >= min_span]
                texts.append(None if text is None else (_without(text, cut) if cut and keep[-1] else text).decode())
            columns = [pa.array(texts, row.type.field(i).type) if i == at else row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[row.type.field(i).name for i in range(row.type.num_fields)]).filter(pa.array(keep, pa.bool_()))

    with scratch(documents.sparkSession, "decontaminate") as folder:
        found = gathered(documents, benchmark, n, text_col, item_col, folder, most_blocks, block_chars)
        return written(found.select("row", "spans").mapInArrow(run, documents.schema), "removed")


def remove(documents: DataFrame, benchmark: DataFrame, n: int = 10, min_span: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``documents`` without contamination: hit spans of at least ``min_span`` words, or with a whole item of fewer than ``n``
    in them, are cut out of the text, and a document of which more than ``max_coverage`` of the words are hit goes as a whole.

    Clean rows come back byte for byte; the columns and their order stay.
    """
    if block_count(benchmark) > MOST_BLOCKS:
        return _remove_in_rounds(documents, benchmark, n, min_span, max_coverage, text_col, item_col)
    held = automata(benchmark, n, item_col)
    at = documents.columns.index(text_col)

    def run(batches):
        blocks = [b.value for b in held]
        for batch in batches:
            for part in portions(batch):
                keep, texts = [], []
                for text in as_bytes(part.column(at)):
                    doc, spans, _ = hits(text, blocks)
                    hit = sum(b - a for a, b, _ in spans)
                    keep.append(hit <= max_coverage * len(doc))
                    cut = [(a, b) for a, b, short in spans if short or b - a >= min_span]
                    if cut and keep[-1]:
                        text = _without(text, cut)
                    texts.append(None if text is None else text.decode())
                columns = [pa.array(texts, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(settled(run), documents.schema)


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return match(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )


def brute(text: str | None, items: list[tuple[str, str | None]], n: int = 10) -> tuple[int, int, list[str]]:
    """The contract read literally, for tests: n_words, n_hit, items."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    doc, hit, found = pattern.findall(low(text)), set(), set()
    for name, item in items:
        w = pattern.findall(low(item))
        size = min(n, len(w))
        for window in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else ():
            for i in range(len(doc) - size + 1):
                if tuple(doc[i : i + size]) == window:
                    hit.update(range(i, i + size))
                    found.add(name)
    return len(doc), len(hit), sorted(found)


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
