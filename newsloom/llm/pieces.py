"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character, so
a merge never crosses from a word into the next marker: the marked text falls
into chunks (a run of markers and the word after it) that are segmented each
for itself. A task segments every distinct chunk once, by the library, and
joins the ids of a text back by the positions of its chunks.

Defined results. A null text counts as empty; an empty text has no ids, and
decodes to an empty text. Very long words go to the library whole, very long
texts chunk by chunk. Repeated rows are encoded alike, each in its own row; an
empty table gives none. Further columns are not read, whatever their names. The
table is emptied when it holds ``TABLE_CHARS`` characters (about 100 MB of Python
objects), so memory stays bounded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import portions, settled

#: Fixed value: the library's whitespace marker.
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHARS = 6_000_000


class Codec:
    """Text to ids and back, as the library does without begin or end ids.

    A chunk is named by what follows its first marker, which is what the library
    takes for it: it puts the marker back itself.
    """

    def __init__(self, model_file: str, table_chars: int = TABLE_CHARS):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        crossing = [p for i in range(size) if MARK in (p := self.library.id_to_piece(i)).lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        byte = [self.library.is_byte(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for b, p in zip(byte, map(self.library.id_to_piece, range(size)), strict=True)]
        self.table_chars = table_chars
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.decimals: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks, in one call, and decode each by its pieces."""
        new = [c for c in chunks if c not in self.decimals]
        for chunk, ids in zip(new, self.library.encode(new, num_threads=1) if new else [], strict=True):
            ids = ids or [self.library.piece_to_id(MARK)]
            self.decimals[chunk] = ",".join(map(str, ids))
            self.texts[chunk] = b"".join([self.bytes[i] for i in ids]).decode(errors="replace")
            self.held += len(chunk) + 16

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, all of which the table then holds."""
        out = [self.chunks(t or "") for t in texts]
        if self.held > self.table_chars:
            self.clear()
        self.learn(set().union(*out))
        return out

    def decimal(self, chunks: list[str]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, chunks))

    def decoded(self, chunks: list[str]) -> str:
        """The text that the ids decode to; the first marker goes, as it was put there."""
        return "".join(map(self.texts.__getitem__, chunks))[1:]


class Packer(Codec):
    """Text to ids as little-endian 16-bit numbers, and nothing else."""

    def clear(self) -> None:
        self.held = 0
        self.decimals: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.decimals]
        found = [x or [self.library.piece_to_id(MARK)] for x in self.library.encode(new, num_threads=1)] if new else []
        raw, at = np.array([i for ids in found for i in ids], "<u2").tobytes(), 0
        for chunk, ids in zip(new, found, strict=True):
            self.decimals[chunk] = raw[at : at + 2 * len(ids)]
            at += 2 * len(ids)
            self.held += len(chunk) + 16

    def pack(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self.decimals.__getitem__, chunks)) for chunks in self.split(texts)]


def packer(model_file: str):
    """What packs texts, and the packed end id."""
    p = Packer(model_file)
    if p.library.get_piece_size() > 1 << 16:
        raise ValueError("ids need more than 16 bits")
    return p.pack, p.library.eos_id().to_bytes(2, "little")


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """This process's codec for a model."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encoded(documents: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_tokens, token_ids, and round_trip, whether the ids decode to the text (whose markers come back as spaces).
    A task's table goes at its end, so that other stages do not run beside it."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model_file)
        try:
            yield from pack(c, batches)
        finally:
            c.clear()

    def pack(c, batches):
        for batch in batches:
            for part in portions(batch, 128):
                texts = part.column(1).to_pylist()
                rows = c.split(texts)
                ids = [np.array(c.decimal(r).split(","), np.int32) if r else np.empty(0, np.int32) for r in rows]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                back = [c.decoded(r) == (t or "").replace(MARK, " ") for r, t in zip(rows, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), held, pa.array(back)], names=["id", "n_tokens", "token_ids", "round_trip"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(settled(run), f"id {kind}, n_tokens long, token_ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def digest(documents: DataFrame, model_file: str) -> DataFrame:
    """The contract's row for each document."""

    def run(batches):
        c, sha = codec(model_file), hashlib.sha256
        for batch in batches:
            for part in portions(batch):
                n, ids, back = [], [], []
                for chunks in c.split(part.column(1).to_pylist()):
                    decimal = c.decimal(chunks)
                    n.append(decimal.count(",") + 1 if chunks else 0)
                    ids.append(sha(decimal.encode()).hexdigest())
                    back.append(sha(c.decoded(chunks).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
