"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

Two words are as alike as the gapped subsequences of three symbols they share,
each weighted by ``DECAY`` for every symbol it skips, so that ``idxiot`` and
``i-d-i-o-t`` stay near ``idiot``. Word ends are symbols too. The kernel against
a fixed set of landmark words gives every word a short vector (Nyström); a linear
machine separates insults from other words there.

Labels name texts, not words: of a toxic text the machine learns from its most
suspect word that clean texts lack, of clean texts from all words, the hardest
in particular, and looks again with what it has learned. Few words that account
for the toxic texts between them come first, so that copies of a toxic text do
not make insults of all their words. A text scores by its worst word, through a
logistic curve fitted on the labelled texts.

Kernel against landmarks and weights are both sums over subsequences, so they
fold into one weight for each of 32^3 subsequences: scoring a word is a sum over
its own, divided by its norm.

Defined results. A text that is null or has no letter has the score of a word
without features. Texts are read whole, a word at a time; runs of single letters
are also read as one word. Very long words are read in overlapping windows. Rows
that repeat score alike. An empty table has no scores. Ties in training go by
doc_id and text. A doc_id with several labels is toxic if one says so. Without
texts of both kinds every score is the share of toxic ones, or 0. Further columns
pass through; columns that have the names of the results give way to them.

Bounds of training, all of them parameters of this module: ``SAMPLE`` labelled
rows of ``SAMPLE_BYTES`` of text together, by a hash of doc_id, as many as fit
both. Of their words the machine sees all that it takes for insults, and
``HARDEST`` and ``RANDOM`` of the clean ones a round, the hardest chosen anew from
all by what it has learned; where no word is suspect, the ``FALLBACK`` that come
nearest. Words of every length are read in the windows that scoring uses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from newsloom.llm.arrow import portions
from newsloom.llm.langid import held_out
from newsloom.llm.names import without

SAMPLE, SAMPLE_BYTES = 6000, 24_000_000
HARDEST, RANDOM, FALLBACK = 4000, 4000, 20
#: Standard deviations above its expected number of toxic texts from which a word that clean texts lack is taken for an insult.
SURE = 4
#: Letters of the shortest word of which bent forms are learned: shorter ones come too near to clean words.
LEAST_BENT = 4
LANDMARKS = 256
DECAY = 0.6
SPAN = 5
WINDOW = 24
ROUNDS = 5
COST = 4.0
THRESHOLD = 0.3
TABLE_WORDS = 400_000
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]
_DIM = 32**3
#: Symbols 1 to 26 are letters, 27 to 31 other letters; an end of a word shares the last of them.
_END = 31
_SYMBOLS = {}


def symbol(point: int) -> int:
    """1 to 26 for a-z; letters of other scripts fall, by code point, into five further symbols."""
    letter = chr(point)
    if not letter.isalpha():
        return 0
    low = ord(letter.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low % 5


def unit(token: str) -> str:
    """The letters of a token, in lower case."""
    return token.lower() if token.isalpha() else "".join([c for c in token if c.isalpha()]).lower()


def windows(token: str) -> list[str]:
    """The letters of a token; those of a very long one in overlapping windows."""
    u = unit(token)
    return [u[lo : lo + WINDOW] for lo in range(0, max(1, len(u) - WINDOW // 2), WINDOW // 2)] if len(u) > WINDOW else [u]


def units(text: str | None) -> set[str]:
    """The distinct words of a text, with runs of three or more single letters also as one."""
    tokens = (text or "").split()
    out = set(tokens)
    if sum(map(len, out)) < 4 * len(tokens) or any(len(t) <= 2 for t in out):
        run: list[str] = []
        for t in [*tokens, "  "]:
            if len(t) == 1 or (len(t) == 2 and not t[1].isalpha()):
                run.append(t[0])
            else:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of words, each normed to length one."""
    rows, codes = [], []
    for k, w in enumerate(words):
        c = [_SYMBOLS.get(x) or _SYMBOLS.setdefault(x, symbol(ord(x))) for x in w]
        codes += [_END, *c, _END, *[0] * SPAN]
        rows.append(len(c) + 2 + SPAN)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    code = np.array(codes, np.int64)
    row = np.repeat(np.arange(len(words)), rows)
    keys, weights = [], []
    for a, b in _STEPS:
        x, y, z = code[: -(a + b)], code[a : len(code) - b], code[a + b :]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (row[: -(a + b)] == row[a + b :]))
        keys.append(row[at] * _DIM + ((x[at] << 10) | (y[at] << 5) | z[at]))
        weights.append(np.full(len(at), DECAY ** (a + b - 2)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(key))
    word = key // _DIM
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, key % _DIM, weight / norm[word]


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """words x landmarks; ``landmarks`` holds a dense column of features for each."""
    out = np.empty((len(words), landmarks.shape[1]))
    for lo in range(0, len(words), 500):
        some = words[lo : lo + 500]
        word, sub, weight = features(some)
        used, at = np.unique(sub, return_inverse=True)
        dense = np.zeros((len(some), len(used)))
        dense[word, at] = weight
        out[lo : lo + 500] = dense @ landmarks[used]
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """The weights (bias last) of a linear machine with squared hinge loss, by Newton steps on the rows within the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def bend(words: list[str], rng: np.random.Generator, each: int = 3) -> list[str]:
    """Words with a letter put in between, as someone would write them to get past a list."""
    out = []
    for word in words:
        for _ in range(each if len(word) >= LEAST_BENT else 0):
            at = int(rng.integers(1, len(word)))
            out.append(word[:at] + chr(97 + int(rng.integers(26))) + word[at:])
    return out


def judged(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """What the machine, folded into a weight for each subsequence, makes of words."""
    out = []
    for lo in range(0, len(words), 5000):
        word, sub, weight = features(words[lo : lo + 5000])
        out.append(np.bincount(word, weight * weights[sub], len(words[lo : lo + 5000])) + bias)
    return np.concatenate(out) if out else np.empty(0)


class Model:
    """One weight for each subsequence, a bias, and the curve from the worst word to a score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self.table: dict[str, float] = {}

    def words(self, tokens: set[str]) -> None:
        """Judge the tokens that the table lacks."""
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        new = [t for t in tokens if t not in self.table]
        pieces, owner = [], []
        for k, t in enumerate(new):
            own = windows(t)
            pieces += own
            owner += [k] * len(own)
        value = np.full(len(new), -np.inf)
        np.maximum.at(value, np.array(owner, np.int64), judged(pieces, self.weights, self.bias))
        self.table.update(zip(new, value.tolist(), strict=True))

    def worst(self, texts: list[str | None]) -> np.ndarray:
        found = [units(t) for t in texts]
        self.words(set().union(*found) if found else set())
        return np.array([max(map(self.table.__getitem__, f), default=self.bias) for f in found])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.shift, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with a small ridge, by Newton steps that are halved until they lessen the loss: whole
    steps run away where texts of both kinds mostly score alike."""
    a = np.stack([x, np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 5e-4 * w @ w)

    w = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - y) + 1e-3 * w)
        size, now = 1.0, loss(w)
        while size > 1e-10 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def reasons(members: list[np.ndarray], may: np.ndarray, base: float) -> np.ndarray:
    """Of the words that may mark toxic texts, those that still do by the texts that no other chosen one is in, the most frequent
    first. Copies of a toxic text share all their words, so each of those words looks as suspect as an insult; here the text's
    insult speaks for the copies, and the words around it have no text left."""
    own = [m[may[m]] for m in members]
    holder = np.repeat(np.arange(len(own)), [len(m) for m in own])
    word = np.concatenate([*own, np.empty(0, np.int32)])
    order = np.argsort(word, kind="stable")
    start = np.searchsorted(word[order], np.arange(len(may) + 1))
    left = np.bincount(word, minlength=len(may))
    open_, out = np.ones(len(own), bool), []
    while len(left):
        best = int(np.argmax(left))
        if left[best] == 0 or left[best] - (left[best] + 1) * base < SURE * np.sqrt((left[best] + 1) * base):
            break
        out.append(best)
        held = holder[order[start[best] : start[best + 1]]]
        for k in held[open_[held]]:
            left[own[k]] -= 1
            open_[k] = False
    return np.array(out, np.int64)


def fit(texts: list[str | None], toxic: list[int], landmarks: int = LANDMARKS) -> Model:
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(_DIM), 0.0, 0.0, float(np.log(share / (1 - share))))
    place: dict[str, int] = {}
    members = [np.unique(np.array([place.setdefault(u, len(place)) for t in sorted(units(x)) for u in windows(t) if u], np.int32)) for x in texts]
    vocabulary = list(place)
    n1, n0 = (sum((np.bincount(m, minlength=len(place)) for m, label in zip(members, toxic, strict=True) if bool(label) == kind), np.zeros(len(place))) for kind in (True, False))
    expected = (n1 + n0 + 1) * y.mean()
    suspect = np.where(n1 > expected, (n1 - expected) / np.sqrt(expected), 0)
    rng = np.random.default_rng(5)
    by_suspicion = np.argsort(-suspect, kind="stable")
    clean = np.flatnonzero(n0 > 0)
    lacking = n0 <= 0.1 * n1
    likely = (suspect >= SURE) & lacking
    sure = reasons([m for m, label in zip(members, toxic, strict=True) if label], likely, float(y.mean()))
    if not len(sure):
        sure = by_suspicion[:FALLBACK]
    bent = bend([vocabulary[k] for k in sure], rng)
    positive, hard = sure, clean[np.argsort(-suspect[clean], kind="stable")][:HARDEST]
    for turn in range(2):  # the second time, the clean words that looked worst are landmarks too
        near = hard if turn else np.argsort(-n0, kind="stable")
        chosen = list(dict.fromkeys([*by_suspicion[: landmarks // 2].tolist(), *near[: landmarks // 4].tolist(), *rng.permutation(len(vocabulary))[: landmarks // 4].tolist()]))
        word, sub, weight = features([vocabulary[k] for k in chosen])
        dense = np.zeros((_DIM, len(chosen)))
        dense[sub, word] = weight
        values, vectors = np.linalg.eigh(dense.T @ dense)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        for _ in range(ROUNDS):
            negative = np.unique(np.concatenate([hard, rng.permutation(clean)[:RANDOM]]))
            negative = negative[~np.isin(negative, positive)]
            rows = np.concatenate([positive, negative])
            words = [vocabulary[k] for k in rows] + bent
            signs = np.concatenate([np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(bent))])
            share = np.concatenate([np.full(len(positive), 1 / len(positive)), np.full(len(negative), 1 / max(1, len(negative))), np.full(len(bent), 0.5 / max(1, len(bent)))]) * len(words) / 2
            w = machine(kernel(words, dense) @ root, signs, share, COST)
            value = judged(vocabulary, dense @ (root @ w[:-1]), float(w[-1]))
            found = [own[np.argmax(value[own])] for m, label in zip(members, toxic, strict=True) if label and len(own := m[lacking[m]])]
            positive = np.unique(np.concatenate([np.array([k for k in found if value[k] > -0.5], np.int64), sure, np.flatnonzero(likely & (value > 0))]))
            hard = clean[np.argsort(-value[clean], kind="stable")][:HARDEST]
    model = Model(dense @ (root @ w[:-1]), float(w[-1]), 1.0, 0.0)
    model.slope, model.shift = _curve(model.worst(texts), y)
    model.table = {}
    return model


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Labels outside the held-out fold; at most ``sample`` texts of ``sample_bytes`` together, by a hash of doc_id. A text that no
    longer fits is passed over, and the next ones are still taken. Rows alike in doc_id and text count once."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("text"))
    sizes = rows.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    taken, total = [], 0
    for r in sizes.collect():
        if total + r.bytes <= sample_bytes:
            taken.append((r.doc_id, r.h))
            total += r.bytes
    if not taken:
        return fit([], [])
    keys = documents.sparkSession.createDataFrame(taken, StructType([documents.schema["doc_id"], StructField("h", LongType())]))
    rows = rows.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    rows = rows.orderBy("doc_id", "text").select("doc_id", "text", "toxic").toArrow().to_pandas()
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """``documents`` with score and predicted (or other names) behind its columns."""
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))
    documents = documents.select(*[F.col(f"`{c}`") for c in without(documents.columns, [score_name, predicted_name])])
    at = documents.columns.index(text_col)

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            for part in portions(batch, 256):
                value = own.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64()), pa.array((value >= threshold).astype(np.int32))], names=[*part.schema.names, score_name, predicted_name])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(score_name, DoubleType()), StructField(predicted_name, IntegerType())]))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    model = train(documents, labels)
    return score(documents.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
