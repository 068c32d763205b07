"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct shingles of ``n`` words. Documents with one
set are one class. Shingles are ordered rare first, by document counts over the
whole corpus held in counters (of a shingle's bucket; any one order is right,
this one makes prefixes rare). A class posts the first |x| - ceil(t|x|) + 1
shingles; two classes within the threshold share one. Texts are read twice: for
the counts, and for everything else that is known of a document; after that, only
the sets of candidates are read again.

Groups of near copies post the same shingles in thousands, so pairs are not
taken from a posting list all at once:

1. In the lists of its rarest shingles, ordered by size, a class is paired with
   the one before it and with the first: a number of pairs linear in the
   classes. Pairs that the length, positional and suffix filters leave are
   verified once, and the links are joined into components.
2. Lists that then still hold several components do the same in another order,
   with more partners, between different components.
3. Lists that still hold several components give all further pairs between
   components, by bands of size, that the three filters leave.

A pair left out of ``cluster`` is one whose documents are connected already, so
components are those of all links; ``links`` leaves out none.

The suffix filter bounds the symmetric difference from below: shingles fall into
twice as many bins as there are, and each bin whose parity differs holds one
that is not common. Verification meets the sets in groups of bounded weight, so
a group of near copies is many groups.

Defined results. Words are separated by ASCII white space, A-Z in lower case.
Fewer than ``n`` words are one shingle together; a null text or one without
words has an empty set, size 0, and is its own component. Texts are read whole,
very long ones in pieces. Ties do not matter. Rows that repeat a doc_id each get
their row; a null doc_id is no component's smallest id unless it has no other.
The table may be empty. Further columns are not read, whatever their names.
Shingles and classes are named by 64 bits; the chance that two of m names agree
is about m * m / 3.7e19.

Driver and broadcast: one byte for each counter, whose number follows the input's
partitions between 2^20 and 2^24, and a Bloom filter of 32 MB at most that says
which classes' sets a task must send; what passes by mistake is dropped by the
join behind it. With far more shingles than counters, prefixes are less rare and
lists longer; with far more candidates than bits, more sets travel; results stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm import bloom
from newsloom.llm.arrow import portions, settled
from newsloom.llm.shingles import Shingler
from newsloom.plans.durable import scratch, written
from newsloom.plans.graph import components

#: Counters: so many for each input partition, within these bounds.
COUNTERS_EACH, LEAST_COUNTERS, MOST_COUNTERS = 1 << 15, 1 << 20, 1 << 24
BLOCK = 1 << 12
#: Tasks whose counters one task of the first level adds up.
SUMMED_TOGETHER = 1024
#: Shingles of pairs that one verification group takes, about 8 MB of sets.
GROUP_SHINGLES = 500_000
#: Lists in which a class is paired first, its rarest; whatever that leaves apart is paired in all of them.
FIRST_LISTS = 2
#: Rounds of linear pairing in all lists, before all remaining pairs across components are taken.
ROUNDS = 2
#: Postings of a list that are ordered together when neighbours are paired.
LIST_BLOCK = 4096
#: Bins of the suffix filter, as a power of two: twice the shingles, within these bounds.
LEAST_BINS, MOST_BINS = 64, 1 << 14


def class_of(shingles: np.ndarray) -> int:
    name = xxhash.xxh3_64_intdigest(shingles)
    return name - (1 << 64) if name >> 63 else name


def counters_for(documents: DataFrame) -> int:
    wanted = COUNTERS_EACH * max(1, documents.rdd.getNumPartitions())
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (wanted - 1).bit_length()))


def rareness(documents: DataFrame, n: int, counters: int) -> np.ndarray:
    """One byte for each counter, larger where more documents have a shingle of it: eight steps for each doubling."""

    def tally(values: list[np.ndarray]) -> np.ndarray:
        return np.bincount((np.concatenate(values) & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)

    def count(batches):
        sums, shingle, waiting, held = np.zeros(counters, np.uint32), Shingler(n), [], 0
        for batch in batches:
            for part in portions(batch, 1024):
                waiting.append(shingle(part.column(0))[0])
                held += len(waiting[-1])
                if held > counters:
                    sums += tally(waiting)
                    waiting, held = [], 0
        if held:
            sums += tally(waiting)
        packed = [zlib.compress(x.tobytes(), 1) for x in sums.reshape(-1, BLOCK)]
        group = TaskContext.get().partitionId() // SUMMED_TOGETHER
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([group] * len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["block", "group", "counts"])

    def total(table) -> np.ndarray:
        """Sums that stop at the largest 32-bit number, which is beyond the largest step."""
        out = np.zeros(BLOCK, np.int64)
        for x in table["counts"]:
            out += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return np.minimum(out, (1 << 32) - 1)

    def add(_key, table):
        packed = zlib.compress(total(table).astype(np.uint32).tobytes(), 1)
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([packed], pa.binary())})

    def finish(_key, table):
        steps = np.minimum(255, 8 * np.log2(1 + total(table))).astype(np.uint8)
        return pa.table({"block": table["block"].slice(0, 1), "steps": pa.array([steps.tobytes()], pa.binary())})

    counted = documents.select("text").mapInArrow(settled(count), "block int, group int, counts binary")
    if documents.rdd.getNumPartitions() > SUMMED_TOGETHER:
        counted = counted.groupBy("block", "group").applyInArrow(add, "block int, counts binary")
    table = counted.groupBy("block").applyInArrow(finish, "block int, steps binary").toArrow()
    out = np.zeros((counters // BLOCK, BLOCK), np.uint8)
    for block, steps in zip(table["block"].to_pylist(), table["steps"].to_pylist(), strict=True):
        out[block] = np.frombuffer(steps, np.uint8)
    return out.reshape(-1)


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each bin, whether it holds an odd number of the shingles; packed into longs."""
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount(((shingles >> np.uint64(24)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray], present: list[bool]) -> pa.Array:
    """An array<long> of ``parts``, null where not ``present``."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([not x for x in present], pa.bool_()))


def signatures(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, class, size, key, parities, prefix) for each row: class is null for an empty set, key is the set's least shingle;
    the prefix, rarest first, comes once for each class in a task."""
    kind = documents.schema["id"].dataType.simpleString()
    counters = counters_for(documents)
    steps = documents.sparkSession.sparkContext.broadcast(rareness(documents, n, counters))
    none = np.empty(0, np.uint64)

    def run(batches):
        shingle, seen, rank = Shingler(n), set(), steps.value
        for batch in batches:
            for part in portions(batch):
                values, at = shingle(part.column(1))
                ranks = rank[(values & np.uint64(counters - 1)).astype(np.int64)]
                names, sizes, keys, parities, prefixes = [], np.diff(at), [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    s = values[lo:hi]
                    names.append(class_of(s) if hi > lo else None)
                    keys.append(int(s[0].view(np.int64)) if hi > lo else None)
                    parities.append(_parities(s).view(np.uint64) if hi > lo else none)
                    if hi == lo or names[-1] in seen:
                        prefixes.append(none)
                    else:
                        seen.add(names[-1])
                        prefixes.append(s[np.argsort(ranks[lo:hi], kind="stable")[: hi - lo - -(-percent * (hi - lo) // 100) + 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.int64()), _lists(parities, [x is not None for x in names]), _lists(prefixes, [len(x) > 0 for x in prefixes])],
                    names=["id", "class", "size", "key", "parities", "prefix"],
                )

    return documents.select("id", "text").mapInArrow(settled(run), f"id {kind}, class long, size long, key long, parities array<long>, prefix array<long>")


def sets_of(documents: DataFrame, n: int, classes: DataFrame, number: int) -> DataFrame:
    """(class, set) of the ``number`` classes in ``classes`` (and of a few more), once in each task."""
    held = bloom.gather(classes, bloom.bits_for(number))

    def run(batches):
        shingle, seen = Shingler(n), set()
        for batch in batches:
            for part in portions(batch, 256):
                values, at = shingle(part.column(0))
                spans = [(lo, hi) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if hi > lo]
                names = [class_of(values[lo:hi]) for lo, hi in spans]
                keep = bloom.may_hold(held.value, np.array(names, np.int64))
                out = []
                for name, (lo, hi), k in zip(names, spans, keep.tolist(), strict=True):
                    if k and name not in seen:
                        seen.add(name)
                        out.append((name, values[lo:hi].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["class", "set"])

    return documents.select("text").mapInArrow(settled(run), "class long, set binary")


def _half(x: Column) -> Column:
    """Parities over half as many bins."""
    h = (F.size(x) / 2).cast("int")
    return F.when(h > 0, F.zip_with(F.slice(x, F.lit(1), h), F.slice(x, h + 1, h), lambda p, q: p.bitwiseXOR(q)))


def _similar(x: Column, y: Column, x_size: Column, y_size: Column, percent: int) -> Column:
    """The suffix filter: no more bins may differ in parity than shingles may be not common. Sizes fit each other, so bins differ once by half at most."""
    fewer, more = F.when(F.size(x) > F.size(y), _half(x)).otherwise(x), F.when(F.size(y) > F.size(x), _half(y)).otherwise(y)
    differ = F.aggregate(F.zip_with(fewer, more, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return (100 + percent) * differ <= (100 - percent) * (x_size + y_size)


def _length(x_size, y_size, percent: int) -> Column:
    return 100 * F.least(x_size, y_size) >= percent * F.greatest(x_size, y_size)


def _fits(x_size, x_pos, y_size, y_pos, percent: int) -> Column:
    """The length filter, and the positional one: what is left behind a common shingle must suffice."""
    need = F.ceil(percent * (x_size + y_size) / F.lit(100 + percent))
    return _length(x_size, y_size, percent) & (F.least(x_size - x_pos, y_size - y_pos) >= need)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, key, weight) of pairs (a, b) that pass the suffix filter. Key is that of a."""
    one = lambda s: classes.select(F.col("class").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "key", "parities")])
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(_length(F.col("a_size"), F.col("b_size"), percent))
    return both.where(_similar(F.col("a_parities"), F.col("b_parities"), F.col("a_size"), F.col("b_size"), percent)).select("a", "b", F.col("a_key").alias("key"), (F.col("a_size") + F.col("b_size")).alias("weight"))


def verify(pairs: DataFrame, documents: DataFrame, n: int, percent: int, into: str) -> DataFrame:
    """Written: the pairs (a, b) of distinct classes that are within the threshold; each is looked at once."""
    size = pairs.groupBy("key").agg(F.sum("weight").alias("n"))
    dealt = pairs.join(size, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / GROUP_SHINGLES))).alias("g"), "a", "b")
    dealt = written(dealt, "pairs", into)
    wanted = dealt.select("g", F.col("a").alias("class")).unionByName(dealt.select("g", F.col("b").alias("class"))).distinct()
    names = written(wanted.select("class").distinct(), "names", into)
    sent = wanted.join(sets_of(documents, n, names, names.count()), "class").select("g", F.lit(None).cast("long").alias("a"), F.col("class").alias("b"), "set")
    both = sent.unionByName(dealt.select("g", "a", "b", F.lit(None).cast("binary").alias("set")))

    def run(batches):
        """Rows come by group, its sets first."""
        now, held = None, {}
        for batch in batches:
            good = []
            for part in portions(batch, 256):
                for g, a, b, own in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if g != now:
                        now, held = g, {}
                    if own is not None:
                        held[b] = np.frombuffer(own, np.uint64)
                        continue
                    x, y = sorted((held[a], held[b]), key=len)
                    at = np.searchsorted(y, x)
                    common = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in good], pa.int64()), pa.array([b for _, b in good], pa.int64())], names=["a", "b"])

    return written(both.repartition("g").sortWithinPartitions("g", F.asc_nulls_first("a"), "b").mapInArrow(settled(run), "a long, b long"), "links", into)


def _open(lists: DataFrame) -> DataFrame:
    """Postings (token, class, size, pos, part) of lists that hold several parts, with the list's length ``n``."""
    several = lists.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low <> high").select("token", "n")
    return lists.join(several.hint("shuffle_hash"), "token")


def _parted(lists: DataFrame, joined: DataFrame) -> DataFrame:
    return lists.join(joined.withColumnRenamed("node", "class"), "class", "left").select("token", "class", "size", "pos", "back1", "back2", F.coalesce("component", "class").alias("part"))


def _pairs(ends: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of rows with another posting ``o`` of their list, where length and position allow a link."""
    fit = ends.where("o is not null and o.part <> part and o.class <> class").where(_fits(F.col("size"), F.col("pos"), F.col("o.size"), F.col("o.pos"), percent))
    return fit.select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct()


def _meet(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each posting with the one before it and the first of its block of the list; from the second turn on in random
    order, and with two more before it."""
    mixed = F.xxhash64("class", F.lit(turn))
    block = F.pmod(F.xxhash64("class", F.lit(-turn)), F.ceil(F.col("n") / LIST_BLOCK))
    order = Window.partitionBy("token", "block").orderBy("size", "class") if turn == 0 else Window.partitionBy("token", "block").orderBy("mixed", "class")
    one = F.struct("class", "size", "pos", "part")
    partners = [F.lag(one).over(order), F.first(one).over(order)] + ([F.lag(one, k).over(order) for k in (2, 3)] if turn else [])
    ends = open_.withColumns({"mixed": mixed, "block": block}).select("class", "size", "pos", "part", F.array(*partners).alias("others"))
    return _pairs(ends.select("class", "size", "pos", "part", F.explode("others").alias("o")), percent)


def _all_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different parts that meet in a list where length and position allow a link. Lists are cut by bands of
    size, within which a link is possible to the same or the next; the join's skewed keys are Spark's to split. Two classes
    that share one of the two shingles before this one, in either order, have met in its list, where position allows no
    less: they are left out here."""
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent) + 1e-9)) if percent < 100 else F.col("size")
    full = open_.select("token", "class", "size", "pos", "back1", "back2", "part", band.cast("int").alias("band"))
    x, y = full.alias("x"), full.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("y")
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (xs, ys), (xc, yc), (xp, yp) = c("size"), c("class"), c("pos")
    before = (xs < ys) | ((xs == ys) & (xc < yc))
    again = F.lit(False)
    for i in (1, 2):
        for j in (1, 2):
            again = again | F.coalesce(F.col(f"x.back{i}") == F.col(f"y.back{j}"), F.lit(False))
    met = ~again & (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & before & (F.col("x.part") != F.col("y.part")) & _fits(xs, xp, ys, yp, percent)
    return x.join(y, met).select(F.least(xc, yc).alias("a"), F.greatest(xc, yc).alias("b")).distinct()


def _prepared(documents: DataFrame, n: int, percent: int, id_col: str, text_col: str, into: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (id, text); written: members (id, class, size), classes (class, size, key, parities), lists (token, class, size, pos)."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(rows, n, percent), "signed", into)
    known = signed.where("class is not null")
    classes = written(known.where("prefix is not null").groupBy("class").agg(*[F.first(c).alias(c) for c in ("size", "key", "parities")]), "classes", into)
    posted = known.where("prefix is not null").select("class", F.col("size").cast("int").alias("size"), "prefix", F.posexplode("prefix").alias("pos", "token"))
    posted = posted.withColumns({f"back{k}": F.when(F.col("pos") >= k, F.element_at("prefix", F.col("pos") + 1 - k)) for k in (1, 2)}).drop("prefix")
    # a class comes with its prefix from every task that has it; in its lists it stands once
    several = _open(posted.withColumn("part", F.col("class"))).dropDuplicates(["token", "class"])
    lists = written(several.select("token", "class", "size", "pos", "back1", "back2", "n"), "lists", into)
    return rows, signed.select("id", "class", "size"), classes, lists


def links(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: verified pairs (a, b) between classes of equal sets, and the members (id, class, n_shingles)."""
    spark = documents.sparkSession
    with scratch(spark, "ngram") as into:
        rows, members, classes, lists = _prepared(documents, n, percent, id_col, text_col, into)
        near = written(likely(_all_pairs(lists.withColumn("part", F.col("class")), percent), classes, percent), "near", into)
        return written(verify(near, rows, n, percent, into), "links"), written(members.select(F.col("id").alias(id_col), "class", F.col("size").alias("n_shingles")), "members")


def cluster(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, and component_id, the smallest id that links reach."""
    with scratch(documents.sparkSession, "ngram") as into:
        rows, members, classes, lists = _prepared(documents, n, percent, id_col, text_col, into)

        def next_to(pairs: DataFrame, seen: DataFrame | None) -> DataFrame:
            return written(likely(pairs.join(seen, ["a", "b"], "left_anti") if seen else pairs, classes, percent), "near", into)

        by_class = Window.partitionBy("class").orderBy("pos", "token")
        rarest = lists.withColumn("r", F.dense_rank().over(by_class)).where(F.col("r") <= FIRST_LISTS).drop("r", "n")
        near = next_to(_meet(_open(rarest.withColumn("part", F.col("class"))), 0, percent), None)
        seen = near.select("a", "b")
        joined = written(components(verify(near, rows, n, percent, into), "a", "b"), "components", into)
        for turn in range(1, ROUNDS + 2):
            open_ = written(_open(_parted(lists, joined)), "open", into)
            pairs = _meet(open_, turn, percent) if turn <= ROUNDS else _all_pairs(open_, percent)
            near = next_to(pairs, seen)
            if near.limit(1).count():
                seen = seen.unionByName(near.select("a", "b"))
                more = verify(near, rows, n, percent, into)
                if more.limit(1).count():
                    stars = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                    joined = written(components(stars.unionByName(more), "a", "b"), "components", into)

        part = F.coalesce("component", "class")
        whole = written(members.join(joined.withColumnRenamed("node", "class"), "class", "left").select("id", "size", part.alias("part")), "parts", into)
        least = whole.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
        out = whole.join(least, "part", "left").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
        return written(out, "clusters")


def digest(documents: DataFrame) -> DataFrame:
    """The contract: shingles of four words, 100 * intersection >= 85 * union."""
    return cluster(documents, 4, 85)


def brute(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """The contract read literally, for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    sets, up = {}, {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and root(i) != root(j):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in ids}
