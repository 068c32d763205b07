"""Workers outlive their tasks: what a stage of the pipeline held in them must not stand beside the stages that follow."""

import pyarrow as pa

from newsloom.llm import arrow, decontaminate, pieces
from newsloom.llm.registry import MODEL


class _Pool:
    def __init__(self):
        self.released = 0

    def release_unused(self):
        self.released += 1


def test_settled_gives_memory_back_after_the_last_batch(monkeypatch):
    pool = _Pool()
    monkeypatch.setattr(arrow.pa, "default_memory_pool", lambda: pool)
    task = arrow.settled(lambda batches: (2 * x for x in batches))
    seen = [(x, pool.released) for x in task(iter([1, 2]))]
    assert seen == [(2, 0), (4, 0)] and pool.released == 1
    early = task(iter([1, 2]))
    next(early)
    early.close()
    assert pool.released == 2


class _Frame:
    """Takes the function given to mapInArrow, to run it here."""

    def __init__(self, **fields):
        self.columns = list(fields)
        self.schema = {k: type("Field", (), {"dataType": type("Type", (), {"simpleString": lambda self: "bigint"})()})() for k in fields}
        self.batch = pa.RecordBatch.from_pydict(fields)

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):  # noqa: N802
        self.run = run
        return self

    def withColumnRenamed(self, *_):  # noqa: N802
        return self

    def out(self):
        return list(self.run(iter([self.batch])))


def test_encoding_leaves_no_table_in_its_worker(spark):
    texts = [f"word{k} of a text" for k in range(300)]
    out = pieces.encoded(_Frame(doc_id=list(range(300)), text=texts), MODEL).out()
    library = pieces.codec(MODEL).library
    assert [ids for b in out for ids in b.column(2).to_pylist()] == library.encode(texts)
    held = pieces.codec(MODEL)
    assert (held.held, held.decimals, held.texts) == (0, {}, {})


def test_benchmark_leaks_are_cut_a_portion_at_a_time(monkeypatch):
    item = "one two three four five six seven eight nine ten"
    held = type("Held", (), {"value": decontaminate.Automaton([("1", decontaminate.words(item.encode()))], 10)})()
    monkeypatch.setattr(decontaminate, "automata", lambda *_: [held])
    monkeypatch.setattr(decontaminate, "block_count", lambda *_: 1)
    texts = [item if k % 3 == 0 else f"text {k}" if k % 3 == 1 else None for k in range(2000)]
    out = decontaminate.remove(_Frame(doc_id=list(range(2000)), text=texts), None).out()
    assert [t for b in out for t in b.column(1).to_pylist()] == [t for t in texts if t != item]
    assert max(b.num_rows for b in out) <= 512
