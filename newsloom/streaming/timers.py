"""Operators that wait, with event-time timers: retries that come due, predictions that settle.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Rows of a key take effect in order of
time whatever the micro-batches: retries fire what is due before each row, predictions are held until the watermark has
passed them. A restart goes on from the checkpoint with its timers. States hold moments as microseconds, which no time zone
touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from newsloom.functions import score as X
from newsloom.functions import time as D
from newsloom.operators import timed

_EPOCH, _MICRO = datetime(1970, 1, 1), timedelta(microseconds=1)


def _micros(at: datetime | None) -> int | None:
    return None if at is None else (at - _EPOCH) // _MICRO


def _moment(micros: int | None) -> datetime | None:
    return None if micros is None else _EPOCH + micros * _MICRO


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before a moment; timers have no finer ones."""
    return -(-micros // 1000)


def _times(df: DataFrame, *names: str) -> DataFrame:
    """Microseconds back as moments."""
    return df.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in names})


def _us(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


class Retries(StatefulProcessor):
    """One value for each page, and a timer for when it is due or leaves."""

    def __init__(self):
        # workers have no session to read types with
        self.kind = StructType.fromDDL("attempts int, next_us long, fired boolean, gave_up boolean, updated_us long, cause string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", self.kind)

    def _held(self) -> timed.Retry | None:
        if not self.page.exists():
            return None
        attempts, due, fired, gave_up, updated, cause = self.page.get()
        return timed.Retry(attempts, _moment(due), fired, gave_up, _moment(updated), cause)

    def _hold(self, before: timed.Retry | None, s: timed.Retry | None) -> None:
        old, new = timed.wakes_at(before), timed.wakes_at(s)
        if old is not None and old != new:
            self.handle.deleteTimer(_millis(_micros(old)))
        if new is not None and new != old:
            self.handle.registerTimer(_millis(_micros(new)))
        if s is None:
            self.page.clear()
        else:
            self.page.update((s.attempts, _micros(s.next_at), s.fired, s.gave_up, _micros(s.updated_at), s.cause))

    @staticmethod
    def _told(key, found: list[tuple]) -> Iterator[Row]:
        return iter([Row(source_id=key[0], url=key[1], at=_micros(a), kind=k, attempts=n, next_at=_micros(t), cause=c) for a, k, n, t, c in found])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = s = self._held()
        out = []
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            s, found = timed.tried(s, _moment(r.us), r.cause)
            out += found
        self._hold(before, s)
        return self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._held()
        s, out = timed.woken(before, _moment(1000 * expiredTimerInfo.getExpiryTimeInMs()))
        if out:
            self._hold(before, s)
        return self._told(key, out)

    def close(self) -> None:
        pass


def retry_log(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The events of ``operators.timed.retry_log``, each when it happens. ``stream``: source_id, url, at, seq, error."""
    kind = stream.schema["source_id"].dataType.simpleString()
    rows = stream.select("source_id", "url", F.col("at").cast("timestamp").alias("at"), _us("at").alias("us"), "seq", X.error_class(F.col("error")).alias("cause")).withWatermark("at", lateness)
    told = StructType.fromDDL(f"source_id {kind}, url string, at long, kind string, attempts int, next_at long, cause string")
    return _times(rows.groupBy("source_id", "url").transformWithState(Retries(), told, "append", "EventTime"), "at", "next_at")


_PRICE, _PREDICTION = 0, 1
_DAY = timedelta(days=1) // _MICRO


def _local_day(us: int) -> int:
    return (us + D.OFFSET_MINUTES * 60_000_000) // _DAY


class Settlements(StatefulProcessor):
    """Per symbol the rows that the watermark has not passed, the last price, and predictions by their day."""

    def __init__(self, n: int):
        self.n = n
        ddl = ("us long, kind int, seq long", "price double, id long, trend string", "us long, price double, day long", "day long", "n int", "day long, id long", "us long, base_us long, base double, trend string")
        self.kinds = [StructType.fromDDL(x) for x in ddl]

    def init(self, handle: StatefulProcessorHandle) -> None:
        place, held, last, day, n, prediction, open_ = self.kinds
        self.handle = handle
        self.waiting = handle.getMapState("waiting", place, held)
        self.last = handle.getValueState("last", last)
        self.left = handle.getMapState("left", day, n)
        self.open = handle.getMapState("open", prediction, open_)

    def _wake(self, us: int | None, timerValues) -> None:
        if us is not None:
            self.handle.registerTimer(max(_millis(us), timerValues.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        least = None
        for r in rows:
            self.waiting.updateValue((r.us, r.kind, r.seq), (r.price, r.id, r.trend))
            least = r.us if least is None else min(least, r.us)
        self._wake(least, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = 1000 * timerValues.getCurrentWatermarkInMs()
        passed, least = [], None
        for us, kind, seq in map(tuple, self.waiting.keys()):
            if us <= until:
                passed.append((us, kind, seq))
            else:
                least = us if least is None else min(least, us)
        out = []
        for place in sorted(passed):
            price, id_, trend = self.waiting.getValue(place)
            self.waiting.removeKey(place)
            if place[1] == _PRICE:
                out += self._traded(key[0], place[0], price)
            else:
                self._predicted(place[0], id_, trend)
        self._wake(least, timerValues)
        return iter(out)

    def _predicted(self, us: int, id_: int, trend: str) -> None:
        if not self.last.exists():
            return  # a prediction without a price before it is never scored
        base_us, base, _ = self.last.get()
        day = _local_day(us)
        if not self.left.containsKey((day,)):
            self.left.updateValue((day,), (self.n,))
        self.open.updateValue((day, id_), (us, base_us, base, trend))

    def _traded(self, symbol: str, us: int, price: float) -> list[Row]:
        day, out = _local_day(us), []
        if not self.last.exists() or self.last.get()[2] < day:
            over = set()
            for (of,), (left,) in [(tuple(k), tuple(v)) for k, v in self.left.iterator()]:
                if of < day and left == 1:
                    over.add(of)
                    self.left.removeKey((of,))
                elif of < day:
                    self.left.updateValue((of,), (left - 1,))
            for prediction in [k for k in map(tuple, self.open.keys()) if k[0] in over]:
                began, base_us, base, trend = self.open.getValue(prediction)
                out.append(Row(id=prediction[1], symbol=symbol, gold_trend=trend, at=began, baseline_at=base_us, baseline=base, nth_at=us, realized=price))
                self.open.removeKey(prediction)
        self.last.update((us, price, day))
        return out

    def close(self) -> None:
        pass


def settlements(stream: DataFrame, n: int, lateness: str = "1 hour", shards: int = 1) -> DataFrame:
    """Predictions as they settle: each once, when the first observation of the n-th trading day (at least 1) after its day
    has come. ``stream``: symbol, at, seq, kind (0 price, 1 prediction), price, id, trend; (at, kind, seq) tells a symbol's rows
    apart. With ``shards`` a symbol's predictions are dealt over so many groups, each of which sees all its prices."""
    if n < 1:
        raise ValueError("a prediction settles on a later trading day")
    rows = stream.withColumn("us", _us("at")).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    own = F.when(F.col("kind") == _PRICE, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.col("id"), F.lit(shards)).cast("int")))
    settled = StructType.fromDDL("id long, symbol string, gold_trend string, at long, baseline_at long, baseline double, nth_at long, realized double")
    out = rows.withColumn("shard", F.explode(own)).groupBy("symbol", "shard").transformWithState(Settlements(n), settled, "append", "EventTime")
    pct = X.pct_change(F.col("baseline"), F.col("realized"))
    return _times(out, "at", "baseline_at", "nth_at").withColumn("realized_pct", pct).withColumn("direction_correct", X.direction_correct(F.col("gold_trend"), F.col("realized_pct")))
