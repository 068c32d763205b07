"""Prices over the driver's event stream; articles are the moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import NOW, ctes, domain
from newsloom.operators import events as E
from newsloom.operators import market as M
from newsloom.plans.joins import asof_join
from newsloom.registry import query

SYMBOLS = ("signup", "error", "view", "click", "purchase")
MOMENTS = f"moments AS (SELECT id, {vocab.sql_pick(SYMBOLS, '(1 + id % 5)')} AS symbol, published_at AS happened, {vocab.sql_pick(vocab.GOLD_TRENDS, '(1 + id % 4)')} AS gold_trend, (1 + id % 5)::INT AS tier FROM article)"
DAYS = "days AS (SELECT symbol, (observed_at + INTERVAL 210 MINUTE)::DATE AS day, min(observed_at) AS first_at, max(observed_at) AS last_at, arg_max(price, observed_at) AS close_ FROM price GROUP BY ALL)"


def moments(spark, sf_dir):
    i = F.col("id")
    return domain(spark, sf_dir, "article").select("id", vocab.pick(SYMBOLS, 1 + i % 5).alias("symbol"), F.col("published_at").alias("at"), vocab.pick(vocab.GOLD_TRENDS, 1 + i % 4).alias("gold_trend"), (1 + i % 5).cast("int").alias("tier"))


def prices(spark, sf_dir):
    return domain(spark, sf_dir, "price")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("j07_asof_backward", f"WITH {ctes('article', 'price')}, {MOMENTS} SELECT id, m.symbol, p.observed_at, p.price FROM moments m ASOF LEFT JOIN price p ON m.symbol = p.symbol AND m.happened >= p.observed_at")
def j07(spark, sf_dir):
    return asof_join(moments(spark, sf_dir), prices(spark, sf_dir), ["symbol"], "at", "observed_at", ["price"]).select("id", "symbol", "observed_at", "price")


@query("j08_asof_tolerance", f"WITH {ctes('article', 'price')}, {MOMENTS}, j AS (SELECT id, m.happened, p.observed_at, p.price FROM moments m ASOF LEFT JOIN price p ON m.symbol = p.symbol AND m.happened >= p.observed_at) SELECT id, CASE WHEN near THEN observed_at END AS observed_at, CASE WHEN near THEN price END AS price FROM (SELECT *, happened - observed_at <= INTERVAL 20 MINUTE AS near FROM j)")
def j08(spark, sf_dir):
    # whole seconds, as moments of the driver's articles are whole minutes and the gap is far from the edge
    return asof_join(moments(spark, sf_dir), prices(spark, sf_dir), ["symbol"], "at", "observed_at", ["price"], tolerance_seconds=1200).select("id", "observed_at", "price")


@query("j09_asof_forward", f"WITH {ctes('article', 'price')}, {MOMENTS}, j AS (SELECT id, m.happened, p.observed_at, p.price FROM moments m ASOF LEFT JOIN price p ON m.symbol = p.symbol AND m.happened <= p.observed_at) SELECT id, CASE WHEN observed_at <= happened + INTERVAL 3 DAY THEN observed_at END AS observed_at, CASE WHEN observed_at <= happened + INTERVAL 3 DAY THEN price END AS price FROM j")
def j09(spark, sf_dir):
    return asof_join(moments(spark, sf_dir), prices(spark, sf_dir), ["symbol"], "at", "observed_at", ["price"], forward=True, tolerance_seconds=3 * 86_400).select("id", "observed_at", "price")


NTH = "(SELECT first_at FROM days d WHERE d.symbol = m.symbol AND d.day > (m.happened + INTERVAL 210 MINUTE)::DATE ORDER BY d.day LIMIT 1 OFFSET {})"


@query("j10_nth_trading_day", f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS} SELECT id, {NTH.format(2)} AS nth_at FROM moments m")
def j10(spark, sf_dir):
    return M.nth_trading_day(moments(spark, sf_dir), prices(spark, sf_dir), 3).select("id", "nth_at")


@query(
    "c08_backtest",
    f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS}, s AS (SELECT m.*, p.price AS baseline FROM moments m ASOF JOIN price p ON m.symbol = p.symbol AND m.happened >= p.observed_at), e AS (SELECT m.*, {NTH.format(0)} AS nth_at FROM s m), r AS (SELECT e.*, p.price AS realized, (p.price - baseline) / baseline * 100.0::DOUBLE AS realized_pct FROM e JOIN price p ON p.symbol = e.symbol AND p.observed_at = nth_at) SELECT id, baseline, realized, realized_pct, CASE gold_trend WHEN '↑' THEN realized_pct > 0.25::DOUBLE WHEN '↓' THEN realized_pct < -0.25::DOUBLE END AS direction_correct FROM r",
)
def c08(spark, sf_dir):
    return M.backtest(moments(spark, sf_dir), prices(spark, sf_dir), 1).select("id", "baseline", "realized", "realized_pct", "direction_correct")


def window_sql(name: str) -> str:
    start, end, slack = {"2h": ("happened - INTERVAL 2 HOUR", "happened + INTERVAL 2 HOUR", "1 HOUR"), "1d": ("happened", "happened + INTERVAL 1 DAY", "1 DAY"), "1td": ("happened", NTH.format(0), "4 DAY"), "3td": ("happened", NTH.format(2), "4 DAY")}[name]
    return f"""t AS (SELECT m.*, {start} AS start_, {end} AS end_ FROM moments m), b AS (SELECT t.*, p.observed_at AS before_at, p.price AS before_ FROM t ASOF JOIN price p ON t.symbol = p.symbol AND t.start_ >= p.observed_at WHERE end_ <= TIMESTAMP '{NOW}'),
r AS (SELECT b.*, p.observed_at AS after_at, p.price AS after_, (p.price - before_) / before_ * 100.0::DOUBLE AS pct_change FROM b ASOF JOIN price p ON b.symbol = p.symbol AND b.end_ >= p.observed_at WHERE start_ - before_at <= INTERVAL {slack} AND after_at > happened AND after_at <> before_at)"""


def _window(name):
    @query(f"c09_window_{name}", f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS}, {window_sql(name)} SELECT id, before_at, after_at, pct_change FROM r")
    def run(spark, sf_dir):
        w = M.window_prices(moments(spark, sf_dir), prices(spark, sf_dir), name, now())
        return w.select("id", "before_at", "after_at", ((F.col("after") - F.col("before")) / F.col("before") * 100.0).alias("pct_change"))

    return run


for _name in ("2h", "1d", "1td", "3td"):
    _window(_name)

_Z = """moves AS (SELECT * FROM (SELECT symbol, lag(last_at) OVER w AS from_at, last_at AS to_at, (close_ - lag(close_) OVER w) / lag(close_) OVER w * 100.0::DOUBLE AS move FROM days WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE from_at IS NOT NULL),
spread AS (SELECT r.id, CASE WHEN count(*) >= 10 AND stddev_pop(move) > 0 THEN stddev_pop(move) END AS spread FROM r JOIN moves v ON v.symbol = r.symbol AND to_at <= happened AND from_at >= happened - INTERVAL 30 DAY GROUP BY 1), z AS (SELECT r.*, abs(pct_change) / spread AS abs_z FROM r LEFT JOIN spread USING (id))"""


def _reactions(spark, sf_dir):
    w = M.window_prices(moments(spark, sf_dir), prices(spark, sf_dir), "1d", now())
    w = w.withColumn("pct_change", (F.col("after") - F.col("before")) / F.col("before") * 100.0)
    return M.with_abs_z(w, prices(spark, sf_dir))


@query("w04_abs_z", f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS}, {window_sql('1d')}, {_Z} SELECT id, abs_z FROM z")
def w04(spark, sf_dir):
    return _reactions(spark, sf_dir).select("id", "abs_z")


@query("a27_calibration", f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS}, {window_sql('1d')}, {_Z} SELECT tier, symbol, count(*) AS reactions, count(abs_z) AS scored, count(*) FILTER (abs_z >= 1) AS hits, avg(abs_z) AS mean_abs_z, count(*) FILTER (abs_z >= 1) / nullif(count(abs_z), 0)::DOUBLE AS hit_rate FROM z GROUP BY GROUPING SETS ((tier), (symbol))")
def a27(spark, sf_dir):
    return M.calibration(_reactions(spark, sf_dir), ["tier", "symbol"])


_A34 = f"WITH {ctes('price')}, g AS (SELECT symbol, lag(observed_at) OVER (PARTITION BY symbol ORDER BY observed_at) AS from_at, observed_at AS to_at FROM price) SELECT * FROM g WHERE to_at - from_at > INTERVAL 20 MINUTE"
@query("a34_timeline_gaps", _A34)
@query("a34_timeline_gaps_whole", _A34)
def a34(spark, sf_dir):
    """All prices; they are minutes apart, so the silence sought is shorter."""
    return E.timeline_gaps(prices(spark, sf_dir), days=0, minutes=20)


@query("c10_market_context", f"WITH {ctes('price')}, w AS (SELECT symbol, arg_max(price, observed_at) AS last_price, arg_max(price, observed_at) FILTER (observed_at <= TIMESTAMP '2024-01-24') AS week_ago FROM price WHERE symbol IN ('view', 'purchase') AND observed_at <= TIMESTAMP '{NOW}' GROUP BY 1) SELECT symbol, last_price, (last_price - week_ago) / week_ago * 100.0::DOUBLE AS change FROM w")
def c10(spark, sf_dir):
    """Last price and its change over a week, of two symbols, in one aggregation."""
    p = prices(spark, sf_dir).where(F.col("symbol").isin("view", "purchase") & (F.col("observed_at") <= now()))
    week = F.max_by(F.when(F.col("observed_at") <= now() - F.make_dt_interval(days=F.lit(7)), F.col("price")), F.when(F.col("observed_at") <= now() - F.make_dt_interval(days=F.lit(7)), F.col("observed_at")))
    w = p.groupBy("symbol").agg(F.max_by("price", "observed_at").alias("last_price"), week.alias("week_ago"))
    return w.select("symbol", "last_price", ((F.col("last_price") - F.col("week_ago")) / F.col("week_ago") * 100.0).alias("change"))


@query("c30_market_view", f"WITH {ctes('price')} SELECT symbol, count(*) AS points, min(price) AS low, max(price) AS high, max(observed_at) AS last_at, arg_max(price, observed_at) AS last_price FROM price WHERE observed_at >= TIMESTAMP '2024-01-20' GROUP BY 1")
def c30(spark, sf_dir):
    p = prices(spark, sf_dir).where("observed_at >= timestamp_ntz'2024-01-20'")
    return p.groupBy("symbol").agg(F.count("*").alias("points"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("observed_at").alias("last_at"), F.max_by("price", "observed_at").alias("last_price"))


@query("c17_macro_tiles", f"WITH {ctes('price')}, catalogue(symbol, place) AS (VALUES ('view', 1), ('click', 2), ('gold', 3)), days AS (SELECT symbol, observed_at::DATE AS day, arg_max(price, observed_at) AS price FROM price GROUP BY ALL), spark AS (SELECT symbol, string_agg(printf('%.2f', price), ',' ORDER BY day) AS spark FROM days GROUP BY 1) SELECT c.symbol, place, spark IS NOT NULL AS available, coalesce(spark, '') AS spark FROM catalogue c LEFT JOIN spark USING (symbol)")
def c17(spark, sf_dir):
    catalogue = spark.createDataFrame([("view", 1), ("click", 2), ("gold", 3)], "symbol string, place int")
    days = prices(spark, sf_dir).groupBy("symbol", F.to_date("observed_at").alias("day")).agg(F.max_by("price", "observed_at").alias("price"))
    lines = days.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "price"))), lambda x: F.format_string("%.2f", x["price"])), ",").alias("spark"))
    return catalogue.join(lines, "symbol", "left").select("symbol", "place", F.col("spark").isNotNull().alias("available"), F.coalesce("spark", F.lit("")).alias("spark"))


_LATER = "(SELECT min({{'t': observed_at, 'p': price}}) FROM price p WHERE p.symbol = b.symbol AND observed_at >= happened + INTERVAL {0} DAY AND observed_at <= happened + INTERVAL {1} DAY)"


def _change(days: int) -> str:
    return f"CASE WHEN happened + INTERVAL {days} DAY <= TIMESTAMP '{NOW}' THEN round(100 * ({_LATER.format(days, days + 3)}.p - before_) / nullif(before_, 0), 2) END"


@query("c12_observed_changes", f"WITH {ctes('article', 'price')}, {MOMENTS}, b AS (SELECT m.id, m.symbol, m.happened, CASE WHEN m.happened - p.observed_at <= INTERVAL 3 DAY THEN p.price END AS before_ FROM moments m ASOF LEFT JOIN price p ON m.symbol = p.symbol AND m.happened >= p.observed_at) SELECT id, symbol, {_change(1)} AS change_1d, {_change(7)} AS change_1w FROM b")
def c12_changes(spark, sf_dir):
    return M.observed_changes(moments(spark, sf_dir), prices(spark, sf_dir), now()).select("id", "symbol", "change_1d", "change_1w")
