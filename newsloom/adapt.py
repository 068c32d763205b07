"""The driver's tables as domain tables.

Each column is one SQL expression that Spark and DuckDB read alike, or a pair
where they spell it differently, so a query and its SQL start from one mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom import vocab
from newsloom.tables import read

#: The moments that stand for "now": behind all events of the stream table, and behind all orders.
NOW, EVENT_NOW = "2024-01-31 00:00:00", "2001-08-01 00:00:00"

_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END"


def _minutes(start: str, n: str) -> tuple[str, str]:
    return f"timestamp_ntz'{start}' + make_dt_interval(0, 0, cast({n} AS INT), 0)", f"TIMESTAMP '{start}' + to_minutes(CAST({n} AS INTEGER))"


DOMAIN: dict[str, tuple[str, dict[str, str | tuple[str, str]]]] = {
    "article": (
        "documents",
        {
            "id": "doc_id",
            "source_id": "source",
            "language": "lang",
            "title": "substr(split_part(text, chr(10), 1), 1, 120)",
            "lead": "substr(text, 1, 200)",
            "content": "text",
            "native_category": "concat('cat', CAST(doc_id % 7 AS VARCHAR(9)))",
            "url": "concat(CASE WHEN doc_id % 11 = 0 THEN 'javascript:' ELSE 'https://example.org/' END, CAST(doc_id AS VARCHAR(19)))",
            "published_at": _minutes("2024-01-01 00:00:00", "doc_id * 43"),
            "created_at": _minutes("2024-01-01 00:00:00", "doc_id * 43 + (doc_id * 7) % 20"),
        },
    ),
    "source": (
        "(SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents)",
        {
            "source_id": "source",
            "tier": "1 + n % 2",
            "priority": "n",
            "independence_group": "CASE WHEN n % 7 = 6 THEN NULL WHEN n % 10 = 0 THEN concat('official', CAST(n AS VARCHAR(9))) ELSE concat('g', CAST(n % 5 AS VARCHAR(9))) END",
            "is_aggregator": "n % 7 = 6",
        },
    ),
    "evaluation": (
        "orders",
        {
            "id": "o_orderkey",
            "article_id": "o_orderkey % 200",
            "variant": "o_orderstatus",
            "created_at": "o_orderdate",
            "axis1": vocab.sql_pick(vocab.LEVELS, f"({_PRIORITY})"),
            "axis2": vocab.sql_pick(vocab.LEVELS, "(1 + CAST(floor(o_totalprice) AS BIGINT) % 5)"),
            "axis3": vocab.sql_pick(vocab.LEVELS, "(1 + o_custkey % 6)"),
            "gold_trend": vocab.sql_pick(vocab.GOLD_TRENDS, "(1 + o_custkey % 4)"),
        },
    ),
    "classification": ("orders", {"id": "o_orderkey", "article_id": "o_orderkey % 200", "variant": "o_orderstatus", "category": vocab.sql_pick(vocab.CATEGORIES, "(1 + o_custkey % 4)"), "created_at": "o_orderdate"}),
    "news_event": (
        "orders",
        {
            "id": "o_orderkey",
            "event_time": "o_orderdate",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'assessed' WHEN 'O' THEN 'developing' ELSE 'corrected' END",
            "hidden": "o_orderkey % 17 = 0",
            "category": vocab.sql_pick(vocab.EVENT_CATEGORIES, "(1 + o_custkey % 9)"),
            "iran_score": f"CAST(20 * ({_PRIORITY}) AS DOUBLE)",
            "global_score": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE)",
            "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE)",
            "primary_article_id": "o_orderkey % 200",
        },
    ),
    "report": (
        "(SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
        {
            "event_id": "l_orderkey",
            "report_id": "l_orderkey * 10 + l_linenumber",
            "source_id": "l_suppkey",
            "independence_group": "CASE WHEN s_nationkey % 7 = 6 THEN NULL WHEN s_nationkey % 10 = 0 THEN concat('official', CAST(s_nationkey AS VARCHAR(9))) ELSE concat('g', CAST(s_nationkey AS VARCHAR(9))) END",
            "stance": "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'contradicts' ELSE 'reports' END",
            "reported_at": "l_shipdate",
        },
    ),
    "price": ("events", {"symbol": "event_type", "observed_at": "ts", "price": "value"}),
    "attempt": (
        "events",
        {
            "id": "event_id",
            "source_id": "user_id",
            "started_at": "ts",
            "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'empty' ELSE 'success' END",
            "error": "CASE WHEN event_type = 'error' THEN concat('HTTP ', CASE event_id % 5 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN '404' WHEN 3 THEN '403' ELSE 'none' END) ELSE '' END",
            "fetched": "CAST(floor(value) AS BIGINT)",
            "new": "CAST(floor(value / 2) AS BIGINT)",
        },
    ),
    "usage": (
        "events",
        {"id": "event_id", "stage": vocab.sql_pick(vocab.STAGES, "(1 + event_id % 4)"), "provider": "concat('p', CAST(user_id % 3 AS VARCHAR(9)))", "cost": "value", "event_key": "event_id % 500", "run_id": "user_id", "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END", "created_at": "ts"},
    ),
    "account": ("customer", {"user_id": "c_custkey", "dial": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'low' WHEN 'BUILDING' THEN 'high' ELSE 'medium' END", "quiet_start": "CAST(60 * (c_custkey % 24) AS INT)", "quiet_end": "CAST(60 * ((c_custkey * 7) % 24) AS INT)", "item": "concat('Brand#', CAST(1 + c_custkey % 25 AS VARCHAR(9)))"}),
    "tag": ("(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)", {"event_id": "l_orderkey", "item": "p_brand", "created_at": "l_shipdate"}),
    "review": ("labels", {"article_id": "doc_id", "quality": "quality", "toxic": "toxic"}),
}


def _says(expression: str | tuple[str, str], engine: int) -> str:
    return expression if isinstance(expression, str) else expression[engine]


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, lazily; only the columns that are used reach the scan."""
    table, columns = DOMAIN[name]
    source = _joined(spark, sf_dir, name) if table.startswith("(") else read(spark, sf_dir, table)
    return source.selectExpr(*[f"{_says(e, 0)} AS {c}" for c, e in columns.items()])


def _joined(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "source":
        return read(spark, sf_dir, "documents").selectExpr("source", "CAST(substr(source, 4) AS INT) AS n").distinct()
    lines = read(spark, sf_dir, "lineitem")
    if name == "report":
        right = read(spark, sf_dir, "supplier")
        return lines.join(right, lines["l_suppkey"] == right["s_suppkey"])
    right = read(spark, sf_dir, "part")
    return lines.join(right, lines["l_partkey"] == right["p_partkey"])


def ctes(*names: str) -> str:
    """The same domain tables as SQL, to stand behind WITH."""
    parts = []
    for name in names:
        table, columns = DOMAIN[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{_says(e, 1)} AS {c}' for c, e in columns.items())} FROM {table})")
    return ", ".join(parts)
