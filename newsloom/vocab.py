"""Ordered vocabularies. Order is meaning: a level's score is its place, from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words that stored answers hold, in their order.
LEVELS = ("خیلی کم", "کم", "متوسط", "زیاد", "خیلی زیاد")
CATEGORIES = ("security", "economics", "security/economics", "other")
BOTH_CATEGORIES = "security/economics"
GOLD_TRENDS = ("↑", "↓", "خنثی", "نامطمئن")
NOTIFY, NO_NOTIFY, INSUFFICIENT = "اطلاع‌رسانی شود", "اطلاع‌رسانی نشود", "ارزیابی ناکافی"
NOTIFY_STATUSES = (NOTIFY, NO_NOTIFY, INSUFFICIENT)
EVENT_CATEGORIES = ("conflict_security", "sanctions_diplomacy", "macro_monetary", "energy_commodities", "iran_economy_policy", "markets_companies", "disasters", "social_unrest", "other")
LEGACY_EVENT_CATEGORIES = {"monetary": "macro_monetary", "macro": "macro_monetary", "sanctions_trade": "sanctions_diplomacy", "geopolitics": "sanctions_diplomacy", "energy": "energy_commodities", "markets": "markets_companies"}
LEGACY_CATEGORY = {"conflict_security": "security", "social_unrest": "security", "sanctions_diplomacy": "security/economics", "disasters": "security/economics", "macro_monetary": "economics", "energy_commodities": "economics", "iran_economy_policy": "economics", "markets_companies": "economics"}
OCCURRENCE_LEVEL = {"official": LEVELS[4], "multi": LEVELS[3], "single": LEVELS[2], "disputed": LEVELS[1]}
ANSWERED_SCORES = ("iran", "global", "asset_fx", "asset_gold", "asset_tehran_index", "asset_oil", "asset_bitcoin")
ERROR_CLASSES = ("network", "blocked", "parse", "rate_limit", "gone", "provider")
RUN_STATUSES = ("no_work", "quota_exhausted", "circuit_open", "aborted", "partial", "success", "failed")
OPEN_CIRCUITS = ("open_budget", "open_errors", "stopped")
STAGES = ("assess", "brief", "translate", "memory")


def table(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    """A vocabulary as rows (name, place); its size is fixed in code, so it may be broadcast."""
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], f"{name} string, place int")


def pick(values: tuple[str, ...], place: Column) -> Column:
    """The value at a place from 1; null for null or a place outside."""
    return F.try_element_at(F.array(*map(F.lit, values)), F.when(place != 0, place.cast("int")))


def lookup(names: dict[str, str], key: Column, default: str) -> Column:
    """The value of a fixed table, by its few keys."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), F.lit(default))


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_pick(values: tuple[str, ...], place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(values)) + " END"
