"""Ordinal votes, impact, bands and the other rules of a single row. What is not assessed is null and stays so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.functions.text import clean, fold


def level_score(level: Column) -> Column:
    """The place of a level, null for what is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, vocab.LEVELS)), level), F.lit(0))


def decide(*axes: Column) -> Column:
    """Fewer than two assessed are too few; any of the lowest says no; two high ones say yes."""
    scores = F.filter(F.array(*[level_score(a) for a in axes]), lambda s: s.isNotNull())
    high = F.size(F.filter(scores, lambda s: s >= 4))
    return F.when(F.size(scores) < 2, F.lit(vocab.INSUFFICIENT)).when(F.array_min(scores) < 2, F.lit(vocab.NO_NOTIFY)).when(high >= 2, F.lit(vocab.NOTIFY)).otherwise(F.lit(vocab.NO_NOTIFY))


def quality_flag(title: Column, lead: Column, content: Column, url: Column, published: Column, now: Column) -> Column:
    """The first reason that fails, '' for none. Title, lead and content together are the evidence, each as it is shown."""
    shown = [clean(c) for c in (title, lead, content)]
    return (
        F.when(shown[0] == "", F.lit("missing_title"))
        .when(F.length(shown[0]) < 10, F.lit("title_too_short"))
        .when(sum((F.length(c) for c in shown), F.lit(0)) < 40, F.lit("insufficient_text"))
        .when(published > now + F.make_dt_interval(hours=F.lit(6)), F.lit("published_in_future"))
        .when(~F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False)), F.lit("invalid_url"))
        .otherwise(F.lit(""))
    )


def impact(iran: Column, world: Column) -> Column:
    """60/40, one alone stands for both."""
    return F.coalesce(0.6 * iran + 0.4 * world, iran, world)


def band(score: Column, cuts: tuple = (20, 40, 60, 80)) -> Column:
    """X06."""
    return sum(((score >= c).cast("int") for c in cuts), F.lit(1))


def tier(score: Column, cutoffs: Column) -> Column:
    """Against an array of cut-offs; infinity cannot be reached."""
    return F.when(score.isNotNull(), F.size(F.filter(cutoffs, lambda c: score >= c)) + 1)


def brief_eligible(category: Column, level: Column, watched: Column) -> Column:
    """X08."""
    return F.coalesce(~F.coalesce(category, F.lit("")).isin("", "other") & ((level >= 4) | (watched & (level >= 3))), F.lit(False))


def rank_score(iran: Column, world: Column, hours: Column) -> Column:
    """Halves every twelve hours; here what is missing counts as 0."""
    return (0.6 * F.coalesce(iran, F.lit(0.0)) + 0.4 * F.coalesce(world, F.lit(0.0))) * F.pow(F.lit(0.5), hours / 12.0)


def alert_reason(dial: Column, level: Column, world_level: Column, watched: Column) -> Column:
    """Breaking news reach everybody; what is watched, those whose dial is at or under its tier, an unknown dial as a medium one; else ''."""
    floor = F.when(dial == "low", 2).when(dial == "high", 4).otherwise(3)
    return F.when(world_level >= 5, F.lit("breaking")).when(watched & (level >= floor), F.lit("watch")).otherwise(F.lit(""))


def alert_change(old_tier: Column, tier_: Column, old_evidence: Column, evidence: Column) -> Column:
    """An update only where evidence turned or the tier rose."""
    return F.when(old_evidence != evidence, F.lit("evidence")).when(tier_ > old_tier, F.lit("tier"))


def direction_correct(trend: Column, pct: Column, deadband: float = 0.25) -> Column:
    """X11: null where neither way was called."""
    return F.when(trend == vocab.GOLD_TRENDS[0], pct > deadband).when(trend == vocab.GOLD_TRENDS[1], pct < -deadband)


def pct_change(before: Column, after: Column) -> Column:
    """X12."""
    return (after - before) / before * 100.0


def error_class(error: Column) -> Column:
    """The cause of a failed fetch, '' for none. ``error``: an exception's name and what it says, which may hold a status."""
    name = F.lower(F.regexp_extract(error, "^(\\w*)", 1))
    status = F.regexp_extract(error, "\\bHTTP (\\d{3})\\b", 1).try_cast("int")
    return (
        F.when(F.coalesce(error, F.lit("")) == "", F.lit(""))
        .when(name == "gone", F.lit("gone"))
        .when(name.isin("fatal", "budgetexceeded"), F.lit("provider"))
        .when(status == 429, F.lit("rate_limit"))
        .when(status.isin(404, 410), F.lit("gone"))
        .when(status.isin(401, 403, 451) | name.contains("blocked"), F.lit("blocked"))
        .when((status >= 500) | name.rlike("^transient$|timeout|connection|ssl|socket"), F.lit("network"))
        .otherwise(F.lit("parse"))
    )


def event_topic(slug: Column) -> Column:
    """A stored category in today's vocabulary."""
    s = F.coalesce(slug, F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in vocab.LEGACY_EVENT_CATEGORIES.items() for x in pair])[s], s)


def price(text: Column) -> Column:
    """A price's text to a decimal; null if it is none."""
    return F.replace(fold(text, compose=False), F.lit(","), F.lit("")).try_cast("decimal(20,4)")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million; a negative one gives null."""
    return F.when((price_in >= 0) & (price_out >= 0), (tokens_in * price_in + tokens_out * price_out) / 1e6)


def retry_minutes(attempts: Column) -> Column:
    """Doubles from five minutes up to six hours."""
    return F.least(F.lit(360.0), 5.0 * F.pow(F.lit(2.0), attempts - 1))


def gives_up(attempts: Column, cause: Column) -> Column:
    return (attempts >= 6) | ~cause.isin("network", "rate_limit")


def stored_score(answer: Column) -> Column:
    """An answer of 0 to 4 as 0 to 100; null outside."""
    return F.when((answer >= 0) & (answer <= 4), F.bround(answer * 25).cast("int"))


def matched(choice: Column, candidates: Column, p: Column) -> Column:
    """X22."""
    return F.coalesce(F.array_contains(candidates, choice) & (p >= 0.9) & (p <= 1.0), F.lit(False))


def stance(value: Column, confidence: Column) -> tuple[Column, Column]:
    """The default stance, and a confidence only within 0..1."""
    known = value.isin("reports", "supports", "contradicts", "updates")
    return F.when(known, value).otherwise(F.lit("reports")), F.when((confidence >= 0) & (confidence <= 1), confidence)


def chart_days(age_days: Column) -> Column:
    """The smallest range of which an age is no more than 0.7."""
    out = F.lit(365)
    for days in (180, 90, 30, 7):
        out = F.when(age_days <= 0.7 * days, F.lit(days)).otherwise(out)
    return out


def toman(rial: Column) -> Column:
    """A tenth; whole from a thousand on, else to two places; halves go up."""
    t = rial / 10.0
    return F.when(F.abs(t) >= 1000, F.floor(t + 0.5).cast("double")).otherwise(F.floor(t * 100 + 0.5) / 100.0)


def direction_glyph(pct: Column) -> Column:
    """Which way, and nothing of good or bad."""
    return F.when(pct > 0, "▲").when(pct < 0, "▼").otherwise("→")


def legacy_category(slug: Column) -> Column:
    """A topic in the words of the old categories; other for what had none."""
    return vocab.lookup(vocab.LEGACY_CATEGORY, event_topic(slug), "other")


def occurrence_level(evidence: Column) -> Column:
    """How sure it is that something happened, from who reports it; blank for no evidence."""
    return vocab.lookup(vocab.OCCURRENCE_LEVEL, F.coalesce(evidence, F.lit("")), "")


def level_label(score: Column) -> Column:
    """A score of 0 to 100 as a level; blank where it is not assessed."""
    return F.coalesce(vocab.pick(vocab.LEVELS, band(score)), F.lit(""))


def answered(category: Column, scores: dict[str, Column], confidences: list[Column]) -> Column:
    """A model's whole answer as stored: category, the seven scores as 0 to 100, the least of the confidences; null where
    any part is outside its scale."""
    stored = [stored_score(scores[k]).alias(k) for k in vocab.ANSWERED_SCORES]
    sure = F.least(*[F.coalesce(c, F.lit(0.0)) for c in confidences])
    fine = category.isin(*vocab.EVENT_CATEGORIES) & (sure >= 0) & (sure <= 1)
    for k in vocab.ANSWERED_SCORES:
        fine = fine & stored_score(scores[k]).isNotNull()
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(category.alias("category"), *stored, sure.alias("confidence")))


def push_worthy(confidence: Column, lead_tier: Column, sources: Column, iran: Column, world: Column, asset: Column) -> Column:
    """X31."""
    return F.coalesce((confidence >= 0.8) & ((lead_tier == 1) | (sources >= 2)) & ((iran >= 80) | (world >= 85) | (asset >= 80)), F.lit(False))


def pause_reason(circuit: Column, month: Column, today: Column, month_limit: Column, day_limit: Column) -> Column:
    """Why no call to a model can run, '' if nothing is in the way: an empty wallet, another open circuit, the month's budget, the day's."""
    return F.when(circuit == "open_budget", "wallet_empty").when(circuit.isin(*vocab.OPEN_CIRCUITS), "circuit_open").when(month >= month_limit, "monthly_budget").when(today >= day_limit, "daily_budget").otherwise("")


def boosted_place(place: Column, watched: Column) -> Column:
    """What is watched moves up by five and a half places."""
    return place - F.when(watched, F.lit(5.5)).otherwise(F.lit(0.0))
