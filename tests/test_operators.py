"""Operators on small tables, against plain loops and cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import articles as A
from newsloom.operators import composites as C
from newsloom.operators import events as E
from newsloom.operators import market as M
from newsloom.operators import ops as O
from newsloom.operators import retrieval as R
from newsloom.plans.graph import components
from newsloom.plans.joins import asof_join, range_join
from newsloom.sources import pages as S

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [600, 86_400])
def test_asof_equals_brute_force(spark, forward, bucket):
    r = random.Random(1)
    left = [(i, r.choice("ab"), at(r.randrange(5000))) for i in range(80)]
    right = [(r.choice("abc"), at(5 * r.randrange(1000)), float(k)) for k in range(60)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    got = asof_join(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v double"), ["k"], "t", "u", ["v"], forward=forward, bucket_seconds=bucket, tolerance_seconds=60_000)
    for row in got.collect():
        fits = [(u, v) for k, u, v in right if k == row.k and (u >= row.t if forward else u <= row.t)]
        best = (min if forward else max)(fits) if fits else (None, None)
        if best[0] is not None and abs((row.t - best[0]).total_seconds()) > 60_000:
            best = (None, None)
        assert (row.u, row.v) == best
    assert got.count() == len(left)


def test_range_join_equals_brute_force(spark):
    r = random.Random(2)
    left, right = [(i, at(r.randrange(3000))) for i in range(60)], [(i, at(r.randrange(3000))) for i in range(60)]
    got = range_join(spark.createDataFrame(left, "i int, t timestamp_ntz"), spark.createDataFrame(right, "j int, u timestamp_ntz"), "t", "u", 3600)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, t in left for j, u in right if abs(t - u) <= timedelta(hours=1))


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_chain_of_titles_is_one_group(spark):
    """A~B, B~C, A not ~C: one component, whose best member is canonical."""
    rows = [(1, "abcdefghijkl", at(0), False, 5, "x"), (2, "abcdefghijklmn", at(1), True, 9, "x"), (3, "abcdefghijklmnop", at(2), False, 1, "xxxx")]
    a = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz, classified boolean, priority int, content string")
    pairs = A.similar_pairs(a)
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == [(1, 2), (2, 3)]
    assert sorted((r.id, r.canonical_id) for r in A.elect(a, pairs).collect()) == [(1, 2), (3, 2)]


def test_titles_out_of_the_window_are_no_copies(spark):
    rows = [(1, "the very same title", at(0)), (2, "the very same title", at(36 * 60)), (3, "the very same title", at(72 * 60 + 1))]
    got = A.similar_pairs(spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz")).collect()
    assert [(r.left_id, r.right_id, r.score) for r in got] == [(1, 2, 1.0)]


def test_shortlist_by_keys(spark):
    """Keys on both sides, endings, the longest alias first, ties to the first met."""
    items = [("gold", ["gold", "gold coin"]), ("coin", ["coin", "gold"]), ("iran", ["iran"]), ("box", ["box"]), ("oil", ["Oil-Price"]), ("tax", ["tax"]), ("none", ["", "--"])]
    rows = [(1, "Gold coins and gold. A coin; iranian Iran"), (2, "golden"), (3, None), (4, "Boxes, oil-price and taxes"), (5, "tax box tax box"), (6, "ایرانی")]
    got = {(r.id, r.slug): r.hits for r in A.shortlist(spark.createDataFrame(rows, "id long, t string"), items, F.col("t")).collect()}
    assert got == {(1, "gold"): 2, (1, "coin"): 1, (1, "iran"): 1, (4, "box"): 1, (4, "oil"): 1, (4, "tax"): 1, (5, "tax"): 2, (5, "box"): 2}
    one = A.shortlist(spark.createDataFrame(rows, "id long, t string"), items, F.col("t"), 1)
    assert {(r.id, r.slug) for r in one.collect()} == {(1, "gold"), (4, "box"), (5, "tax")}
    assert A.shortlist(spark.createDataFrame(rows, "id long, t string"), [("none", ["-"])], F.col("t")).count() == 0


@pytest.mark.parametrize(
    "reports,level",
    [
        ([("state", "reports"), ("state", "reports")], "single"),
        ([("irna", "reports"), ("mehr", "reports")], "multi"),
        ([("state", "reports"), ("official1", "reports")], "official"),
        ([("a", "reports"), ("b", "contradicts")], "disputed"),
        ([("a", "reports"), ("a", "contradicts")], "single"),
        ([("a", "reports"), (None, "contradicts")], "single"),
        ([(None, "reports")], "single"),
    ],
)
def test_evidence(spark, reports, level):
    df = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate(reports)], "event_id long, report_id long, independence_group string, stance string")
    assert E.evidence(df).first().evidence_level == level
    assert E.evidence(df, spark.createDataFrame([(1, "disputed")], "event_id long, evidence_level string")).first().evidence_level == "disputed"


def test_cutoffs(spark):
    c = E.cutoffs(spark.createDataFrame([("iran", float(s)) for s in range(1000)], "axis string, score double")).first()
    assert [sum(s >= x for s in range(1000)) for x in c.cuts] == [600, 300, 100, 20]
    c = E.cutoffs(spark.createDataFrame([("iran", 100.0 if k < 50 else 50.0) for k in range(1000)], "axis string, score double")).first()
    assert c.cuts[3] == float("inf") and c.cuts[2] == 100.0
    assert E.cutoffs(spark.createDataFrame([("iran", 1.0)], "axis string, score double")).first().basis == "fixed"


def ledger_brute(rows):
    told, out = {}, []
    for r in sorted(rows, key=lambda r: r[2:]):
        key, new = r[:2], (r[4], r[5])
        old = told.get(key)
        if r[6] and old is not None:
            told[key] = new
        elif old is None or new[1] != old[1] or new[0] > old[0]:
            told[key] = new
            out.append((*r[:4], "new" if old is None else "update"))
    return sorted(out)


def changes():
    r = random.Random(5)
    return [(r.randrange(3), r.randrange(4), at(k), k, 1 + r.randrange(5), r.choice(["multi", "disputed"]), r.random() < 0.1) for k in range(120)]


CHANGES = "user_id long, event_id long, at timestamp, seq long, tier int, evidence_level string, merged boolean"


@pytest.mark.parametrize("block_seconds", [60, 600, 86_400])
def test_ledger_equals_a_loop(spark, block_seconds):
    """Rows of any spread over blocks; ties in (at, seq) are ordered by what they say."""
    rows = changes() + [(0, 0, at(7), 7, t, e, m) for t in (1, 5) for e in ("multi", "disputed") for m in (False, True)]
    got = E.alert_ledger(spark.createDataFrame(rows, CHANGES).repartition(5), block_seconds).collect()
    assert sorted((r.user_id, r.event_id, r.at, r.seq, r.kind) for r in got) == ledger_brute(rows)


def test_alerts_reach_whom_they_should(spark):
    """Hidden, withdrawn, other and unassessed events alert nobody; neither do plans without alerts; breaking news reach all others once."""
    events = [(1, False, "assessed", "oil", 50.0, 9, 3, 2), (2, True, "assessed", "oil", 50.0, 9, 5, 5), (3, False, "withdrawn", "oil", 50.0, 9, 5, 5), (4, False, "assessed", "other", 50.0, 9, 5, 5), (5, False, "assessed", "oil", None, 9, 5, 5), (6, False, "assessed", "oil", 50.0, 8, 5, 5), (7, False, "assessed", "oil", 50.0, 9, 4, 5), (8, False, "assessed", None, 50.0, 9, 5, 5)]
    e = spark.createDataFrame(events, "id long, hidden boolean, status string, category string, iran_score double, primary_article_id long, tier int, global_tier int")
    tags = spark.createDataFrame([(k, "gold") for k in range(1, 9)] * 2, "event_id long, item string")
    accounts = spark.createDataFrame([(10, "medium", True), (11, "high", True), (12, "low", False), (13, None, True)], "user_id long, dial string, alerts boolean")
    watches = spark.createDataFrame([(10, "gold"), (10, "gold"), (11, "gold"), (12, "gold")], "user_id long, item string")
    open_ = E.alertable(e, spark.createDataFrame([(8,)], "id long"))
    got = sorted(tuple(r) for r in E.alert_matches(open_, tags, watches, accounts).collect())
    assert got == [(10, 1, "watch"), (10, 7, "breaking"), (11, 7, "breaking"), (13, 7, "breaking")]


def test_breaking_news_are_not_held(spark):
    accounts = spark.createDataFrame([(1, 0, 1439)], "user_id long, quiet_start int, quiet_end int")
    alerts = spark.createDataFrame([(1, 5, T0, 1, 3, True), (1, 6, T0, 2, 3, False), (1, 7, T0, 3, 5, False)], "user_id long, event_id long, at timestamp_ntz, seq long, tier int, breaking boolean")
    assert {r.event_id: r.held for r in E.pushes(alerts, accounts).collect()} == {5: "", 6: "quiet", 7: ""}


def test_coverage_case(spark):
    rows = [("s", at(m), i, s, "") for i, (m, s) in enumerate([(0, "covered"), (2, "covered"), (4, "gap"), (6, "gap"), (60, "covered")])]
    got = sorted((r.started_at, r.ended_at, r.state) for r in O.coverage(spark.createDataFrame(rows, "source_id string, at timestamp_ntz, seq long, state string, error_class string")).collect())
    assert got == [(at(0), at(2), "covered"), (at(2), at(6), "gap"), (at(6), at(60), "unknown"), (at(60), at(60), "covered")]


def test_trading_days(spark):
    """A day without an observation is no trading day; the day of the moment is day zero."""
    days = [0, 1, 3, 4]
    prices = spark.createDataFrame([("g", T0 + timedelta(days=d, hours=9), float(100 + d)) for d in days], "symbol string, observed_at timestamp_ntz, price double")
    moments = spark.createDataFrame([("g", T0 + timedelta(hours=14))], "symbol string, at timestamp_ntz")
    got = {n: M.nth_trading_day(moments, prices, n).first().nth_at for n in (1, 2, 3, 4)}
    assert got == {1: T0 + timedelta(days=1, hours=9), 2: T0 + timedelta(days=3, hours=9), 3: T0 + timedelta(days=4, hours=9), 4: None}


def test_reaction_windows(spark):
    prices = spark.createDataFrame([("g", T0 + timedelta(hours=h), float(100 + h)) for h in range(24)], "symbol string, observed_at timestamp_ntz, price double")
    events = lambda *m: spark.createDataFrame([(i, "g", t) for i, t in enumerate(m)], "id long, symbol string, at timestamp_ntz")
    now = F.lit(T0 + timedelta(days=3)).cast("timestamp_ntz")
    r = M.window_prices(events(T0 + timedelta(hours=6)), prices, "2h", now).first()
    assert (r.before_at, r.before, r.after_at, r.after) == (T0 + timedelta(hours=4), 104.0, T0 + timedelta(hours=8), 108.0)
    assert M.window_prices(events(T0 + timedelta(hours=40)), prices, "2h", now).count() == 0  # stale
    assert M.window_prices(events(T0 + timedelta(hours=6)), prices, "1d", F.lit(T0 + timedelta(hours=7)).cast("timestamp_ntz")).count() == 0  # not over


def test_abs_z(spark):
    start = datetime(2024, 1, 1, 9)
    closes = [100.0]
    for k in range(20):
        closes.append(closes[-1] * (1.01 if k % 2 == 0 else 0.99))
    prices = spark.createDataFrame([("g", start + timedelta(days=d), p) for d, p in enumerate(closes)], "symbol string, observed_at timestamp_ntz, price double")
    change = spark.createDataFrame([(1, "g", start + timedelta(days=20, hours=1), -2.0), (2, "g", start + timedelta(days=5), -2.0)], "id long, symbol string, at timestamp_ntz, pct_change double")
    got = {r.id: r.abs_z for r in M.with_abs_z(change, prices).collect()}
    assert got[1] == pytest.approx(2.0, abs=0.05) and got[2] is None


def test_storylines(spark):
    near, far = [1.0] + [0.0] * 7, [0.99, 0.1] + [0.0] * 6
    rows = [(1, at(0), "disasters", None), (2, at(10), "disasters", None), (3, at(20), "disasters", None), (4, at(30), "social_unrest", near), (5, at(40), "markets", far), (6, at(60 * 24 * 15), "disasters", None)]
    events = spark.createDataFrame(rows, "id long, event_time timestamp_ntz, category string, vector array<float>")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (6, "a"), (6, "b")], "event_id long, item string")
    assert sorted((r.event_id, r.storyline_id) for r in R.storylines(events, tags).collect()) == [(1, 1), (2, 1), (4, 4), (5, 4)]


PAGE = """<html><head><meta property="og:image" content="/i.jpg"><meta name="keywords" content="a, b,a, ,c">
<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "headline": "Head &amp; more", "articleBody": "short", "datePublished": "2024-01-01"}]}</script>
<script>var p = "<p>not a paragraph of this page</p>"</script></head><body><p>outside the article it is longer than twenty</p><article><h1>Other</h1>
<p>A paragraph that is long enough to count.<p>too short</p><a href="/x">x</a></article></body></html>"""


def test_page(spark):
    r = S.extract(spark.createDataFrame([(1, "https://a.b/c", PAGE), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].content, r[0].extraction_tier, r[0].image_url, r[0].keywords, r[0].published_at, r[0].n_links) == ("Head & more", "A paragraph that is long enough to count.", "css", "https://a.b/i.jpg", ["a", "b", "c"], "2024-01-01", 1)
    assert (r[1].title, r[1].content, r[1].keywords) == ("", "", [])


RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>T &amp; t</title><link>https://a.b/1</link><description>&lt;b&gt;lead&lt;/b&gt;</description>
<pubDate>Mon, 01 Jan 2024 10:00:00 +0330</pubDate><category domain="Politics">x</category><enclosure url="https://a.b/i.jpg" type="image/jpeg"/><content:encoded>&lt;p&gt;body&lt;/p&gt;</content:encoded></item>
<item><title>no link</title></item><item><title>odd date</title><link>https://a.b/2</link><pubDate>soon</pubDate></item></channel></rss>"""


def test_feeds():
    a, b = S.parse_feed(RSS)
    assert a == {"url": "https://a.b/1", "title": "T & t", "lead": "lead", "content": "body", "published_at": "2024-01-01T06:30:00+00:00", "image_url": "https://a.b/i.jpg", "native_category": "politics"}
    assert b["published_at"] == "soon"
    (atom,) = S.parse_feed('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link rel="self" href="https://a.b/feed"/><link href="https://a.b/3"/><summary>s</summary></entry></feed>')
    assert (atom["url"], atom["lead"]) == ("https://a.b/3", "s")
    for bad in ("<rss>", "<rss><channel/></rss>"):
        with pytest.raises(ValueError):
            S.parse_feed(bad)


def test_listing_relay_merge():
    assert S.listing('<a href="/1">x</a><a class="y" href="https://c.d/2">y</a><a href="/1">z</a>', "https://a.b/") == ["https://a.b/1", "https://c.d/2"]
    assert S.relay('<iframe src="/in">', "https://a.b/x") == "https://a.b/in" and S.relay("<p>", "https://a.b/x") == "https://a.b/x"
    got = S.merged({"title": "feed", "lead": "", "content": "feed body"}, {"title": "page", "lead": "page lead", "content": "", "extraction_tier": "css"})
    assert got == {"title": "feed", "lead": "page lead", "content": "feed body", "extraction_tier": "feed"}
    with pytest.raises(ValueError):
        S.strategy("other")


def test_interested_whole_table(spark):
    """Every event meets its subscribers, each pair once, whatever its id and however many topics it shares."""
    from newsloom.adapt import domain
    from newsloom.operators import desk as K
    from newsloom.registry import registered

    r = random.Random(8)
    topics = ["iran", "global", "gold", "oil"]
    events = [(i, r.sample(topics, r.randrange(4))) for i in range(60)] + [(3, ["iran", "iran"])]
    subs = [(f"u{i}", r.random() < 0.3, r.random() < 0.3, r.sample(topics[2:], r.randrange(3))) for i in range(25)] + [("u1", True, True, ["gold"])]
    got = sorted(map(tuple, K.interested(spark.createDataFrame(events, "event_id long, topics array<string>"), spark.createDataFrame(subs, "endpoint string, iran boolean, world boolean, assets array<string>")).collect()))
    want = {(e, u) for e, has in events for u, iran, world, assets in subs if set(has) & {*assets, *(["iran"] * iran), *(["global"] * world)}}
    assert got == sorted(want)
    sf = "/root/testdata/sf0.001"
    found = registered()["j15_interested_whole"].run(spark, sf).select("event_id").distinct().count()
    assert found == domain(spark, sf, "news_event").count()


def test_merge_whole_table(spark):
    """Reports of every event are in the merged table, those with large ids too."""
    from newsloom.adapt import domain
    from newsloom.registry import registered

    sf = "/root/testdata/sf0.001"
    reports = {(r.event_id, r.source_id) for r in domain(spark, sf, "report").select("event_id", "source_id").collect()}
    got = [(r.event_id, r.source_id) for r in registered()["c02_merge_whole"].run(spark, sf).collect()]
    assert max(got)[0] > 500 and sorted(got) == sorted({(3 if e == 7 else e, s) for e, s in reports})


def test_gaps_and_candidates_whole_tables(spark):
    """Gaps lie between neighbours among all prices, over days without any too, and every article gets its candidates."""
    from newsloom.adapt import domain
    from newsloom.registry import registered

    r = random.Random(11)
    points = [(s, at(r.randrange(40) * 1440 + r.randrange(3) * 300)) for s in "ab" for _ in range(30)] + [("a", None), ("c", at(5))]
    table = spark.createDataFrame(points, "symbol string, observed_at timestamp_ntz")
    for days, minutes in ((3, 0), (0, 299), (0, 300)):
        want = []
        for s in "abc":
            mine = sorted(t for x, t in points if x == s and t)
            want += [(s, x, y) for x, y in zip(mine, mine[1:], strict=False) if y - x > timedelta(days=days, minutes=minutes)]
        assert sorted(map(tuple, E.timeline_gaps(table, days, minutes).collect())) == sorted(want)
    sf = "/root/testdata/sf0.001"
    price = domain(spark, sf, "price").groupBy("symbol").count().collect()
    assert registered()["a34_timeline_gaps_whole"].run(spark, sf).count() > sum(x["count"] for x in price) / 2
    events = [(e.id, e.event_time) for e in domain(spark, sf, "news_event").select("id", "event_time").collect()]
    want = []
    for i, t in events:
        near = [(u, j) for j, u in events if j != i and abs(u - t - timedelta(hours=5)) <= timedelta(hours=36)]
        want += [(i, j) for _, j in sorted(near)[-10:]]
    assert sorted(map(tuple, registered()["j11_event_candidates_whole"].run(spark, sf).collect())) == sorted(want)


def test_undated_titles_match_too(spark):
    """Titles without a moment against all others, on either side, each pair once; alone they are still no copies."""
    r = random.Random(6)
    base = ["a first story about gold prices", "the second story from tehran today", "something else entirely in here"]
    rows = [(i, r.choice(base) + r.choice(["", " x", " now"]), None if r.random() < 0.4 else at(r.randrange(10) * 1440)) for i in range(40)] + [(90, "", None), (91, None, None)]
    table = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz").withColumn("content_hash", F.lit(None).cast("string"))
    close = spark.createDataFrame([(i, t, at(0)) for i, t, _ in rows], "id long, title string, published_at timestamp_ntz")
    when = {i: t for i, _, t in rows}
    alike = [(p.left_id, p.right_id, p.score) for p in A.similar_pairs(close).collect()]
    want = [p for p in alike if None in (x := (when[p[0]], when[p[1]])) or abs(x[0] - x[1]) <= timedelta(hours=36)]
    got = [(p.left_id, p.right_id, p.score) for p in A.similar_pairs(table).collect()]
    assert sorted(got) == sorted(want) and any(when[a] is None for a, _, _ in want) and any(when[b] is None for _, b, _ in want)
    assert {d.id for d in A.find_duplicates(table).collect()} == {b for _, b, _ in want}


def test_newest_candidates_with_many_ruled_apart(spark):
    """Ties in time go by id, ruled pairs fall out, and an article with more of them than are spare still gets its ten."""
    r = random.Random(4)
    events = [(k, T0 + timedelta(hours=r.choice([0, 0, 1, 5, 30, 60, 61, 200]))) for k in range(120)]
    articles = [(1000 + k, T0 + timedelta(hours=h)) for k, h in enumerate([0, 10, 36, 37, 96, 150, 300])] + [(2000, None)]
    apart = [(1001, k) for k in range(0, 120, 2)] + [(1000, 5), (1002, events[7][0])]
    got = E.candidates(spark.createDataFrame(articles, "id long, published_at timestamp_ntz"), spark.createDataFrame(events, "id long, event_time timestamp_ntz"), spark.createDataFrame(apart, "article_id long, event_id long"))
    want = set()
    for a, t in articles:
        near = sorted(((e, k) for k, e in events if t is not None and abs((e - t).total_seconds()) <= 36 * 3600 and (a, k) not in apart), reverse=True)[:10]
        want |= {(a, k) for _, k in near}
    assert {tuple(x) for x in got.collect()} == want


def test_merges_are_refused_or_followed(spark):
    df = spark.createDataFrame
    events = df([(1, False), (2, False), (3, True), (4, False), (5, False)], "id long, hidden boolean")
    merges = df([(2, 1), (3, 1), (4, 1), (5, 1), (9, 1), (1, 1)], "incoming long, target long")
    tables = {
        "links": df([(1, 10), (2, 10), (2, 11), (4, 12)], "event_id long, article_id long"),
        "tags": df([(1, "a"), (2, "a"), (5, "b")], "event_id long, item string"),
        "alerts": df([(2, 7), (2, 8)], "event_id long, alert_id long"),
        "assessments": df([(5, 70)], "event_id long, id long"),
        "states": df([(2, 100, 4), (5, 100, 5), (5, 101, 3), (1, 101, 2)], "event_id long, user_id long, tier int"),
        "rulings": df([(2, 10, "same"), (1, 10, "apart"), (5, 11, "apart")], "event_id long, article_id long, decision string"),
        "notices": df([(1, 1, None), (2, 1, T0), (5, 1, T0 + timedelta(hours=1))], "event_id long, subscription_id long, sent_at timestamp_ntz"),
    }
    out, refused = C.merge_events(merges, events, df([(4, 1)], "a long, b long"), tables)
    rows = lambda n: sorted(map(tuple, out[n].collect()), key=repr)
    assert sorted(map(tuple, refused.collect())) == [(3, 1, "hidden"), (4, 1, "apart"), (9, 1, "missing")]
    assert rows("links") == [(1, 10), (1, 11), (4, 12)] and rows("tags") == [(1, "a"), (1, "b")] and rows("alerts") == [(1, 7), (1, 8)] and rows("assessments") == [(1, 70)]
    assert rows("states") == [(1, 100, 4), (1, 101, 2)] and rows("rulings") == [(1, 10, "apart"), (1, 11, "apart")] and rows("notices") == [(1, 1, T0)]


def test_backfill_goes_on_from_its_cursor(spark):
    articles = spark.createDataFrame([(k, "" if k == 4 else f"t{k}", 1 if k == 3 else None, T0, None) for k in range(1, 9)], "id long, title string, duplicate_of long, fetched_at timestamp_ntz, published_at timestamp_ntz")
    matches = spark.createDataFrame([(2, 1, 0.9), (6, 5, 0.8), (4, 1, 0.9)], "id long, duplicate_of long, score double")
    seen, cursor = [], {"last_id": 0, "exhausted": False}
    while not cursor["exhausted"]:
        found, cursor = C.backfill_page(articles, matches, cursor["last_id"], 2)
        seen.append((cursor["last_id"], sorted(r.id for r in found.collect())))
    assert seen == [(2, [2]), (6, [6]), (8, []), (8, [])]
