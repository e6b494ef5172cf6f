"""Feeds, fuzzy matching, answers and group trees by cases."""

import json
from datetime import date
from difflib import SequenceMatcher

import pyspark.sql.functions as F

from millrace.operators import feeds, fuzzy, rank
from millrace.plans import answers, profiles
from millrace.sources.tables import read_table

RSS = "<rss><channel><item><title>A  b</title><link>https://a/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate></item><item><title>No date</title></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>C</title><link href='https://a/2'/><updated>2024-03-04T05:06:07Z</updated></entry></feed>"


def test_feeds(spark):
    rows = [(1, RSS), (2, ATOM), (3, "<!DOCTYPE x><rss/>"), (4, "broken <"), (5, None), (6, "")]
    got = feeds.feed_items(spark.createDataFrame(rows, "pos int, xml string"), "pos", "xml").collect()
    assert {(r.key, r.pos, r.title, r.url, r.day) for r in got} == {(1, 0, "A b", "https://a/1", date(2024, 1, 2)), (1, 1, "No date", None, None), (2, 0, "C", "https://a/2", date(2024, 3, 4))}


def test_posts(spark):
    payload = json.dumps([{"title": {"rendered": "<b>T</b> x"}, "link": "l", "date": "2024-05-06T07:08:09"}, {"title": None}])
    df = spark.createDataFrame([(1, payload), (2, "no"), (3, None)], "k int, p string")
    assert {(r.key, r.pos, r.title, r.day) for r in feeds.post_items(df, "k", "p").collect()} == {(1, 0, "T x", date(2024, 5, 6)), (1, 1, None, None)}


def test_article_ladder_and_jobs(spark):
    rows = [("2024-01-01", None, None, None, None), (None, "2024-01-02T00:00:00Z", "2024-01-03", None, None), (None, None, None, "Publisert 4. mai 2024 av N", None), (None, None, None, None, "https://a/2024/6/7/x"), (None, None, None, "none", "https://a/x")]
    df = spark.createDataFrame(rows, "m string, s string, t string, x string, u string")
    got = df.select(*feeds.article_day(F.col("m"), F.col("s"), F.col("t"), F.col("x"), F.col("u"))).collect()
    assert [(r.day, r.method) for r in got] == [(date(2024, 1, 1), "meta"), (date(2024, 1, 2), "structured"), (date(2024, 5, 4), "text"), (date(2024, 6, 7), "url"), (None, None)]
    nodes = list(feeds.typed_nodes(['{"@graph":[{"@type":"JobPosting","title":"J"},{"@type":"Thing"}]}', "broken"], feeds.JOBS))
    assert [n["title"] for n in nodes] == ["J"]


def test_merged_items(spark):
    df = spark.createDataFrame([("o", "Welder, Oslo", "u1", 1), ("o", "WELDER  oslo", "u2", 2), ("o", None, "u3", 3), ("p", "Welder", None, 1)], "o string, t string, u string, n int")
    got = {(r.o, r.t, tuple(r.urls), r.agree) for r in feeds.merge_items(df, "o", "t", "u", "n").collect()}
    assert got == {("o", "Welder, Oslo", ("u1", "u2"), 2), ("p", "Welder", (), 1)}


def test_fuzzy_ratio(spark):
    pairs = [("Åse Bygg", "ase  bygg"), ("Fjord Data", "Fjell Data AS"), (None, "x"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(fuzzy.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, round(SequenceMatcher(None, "fjord data", "fjell data as", autojunk=False).ratio(), 6), None, 1.0]


def test_answers(spark):
    df = spark.createDataFrame([("o", 5, " ", None)], "k string, employees int, municipality string, value string")
    got = answers.answer(df, "Where is it and how many employees?", "k").collect()
    assert {(r.fact, r.value, r.module) for r in got} == {("employees", "5", "registry"), ("municipality", None, "registry")}
    assert answers.answer(df, "Tell me a joke", "k").count() == 0


def test_group_edges_and_records(spark, sf):
    edges = profiles.group_edges(spark, sf).collect()
    assert edges and all((e.parent is None) == (e.child_path.count("[") == 1) for e in edges)
    plain = 0
    for r in read_table(spark, sf, "companies").select("row_id", "latest_envelope").distinct().collect():
        records = json.loads(r.latest_envelope)["profile"]["evidence"]["financials"]["value"]["records"]
        if isinstance(records, str):
            records = json.loads(records)
        if isinstance(records, dict):
            records = list(records.values()) if records and all(k.isdigit() for k in records) else [records]
        plain += sum(isinstance(x, dict) for x in records or [])
    assert profiles.financial_records(spark, sf).count() == plain


def test_priority_and_filled_samples(spark):
    df = spark.range(60).selectExpr("id", "IF(id < 40, 'a', 'b') AS g", "CAST(IF(id < 5, 1, NULL) AS INT) AS p")
    first = {r.id for r in rank.priority_sample(df, "p", "id", 7, "s").collect()}
    assert set(range(5)) <= first and len(first) == 7
    out = rank.filled_sample(df, "g", "id", 10, "s").groupBy("g").count().collect()
    assert sum(r["count"] for r in out) == 10 and {r.g for r in out} == {"a", "b"}


def test_evidence_rules(spark):
    from millrace.operators import evidence

    df = spark.createDataFrame([(1, {"a": "ok", "b": "no"}, {"a": "1", "b": "2", "c": "3"}, [5, 7, None], [1, 1, 1]), (2, None, None, [5, 7], [2, 1]), (3, {}, {}, [], [])], "k int, s map<string,string>, c map<string,string>, v array<int>, p array<int>")
    got = {r.k: tuple(r)[1:] for r in df.select("k", evidence.complete_for(F.col("s"), ("a",), ("ok",)), evidence.merge_available(F.col("c"), F.col("s"), "ok"), evidence.sole_value(F.col("v"), F.col("p"))).collect()}
    assert got == {1: (True, {"a": "1"}, None), 2: (False, None, 7), 3: (False, {}, None)}
    labels = spark.createDataFrame([("x", 0.7), ("q", 0.7), ("x", None)], "c string, p double")
    spreads = [r[0] for r in labels.select(evidence.label_spread(F.col("c"), F.col("p"), ["x", "y", "z"])).collect()]
    assert spreads[0] == {"x": 0.7, "y": 0.15, "z": 0.15} and spreads[1] == spreads[2] == {"x": 0.333333, "y": 0.333333, "z": 0.333333}
    a = spark.createDataFrame([("k", 0.5), ("l", 0.4)], "kind string, s double")
    b = spark.createDataFrame([("k", 0.45), ("l", 0.45)], "kind string, s double")
    assert [tuple(r) for r in evidence.promotion(a, b, "kind", "s").collect()] == [(2, 0.05, -0.05, False)]
    assert evidence.promotion(a, b.where("kind = 'k'"), "kind", "s").first().promoted


def test_urls_and_questions(spark):
    from millrace.functions import text, urls
    from millrace.operators import relate

    df = spark.createDataFrame([("https://a.no//Jobb/x?q", " Firm  AS ", "Oslo", "1"), (None, None, "Oslo", "1"), ("a.no", "Firm", None, None)], "u string, n string, p string, o string")
    got = [tuple(r) for r in df.select(urls.path_parts(F.col("u")), urls.term_weight(F.col("u"), {"jobb": 2}, 9), text.search_queries(F.col("n"), F.col("p"), F.col("o"))).collect()]
    assert got == [(["jobb", "x"], 2, ['"Firm AS" Oslo', '1 "Firm AS"']), ([], 9, []), ([], 9, ['"Firm"'])]
    requests = spark.createDataFrame([("u1",), ("u2",)], "url string")
    responses = spark.createDataFrame([("u1", 200)], "url string, code int")
    assert {tuple(r) for r in relate.replayed(requests, responses, "url", "code").collect()} == {("u1", 200, None), ("u2", None, "unknown_url")}
    chain = spark.createDataFrame([("t", "t", []), ("t", "p", ["t"]), ("t", None, None), (None, "p", ["x"])], "t string, p string, c array<string>")
    assert [r[0] for r in chain.select(relate.chain_match(F.col("t"), F.col("p"), F.col("c"))).collect()] == ["same", "redirect", "none", "other"]


def test_scans_read_only_the_columns_they_need(spark, sf):
    import __spark_entry__ as entry

    for name, unwanted in {"p3_found": ("website_html", "content_sha256"), "dedupe_first_wins": ("url", "published_at"), "latency_nearest_rank": ("props", "user_id"), "counter_one_level": ("text",), "url_priority": ("html",), "shared_key_counts": ("text", "content_sha256")}.items():
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        schemas = [line.split("ReadSchema:")[1] for line in plan.split("\n") if "ReadSchema:" in line]
        assert schemas and not any(f"{u}:" in s for u in unwanted for s in schemas), name
