"""Operators by cases: nulls, empty tables, ties, repeated rows, hot keys, clashing names."""

import math
from datetime import date, datetime

import pyspark.sql.functions as F
import pytest

from millrace.functions import dates, jsonx, markup, orgid, text, urls
from millrace.operators import aggregate, cascade, evidence, fielddiff, rank, relate, sets, state
from millrace.plans import screen


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# ---------------------------------------------------------------- functions
def test_texts(spark):
    df = spark.createDataFrame([("Ærø Bygg og Anlegg AS",), (None,), ("",), ("ÅSE & Søn – café",)], "t string")
    t = F.col("t")
    got = df.select(text.ascii_fold(t), F.array_join(text.fold_tokens(t), " "), F.array_join(text.identity_tokens(t), " "), text.slug(t)).collect()
    assert [tuple(r) for r in got] == [
        ("aero bygg og anlegg as", "aero bygg og anlegg as".replace("aero", "aero"), "aero bygg anlegg", "aero-bygg-og-anlegg-as"), (None, "", "", ""), ("", "", "", ""), ("ase & son  cafe", "ase son cafe", "ase son cafe", "ase-son-cafe"),
    ]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("+47 22 33 44 55", "Post@Firm.NO ", "1 234,5", " A  b. C d", "A b"), (None, None, None, None, None), ("123", "none", "x", "", "")], "p string, e string, n string, b string, s string")
    got = df.select(text.phone_digits(F.col("p")), text.email_domain(F.col("e")), text.number_value(F.col("n")), text.first_sentence(F.col("b")), text.holds_span(F.col("b"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("22334455", "firm.no", 1234.5, "A b.", True), (None, None, None, None, False), (None, None, None, "", False)]


def test_token_runs_and_caps(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"], 2.0), (["a"], ["a", "b"], None), (["a"], [], 0.5)], "t array<string>, r array<string>, v double")
    got = df.select(text.holds_token_run(F.col("t"), F.col("r")), text.capped(8.0, F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, 8.0), (False, 0.0), (False, 4.0)]


def test_numbers_in_texts(spark):
    df = spark.createDataFrame([("Org.nr. 974 760 673 og 974760673, tlf +47 974 760 673, 1974760673, 974.760.674",), (None,)], "t string")
    assert [r[0] for r in df.select(orgid.numbers_in(F.col("t"))).collect()] == [["974760673"], []]


def test_urls(spark):
    rows = ["HTTPS://www.Firm.no/A/?q=1#x", "firm.no/", "//a.b.co.uk/p/", "no dots", "", None, "http://user@x.firm.no:80/z"]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    u = F.col("u")
    got = [tuple(r) for r in df.select(urls.host(u), urls.url_key(u), urls.registered_domain(u), urls.under_any(urls.host(u), ["firm.no"])).collect()]
    assert got == [
        ("firm.no", "firm.no/a?q=1", "firm.no", True), ("firm.no", "firm.no", "firm.no", True), ("a.b.co.uk", "a.b.co.uk/p", "b.co.uk", False),
        (None, None, None, False), (None, None, None, False), (None, None, None, False), ("x.firm.no", "x.firm.no/z", "firm.no", True),
    ]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("Tue, 02 Jan 2024 10:00:00 +0100",), ("3.4.2024",), ("3. mai 2024",), ("soon",), (None,)], "d string")
    assert [r[0] for r in df.select(dates.date_ladder(F.col("d"))).collect()] == [date(2024, 2, 29), None, date(2024, 1, 2), date(2024, 4, 3), date(2024, 5, 3), None, None]
    at = spark.createDataFrame([(date(2024, 12, 31), True), (date(2024, 1, 31), False)], "d date, daily boolean")
    assert [r[0] for r in at.select(dates.next_reset(F.col("d"), F.col("daily"))).collect()] == [date(2025, 1, 1), date(2024, 2, 1)]


def test_json(spark):
    df = spark.createDataFrame([('{"a":{"b":[1]},"n":null,"s":"x","f":1.5,"t":true}',), ("no",), (None,)], "j string")
    kinds = [jsonx.json_kind(F.col("j"), p) for p in ("$.a", "$.a.b", "$.n", "$.s", "$.f", "$.t", "$.z")]
    assert [tuple(r) for r in df.select(*kinds).collect()] == [("object", "array", "null", "string", "number", "boolean", "missing"), (None,) * 7, (None,) * 7]


def test_page_facts(spark):
    html = """<title> A &amp; B </title><meta property='og:description' content='D'><link rel=canonical href=/c><a href='/x'>x</a><a href='mailto:a@b'>m</a>
    <time datetime='2024-01-01'>t</time><script type='application/ld+json'>{"@graph":[{"@type":["Organization"],"name":"N","url":"u","subOrganization":{"@type":"Store","name":"S"}}]}</script><script type='application/ld+json'>broken</script>"""
    df = spark.createDataFrame([(1, html, "https://f.no/p"), (2, "", None), (3, None, None)], "title int, h string, base string")
    got = {r.k: r for r in markup.page_facts(df, {"k": F.col("title")}, F.col("h"), F.col("base")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].title, got[1].description, got[1].canonical, got[1].links, got[1].times) == ("A & B", "D", "/c", ["https://f.no/x"], ["2024-01-01"])
    assert [tuple(o) for o in got[1].organisations] == [("N", "u"), ("S", None)] and got[2].links == []


# ---------------------------------------------------------------- aggregation
def test_three_percentile_rules(spark):
    data = [5.0, 1.0, 4.0, 2.0, 3.0, 2.0, None]
    df = spark.createDataFrame([("g", v) for v in data] + [("h", None)], "k string, v double")
    ordered = sorted(v for v in data if v is not None)
    n = len(ordered)
    for q in (0.25, 0.5, 0.9):
        lower = aggregate.value_at_place(df, ["k"], "v", {"x": aggregate.lower_index(q)}).collect()
        clamped = aggregate.value_at_place(df, ["k"], "v", {"x": aggregate.clamped_index(q)}).collect()
        assert [r.x for r in lower] == [ordered[int((n - 1) * q)]] and [r.x for r in clamped] == [ordered[min(n - 1, int(n * q))]]
        nearest = aggregate.value_at_place(df, ["k"], "v", {"x": aggregate.nearest_rank(q)}).collect()
        assert [r.x for r in nearest] == [ordered[max(1, math.ceil(q * n)) - 1]]
    assert [r.x for r in aggregate.value_at_place(df, [], "v", {"x": F.col("n") - 1}).collect()] == [5.0]
    assert aggregate.value_at_place(df.where("false"), ["k"], "v", {"x": aggregate.nearest_rank(0.5)}).count() == 0
    with pytest.raises(ValueError):
        aggregate.nearest_rank(1.5)


def test_bounded_collections_are_checked(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(20)], "k int, v int")
    assert aggregate.counter_map(df, "k", 5).collect()[0][0] == '{"0":4,"1":4,"2":4,"3":4,"4":4}'
    with pytest.raises(Exception, match="more than 4 values"):
        aggregate.counter_map(df, "k", 4).collect()
    left = df.select("k").distinct()
    assert {len(r.x) for r in relate.attach_list(left, df, "k", "x", F.col("v"), F.col("v"), 4).collect()} == {4}
    with pytest.raises(Exception, match="more than 3 matches"):
        relate.attach_list(left, df, "k", "x", F.col("v"), F.col("v"), 3).collect()


def test_wilson_and_ratio(spark):
    df = spark.createDataFrame([(38, 40), (0, 0), (0, 5)], "a long, b long")
    got = [tuple(r) for r in df.select(aggregate.wilson_lower(F.col("a"), F.col("b")), aggregate.ratio(F.col("a"), F.col("b")), aggregate.ratio(F.col("a"), F.col("b"), zero=True)).collect()]
    assert got == [(0.835, 0.95, 0.95), (None, None, 0.0), (0.0, 0.0, 0.0)]


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    assert values(aggregate.cohen_kappa(df, "x", "y")) == [(4, 0.5)]
    assert values(aggregate.cohen_kappa(df.where("x = 'b'"), "x", "y")) == [(2, 1.0)]
    assert values(aggregate.cohen_kappa(df.where("false"), "x", "y")) == [(0, None)]


def test_recall_and_pool(spark):
    df = spark.createDataFrame([("q", 1, False), ("q", 4, True), ("r", 1, True), ("s", 1, False)], "q string, r int, hit boolean")
    assert values(aggregate.recall_at(df, "q", "r", F.col("hit"), (1, 3, 5))) == [(3, 0.3333, 0.3333, 0.6667)]
    pool = spark.createDataFrame([("t", "o1", "f1"), ("t", "o1", "f2"), ("t", "o2", "f1"), ("t", None, "f")], "k string, e string, f string")
    found = spark.createDataFrame([("t", "o1", "f2"), ("t", "o1", "f2")], "k string, e string, f string")
    assert values(aggregate.pool_recall(pool, found, "k", "e", "f")) == [("t", 2, 3, 0.45)]


def test_digest_ignores_order(spark):
    a = spark.range(1000).selectExpr("CAST(id AS STRING) AS k")
    assert aggregate.digest(a, "k").first() == aggregate.digest(a.orderBy(F.desc("k")).repartition(5), "k").first()
    assert aggregate.digest(a.where("false"), "k").first().n == 0


# ---------------------------------------------------------------- ranks and quotas
def test_quotas_add_up(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 0)], "g string, size long")
    for limit in (0, 1, 3, 7, 10):
        got = {r.g: r.quota for r in rank.largest_remainder(sizes, "g", "size", limit).collect()}
        assert sum(got.values()) == limit and all(got[g] <= s for g, s in (("a", 5), ("b", 3), ("c", 2), ("d", 0)))


def test_splits_and_samples(spark):
    df = spark.range(100).selectExpr("id", "id % 2 AS g")
    out = rank.split_assignment(df, "g", "id", "s", {"a": 0.6, "b": 0.2, "c": 0.2})
    places = rank.hash_places(spark.range(500).selectExpr("id", "IF(id % 3 = 0, NULL, 'hot') AS g"), ["g"], "id", "s", "|", slices=16)
    assert {r.g: (r.n, r.top, r.p) for r in places.groupBy("g").agg(F.countDistinct("place").alias("n"), F.max("place").alias("top"), F.max("population_n").alias("p")).collect()} == {None: (167, 166, 167), "hot": (333, 332, 333)}
    assert values(out.groupBy("g", "split").count()) == [(0, "a", 30), (0, "b", 10), (0, "c", 10), (1, "a", 30), (1, "b", 10), (1, "c", 10)]
    sample = [r.id for r in rank.hash_sample(df, "id", 7, "s").collect()]
    assert len(sample) == 7 and sample == [r.id for r in rank.hash_sample(df.repartition(9), "id", 7, "s").collect()]
    per_group = rank.distinct_group_sample(df, "id", "g", 5, "s", df.where("g = 1").select("g"))
    assert [r.g for r in per_group.collect()] == [0]


def test_ties_and_caps(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 2.0), ("b", 2, 1.0), ("c", 1, None)], "k string, i int, s double")
    got = {r.k: (r.i, r.ambiguous) for r in rank.best_unless_tied(df, "k", "s", "i").collect()}
    assert got == {"a": (1, True), "b": (1, False), "c": (1, False)}
    flags = spark.createDataFrame([("a", True)] * 3 + [("b", True), ("b", None)], "k string, f boolean")
    assert values(rank.none_above_cap(flags, ["k"], "f", 2)) == [("a", False)] * 3 + [("b", False), ("b", True)]
    assert rank.first_per_group(df.where("false"), ["k"], [F.col("i")]).count() == 0


# ---------------------------------------------------------------- joins and sets
def test_strict_pairs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (1, "w")], "k int, u string")
    assert values(relate.strict_pairs(a, b, "k"), "k", "v", "u") == [(1, "x", "w"), (2, "y", "z")]
    for bad in (b.where("k = 1"), b.union(b)):
        with pytest.raises(Exception, match="not one to one"):
            relate.strict_pairs(a, bad, "k").collect()


def test_lookup_rekey_and_shared(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, v string, o int")
    assert values(relate.attach_list(left, right, "k", "vs", F.col("v"), F.col("o"))) == [(1, ["a", "b"]), (2, [])]
    rows = spark.createDataFrame([("c1",), ("p1",), ("zz",)], "k string")
    parents = spark.createDataFrame([("c1", "p1")], "k string, p string")
    known = spark.createDataFrame([("p1",)], "p string")
    assert values(relate.rekey(rows, "k", parents, "p", known), "k", "entity", "how") == [("c1", "p1", "mapped"), ("p1", "p1", "already_parent"), ("zz", None, "unmapped")]
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('d', id)) AS d", "id % 50 AS o")
    assert values(relate.shared_keys(hot, "d", "o")) == [("hot", 50)]


def test_domain_owners(spark):
    df = spark.createDataFrame([("a", "d", False), ("b", "d", True), ("c", "e", False), ("x", "f", True), ("y", "f", True), ("n", None, False)], "o string, d string, ex boolean")
    assert values(relate.demote_shared(df, "d", "o", F.col("ex")), "o", "demoted") == [("a", True), ("b", False), ("c", False), ("n", False), ("x", False), ("y", False)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 0)], "k int, v string, s int")
    b = spark.createDataFrame([(1, "z", 0), (2, "w", 0)], "k int, v string, s int")
    assert values(sets.union_first_wins([a, b], "k", F.col("s")), "k", "v") == [(1, "y"), (2, "w")]
    assert values(sets.first_wins(a, ["k"], [F.col("s")]), "v") == [("y",)]
    with pytest.raises(Exception, match="in both tables"):
        sets.disjoint_union(a, b, "k").collect()
    assert sets.disjoint_union(a, b.where("k = 2"), "k").count() == 3


# ---------------------------------------------------------------- differences, state, rules
def test_field_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "a", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", 5, "ok"), (2, "b", 1, "failed"), (4, "a", 1, "ok")], "k int, x string, y int, st string")
    assert values(fielddiff.field_changes(old, new, "k", ["x", "y"])) == [(1, "y", None, "5"), (2, "x", "a", "b")]
    assert values(fielddiff.field_changes(old, new, "k", ["x", "y"], "st", ["failed"])) == [(1, "y", None, "5")]
    assert values(fielddiff.replay_scores(old.select("k"), new.select("k"), ["k"])) == [(3, 3, 2, 0.6667, 0.6667)]


def test_state(spark):
    t = lambda d: datetime(2024, 1, d)
    events = spark.createDataFrame([("a", t(1), "x"), ("a", t(3), "no"), ("b", t(2), "no")], "k string, at timestamp, d string")
    once = state.ledger(events, "k", "at", "d")
    twice = state.merge_ledgers(state.ledger(events.where("d = 'x'"), "k", "at", "d"), state.ledger(events.where("d = 'no'"), "k", "at", "d"), "k")
    assert values(once) == values(twice)
    assert values(state.to_skip(once, F.lit(t(4)), 2, ["no"]), "k") == [("a",)]
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, n string, m string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, n string, m string")
    assert values(state.upsert(old, new, "k", ["n"])) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert values(state.pending(old, new, "k"), "k") == [(1,)]


def test_rules(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None)], "k int, v double")
    rules = [("high", F.col("v") > 0.5, 1.0), ("any", F.col("v").isNotNull(), 0.5)]
    assert values(df.select("k", *cascade.first_rule(rules, "none", 0.0))) == [(1, "any", 0.5), (2, "high", 1.0), (3, "none", 0.0)]
    states = spark.createDataFrame([(1, ["failed", "not_available"]), (2, []), (3, None), (4, ["blocked"]), (5, ["ambiguous", "blocked"])], "k int, s array<string>")
    got = {r.k: r.x for r in states.select("k", cascade.final_state(F.col("s"), F.lit(False), F.lit(False)).alias("x")).collect()}
    assert got == {1: "not_available", 2: "not_available", 3: "not_available", 4: "blocked", 5: "ambiguous"}
    assert values(evidence.violations(df, "k", [("positive", F.col("v") > 0.5)])) == [(1, "positive"), (3, "positive")]


# ---------------------------------------------------------------- the screening language
def test_parse():
    plan = screen.parse("Companies in Nord-Aurdal with at least 5 employees and revenue > NOK 2.5 million, top 500 by employees")
    assert [(t.field, t.operator, t.value) for t in plan.tests] == [("municipality", "eq", "nord-aurdal"), ("employees", ">=", 5.0), ("revenue", ">", 2_500_000.0)]
    assert (plan.sort, plan.limit, plan.executable) == ("employees", 100, True)
    assert not screen.parse("firms with buzz and over 3 employees").executable and not screen.parse("tell me a story").executable
    assert [t.value for t in screen.parse("over 1 billion revenue").tests] == [1e9]


def test_absent_values_compare_false(spark):
    df = spark.createDataFrame([(1, 10), (2, None)], "k int, e int")
    got = screen.screen(df, "over 5 employees", {"employees": F.col("e")}, "k")
    assert values(got, "k") == [(1,)]


def test_every_match_unless_the_top_is_asked_for(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(1000)], "k int, e int")
    columns = {"employees": F.col("e")}
    assert screen.screen(df, "over 5 employees", columns, "k").count() == 142
    assert [r.k for r in screen.screen(df, "over 1 employees top 3 by employees", columns, "k").collect()] == [6, 13, 20]


def test_criteria():
    tests = lambda q: [(t.field, t.operator, t.value) for t in screen.parse(q).tests]
    assert tests("hiring companies in Bergen with annual accounts") == [("active_jobs", ">", 0.0), ("job_location", "contains", "bergen"), ("financials", "available", True)]
    assert tests("unprofitable firms municipality = Stor-Elvdal") == [("annual_result", "<", 0.0), ("municipality", "eq", "stor-elvdal")]
    assert tests("rating above 4.5 and at least 10 reviews") == [("rating", ">", 4.5), ("review_count", ">=", 10.0)]
    assert tests("industry contains 'Fisk' and industry is \"Tre\"") == [("industry", "contains", "fisk")]
    assert tests("revenue over, employees <= many") == [] and not screen.parse("top ten by revenue").executable


def test_social_links(spark):
    df = spark.createDataFrame([(1, ["https://www.facebook.com/x", None, "https://a.example/facebook.com", "https://m.facebook.com/y", "https://www.facebook.com/x", ""]), (2, []), (3, None)], "k int, u array<string>")
    got = {r.k: r.x for r in df.select("k", markup.social_links(F.col("u")).alias("x")).collect()}
    assert got == {1: ["https://m.facebook.com/y", "https://www.facebook.com/x"], 2: [], 3: None}
