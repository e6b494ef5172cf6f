"""Discovery over landed tables, injected classifiers, event merges and cursors, by cases."""

import pyspark.sql.functions as F

from millrace.operators import classify, discovery, state


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_candidates_are_one_a_domain_strongest_first(spark):
    rows = [("a", "https://www.a.example/x", "https://a.example", "clash"), ("a", "https://www.a.example/x", "https://a.example", "clash"), ("b", None, "no address", "x"), ("c", "", "https://c.example/y", "x"), (None, "https://n.example", None, "x")]
    df = spark.createDataFrame(rows, "k string, one string, two string, url string")
    found = discovery.candidates(df, "k", [("one", F.col("one")), ("two", F.col("two"))])
    assert rows_of(found.select("k", "source", "place", "host")) == [("a", "one", 0, "a.example"), ("c", "two", 1, "c.example")]
    assert discovery.candidates(df.where("false"), "k", [("one", F.col("one"))]).count() == 0


def test_states_of_entities(spark):
    found = spark.createDataFrame(
        [("a", "reg", 0, "u0", "a.example"), ("a", "name", 1, "u1", "b.example"), ("b", "reg", 0, "u2", "gone.example"), ("c", "name", 1, "u3", "gone.example"), ("d", "reg", 0, "u4", "x.bad.example"), ("e", "reg", 0, "u5", "b.example")],
        "k string, source string, place int, url string, host string",
    )
    pages = spark.createDataFrame([("a.example", None), ("b.example", "B")], "host string, title string")
    judged = discovery.judged(found, pages, (F.col("title") == "B") & (F.col("k") == "a"), ["bad.example"])
    assert rows_of(judged.select("k", "url", "state")) == [("a", "u0", "ambiguous"), ("a", "u1", "available"), ("b", "u2", "failed"), ("c", "u3", "failed"), ("d", "u4", "blocked"), ("e", "u5", "ambiguous")]
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("f",), ("f",), (None,)], "k string")
    got = rows_of(discovery.entity_results(entities, "k", judged, "reg"))
    assert got == [
        ("a", "available", "name", "u1", 2), ("b", "failed", None, None, 1), ("c", "not_available", None, None, 1),
        ("d", "blocked", None, None, 1), ("e", "ambiguous", None, None, 1), ("f", "not_available", None, None, 0),
    ]


def test_injected_classifier(spark):
    class Lengths:
        """An injected model: short or long."""

        labels = ("short", "long")

        def scores(self, texts):
            return [[1.0, 0.0] if len(t) < 5 else [0.25, 0.75] if t.strip() else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([(1, "abc", "x"), (2, "a long text", "x"), (3, None, "x"), (4, "      ", "x"), (4, "      ", "x")], "i int, t string, label string")
    got = rows_of(classify.classified(df, {"i": F.col("i")}, F.col("t"), Lengths()))
    assert got == [(1, "short", 1.0), (2, "long", 0.75), (3, None, None), (4, "short", 0.0), (4, "short", 0.0)]
    assert classify.classified(df.where("false"), {"i": F.col("i")}, F.col("t"), Lengths()).count() == 0
    words = classify.FACTORIES["words"]({"none": frozenset(), "fish": frozenset({"fisk", "torsk"})})
    assert [r[1:] for r in rows_of(classify.classified(df.select("i", F.lit("Fisk og torsk").alias("t")).limit(1), {"i": F.col("i")}, F.col("t"), words))] == [("fish", 0.8)]
    both = spark.createDataFrame([("a", "a"), ("a", None), (None, None)], "x string, y string")
    assert rows_of(classify.agreement(both, "x", "y")) == [("a", 2, 1), (None, 1, 1)]


def test_events_merge_field_by_field(spark):
    profiles = spark.createDataFrame([("a", "old", "u", 1), ("b", None, "v", 2), (None, "x", "x", 3)], "k string, name string, url string, kept int")
    events = spark.createDataFrame([("a", 1, "new", None), ("a", 2, None, "w"), ("a", 2, None, "w"), ("c", 5, "n1", None), ("c", 5, "n2", None), (None, 9, "z", "z")], "k string, at int, name string, url string")
    assert rows_of(state.merged_fields(profiles, events, "k", "at", ["name", "url"])) == [("a", "new", "w", 1, 3), ("b", None, "v", 2, 0), ("c", "n2", None, None, 2)]
    assert rows_of(state.merged_fields(profiles, events.where("false"), "k", "at", ["name", "url"])) == [("a", "old", "u", 1, 0), ("b", None, "v", 2, 0)]


def test_cursor_resumes_once(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", None), (None, 4)], "k string, at int")
    cursor = spark.createDataFrame([("a", 1), ("z", 9), ("n", None)], "k string, at int")
    new = state.after_cursor(events, cursor, "k", "at")
    assert rows_of(new) == [("a", 2), ("a", 2), ("b", 3), (None, 4)]
    moved = state.advanced(cursor, new, "k", "at")
    assert rows_of(moved) == [("a", 2), ("b", 3), ("n", None), ("z", 9)]
    assert rows_of(state.after_cursor(events.where("k IS NOT NULL"), moved, "k", "at")) == []
