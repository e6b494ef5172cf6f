"""Changes between snapshots, against brute force and by cases."""

import json
import re
import unicodedata
from datetime import date, datetime

import pyspark.sql.functions as F

from millrace.functions.canon import canonical_json, folded_text
from millrace.functions.orgid import has_valid_check_digit, nine_digits
from millrace.operators import snapshots
from millrace.plans.general import TRACKED_OTHERS, TRACKED_TEXTS, VOLATILE, p2_found
from millrace.sources.tables import read_table


def brute(rows, content, version):
    best = {}
    for r in rows:
        org = re.sub(r"\D", "", r["organisation_number"] or "")
        if len(org) == 9:
            k = (org, r["snapshot_date"])
            if k not in best or r[version] > best[k][version]:
                best[k] = r
    dates = sorted({d for _, d in best})
    for a, b in zip(dates, dates[1:]):
        old = {o: content(r) for (o, d), r in best.items() if d == a}
        new = {o: content(r) for (o, d), r in best.items() if d == b}
        for o in old.keys() | new.keys():
            if o not in old:
                yield o, b.isoformat(), "added"
            elif o not in new:
                yield o, b.isoformat(), "removed"
            elif old[o] != new[o]:
                yield o, b.isoformat(), "changed"


def plain_json(v):
    if isinstance(v, dict):
        return {k: plain_json(x) for k, x in v.items() if k not in VOLATILE}
    if isinstance(v, list):
        return sorted((plain_json(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
    return int(v) if isinstance(v, float) and v == int(v) else v


def test_whole_tables_match_brute_force(spark, sf):
    fold = lambda t: " ".join(unicodedata.normalize("NFC", t or "").lower().split())
    entry = read_table(spark, sf, "entry_companies").collect()
    content = lambda r: [fold(r[c]) for c in TRACKED_TEXTS] + [r[c] for c in TRACKED_OTHERS]
    expected = {("entry_companies", *x) for x in brute(entry, content, "loaded_at")}
    envelopes = read_table(spark, sf, "companies").collect()
    content = lambda r: json.dumps(plain_json(json.loads(r["latest_envelope"])), sort_keys=True)
    expected |= {("companies", *x) for x in brute(envelopes, content, "updated_at")}
    rows = [tuple(r) for r in p2_found(spark, sf).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def _changes(spark, rows):
    df = spark.createDataFrame(rows, "k string, d date, v timestamp, c string, key string, digest int")
    latest = snapshots.latest_versions(df, F.col("k"), F.col("d"), F.col("v"), F.col("c"))
    return {tuple(r) for r in snapshots.changes(latest).collect()}


def test_cases(spark):
    d1, d2, d3 = date(2026, 1, 1), date(2026, 2, 1), date(2026, 3, 1)
    t = lambda h: datetime(2026, 1, 1, h)
    rows = [
        ("a", d1, t(1), "x"), ("a", d2, t(1), "x"), ("a", d3, t(1), "y"),  # changed once
        ("b", d1, t(1), "x"), ("b", d3, t(1), "x"),  # gone and back
        ("c", d1, t(1), None), ("c", d2, t(1), ""), ("c", d3, t(1), ""),  # null is content of its own
        ("d", d1, t(1), "old"), ("d", d1, t(2), "new"), ("d", d2, t(2), "new"), ("d", d2, t(2), "new"), ("d", d3, None, "new"),
        (None, d1, t(1), "x"), ("e", None, t(1), "x"),  # belong to nothing
    ]
    assert _changes(spark, [(*r, "clash", 1) for r in rows]) == {
        ("a", d3, "changed"), ("b", d2, "removed"), ("b", d3, "added"), ("c", d2, "changed"),
    }
    assert _changes(spark, []) == set()
    assert _changes(spark, [("a", d1, t(1), "x", None, None)]) == set()


def test_one_key_with_a_third_of_all_rows(spark):
    rows = [("hot", date(2026, 1 + i % 3, 1), datetime(2026, 1, 1, i % 24, i % 60), f"c{i}", None, None) for i in range(500)]
    rows += [(f"k{i}", date(2026, 1 + i % 3, 1), datetime(2026, 1, 1), "x", None, None) for i in range(900)]
    got = _changes(spark, rows)
    assert {x for x in got if x[0] == "hot"} == {("hot", date(2026, 2, 1), "changed"), ("hot", date(2026, 3, 1), "changed")}


def test_canonical_json():
    a = '{"b": 5.0, "a": [ {"x":1e2}, "\\u00e5" ], "run_id": "r1"}'
    b = '{"a":["å",{"x":100}],"b":5}'
    assert canonical_json(json.loads(a), frozenset({"run_id"})) == canonical_json(json.loads(b), frozenset({"run_id"}))
    assert canonical_json(True) != canonical_json(1) and canonical_json(None) != canonical_json("null")
    assert canonical_json('[2, {"a": 1}]') == canonical_json([{"a": 1.0}, 2])


def test_text_and_number_forms(spark):
    rows = [("Ás   x ", "NO 974 760 673 MVA"), (None, None), ("", "12"), ("ÅS X", "974.760.673"), ("Ås x", "974760674")]
    df = spark.createDataFrame(rows, "t string, n string")
    got = df.select(folded_text(F.col("t")), nine_digits(F.col("n")), has_valid_check_digit(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("ás x", "974760673", True), ("", None, False), ("", None, False), ("ås x", "974760673", True), ("ås x", "974760674", False)]


def test_residues_are_except_all_both_ways(spark):
    import random

    rng = random.Random(2)
    row = lambda: (rng.choice("abcd"), rng.randint(1, 3), rng.choice("xy"))
    later, earlier = [row() for _ in range(40)], [row() for _ in range(40)]
    schema = "key string, snapshot int, digest string"
    a, b = spark.createDataFrame(later, schema), spark.createDataFrame(earlier, schema)
    new, old = snapshots.residues(a.withColumn("sign", F.lit(1)).unionByName(b.withColumn("sign", F.lit(-1))))
    keys = lambda df: sorted(map(tuple, df.select("key", "snapshot").distinct().collect()))
    assert keys(new) == keys(a.exceptAll(b)) and keys(old) == keys(b.exceptAll(a)) and keys(new)


def test_both_residues_and_their_join_use_one_exchange(spark, sf):
    from millrace.plans.general import entry_changes

    df = entry_changes(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) <= 2 + plan.count("ReusedExchange") and "ReusedExchange" in plan
