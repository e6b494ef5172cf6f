"""The identity rules by cases, one for each rule, and nulls, blanks and empty tables."""

import pyspark.sql.functions as F

from millrace.operators import identity

OWN, OTHERS = "974760673", ("923609016", "984661185", "982463718", "985615616")
LONG = "Vi bygger hus i hele fylket og har gjort det i mange tiår. " * 3
SCHEMA = "i int, name string, number string, home array<string>, texts array<string>, title string, content string, related array<string>, registered boolean, rule string"
# Rows are (name, own number, home parts, other texts, title, content, related numbers, listed page).
CASES = {
    "group_or_brand": ("Fjord Bygg AS", OWN, ["Nordlys gruppen"], [f"Org.nr. {OWN}"], "Nordlys gruppen", LONG, None, True),
    "parked": ("Fjord Bygg AS", OWN, ["Fjord Bygg"], ["This domain is for sale"], "Fjord Bygg", "", None, True),
    "directory_with_own_number": ("Fjord Bygg AS", OWN, ["Fjord Bygg"], None, "Fjord Bygg", " ".join((OWN, *OTHERS[:3])), list(OTHERS[:3]), True),
    "contradicting_number": ("Fjord Bygg AS", OWN, ["Fjord Bygg"], [f"Org.nr. {OTHERS[0]}"], "Fjord Bygg", LONG, None, True),
    "own_number": ("Fjord Bygg AS", OWN, ["Noe annet"], None, "Noe annet", "Org.nr. 974 760 673", None, False),
    "whole_name": ("Fjord Bygg AS", OWN, ["Velkommen til Fjord Bygg"], None, "Velkommen", None, None, None),
    "single_name_with_content": ("Fjordlys AS", OWN, ["Fjordlys"], None, "Fjordlys", LONG, None, False),
    "single_name_as_registered": ("Fjordlys AS", None, ["Fjordlys"], None, "Fjordlys", "kort", None, True),
    "most_of_name": ("Fjord Lys Tre Bygg AS", OWN, ["Fjord"], ["lys og tre"], "Fjord", None, None, None),
    "half_of_name": ("Fjord Lys Tre Bygg AS", OWN, ["Fjord"], ["lys"], "Fjord", None, None, None),
    "weak": ("Fjordlys AS", OWN, ["Fjordlys"], None, "Fjordlys", "kort", None, False),
}


def columns():
    return [F.col(c) for c in ("name", "number", "home", "texts", "title", "content", "related", "registered")]


def assessed(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)
    return [tuple(r)[1:] for r in identity.assess(df, ["i"], *columns()).orderBy("i").collect()]


def test_each_rule(spark):
    scores = {**dict(identity.RULES), identity.OTHERWISE[0]: identity.OTHERWISE[1]}
    got = assessed(spark, CASES.values())
    assert [r[0] for r in got] == list(CASES) and [r[1] for r in got] == [scores[k] for k in CASES]
    assert {r[2] for r in got} == {"exact", "review", "related_or_uncertain"}


def test_nulls_blanks_and_nothing(spark):
    blank = [(None,) * 8, ("", "", [], [], "", "", [], False), ("AS", None, [None], [None], None, " ", [None], None)]
    assert assessed(spark, blank) == [("weak", 0.3, "related_or_uncertain")] * 3
    assert assessed(spark, []) == []
    assert assessed(spark, [CASES["own_number"]] * 2) == [("own_number", 1.0, "exact")] * 2


def test_a_group_member_does_not_contradict(spark):
    name, number, home, texts, title, content, _, listed = CASES["contradicting_number"]
    assert assessed(spark, [(name, number, home, texts, title, content, [OTHERS[0]], listed)])[0][0] == "whole_name"


def test_one_native_projection(spark):
    df = spark.createDataFrame([(0, *CASES["parked"], "x")], SCHEMA)
    plan = identity.assess(df, ["i"], *columns())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
