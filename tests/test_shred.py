"""Shredding of nested records, against a brute-force walk and by cases."""

import json

import pyspark.sql.functions as F
from pyspark.sql import types as T

from millrace.operators import shred
from millrace.plans.general import p1_activity_items, p1_found, p1_roles
from millrace.sources.tables import read_table


def brute(record, pairs):
    """Elements with a filled value, from the definition, recursively."""
    out = set()

    def go(v, path, parent, label, outer):
        if (outer, label) in pairs and not path.endswith("]"):
            if isinstance(v, str) and v[:1] in "[{":
                v = json.loads(v)
            if isinstance(v, dict):
                v = [v[str(i)] for i in range(len(v))] if v and all(k.isdigit() for k in v) else [v]
        if isinstance(v, dict):
            for k, x in v.items():
                go(x, f"{path}.{k}" if path else k, parent, k, label)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                here = f"{path}[{i}]"
                if isinstance(x, dict):
                    if any(y is not None and y != "" for y in x.values()):
                        out.add((here, parent))
                    for k, y in x.items():
                        go(y, f"{here}.{k}", here, k, label)
                elif isinstance(x, list):
                    go(x, here, here, label, label)

    go(record, "", "$", "", "")
    return out


def test_whole_tables_match_brute_force(spark, sf):
    companies = read_table(spark, sf, "companies")
    pairs = shred.list_pairs(companies, F.col("latest_envelope"))
    expected = set()
    for r in companies.select("row_id", "latest_envelope").collect():
        expected |= {("companies", str(r[0]), *e) for e in brute(json.loads(r[1]), pairs)}
    for r in read_table(spark, sf, "recovery").select("recovery_id", "activity", "brief", "hiring").collect():
        record = {k: v for k, v in r.asDict(recursive=True).items() if k != "recovery_id"}
        expected |= {("recovery", str(r[0]), *e) for e in brute(record, set())}
    rows = [tuple(r) for r in p1_found(spark, sf).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_shapes_of_one_list(spark):
    texts = {
        "a": '{"v":{"xs":[{"n":1},null,{"n":""},{"n":2,"xs":[{"n":3}]}]}}',
        "b": '{"v":{"xs":{"n":1}}}',
        "c": '{"v":{"xs":{"0":{"n":1},"2":{"n":2}}}}',
        "d": '{"v":{"xs":"[{\\"n\\":1},{\\"n\\":null}]"}}',
        "e": '{"v":{"xs":{}}}',
        "f": '{"v":{"xs":null}}',
        "g": "no json",
        "h": None,
        "i": '{"other":{"xs":{"n":1}}}',
        "j": '{"v":{"xs":"[not json"}}',
        "k": "[[{\"n\":1}]]",
    }
    df = spark.createDataFrame(list(texts.items()), "record_key string, text string")
    rows = shred.object_nodes(df, F.col("record_key"), F.col("text")).where("ordinal IS NOT NULL AND filled > 0")
    found = {(r.record_key, r.child_path, r.parent_path) for r in rows.collect()}
    assert found == {
        ("a", "v.xs[0]", "$"), ("a", "v.xs[3]", "$"), ("a", "v.xs[3].xs[0]", "v.xs[3]"),
        ("b", "v.xs[0]", "$"), ("c", "v.xs[0]", "$"), ("c", "v.xs[2]", "$"), ("d", "v.xs[0]", "$"),
        ("k", "[0][0]", "[0]"),
    }


def test_adjacency_joined_and_pivoted_is_the_entity_table(spark, sf):
    """The join of object nodes with their scalar children, done as a Spark join over the adjacency table."""
    companies = read_table(spark, sf, "companies")
    key, text = F.col("row_id"), F.col("latest_envelope")
    pairs = shred.list_pairs(companies, text)
    nodes = shred.adjacency(companies, key, text, pairs)
    objects = nodes.where("kind = 'object' AND label = 'roles' AND ordinal IS NOT NULL").select("record_key", "node", "path")
    scalars = nodes.where("kind = 'scalar'").select("record_key", F.col("parent").alias("node"), "label", "scalar")
    joined = objects.join(scalars, ["record_key", "node"], "left").groupBy("record_key", "node", "path").pivot("label", ["name", "role_code"]).agg(F.first("scalar"))
    expected = {(r.record_key, r.path, r.name, r.role_code) for r in joined.collect()}
    assert {(r.record_key, r.child_path, r.name, r.role_code) for r in p1_roles(spark, sf).collect()} == expected
    assert all(r.n == 1 for r in nodes.groupBy("record_key", "node").agg(F.countDistinct("path").alias("n")).collect())


def test_typed_structs_with_nulls_and_extra_columns(spark):
    inner = T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("sub", T.ArrayType(T.StructType([T.StructField("u", T.IntegerType())])))]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("record_key", T.StringType()), T.StructField("a", T.StructType([T.StructField("xs", inner)]))])
    rows = [(1, "clash", ([("x", [(None,), (5,)]), None, ("", None)],)), (2, None, None), (3, None, (None,)), (4, None, ([],)), (None, None, ([("y", [])],))]
    objects = lambda rs: shred.object_nodes(spark.createDataFrame(rs, schema), F.col("id"), shred.struct_text(["a"]), pairs=())
    got = objects(rows).where("filled > 0 AND ordinal IS NOT NULL")
    assert {tuple(r) for r in got.select("record_key", "child_path", "parent_path").collect()} == {
        ("1", "a.xs[0]", "$"), ("1", "a.xs[0].sub[1]", "a.xs[0]"), (None, "a.xs[0]", "$"),
    }
    assert objects([]).count() == 0


def test_plan_of_typed_items_reads_only_what_it_needs(spark, sf):
    plan = p1_activity_items(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "website_html" not in plan and "Python" not in plan and "Arrow" not in plan


def test_positions_as_keys_may_be_sparse():
    pairs = frozenset({("", "xs")})
    paths = lambda xs: [(r[6], r[3]) for r in shred.walk({"xs": xs}, pairs) if r[4] == "object" and r[6]]
    assert paths({"1500": {"a": 1}}) == [("xs[1500]", 1500)]
    assert paths({"2000000": {"a": 1}, "3": {"a": 2}}) == [("xs[3]", 3), ("xs[2000000]", 2000000)]
    assert paths('{"1500": {"a": 1}}') == [("xs[1500]", 1500)]
    assert paths([None, {"a": 1}]) == [("xs[1]", 1)] and paths({"a": 1}) == [("xs[0]", 0)]
    assert paths({"9" * 5000: {"a": 1}})[0] == ("xs[0]", 0) and paths({"4000000000": {"a": 1}})[0] == ("xs[0]", 0)


def test_unreadable_text_gives_an_error_node(spark):
    deep = "[" * 200_000 + "]" * 200_000
    df = spark.createDataFrame([("a", deep), ("b", "{"), ("c", None), ("d", "{}"), (None, "[1]")], "record_key string, text string")
    rows = shred.adjacency(df, F.col("record_key"), F.col("text"), pairs=()).collect()
    assert sorted((str(r.record_key), r.node, r.kind, r.scalar) for r in rows) == [
        ("None", 0, "list", None), ("None", 1, "scalar", "1"), ("a", 0, "error", "nested too deep"), ("b", 0, "error", "no JSON"), ("d", 0, "object", None),
    ]
    assert shred.object_nodes(df, F.col("record_key"), F.col("text")).where("filled > 0").count() == 0


def test_stored_table_joins_as_the_batch_does(spark, sf):
    """The Spark join over the stored table and the join within batches, whatever the size of a batch."""
    companies = read_table(spark, sf, "companies")
    nodes = shred.adjacency(companies, F.col("row_id"), F.col("latest_envelope"))
    columns = {"name": "string", "role_code": "string", "role": "string", "last_changed": "date", "inactive": "boolean", "organisation_number": "string"}
    assert {tuple(r) for r in shred.objects_of(nodes, "roles", columns).collect()} == {tuple(r) for r in p1_roles(spark, sf).collect()}


def test_batches_hold_whole_records(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shred, "_BATCH_NODES", 5)
    texts = ['{"a": [{"x": 1, "y": ""}, {"x": null}], "b": {"z": true}}'] * 7 + [None, "3", "nope"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(10)]), pa.array(texts)], names=["record_key", "text"])
    parts = list(shred.adjacency_batches([batch, batch], frozenset()))
    assert len(parts) > 10 and all(p.num_rows == 0 or p.column(1)[0].as_py() == 0 for p in parts)
    rows = [r for p in parts for r in shred.joined_batch(p, True).to_pylist()]
    assert len(rows) == 2 * 7 * 4
    assert [(r["child_path"], r["filled"], r["scalars"]) for r in rows[:4]] == [("$", 2, []), ("a[0]", 1, [("x", "1"), ("y", "")]), ("a[1]", 0, [("x", None)]), ("b", 1, [("z", "true")])]
