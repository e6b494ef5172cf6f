"""Readers, writers and streams over small files."""

import gzip
import json

import pyspark.sql.functions as F
import pytest
from pyspark.sql import types as T

from millrace.sources import readers, sinks
from millrace.streaming import events as streams


def test_registry_csv_plain_and_gzip(spark, tmp_path):
    text = '﻿"organisasjonsnummer";"navn";"antallAnsatte";"konkurs";"forretningsadresse.kommune"\n"974760673";"Firm; AS";"5";"TRUE";"OSLO"\n"12";"Short";"x";"";""\n"923609016";"Other";"many";"";""\n'
    plain, packed = tmp_path / "a.csv", tmp_path / "b.csv.gz"
    plain.write_text(text, encoding="utf-8")
    packed.write_bytes(gzip.compress(text.encode()))
    for path in (plain, packed):
        assert readers.sniff_delimiter(str(path)) == ";"
        rows = readers.read_registry_csv(spark, str(path)).orderBy("name").collect()
        assert [(r.organisation_number, r.name, r.employees, r.bankrupt, r.municipality, r.website) for r in rows] == [
            ("974760673", "Firm; AS", 5, True, "OSLO", None), ("923609016", "Other", None, False, None, None),
        ]
        assert json.loads(rows[0].raw)["navn"] == "Firm; AS"


def test_inputs_with_faults(spark):
    lines = ["974760673", "", '{"organisation_number": "974 760 673", "evaluation_split": "dev"}', '{"broken', "974760674", "923609016", None]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    got = readers.read_inputs(df, "line", "value").orderBy("line").collect()
    assert [r.error for r in got] == [None, "empty_line", "duplicate_input", "malformed_json", "invalid_organisation_number", None, "empty_line"]
    assert got[2].evaluation_split == "dev"


def test_search_payloads(spark):
    serper = json.dumps({"organic": [{"link": "https://a", "title": "A", "snippet": "s", "position": 3}, {"link": "https://ad", "sponsored": True}, {"title": "no url"}]})
    brave = json.dumps({"web": {"results": [{"url": "https://b", "title": "B", "description": "d"}]}})
    df = spark.createDataFrame([("k", "q", serper), ("k2", "q", "broken"), ("k3", "q", None)], "k string, q string, p string")
    got = readers.search_results(df, "k", "q", "p", "serper").collect()
    assert [(r.url, r.position, r.provider) for r in got] == [("https://a", 3, "serper")]
    df = spark.createDataFrame([("k", "q", brave)], "k string, q string, p string")
    assert [(r.url, r.snippet, r.position) for r in readers.search_results(df, "k", "q", "p", "brave").collect()] == [("https://b", "d", 1)]


def test_sitemaps_and_unambiguous(spark):
    df = spark.createDataFrame([(1, "<urlset><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>"), (2, "<!DOCTYPE x><loc>https://evil</loc>"), (3, None)], "k int, x string")
    assert [(r.k, r.pos, r.url) for r in readers.sitemap_urls(df, "k", "x").orderBy("k", "pos").collect()] == [(1, 0, "https://a/1"), (1, 1, "https://a/2")]
    many = spark.createDataFrame([(1, "<urlset>" + "".join(f"<url><loc>https://a/{i}</loc></url>" for i in range(2000)) + "</urlset>")], "k int, x string")
    assert readers.sitemap_urls(many, "k", "x").count() == 2000 and readers.sitemap_urls(many, "k", "x", 500).count() == 500
    rows = spark.createDataFrame([("o", "q1", "b"), ("o", "q1", "a"), ("p", "q1", "a"), ("p", "q2", "b")], "k string, i string, v string")
    assert [tuple(r) for r in readers.unambiguous(rows, "k", "i", "v").collect()] == [("o", "q1", ["a", "b"])]


def test_json_round_trip_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "k int, v string")
    sinks.append_shards(df.coalesce(1), str(tmp_path / "s"), 4)
    sinks.append_shards(df.coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.gz"))) == 6
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    assert readers.read_json_shards(spark, str(tmp_path / "s"), schema, "k").where("error IS NULL").count() == 20
    (tmp_path / "s" / "more.json").write_text('{"k": 1, "v": "a"}\n{broken\n{"v": "keyless"}\n')
    rows = readers.read_json_shards(spark, str(tmp_path / "s"), schema, "k").where("error IS NOT NULL").collect()
    assert sorted((r.error, r.v, r.raw) for r in rows) == [("malformed_json", None, "{broken"), ("missing_key", "keyless", None)]
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert "null" in next((tmp_path / "j").glob("part*")).read_text()


def test_partitions_and_absent_keys(spark, tmp_path):
    path = str(tmp_path / "p")
    day = lambda d, n: spark.createDataFrame([(d, i) for i in range(n)], "day string, k int")
    sinks.write_partitions(day("a", 3).union(day("b", 2)), path, "day")
    sinks.write_partitions(day("a", 1), path, "day")
    assert {r.day: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()} == {"a": 1, "b": 2}
    cache = str(tmp_path / "c")
    day("a", 2).write.parquet(cache)
    sinks.insert_absent(day("z", 4).union(day("y", 4)), spark.read.parquet(cache), "k", cache)
    assert sorted((r.k, r.day) for r in spark.read.parquet(cache).collect()) == [(0, "a"), (1, "a"), (2, "y"), (3, "y")]


def test_worksheet_merge_and_history(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t; \"q\"\n2"), (2, "u")], "k int, t string")
    sinks.write_worksheet(rows, str(tmp_path / "w"))
    labels = spark.createDataFrame([(1, "yes", 1), (1, "no", 2), (2, " ", 1)], "k int, label string, o int")
    merged = sinks.merge_worksheet(rows, labels, "k", "label", "o", ["yes", "no"])
    assert sorted((r.k, r.label) for r in merged.collect()) == [(1, "no"), (2, None)]
    with pytest.raises(Exception, match="unknown label"):
        sinks.merge_worksheet(rows, labels, "k", "label", "o", ["yes"]).collect()
    many = spark.range(300).selectExpr("id % 2 AS owner", "id AS at", "id AS k")
    assert {r.owner: r["count"] for r in sinks.capped_history(many, "owner", "at", "k").groupBy("owner").count().collect()} == {0: 100, 1: 100}


def _landing(tmp_path, spark):
    schema = "id int, at timestamp, kind string"
    files = [[(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "b")], [(1, "2024-01-01 00:10:00", "a"), (3, "2024-01-01 03:00:00", "a")], [(4, "2024-01-02 12:00:00", "c")]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "id int, at string, kind string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_table(spark, tmp_path):
    stream = _landing(tmp_path, spark)
    table = spark.read.parquet(str(tmp_path / "in"))
    from millrace.operators.state import ledger

    assert sorted(map(tuple, streams.stream_ledger(stream, "kind", "at", "kind").collect())) == sorted(map(tuple, ledger(table, "kind", "at", "kind").collect()))
    once = streams.run_to_end(streams.deduplicated(stream, ["id"], "at", "1 day"), "t")
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4]


def test_windows_close_by_watermark(spark, tmp_path):
    stream = _landing(tmp_path, spark)
    closed = streams.run_to_end(streams.tumbling(stream, "at", "1 hour", [], {"n": F.count("*")}, late="30 minutes"), "w")
    assert sorted(r.n for r in closed.collect()) == [1, 3]  # the last window is still open
    table = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in streams.sessions(table, "at", "1 hour", [], {"n": F.count("*")}).collect()) == [1, 1, 3]
