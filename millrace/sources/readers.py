"""Readers of landed files that turn bad input into rows instead of failing, and parsers of payloads."""

from __future__ import annotations

import csv
import gzip
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.orgid import digits_only, has_valid_check_digit

#: Normalised registry row: column, type, and the headers it may stand under (first non-empty wins).
REGISTRY_COLUMNS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("organisation_number", "string", ("organisasjonsnummer", "organisation_number")),
    ("name", "string", ("navn", "name")),
    ("legal_form", "string", ("organisasjonsform.kode", "organisasjonsform", "legal_form")),
    ("employees", "bigint", ("antallAnsatte", "employees")),
    ("bankrupt", "boolean", ("konkurs", "bankrupt")),
    ("liquidating", "boolean", ("underAvvikling", "liquidating")),
    ("municipality", "string", ("forretningsadresse.kommune", "municipality")),
    ("municipality_number", "string", ("forretningsadresse.kommunenummer", "municipality_number")),
    ("industry_code", "string", ("naeringskode1.kode", "naeringskode1", "industry_code")),
    ("industry_label", "string", ("naeringskode1.beskrivelse", "industry_label")),
    ("website", "string", ("hjemmeside", "website")),
    ("latest_submitted_accounts", "string", ("sisteInnsendteAarsregnskap", "latest_submitted_accounts")),
)


def sniff_delimiter(path: str, size: int = 8192) -> str:
    """The delimiter of a CSV file (one of ``; , TAB``), from its first bytes; gzip is told by its magic
    bytes. For a local file: on a cluster pass ``delimiter`` to the reader instead."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    with gzip.open(path, "rb") if packed else open(path, "rb") as f:
        head = f.read(size).decode("utf-8-sig", "replace")
    try:
        return csv.Sniffer().sniff(head, ";,\t").delimiter
    except csv.Error:
        return ","


def normalise_registry(rows: DataFrame) -> DataFrame:
    """Raw text columns as the twelve typed columns and ``raw``, the row as JSON text. Empty texts count as
    missing; an unreadable number is null; a flag is true only for ``true`` in any case."""
    have = {c.lower(): c for c in rows.columns}
    out = []
    for name, kind, headers in REGISTRY_COLUMNS:
        found = [F.nullif(F.trim(F.col(f"`{have[h.lower()]}`")), F.lit("")) for h in dict.fromkeys(headers) if h.lower() in have]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        if kind == "bigint":
            value = value.try_cast("bigint")
        elif kind == "boolean":
            value = F.coalesce(F.lower(value) == "true", F.lit(False))
        out.append(value.alias(name))
    return rows.select(*out, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw"))


def read_registry_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A registry snapshot in CSV (plain or gzip), normalised; rows whose number has not nine characters
    are dropped. A gzip file is one task's work to read: its rows are spread out right after."""
    raw = spark.read.csv(path, header=True, sep=delimiter or sniff_delimiter(path), quote='"', escape='"', multiLine=False, encoding="UTF-8")
    first = raw.columns[0]
    if first.startswith("﻿"):
        raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    if path.endswith(".gz"):
        raw = raw.repartition(spark.sparkContext.defaultParallelism)
    return normalise_registry(raw).where(F.length("organisation_number") == 9)


_INPUT = T.StructType([T.StructField("organisation_number", T.StringType()), T.StructField("evaluation_split", T.StringType()), T.StructField("sample_slice", T.StringType())])


def read_inputs(lines: DataFrame, line: str, value: str) -> DataFrame:
    """Inputs from lines that are JSON objects or bare numbers: ``line, organisation_number,
    evaluation_split, sample_slice, error``. A line gives a row whatever is in it: ``error`` is
    ``empty_line``, ``malformed_json``, ``invalid_organisation_number``, ``duplicate_input`` (a number
    that an earlier line has) or null."""
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    is_json = F.startswith(text, F.lit("{"))
    parsed = F.from_json(F.when(is_json, text), _INPUT)
    broken = is_json & F.try_parse_json(text).isNull()
    number = digits_only(F.when(is_json, parsed["organisation_number"]).otherwise(text))
    rows = lines.select(F.col(line).alias("line"), text.alias("t"), broken.alias("broken"), number.alias("organisation_number"), parsed["evaluation_split"].alias("evaluation_split"), parsed["sample_slice"].alias("sample_slice"))
    fault = F.when(F.col("t") == "", "empty_line").when(F.col("broken"), "malformed_json").when(~has_valid_check_digit(F.col("organisation_number")), "invalid_organisation_number")
    marked = rows.withColumn("error", fault)
    # A number's first line is a grouped minimum: however often it is repeated, no task holds its lines.
    first = marked.where("error IS NULL").groupBy("organisation_number").agg(F.min("line").alias("first"))
    joined = marked.join(first, "organisation_number", "left")
    repeated = F.col("error").isNull() & (F.col("line") > F.col("first"))
    return joined.withColumn("error", F.when(repeated, "duplicate_input").otherwise(F.col("error"))).select("line", "organisation_number", "evaluation_split", "sample_slice", "error")


def read_json_shards(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Sharded (gzip) JSON lines with an explicit schema, and ``error`` and ``raw``: a line that is no JSON
    (``malformed_json``) or has no key (``missing_key``) is a row with its error, so that none vanishes
    uncounted. Good rows have null in both."""
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("raw", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").json(path)
    fault = F.when(F.col("raw").isNotNull(), "malformed_json").when(F.col(key).isNull(), "missing_key")
    return read.select(*[F.col(f"`{f.name}`") for f in schema.fields], fault.alias("error"), "raw")


# ---------------------------------------------------------------- payloads
#: Where each provider's payload keeps its results, and the fields of one.
PROVIDERS: dict[str, tuple[str, str, str, str, str | None]] = {
    "serper": ("organic", "link", "title", "snippet", "position"),
    "serpapi": ("organic_results", "link", "title", "snippet", "position"),
    "tavily": ("results", "url", "title", "content", None),
    "linkup": ("results", "url", "name", "content", None),
    "brave": ("web.results", "url", "title", "description", None),
}


def search_results(payloads: DataFrame, key: str, query: str, payload: str, provider: str) -> DataFrame:
    """Uniform ``key, query, url, title, snippet, position, provider`` of one provider's JSON payloads.
    Results without a URL and sponsored ones are dropped; a missing position is the place in the list;
    broken payloads give no rows."""
    where, url, title, snippet, position = PROVIDERS[provider]
    array = F.try_variant_get(F.try_parse_json(F.col(payload)), "$." + where, "array<variant>")
    rows = payloads.select(F.col(key).alias("key"), F.col(query).alias("query"), F.posexplode(array).alias("pos", "r"))
    read = lambda name, kind="string": F.try_variant_get(F.col("r"), f"$.{name}", kind)
    place = F.coalesce(read(position, "int"), F.col("pos") + 1) if position else F.col("pos") + 1
    sponsored = F.coalesce(read("sponsored", "boolean"), F.lit(False))
    return rows.where(~sponsored & F.coalesce(read(url) != "", F.lit(False))).select("key", "query", read(url).alias("url"), read(title).alias("title"), read(snippet).alias("snippet"), place.alias("position"), F.lit(provider).alias("provider"))


def unambiguous(rows: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Values of keys with exactly one distinct item: ``key, item, values`` (sorted, distinct)."""
    return rows.groupBy(key).agg(F.countDistinct(item).alias("n"), F.first(item, ignorenulls=True).alias(item), F.array_sort(F.collect_set(value)).alias("values")).where("n = 1").drop("n")


def sitemap_urls(df: DataFrame, key: str, xml: str, limit: int | None = None) -> DataFrame:
    """Locations of sitemap documents, all of them or at most ``limit`` each; documents with a DTD, and broken
    ones, give none."""
    safe = F.when(~F.lower(F.col(xml)).contains("<!doctype") & F.lower(F.col(xml)).contains("<loc>"), F.col(xml))
    found = F.regexp_extract_all(safe, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return df.select(key, F.posexplode(F.slice(found, 1, limit) if limit else found).alias("pos", "url"))


def statuses(rows: DataFrame, code: str) -> Column:
    """Evidence status of an HTTP status: 200 available, 404 and 410 not_found, else source_error."""
    c = rows[code]
    return F.when(c == 200, "available").when(c.isin(404, 410), "not_found").otherwise("source_error")



def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
