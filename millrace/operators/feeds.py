"""Dated items of feeds and of structured data in pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import date_ladder

#: JSON-LD types of articles and of job postings.
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "Event", "SocialMediaPosting")
JOBS = ("JobPosting",)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def feed_entries(text: str | None) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """Position, title, link and date text of the items of an RSS or Atom document. Documents with a DTD or
    an entity declaration are refused, broken ones have none."""
    if not text or "<!doctype" in text.lower() or "<!entity" in text.lower():
        return
    try:
        root = ElementTree.fromstring(text.strip())
    except (ElementTree.ParseError, ValueError):
        return
    entries = [e for e in root.iter() if _local(e.tag) in ("item", "entry")]
    for i, entry in enumerate(entries):
        found: dict[str, str] = {}
        for child in entry:
            name = _local(child.tag)
            value = " ".join("".join(child.itertext()).split()) or (child.get("href") or "")
            if value and name not in found:
                found[name] = value
        date = next((found[k] for k in ("pubdate", "published", "date", "updated") if k in found), None)
        yield i, found.get("title"), found.get("link"), date


def feed_items(df: DataFrame, key: str, xml: str) -> DataFrame:
    """``key, pos, title, url, date_text, day`` of feed documents; null documents give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *e) for i, t in enumerate(b.column(1).to_pylist()) for e in feed_entries(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kept = b.column(0).take(pa.array(columns[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(columns[1], pa.int32())] + [pa.array(c, pa.string()) for c in columns[2:]], names=["key", "pos", "title", "url", "date_text"])

    picked = df.select(F.col(key).alias("key"), F.col(xml).alias("xml")).where("xml IS NOT NULL")
    schema = picked.select("key").schema.add("pos", "integer").add("title", "string").add("url", "string").add("date_text", "string")
    return picked.mapInArrow(run, schema).withColumn("day", date_ladder(F.col("date_text")))


def post_items(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, pos, title, url, day`` of blog-engine JSON (a list of posts), natively; broken payloads give none."""
    schema = "array<struct<title: struct<rendered: string>, link: string, date: string>>"
    rows = df.select(F.col(key).alias("key"), F.posexplode(F.from_json(F.col(payload), schema)).alias("pos", "p"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("p.title.rendered", "<[^>]*>", " "), r"\s+", " "))
    return rows.where("p IS NOT NULL").select("key", "pos", plain.alias("title"), F.col("p.link").alias("url"), date_ladder(F.col("p.date")).alias("day"))


def typed_nodes(documents: list[str], types: tuple[str, ...]) -> Iterator[dict]:
    """Objects of the given types anywhere in JSON-LD documents, in order."""
    for text in documents:
        try:
            stack: list[object] = [json.loads(text)]
        except (ValueError, RecursionError):
            continue
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                kinds = v.get("@type")
                if any(k in types for k in (kinds if isinstance(kinds, list) else [kinds])):
                    yield v
                stack += [x for x in reversed(v.values()) if isinstance(x, dict | list)]


def article_day(meta: Column, structured: Column, time: Column, text: Column, url: Column) -> list[Column]:
    """``day`` and ``method`` of an article: the first of its meta date, structured date, time element, a
    date in its text (the first one written with a month's name or as day.month.year), and its URL path."""
    in_text = date_ladder(F.regexp_extract(text, r"(?i)\b(\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}\.? [a-zæøå]{3,9}\.? \d{4})\b", 1))
    path = F.try_to_date(F.regexp_replace(F.regexp_extract(url, r"/(\d{4}/\d{1,2}/\d{1,2})(?:/|$)", 1), "/", "-"), "yyyy-M-d")
    steps = [("meta", date_ladder(meta)), ("structured", date_ladder(structured)), ("time", date_ladder(time)), ("text", in_text), ("url", path)]
    method = None
    for name, day in steps:
        method = F.when(day.isNotNull(), name) if method is None else method.when(day.isNotNull(), name)
    return [F.coalesce(*[d for _, d in steps]).alias("day"), method.alias("method")]


def merge_items(items: DataFrame, owner: str, title: str, url: str, order: str) -> DataFrame:
    """Items with one normalised title merged by owner: the first in ``order`` stays, with the sorted
    distinct URLs of all and how many agree. Items of an owner are bounded facts of one entity."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(title), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    grouped = items.withColumn("__t", norm).where("__t != ''").groupBy(owner, "__t")
    return grouped.agg(F.min_by(title, order).alias(title), F.array_sort(F.collect_set(url)).alias("urls"), F.count("*").alias("agree")).drop("__t")
