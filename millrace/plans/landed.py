"""Queries over landed inputs: registry files, inputs, shards, payloads, feeds, worksheets, dated partitions.

Sources and sinks are exercised as round trips through the shared folder: a table is written in the landed
form and read back by the reader, so that the result can be told from the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import dates, jsonx, markup, orgid, text
from millrace.operators import cascade, evidence, feeds, sets
from millrace.session import ensure_checkpoint_dir
from millrace.sources import readers, sinks
from millrace.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _landing(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- registry files and inputs
_TRIMMED = "nullif(trim({}, ' '), '')"


@query(f"""SELECT DISTINCT organisation_number, {_TRIMMED.format('name')} AS name, employees, bankrupt, liquidating, {_TRIMMED.format('municipality')} AS municipality, {_TRIMMED.format('municipality_number')} AS municipality_number, {_TRIMMED.format('website')} AS website
    FROM (SELECT * REPLACE (trim(organisation_number, ' ') AS organisation_number) FROM entry_companies) WHERE length(organisation_number) = 9 AND NOT regexp_matches(coalesce(name, '') || coalesce(municipality, '') || coalesce(website, ''), '[\\r\\n]')""")
def registry_csv(spark, folder):
    """Snapshots landed as gzip CSV under the registry's headers, read back and typed."""
    rows = read_table(spark, folder, "entry_companies")
    breaks = F.concat(*[F.coalesce(c, F.lit("")) for c in ("name", "municipality", "website")]).rlike("[\\r\\n]")
    headers = {"organisation_number": "organisasjonsnummer", "name": "navn", "employees": "antallAnsatte", "bankrupt": "konkurs", "liquidating": "underAvvikling", "municipality": "forretningsadresse.kommune", "municipality_number": "forretningsadresse.kommunenummer", "website": "hjemmeside"}
    landed = rows.where(~breaks).select(*[F.col(c).cast("string").alias(h) for c, h in headers.items()])
    path = _landing(spark, "registry")
    landed.write.option("header", "true").option("sep", ";").option("escape", '"').option("compression", "gzip").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return readers.read_registry_csv(spark, path, ";").select(*headers).distinct()


_NINE = "regexp_replace(t, '[^0-9]', '', 'g')"
_SUM = " + ".join(f"CAST(substr({_NINE}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(orgid.WEIGHTS))
_VALID = f"(length({_NINE}) = 9 AND coalesce(CASE WHEN length({_NINE}) = 9 THEN CASE WHEN ({_SUM}) % 11 = 0 THEN 0 ELSE 11 - ({_SUM}) % 11 END = CAST(substr({_NINE}, 9, 1) AS INT) END, false))"


@query(f"""WITH r AS (SELECT line, t, CASE WHEN t = '' THEN 'empty_line' WHEN NOT {_VALID} THEN 'invalid_organisation_number' END AS fault, {_NINE} AS n FROM
    (SELECT line, CASE WHEN starts_with(trim(coalesce(number, '')), '{{') THEN 'x' ELSE trim(coalesce(number, '')) END AS t FROM (SELECT row_id AS line, min(organisation_number) AS number FROM companies GROUP BY 1)))
    SELECT coalesce(fault, CASE WHEN line > min(line) FILTER (fault IS NULL) OVER (PARTITION BY n) THEN 'duplicate_input' END, 'ok') AS error, line FROM r""")
def tolerant_inputs(spark, folder):
    """Inputs, one organisation number a line as delivered: every line gives a row, whatever is in it."""
    lines = read_table(spark, folder, "companies").groupBy(F.col("row_id").alias("line")).agg(F.min("organisation_number").alias("number"))
    return readers.read_inputs(lines, "line", "number").select("line", F.coalesce("error", F.lit("ok")).alias("error"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS keys, count(*) FILTER (lang IS NULL) AS without_language, 0 AS errors FROM documents")
def shard_cache_scan(spark, folder):
    """Documents appended as gzip JSON shards and scanned with an explicit schema."""
    path = _landing(spark, "shards")
    sinks.append_shards(read_table(spark, folder, "documents").select("doc_id", "lang", "source"), path, 5_000)
    schema = T.StructType().add("doc_id", "long").add("lang", "string").add("source", "string")
    rows = readers.read_json_shards(spark, path, schema, "doc_id")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("keys"), F.count_if(F.col("lang").isNull()).alias("without_language"), F.count("error").cast("int").alias("errors"))


# ---------------------------------------------------------------- payloads and feeds
@query("""SELECT DISTINCT audit_id, organisation_number AS query, final_url AS url, page_title AS title, rule_evidence AS snippet, CAST(2 AS INTEGER) AS position, 'serper' AS provider FROM g4_registry_floor_audit WHERE final_url <> ''
    UNION SELECT DISTINCT audit_id, organisation_number, declared_url, NULL, NULL, CAST(1 AS INTEGER), 'serper' FROM g4_registry_floor_audit WHERE declared_url <> ''""")
def search_payloads(spark, folder):
    """Results of search payloads in one provider's form, uniform; sponsored ones are dropped."""
    rows = read_table(spark, folder, "g4_registry_floor_audit")
    result = lambda link, title, snippet, sponsored: F.struct(link.alias("link"), title.alias("title"), snippet.alias("snippet"), F.lit(sponsored).alias("sponsored"))
    none = F.lit(None).cast("string")
    results = F.array(result(F.col("declared_url"), none, none, False), result(F.col("final_url"), F.col("page_title"), F.col("rule_evidence"), False), result(F.lit("https://ads.example"), none, none, True))
    payloads = rows.select("audit_id", "organisation_number", F.to_json(F.struct(results.alias("organic"))).alias("payload"))
    found = readers.search_results(payloads, "audit_id", "organisation_number", "payload", "serper")
    return found.withColumnRenamed("key", "audit_id").withColumn("title", F.when(F.col("position") == 2, F.col("title"))).distinct()


def ladder_sql(t: str) -> str:
    """The reading of ``dates.date_ladder``, as SQL."""
    months = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in dates.MONTHS.items()) + "}"
    worded = r"'(?i)^(?:[a-z]{3}, )?(\d{1,2})\.? ([a-zæøå]+)\.? (\d{4})\b'"
    built = f"nullif(regexp_extract(trim({t}), {worded}, 3), '') || '-' || {months}[lower(regexp_extract(trim({t}), {worded}, 2))] || '-' || regexp_extract(trim({t}), {worded}, 1)"
    iso = rf"nullif(regexp_extract(trim({t}), '^(\d{{4}}-\d{{2}}-\d{{2}})(?:[T ].*)?$', 1), '')"
    dotted = rf"nullif(regexp_extract(trim({t}), '^(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})$', 1), '')"
    return f"coalesce(CAST(try_strptime({iso}, '%Y-%m-%d') AS DATE), CAST(try_strptime({dotted}, '%d.%m.%Y') AS DATE), CAST(try_strptime({built}, '%Y-%m-%d') AS DATE))"


_ITEMS = "(SELECT recovery_id, CAST(i - 1 AS INTEGER) AS pos, activity.items[i] AS x FROM (SELECT *, unnest(range(1, len(activity.items) + 1)) AS i FROM (SELECT DISTINCT recovery_id, activity FROM recovery)))"
_SQUEEZED = "nullif(trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


@query(f"""SELECT recovery_id, pos, {_SQUEEZED.format('x.title')} AS title, {_SQUEEZED.format('x.url')} AS url, strftime({ladder_sql(_SQUEEZED.format('x.date'))}, '%Y-%m-%d') AS day FROM {_ITEMS}""")
def feed_documents(spark, folder):
    """Items of RSS documents, one a record, with the day of each."""
    rows = read_table(spark, folder, "recovery").select("recovery_id", F.col("activity.items").alias("items")).where("items IS NOT NULL").distinct()
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = lambda x: F.concat(F.lit("<item><title>"), escaped(x["title"]), F.lit("</title><link>"), escaped(x["url"]), F.lit("</link><pubDate>"), escaped(x["date"]), F.lit("</pubDate></item>"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", item), ""), F.lit("</channel></rss>"))
    found = feeds.feed_items(rows.select("recovery_id", xml.alias("xml")), "recovery_id", "xml")
    return found.select(F.col("key").alias("recovery_id"), "pos", "title", "url", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""SELECT recovery_id, pos, x.url AS url, strftime({ladder_sql('x.date')}, '%Y-%m-%d') AS day, x.title IS NULL AS untitled FROM {_ITEMS} WHERE x IS NOT NULL""")
def blog_posts(spark, folder):
    """Posts of blog-engine JSON, one list a record."""
    rows = read_table(spark, folder, "recovery").select("recovery_id", F.col("activity.items").alias("items")).where("items IS NOT NULL").distinct()
    post = lambda x: F.when(x.isNotNull(), F.struct(F.struct(x["title"].alias("rendered")).alias("title"), x["url"].alias("link"), x["date"].alias("date")))
    found = feeds.post_items(rows.select("recovery_id", F.to_json(F.transform("items", post)).alias("payload")), "recovery_id", "payload")
    return found.select(F.col("key").alias("recovery_id"), "pos", "url", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("title").isNull().alias("untitled"))


_IN_TEXT = r"regexp_extract(coalesce({}, ''), '(?i)\b(\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}\.? [a-zæøå]{{3,9}}\.? \d{{4}})\b', 1)"


@query(f"""SELECT recovery_id, pos, strftime(coalesce(m, t), '%Y-%m-%d') AS day, CASE WHEN m IS NOT NULL THEN 'meta' WHEN t IS NOT NULL THEN 'text' END AS method FROM (SELECT recovery_id, pos, {ladder_sql("x.date")} AS m, {ladder_sql(_IN_TEXT.format("x.title"))} AS t FROM {_ITEMS})""")
def article_days(spark, folder):
    """The day of each item and where it was read: its date, or a date written in its title."""
    items = read_table(spark, folder, "recovery").select("recovery_id", "activity").distinct().select("recovery_id", F.posexplode("activity.items").alias("pos", "x"))
    none = F.lit(None).cast("string")
    found = items.select("recovery_id", "pos", *feeds.article_day(F.col("x.date"), none, none, F.col("x.title"), none))
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT brief_id, CAST(i - 1 AS INTEGER) AS pos, us[i] AS url FROM (SELECT brief_id, us, unnest(range(1, len(us) + 1)) AS i FROM (SELECT DISTINCT brief_id, list_filter(list_transform(pages, lambda p: p.url), lambda u: u IS NOT NULL) AS us FROM briefs))""")
def sitemap_locations(spark, folder):
    """All locations of sitemap documents, one a brief."""
    urls = F.filter(F.col("pages.url"), lambda u: u.isNotNull())
    rows = read_table(spark, folder, "briefs").select("brief_id", urls.alias("urls")).distinct()
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    return readers.sitemap_urls(rows.select("brief_id", xml.alias("xml")), "brief_id", "xml")


@query(r"""SELECT recovery_id, title, array_to_string(list_sort(urls), ' ') AS urls, agree FROM (SELECT recovery_id, arg_min(title, url) AS title, list(DISTINCT url) AS urls, count(*) AS agree FROM (SELECT DISTINCT recovery_id, x.title AS title, x.url AS url, trim(regexp_replace(lower(x.title), '[^\p{L}\p{N}]+', ' ', 'g')) AS t
    FROM (SELECT recovery_id, unnest(list_concat(coalesce(hiring.postings, []), coalesce(hiring.company_site_postings, []), coalesce(hiring.nav_ads, []))) AS x FROM recovery) WHERE x.url IS NOT NULL) WHERE t <> '' GROUP BY recovery_id, t)""")
def merged_postings(spark, folder):
    """Postings of three lists merged by normalised title, with the addresses that agree."""
    rows = read_table(spark, folder, "recovery").select("recovery_id", "hiring")
    lists = F.concat(*[F.coalesce(F.col(f"hiring.{c}"), F.array()) for c in ("postings", "company_site_postings", "nav_ads")])
    items = rows.select("recovery_id", F.explode(lists).alias("x")).select("recovery_id", "x.title", "x.url").where("url IS NOT NULL").distinct()
    return feeds.merge_items(items, "recovery_id", "title", "url", "url").withColumn("urls", F.array_join("urls", " "))


# ---------------------------------------------------------------- values
@query(r"""SELECT n AS phone, count(*) AS pages FROM (SELECT DISTINCT brief_id, i, unnest(list_transform(regexp_extract_all(pages[i].html, '(?:\+47 ?)?(?:\d{2} ){3}\d{2}'), lambda x: regexp_replace(regexp_replace(x, '^\+47', ''), '[^0-9]', '', 'g'))) AS n
    FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM briefs)) WHERE length(n) = 8 GROUP BY 1""")
def phones_in_pages(spark, folder):
    """Phone numbers in pages, in eight digits."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.posexplode("pages.html").alias("i", "html"))
    found = pages.select("brief_id", "i", F.explode(F.regexp_extract_all("html", F.lit(r"(?:\+47 ?)?(?:\d{2} ){3}\d{2}"), F.lit(0))).alias("x"))
    return found.select("brief_id", "i", text.phone_digits(F.col("x")).alias("phone")).where("phone IS NOT NULL").distinct().groupBy("phone").agg(F.count("*").alias("pages"))


@query(r"""SELECT brief_id, i AS page_ord, count(*) AS prices, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT brief_id, CAST(i - 1 AS INTEGER) AS i, CAST(regexp_replace(unnest(regexp_extract_all(html, '>(\d[\d ]*) kr<', 1)), ' ', '', 'g') AS BIGINT) AS v FROM (SELECT DISTINCT brief_id, i, pages[i].html AS html FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM briefs))) GROUP BY 1, 2""")
def prices_in_pages(spark, folder):
    """Amounts written with spaces between thousands, read as numbers."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.posexplode("pages.html").alias("page_ord", "html")).distinct()
    found = pages.select("brief_id", "page_ord", F.explode(F.regexp_extract_all("html", F.lit(r">(\d[\d ]*) kr<"), F.lit(1))).alias("x"))
    return found.groupBy("brief_id", "page_ord").agg(F.count("*").alias("prices"), F.sum(text.number_value(F.col("x"))).alias("total"))


@query("""SELECT domain, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1) AS domain FROM documents WHERE url IS NOT NULL) WHERE domain <> '' GROUP BY 1""")
def email_domains(spark, folder):
    """Domains of the contact addresses at the hosts of documents."""
    host = F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#:]+)", 1)
    rows = read_table(spark, folder, "documents").where("url IS NOT NULL").select(F.concat(F.lit("Post@ "), F.upper(host), F.lit(" ")).alias("address"))
    return rows.select(text.email_domain(F.col("address")).alias("domain")).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"))


@query("""SELECT day, day + 1 AS next_day, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS next_month, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)""")
def quota_resets(spark, folder):
    """When the quotas that a day's requests used reset."""
    days = read_table(spark, folder, "events").where("ts IS NOT NULL").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", dates.next_reset(F.col("day"), F.lit(True)).alias("next_day"), dates.next_reset(F.col("day"), F.lit(False)).alias("next_month"), "n")


@query("""SELECT o_orderkey, round(0.3 * greatest(0.0, least(1.0, o_totalprice / 300000)), 3) AS score FROM orders""")
def capped_weights(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", text.capped(0.3, F.col("o_totalprice") / 300000).alias("score"))


_SPREAD_LABELS = ("company_owned", "news", "review")


@query("SELECT id, " + ", ".join(f"CAST(CASE WHEN source_class IS NULL OR source_class NOT IN {_SPREAD_LABELS} THEN round(1 / 3.0, 6) WHEN source_class = '{x}' THEN c ELSE round((1 - c) / 2, 6) END AS DOUBLE) AS p_{x}" for x in _SPREAD_LABELS) + " FROM (SELECT DISTINCT id, source_class, CASE WHEN exact_entity THEN 0.9 ELSE 0.6 END AS c FROM sentiment_inference_smoke)")
def label_probabilities(spark, folder):
    """Probabilities over three labels from a choice and how sure it is."""
    rows = read_table(spark, folder, "sentiment_inference_smoke").select("id", "source_class", "exact_entity").distinct()
    spread = evidence.label_spread(F.col("source_class"), F.when(F.col("exact_entity"), 0.9).otherwise(0.6), _SPREAD_LABELS)
    return rows.withColumn("p", spread).select("id", *[F.col("p")[x].alias(f"p_{x}") for x in _SPREAD_LABELS])


@query("""SELECT event_type, props, count(*) AS n FROM (SELECT event_type, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS props FROM events WHERE props IS NOT NULL) GROUP BY 1, 2""")
def canonical_properties(spark, folder):
    """Properties of events as canonical JSON text, counted."""
    rows = read_table(spark, folder, "events").where("props IS NOT NULL")
    return rows.select("event_type", jsonx.canonical_map(F.from_json("props", "map<string,string>")).alias("props")).groupBy("event_type", "props").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- states of entities
_STATES = """(SELECT row_id, list_transform(json_keys(latest_envelope, '$.modules'), lambda k: json_extract_string(latest_envelope, '$.modules."' || k || '".state')) AS s, json_keys(latest_envelope, '$.modules') AS ks, latest_envelope FROM (SELECT DISTINCT row_id, latest_envelope FROM companies))"""


def _module_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "companies").select("row_id", "latest_envelope").distinct()
    modules = F.from_json(F.get_json_object("latest_envelope", "$.modules"), "map<string, struct<state: string>>")
    return rows.select("row_id", F.transform_values(modules, lambda _, v: v["state"]).alias("states"))


@query(f"""SELECT row_id, CASE WHEN s IS NULL OR len(s) = 0 OR list_bool_and(list_transform(s, lambda x: x = 'not_available')) THEN 'not_available' WHEN list_contains(s, 'failed') AND list_bool_and(list_transform(s, lambda x: x IN ('failed', 'not_available'))) THEN 'not_available'
    WHEN list_contains(s, 'ambiguous') THEN 'ambiguous' WHEN list_contains(s, 'blocked') AND list_bool_and(list_transform(s, lambda x: x IN ('blocked', 'not_available'))) THEN 'blocked' WHEN list_contains(s, 'failed') THEN 'not_available' ELSE 'ambiguous' END AS state FROM
    (SELECT row_id, list_filter(list_transform(s, lambda x: CASE x WHEN 'complete' THEN 'ambiguous' WHEN 'not_found' THEN 'not_available' ELSE x END), lambda x: x IS NOT NULL) AS s FROM {_STATES})""")
def entity_states(spark, folder):
    """The state of each envelope from the states of its modules."""
    read = lambda s: F.when(s == "complete", "ambiguous").when(s == "not_found", "not_available").otherwise(s)
    states = F.array_compact(F.transform(F.map_values("states"), read))
    return _module_states(spark, folder).select("row_id", cascade.final_state(states, F.lit(False), F.lit(False)).alias("state"))


@query(f"""SELECT row_id, array_to_string(list_sort(list_filter(ks, lambda k: json_extract_string(latest_envelope, '$.modules."' || k || '".state') = 'complete')), ',') AS merged FROM {_STATES}""")
def merged_available(spark, folder):
    """Modules that a profile takes over: those whose state is complete."""
    rows = _module_states(spark, folder)
    kept = evidence.merge_available(F.col("states"), F.col("states"), "complete")
    return rows.select("row_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("merged"))


# ---------------------------------------------------------------- unions, worksheets, partitions
@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT -1 - item_id, 'item' FROM eval_items")
def base_and_extension(spark, folder):
    """A base and its extension, whose ids must not meet."""
    base = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    extension = read_table(spark, folder, "eval_items").select((-1 - F.col("item_id")).alias("id"), F.lit("item").alias("kind"))
    return sets.disjoint_union(base, extension, "id")


@query("""SELECT organisation_number, any_value(name) AS name, CAST(count(DISTINCT brief_id) AS BIGINT) AS briefs FROM briefs WHERE organisation_number IS NOT NULL AND name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1""")
def unambiguous_names(spark, folder):
    """Organisations with one name only, and how many briefs they have."""
    rows = read_table(spark, folder, "briefs").where("organisation_number IS NOT NULL AND name IS NOT NULL").select("organisation_number", "name", "brief_id")
    return readers.unambiguous(rows, "organisation_number", "name", "brief_id").select("organisation_number", "name", F.size("values").cast("bigint").alias("briefs"))


@query("""SELECT d.organisation_number, label FROM (SELECT DISTINCT organisation_number FROM documents WHERE organisation_number IS NOT NULL) d LEFT JOIN (SELECT organisation_number, arg_max(lower(lang), (landed_at, lower(lang))) AS label FROM documents WHERE lang IS NOT NULL AND trim(lang) <> '' AND organisation_number IS NOT NULL AND landed_at IS NOT NULL GROUP BY 1) l USING (organisation_number)""")
def worksheet_labels(spark, folder):
    """Labels written to a worksheet and merged back: the latest valid one of each organisation."""
    documents = read_table(spark, folder, "documents").where("organisation_number IS NOT NULL")
    path = _landing(spark, "worksheet")
    sinks.write_worksheet(documents.where("landed_at IS NOT NULL").select("organisation_number", F.lower("lang").alias("label"), F.date_format("landed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")), path)
    labels = spark.read.csv(path, header=True, quote='"', escape='"', schema="organisation_number string, label string, at string")
    return sinks.merge_worksheet(documents.select("organisation_number").distinct(), labels, "organisation_number", "label", "at", ["nb", "nn", "en", "no", "da", "sv", "de", "und"])


@query("""SELECT day, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL) GROUP BY 1""")
def daily_partitions(spark, folder):
    """A day's rows written twice are there once, and other days stay."""
    rows = read_table(spark, folder, "events").where("ts IS NOT NULL").select("event_id", F.col("ts").cast("date").alias("day"))
    path = _landing(spark, "daily")
    sinks.write_partitions(rows, path, "day")
    sinks.write_partitions(rows.where(F.col("day") == rows.select(F.min("day")).scalar()), path, "day")
    return spark.read.schema("event_id long, day date").parquet(path).groupBy("day").agg(F.count("*").alias("n"))


@query("""SELECT organisation_number, min(k) AS kind FROM (SELECT organisation_number, 'a' AS k FROM briefs UNION ALL SELECT organisation_number, 'b' FROM recovery) WHERE organisation_number IS NOT NULL GROUP BY 1""")
def append_absent(spark, folder):
    """Rows appended only where their key is not there yet."""
    keyed = lambda table, kind: read_table(spark, folder, table).where("organisation_number IS NOT NULL").select("organisation_number", F.lit(kind).alias("kind"))
    path = _landing(spark, "absent")
    a = keyed("briefs", "a")
    sinks.insert_absent(a, a.where("false"), "organisation_number", path)
    present = spark.read.schema(a.schema).parquet(path)
    sinks.insert_absent(keyed("recovery", "b"), present, "organisation_number", path)
    return spark.read.schema(a.schema).parquet(path)


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r <= 3""")
def workspace_history(spark, folder):
    """The newest three entries of each owner's history."""
    return sinks.capped_history(read_table(spark, folder, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3).select("user_id", "event_id")


@query(r"""SELECT DISTINCT recovery_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(brief.parts, lambda p: p.source_url), lambda u: coalesce(regexp_matches(lower(u), '^[a-z]+://(?:[^/?#:]+\.)?example(?:[/?#:]|$)'), false)))), ' ') AS links FROM recovery WHERE brief.parts IS NOT NULL""")
def profile_links(spark, folder):
    """Addresses of a brief's parts that lie under given hosts, sorted and distinct."""
    rows = read_table(spark, folder, "recovery").select("recovery_id", F.col("brief.parts.source_url").alias("urls")).where("urls IS NOT NULL")
    return rows.select("recovery_id", F.array_join(markup.social_links(F.col("urls"), ["example"]), " ").alias("links")).distinct()
