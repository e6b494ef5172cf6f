"""Queries over whole profiles: envelopes, answers, coverage, gates, matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.jsonx import json_read
from millrace.functions.orgid import nine_digits
from millrace.functions.urls import host, registered_domain
from millrace.operators import aggregate, classify, discovery, fuzzy, rank, shred
from millrace.plans import answers
from millrace.plans.textual import identity_sql, tokens_sql
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


_ROWS = "(SELECT DISTINCT row_id, latest_envelope FROM companies)"


def _envelopes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "companies").select("row_id", "latest_envelope").distinct()


@query(f"""SELECT row_id, latest_envelope ->> '$.run_id' AS run_id, latest_envelope ->> '$.state' AS state, latest_envelope ->> '$.profile.name' AS name, latest_envelope ->> '$.profile.legal_form' AS legal_form,
    CAST(TRY_CAST(latest_envelope ->> '$.profile.employees' AS DOUBLE) AS BIGINT) AS employees, CAST(len(json_keys(latest_envelope, '$.modules')) AS INTEGER) AS n_modules, latest_envelope ->> '$.profile.evidence.website.value.final_url' AS final_url FROM {_ROWS}""")
def starter_projection(spark, folder):
    """Full envelopes projected to the starter shape."""
    read = lambda p, k="string": json_read(F.col("latest_envelope"), p, k)
    modules = F.from_json(F.get_json_object("latest_envelope", "$.modules"), "map<string, string>")
    return _envelopes(spark, folder).select(
        "row_id", read("$.run_id").alias("run_id"), read("$.state").alias("state"), read("$.profile.name").alias("name"), read("$.profile.legal_form").alias("legal_form"),
        read("$.profile.employees", "double").cast("bigint").alias("employees"), F.size(modules).alias("n_modules"), read("$.profile.evidence.website.value.final_url").alias("final_url"),
    )


@query(f"""SELECT row_id, CAST(len(c) AS INTEGER) AS n_claims, CAST(len(list_filter(c, lambda x: x.availability = 'available')) AS INTEGER) AS n_available FROM
    (SELECT row_id, json_transform(json_extract(latest_envelope, '$.claims'), '[{{"field": "VARCHAR", "availability": "VARCHAR"}}]') AS c FROM {_ROWS}) WHERE c IS NOT NULL""")
def claim_coverage(spark, folder):
    """How many claims of an envelope are available."""
    claims = F.from_json(F.get_json_object("latest_envelope", "$.claims"), "array<struct<field: string, availability: string>>")
    rows = _envelopes(spark, folder).select("row_id", claims.alias("c")).where("c IS NOT NULL")
    return rows.select("row_id", F.size("c").alias("n_claims"), F.size(F.filter("c", lambda x: x["availability"] == "available")).alias("n_available"))


@query(f"""WITH c AS (SELECT row_id, unnest(json_transform(json_extract(latest_envelope, '$.claims'), '[{{"field": "VARCHAR", "evidence_ids": ["VARCHAR"]}}]'), recursive := true) FROM {_ROWS}),
    e AS (SELECT row_id, unnest(json_transform(json_extract(latest_envelope, '$.evidence'), '[{{"id": "VARCHAR"}}]'), recursive := true) FROM {_ROWS}), r AS (SELECT DISTINCT row_id, field, unnest(evidence_ids) AS id FROM c)
    SELECT field, count(*) AS n_references, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.row_id = r.row_id AND e.id = r.id)) AS n_found FROM r GROUP BY 1""")
def evidence_references(spark, folder):
    """References of claims to evidence by field, and how many of them the envelope holds."""
    claims = F.from_json(F.get_json_object("latest_envelope", "$.claims"), "array<struct<field: string, evidence_ids: array<string>>>")
    have = F.from_json(F.get_json_object("latest_envelope", "$.evidence"), "array<struct<id: string>>")
    rows = _envelopes(spark, folder).select("row_id", F.explode(claims).alias("c"), F.coalesce(have["id"], F.array().cast("array<string>")).alias("ids"))
    references = rows.select("row_id", "c.field", "ids", F.explode("c.evidence_ids").alias("id")).distinct()
    return references.groupBy("field").agg(F.count("*").alias("n_references"), F.count_if(F.array_contains("ids", F.col("id"))).alias("n_found"))


@query(f"""WITH c AS (SELECT row_id, unnest(json_transform(json_extract(latest_envelope, '$.claims'), '[{{"field": "VARCHAR", "evidence_ids": ["VARCHAR"]}}]'), recursive := true) FROM {_ROWS}),
    e AS (SELECT row_id, unnest(json_transform(json_extract(latest_envelope, '$.evidence'), '[{{"id": "VARCHAR"}}]'), recursive := true) FROM {_ROWS}), r AS (SELECT DISTINCT row_id, field, unnest(evidence_ids) AS id FROM c)
    SELECT row_id, field, id FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.row_id = r.row_id AND e.id = r.id)""")
def dangling_evidence(spark, folder):
    """References of claims to evidence that the same envelope doesn't have, found within the row."""
    claims = F.from_json(F.get_json_object("latest_envelope", "$.claims"), "array<struct<field: string, evidence_ids: array<string>>>")
    have = F.from_json(F.get_json_object("latest_envelope", "$.evidence"), "array<struct<id: string>>")
    rows = _envelopes(spark, folder).select("row_id", F.explode(claims).alias("c"), F.coalesce(have["id"], F.array().cast("array<string>")).alias("ids"))
    return rows.select("row_id", "c.field", F.explode(F.array_except("c.evidence_ids", "ids")).alias("id")).distinct()


@query()
def financial_records(spark, folder):
    """Entity table of the filed accounts, in whatever shape an envelope holds their list."""
    companies = read_table(spark, folder, "companies")
    objects = shred.object_nodes(companies, F.col("row_id"), F.col("latest_envelope"))
    columns = {"record_id": "double", "account_type": "string", "currency": "string", "revenue": "double", "annual_result": "double", "equity": "double"}
    return shred.entity_table(objects, "records", columns).distinct()


@query()
def group_edges(spark, folder):
    """Parent and child organisation numbers of the group trees, at any depth."""
    companies = read_table(spark, folder, "companies")
    objects = shred.object_nodes(companies, F.col("row_id"), F.col("latest_envelope"))
    members = objects.where("label = 'children' AND ordinal IS NOT NULL").select("record_key", "child_path", "parent_path", F.try_element_at("scalars", F.lit("organisation_number")).alias("member")).distinct()
    above = members.select("record_key", F.col("child_path").alias("parent_path"), F.col("member").alias("parent"))
    return members.join(above, ["record_key", "parent_path"], "left").select("record_key", "child_path", "parent", "member")


_LATEST = "(SELECT * FROM (SELECT *, regexp_replace(organisation_number, '[^0-9]', '', 'g') AS o, row_number() OVER (PARTITION BY regexp_replace(organisation_number, '[^0-9]', '', 'g') ORDER BY snapshot_date DESC, loaded_at DESC) AS r FROM entry_companies) WHERE r = 1 AND length(o) = 9)"


@query(f"""SELECT o AS organisation_number, fact, nullif(trim(value), '') AS value, 'registry' AS module FROM (SELECT o, unnest([{{'fact': 'employees', 'value': CAST(employees AS VARCHAR)}}, {{'fact': 'municipality', 'value': municipality}}, {{'fact': 'municipality_number', 'value': municipality_number}}], recursive := true) FROM {_LATEST})""")
def answer_companies(spark, folder):
    rows = read_table(spark, folder, "entry_companies").withColumn("organisation_number", nine_digits(F.col("organisation_number"))).where("organisation_number IS NOT NULL")
    newest = rank.latest_per_key(rows, ["organisation_number"], [F.desc("snapshot_date"), F.desc("loaded_at")])
    return answers.answer(newest, "How many employees do they have, and where are they located?", "organisation_number")


@query("""SELECT round(avg(CASE WHEN platforms >= 1 THEN 1.0 ELSE 0 END), 4) AS with_one, round(avg(CASE WHEN platforms >= 2 THEN 1.0 ELSE 0 END), 4) AS with_two, round(avg(CASE WHEN fresh THEN 1.0 ELSE 0 END), 4) AS with_fresh, count(*) AS n FROM
    (SELECT b.organisation_number, count(DISTINCT source_class) AS platforms, coalesce(bool_or(date_diff('day', CAST(landed_at AS DATE), DATE '2026-09-01') BETWEEN 0 AND 45), false) AS fresh FROM (SELECT DISTINCT organisation_number FROM briefs WHERE organisation_number IS NOT NULL) b
    LEFT JOIN sentiment_inference_smoke s ON s.organisation_number = b.organisation_number GROUP BY 1)""")
def coverage_rates(spark, folder):
    """Shares of entities with one, two and fresh sources; entities without any count too."""
    ids = read_table(spark, folder, "briefs").select("organisation_number").where("organisation_number IS NOT NULL").distinct()
    days = F.datediff(F.lit("2026-09-01").cast("date"), F.col("landed_at").cast("date"))
    rows = read_table(spark, folder, "sentiment_inference_smoke").select("organisation_number", "source_class", days.between(0, 45).alias("fresh"))
    per = rows.groupBy("organisation_number").agg(F.countDistinct("source_class").alias("platforms"), F.bool_or("fresh").alias("fresh"))
    joined = ids.join(per, "organisation_number", "left")
    share = lambda c: F.round(F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)), 4)
    return joined.agg(share(F.col("platforms") >= 1).alias("with_one"), share(F.col("platforms") >= 2).alias("with_two"), share(F.col("fresh")).alias("with_fresh"), F.count("*").alias("n"))


@query("""SELECT bound, count(*) AS n, count(*) FILTER (c_acctbal > bound) AS passed, round(count(*) FILTER (c_acctbal > bound AND c_mktsegment = 'BUILDING') / CAST(nullif(count(*) FILTER (c_acctbal > bound), 0) AS DOUBLE), 4) AS precision
    FROM customer, (SELECT unnest([0, 2500, 5000, 9000]) AS bound) GROUP BY 1""")
def gate_matrix(spark, folder):
    """Outcome of several gate settings side by side: settings are an array in the row, no join."""
    rows = read_table(spark, folder, "customer").select("c_acctbal", "c_mktsegment", F.explode(F.array(*[F.lit(b) for b in (0, 2500, 5000, 9000)])).alias("bound"))
    passed = F.col("c_acctbal") > F.col("bound")
    return rows.groupBy("bound").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), aggregate.ratio(F.count_if(passed & (F.col("c_mktsegment") == "BUILDING")), F.count_if(passed)).alias("precision"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN declared_url IS NULL THEN 'no_candidate' WHEN page_title IS NULL OR trim(page_title) = '' THEN 'no_title' WHEN contains(lower(page_title), lower(name)) THEN 'verified' WHEN contains(lower(rule_evidence), lower(name)) THEN 'evidence_only' ELSE 'unverified' END AS outcome FROM (SELECT DISTINCT * FROM g4_registry_floor_audit)) GROUP BY 1""")
def outcome_funnel(spark, folder):
    rows = read_table(spark, folder, "g4_registry_floor_audit").distinct()
    low = lambda c: F.lower(F.col(c))
    outcome = (
        F.when(F.col("declared_url").isNull(), "no_candidate").when(F.col("page_title").isNull() | (F.trim("page_title") == ""), "no_title")
        .when(F.contains(low("page_title"), low("name")), "verified").when(F.contains(low("rule_evidence"), low("name")), "evidence_only").otherwise("unverified")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC NULLS LAST, sha256('s6:' || o_orderkey), o_orderkey LIMIT 50""")
def qc_priority_sample(spark, folder):
    return rank.priority_sample(read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 50, "s6")


@query("""WITH s AS (SELECT c_mktsegment AS g, count(*) AS size FROM customer GROUP BY 1), q AS (SELECT g, floor(CAST(size * 103 AS DOUBLE) / CAST(sum(size) OVER () AS DOUBLE)) AS quota FROM s),
    p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s7:' || c_custkey), c_custkey) <= quota AS first_ FROM customer JOIN q ON g = c_mktsegment)
    SELECT c_custkey, c_mktsegment FROM p ORDER BY first_ DESC, sha256('s7:rest:' || c_custkey), c_custkey LIMIT 103""")
def proportional_fill_sample(spark, folder):
    return rank.filled_sample(read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 103, "s7")


@query()
def fuzzy_titles(spark, folder):
    """Best-matching title of each company by fuzzy ratio; equal best scores are ambiguous."""
    rows = read_table(spark, folder, "g4_registry_floor_audit").select("audit_id", "organisation_number", "name", "page_title").where("organisation_number IS NOT NULL").distinct()
    scored = rows.withColumn("score", fuzzy.sequence_ratio(F.col("name"), F.col("page_title")))
    return rank.best_unless_tied(scored, "organisation_number", "score", "audit_id").select("organisation_number", "audit_id", "score", "ambiguous")


_DOMAIN_OF = "nullif(array_to_string(list_slice(string_split(regexp_replace(regexp_extract(lower({}), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '.'), -2, -1), '.'), '')"


@query(f"""WITH a AS (SELECT DISTINCT organisation_number, name, website_url FROM recovery WHERE organisation_number IS NOT NULL), b AS (SELECT organisation_number, page_title, final_url, count(*) AS seen FROM g4_registry_floor_audit WHERE organisation_number IS NOT NULL AND page_title IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT organisation_number, name, page_title, final_url, seen, list_distinct({identity_sql('name')}) AS x, {tokens_sql('page_title')} AS y, {_DOMAIN_OF.format('website_url')} AS d, {_DOMAIN_OF.format('final_url')} AS e FROM a JOIN b USING (organisation_number))
    SELECT organisation_number, name, page_title, final_url, CAST(max(round(4 * coalesce(CAST(len(list_filter(x, lambda w: list_contains(y, w))) AS DOUBLE) / nullif(len(x), 0), 0) + CASE WHEN d = e THEN 3.0 ELSE 0 END + least(1.0, log10(greatest(1.0, seen)) / 5), 4)) AS DOUBLE) AS score FROM t GROUP BY 1, 2, 3, 4""")
def place_match(spark, folder):
    """Landed pages as candidates for an organisation's site, scored over name share, domain and how often
    they were seen; candidates and organisations are made distinct before they meet."""
    a = read_table(spark, folder, "recovery").where("organisation_number IS NOT NULL").select("organisation_number", "name", "website_url").distinct()
    b = read_table(spark, folder, "g4_registry_floor_audit").where("organisation_number IS NOT NULL AND page_title IS NOT NULL").groupBy("organisation_number", "page_title", "final_url").agg(F.count("*").alias("seen"))
    share = text.token_overlap(text.identity_tokens(F.col("name")), text.fold_tokens(F.col("page_title")))
    channels = {"domain": (3.0, registered_domain(F.col("website_url")) == registered_domain(F.col("final_url")))}
    scored = a.join(b, "organisation_number").withColumn("score", fuzzy.match_score(share, channels, F.col("seen")))
    return scored.groupBy("organisation_number", "name", "page_title", "final_url").agg(F.max("score").alias("score"))


@query("""SELECT audit_id, slug FROM (SELECT DISTINCT audit_id, array_to_string(regexp_extract_all(regexp_replace(strip_accents(replace(replace(replace(lower(name), 'ø', 'o'), 'å', 'a'), 'æ', 'ae')), '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+'), '-') AS slug FROM g4_registry_floor_audit WHERE name IS NOT NULL)""")
def directory_slugs(spark, folder):
    return read_table(spark, folder, "g4_registry_floor_audit").where("name IS NOT NULL").select("audit_id", text.slug(F.col("name")).alias("slug")).distinct()


_HOST_SQL = "nullif(regexp_replace(regexp_extract(lower({}), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '')"
_SLUG = "array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '-')"


@query(f"""WITH e AS (SELECT organisation_number AS o, min(name) AS name, min(website_url) AS url FROM recovery WHERE organisation_number IS NOT NULL GROUP BY 1), d AS (SELECT organisation_number AS o, min(declared_url) AS declared FROM g4_registry_floor_audit WHERE organisation_number IS NOT NULL GROUP BY 1),
    s AS (SELECT o, name, url, declared, CASE WHEN len(t) > 0 THEN 'https://' || {_SLUG} || '.example/' END AS derived FROM (SELECT *, {identity_sql('name')} AS t FROM e LEFT JOIN d USING (o))),
    c AS (SELECT o, name, u.source, u.place, u.url, {_HOST_SQL.format('u.url')} AS host FROM (SELECT o, name, unnest([{{'source': 'registry', 'place': 0, 'url': url}}, {{'source': 'audit', 'place': 1, 'url': declared}}, {{'source': 'name', 'place': 2, 'url': derived}}]) AS u FROM s)),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ORDER BY place, url) AS r FROM c WHERE host IS NOT NULL) WHERE r = 1),
    p AS (SELECT host, max(title) AS title FROM (SELECT {_HOST_SQL.format('p.url')} AS host, nullif(regexp_extract(p.html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM (SELECT unnest(pages) AS p FROM briefs) WHERE p.html IS NOT NULL) WHERE host IS NOT NULL GROUP BY 1),
    j AS (SELECT o, source, place, url, CASE WHEN k.host = 'news.example' OR ends_with(k.host, '.news.example') THEN 'blocked' WHEN p.host IS NULL THEN 'failed' WHEN coalesce(len(a) > 0 AND len(list_filter(a, lambda x: list_contains({tokens_sql("coalesce(title, '')")}, x))) = len(a), false) THEN 'available' ELSE 'ambiguous' END AS state
    FROM (SELECT *, list_distinct({identity_sql('name')}) AS a FROM k) k LEFT JOIN p ON p.host = k.host),
    f AS (SELECT o, count(*) AS n, list(state) AS s, arg_min(source, place) FILTER (state = 'available') AS source, arg_min(url, place) FILTER (state = 'available') AS url, bool_or(source = 'registry' AND state = 'failed') AS strong FROM j GROUP BY 1)
    SELECT e.o AS organisation_number, CASE WHEN f.source IS NOT NULL THEN 'available' WHEN n IS NULL THEN 'not_available' WHEN list_contains(s, 'failed') AND strong THEN 'failed' WHEN list_contains(s, 'failed') AND len(list_filter(s, lambda x: x <> 'failed')) = 0 THEN 'not_available' WHEN list_contains(s, 'ambiguous') THEN 'ambiguous'
    WHEN list_contains(s, 'blocked') AND len(list_filter(s, lambda x: x <> 'blocked')) = 0 THEN 'blocked' WHEN list_contains(s, 'failed') THEN 'not_available' ELSE 'ambiguous' END AS state, f.source, f.url, coalesce(n, 0) AS n_candidates FROM e LEFT JOIN f ON f.o = e.o""")
def discovery_states(spark, folder):
    """Candidate addresses of each organisation against the pages that landed, and the state that follows."""
    present = lambda table: read_table(spark, folder, table).where("organisation_number IS NOT NULL")
    entities = present("recovery").groupBy("organisation_number").agg(F.min("name").alias("name"), F.min("website_url").alias("listed"))
    entities = entities.join(present("g4_registry_floor_audit").groupBy("organisation_number").agg(F.min("declared_url").alias("declared")), "organisation_number", "left")
    tokens = text.identity_tokens(F.col("name"))
    derived = F.when(F.size(tokens) > 0, F.concat(F.lit("https://"), F.array_join(tokens, "-"), F.lit(".example/")))
    found = discovery.candidates(entities, "organisation_number", [("registry", F.col("listed")), ("audit", F.col("declared")), ("name", derived)])
    title = F.nullif(F.regexp_extract("p.html", "(?is)<title>(.*?)</title>", 1), F.lit(""))
    landed = read_table(spark, folder, "briefs").select(F.explode("pages").alias("p")).where("p.html IS NOT NULL").select(host(F.col("p.url")).alias("host"), title.alias("title"))
    pages = landed.where("host IS NOT NULL").groupBy("host").agg(F.max("title").alias("title"))
    named = found.join(entities.select("organisation_number", "name"), "organisation_number")
    own = text.identity_tokens(F.col("name"))
    gate = (F.size(own) > 0) & (F.size(F.array_except(own, text.fold_tokens(F.col("title")))) == 0)
    return discovery.entity_results(entities, "organisation_number", discovery.judged(named, pages, gate, ["news.example"]), "registry")


_LABEL_WORDS = {"other": frozenset(), "trade": frozenset({"bygg", "rør", "maskin", "elektro", "verksted", "mek"}), "food": frozenset({"mat", "fisk", "brød", "kaffe"}), "office": frozenset({"data", "design", "invest", "eiendom"})}


@query("""SELECT label, count(*) AS n, CAST(round(sum(CAST(round(s / (s + other), 6) AS DECIMAL(18,6))), 4) AS DOUBLE) AS confidence FROM (SELECT name, CASE WHEN 0.5 >= greatest(a, b, c) THEN 'other' WHEN a >= greatest(b, c) THEN 'trade' WHEN b >= c THEN 'food' ELSE 'office' END AS label, greatest(0.5, a, b, c) AS s, 0.5 + a + b + c - greatest(0.5, a, b, c) AS other FROM
    (SELECT name, len(list_filter(w, lambda x: x IN ('bygg', 'rør', 'maskin', 'elektro', 'verksted', 'mek'))) AS a, len(list_filter(w, lambda x: x IN ('mat', 'fisk', 'brød', 'kaffe'))) AS b, len(list_filter(w, lambda x: x IN ('data', 'design', 'invest', 'eiendom'))) AS c FROM
    (SELECT name, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT name FROM g4_registry_floor_audit WHERE name IS NOT NULL)))) GROUP BY 1""")
def classified_names(spark, folder):
    """Trades of company names from an injected classifier, counted."""
    names = read_table(spark, folder, "g4_registry_floor_audit").select("name").where("name IS NOT NULL").distinct()
    rows = classify.classified(names, {"name": F.col("name")}, F.col("name"), classify.WordClassifier(_LABEL_WORDS))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(18,6)")), 4).cast("double").alias("confidence"))
