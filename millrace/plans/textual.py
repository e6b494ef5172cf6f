"""Queries over names, texts, URLs, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, jsonx, markup, orgid, text, urls
from millrace.operators import cascade, evidence, identity
from millrace.session import spread
from millrace.sources import readers
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


def fold_sql(x: str) -> str:
    return f"regexp_replace(strip_accents(replace(replace(replace(lower({x}), 'ø', 'o'), 'å', 'a'), 'æ', 'ae')), '[^\\x00-\\x7F]', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({fold_sql(x)}, '[a-z0-9]+'), lambda t: replace(replace(t, 'aa', 'a'), 'oe', 'o'))"


_GENERIC = "[" + ", ".join(f"'{w}'" for w in text.GENERIC_NAME_WORDS) + "]"


def identity_sql(x: str) -> str:
    return f"list_filter({tokens_sql(x)}, lambda t: length(t) > 1 AND NOT list_contains({_GENERIC}, t))"


@query(f"SELECT DISTINCT name, array_to_string({tokens_sql('name')}, ' ') AS tokens FROM entry_companies WHERE name IS NOT NULL")
def ascii_fold_tokens(spark, folder):
    names = read_table(spark, folder, "entry_companies").select("name").where("name IS NOT NULL").distinct()
    return names.select("name", F.array_join(text.fold_tokens(F.col("name")), " ").alias("tokens"))


_NINE = "regexp_replace(organisation_number, '[^0-9]', '', 'g')"
_SUM = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(orgid.WEIGHTS))


@query(f"""SELECT organisation_number, d AS digits, length(d) = 9 AND coalesce(CASE WHEN length(d) = 9 THEN CASE WHEN ({_SUM}) % 11 = 0 THEN 0 ELSE 11 - ({_SUM}) % 11 END <> 10 AND
    CASE WHEN ({_SUM}) % 11 = 0 THEN 0 ELSE 11 - ({_SUM}) % 11 END = CAST(substr(d, 9, 1) AS INT) END, false) AS valid FROM (SELECT DISTINCT organisation_number, {_NINE} AS d FROM entry_companies WHERE organisation_number IS NOT NULL)""")
def orgnr_checksum(spark, folder):
    numbers = read_table(spark, folder, "entry_companies").select("organisation_number").where("organisation_number IS NOT NULL").distinct()
    value = F.col("organisation_number")
    return numbers.select(value, orgid.digits_only(value).alias("digits"), orgid.has_valid_check_digit(value).alias("valid"))


def numbers_sql(x: str) -> str:
    """Numbers with a valid check digit in a text, as ``orgid.numbers_in`` finds them in pages."""
    found = f"list_transform(regexp_extract_all(' ' || regexp_replace(coalesce({x}, ''), '([0-9])([^0-9])', '\\1\\2\\2', 'g') || ' ', '[^0-9]([0-9]{{3}}[ .\u00a0]?[0-9]{{3}}[ .\u00a0]?[0-9]{{3}})[^0-9]', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    total = " + ".join(f"CAST(substr(m, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(orgid.WEIGHTS))
    valid = f"CASE WHEN ({total}) % 11 = 0 THEN 0 ELSE 11 - ({total}) % 11 END = CAST(substr(m, 9, 1) AS INT)"
    return f"list_distinct(list_filter({found}, lambda m: {valid}))"


@query(f"SELECT brief_id, page_ord, unnest(ns) AS organisation_number FROM (SELECT DISTINCT brief_id, CAST(i - 1 AS INTEGER) AS page_ord, {numbers_sql('pages[i].html')} AS ns FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM briefs) WHERE pages[i].html IS NOT NULL)")
def orgnr_extract(spark, folder):
    """Numbers with a valid check digit in the pages of briefs, by page."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.posexplode("pages.html").alias("page_ord", "html")).where("html IS NOT NULL")
    return spread(pages).select("brief_id", "page_ord", F.explode(orgid.numbers_in(F.col("html"))).alias("organisation_number")).distinct()


_HOMEPAGE = r"""CASE WHEN contains(trim(u), '.') AND NOT regexp_matches(trim(u), '\s') THEN CASE WHEN regexp_matches(trim(u), '(?i)^[a-z][a-z0-9+.\-]*://') THEN trim(u) ELSE 'https://' || regexp_replace(trim(u), '^/+', '') END END"""


@query(rf"""SELECT url, host, CASE WHEN host IS NOT NULL THEN host || regexp_replace(regexp_extract(lower(h), '^[a-z][a-z0-9+.\-]*://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN regexp_extract(lower(h), '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(lower(h), '\?([^#]*)', 1) ELSE '' END END AS key,
    CASE WHEN host IS NOT NULL THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain FROM (SELECT u AS url, h, nullif(regexp_replace(regexp_extract(lower(h), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '') AS host
    FROM (SELECT u, {_HOMEPAGE} AS h FROM (SELECT website_url AS u FROM recovery UNION SELECT declared_url FROM g4_registry_floor_audit UNION SELECT final_url FROM g4_registry_floor_audit UNION SELECT website FROM entry_companies UNION SELECT url FROM documents) WHERE u IS NOT NULL))""")
def url_keys(spark, folder):
    parts = [read_table(spark, folder, t).select(F.col(c).alias("url")) for t, c in (("recovery", "website_url"), ("g4_registry_floor_audit", "declared_url"), ("g4_registry_floor_audit", "final_url"), ("entry_companies", "website"), ("documents", "url"))]
    u = F.col("url")
    distinct = readers.union_of(parts).where("url IS NOT NULL").distinct()
    return distinct.select(u, urls.host(u).alias("host"), urls.url_key(u).alias("key"), urls.registered_domain(u).alias("domain"))


@query("""SELECT count(*) AS n, count(*) FILTER (h = 'news.example' OR ends_with(h, '.news.example') OR h = 'havlia-tindvik.example' OR ends_with(h, '.havlia-tindvik.example')) AS blocked FROM
    (SELECT regexp_replace(regexp_extract(lower(final_url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS h FROM g4_registry_floor_audit)""")
def blocked_hosts(spark, folder):
    name = urls.host(F.col("final_url"))
    return read_table(spark, folder, "g4_registry_floor_audit").agg(F.count("*").alias("n"), F.count_if(urls.under_any(name, ["news.example", "havlia-tindvik.example"])).alias("blocked"))


@query(f"""SELECT name, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ' ') AS slugs FROM (SELECT name, list_filter([array_to_string(t, ''), array_to_string(t, '-'), CASE WHEN len(t) > 0 THEN array_to_string(t, '') || 'as' END, t[1]], lambda x: x IS NOT NULL) AS l
    FROM (SELECT name, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM (SELECT DISTINCT name, {identity_sql('name')} AS t FROM entry_companies WHERE name IS NOT NULL)))""")
def name_slugs(spark, folder):
    """Domain labels of every company name."""
    names = read_table(spark, folder, "entry_companies").select("name").where("name IS NOT NULL").distinct()
    return names.select("name", F.array_join(text.name_slugs(F.col("name")), " ").alias("slugs"))


@query(f"SELECT DISTINCT industry_label, array_to_string(list_sort(list_distinct(list_transform({tokens_sql('industry_label')}, lambda t: regexp_replace(t, '^(.{{3,}}?)(heten|heter|ende|ane|ene|er|en|et|a|e|s)$', '\\1')))), ' ') AS stems FROM entry_companies WHERE industry_label IS NOT NULL")
def stem_tokens(spark, folder):
    labels = read_table(spark, folder, "entry_companies").select("industry_label").where("industry_label IS NOT NULL").distinct()
    return labels.select("industry_label", F.array_join(text.stem_tokens(F.col("industry_label")), " ").alias("stems"))


_SQ = "trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"""SELECT source_class, count(*) AS n, count(*) FILTER (coalesce({_SQ.format('evidence_span')} <> '' AND contains({_SQ.format('text')}, {_SQ.format('evidence_span')}), false)) AS verbatim FROM sentiment_inference_smoke GROUP BY 1""")
def verbatim_span(spark, folder):
    rows = read_table(spark, folder, "sentiment_inference_smoke")
    return rows.groupBy("source_class").agg(F.count("*").alias("n"), F.count_if(text.holds_span(F.col("text"), F.col("evidence_span"))).alias("verbatim"))


@query(f"""SELECT doc_id, substr(coalesce(nullif(regexp_extract({_SQ.format('text')}, '^[^.!?]*[.!?]'), ''), {_SQ.format('text')}), 1, 300) AS sentence FROM documents WHERE text IS NOT NULL""")
def first_sentences(spark, folder):
    return read_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query(f"""SELECT audit_id, overlap, contains_run FROM (SELECT audit_id, CASE WHEN len(a) > 0 THEN CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS DOUBLE) / len(a) END AS overlap,
    len(c) > 0 AND contains(' ' || array_to_string(d, ' ') || ' ', ' ' || array_to_string(c, ' ') || ' ') AS contains_run FROM (SELECT audit_id, list_distinct({identity_sql('name')}) AS a, list_distinct({identity_sql('page_title')}) AS b, {tokens_sql('name')} AS c, {tokens_sql('page_title')} AS d
    FROM (SELECT DISTINCT audit_id, name, page_title FROM g4_registry_floor_audit WHERE name IS NOT NULL AND page_title IS NOT NULL)))""")
def title_matches_name(spark, folder):
    """How much of a company's name its page title has, and whether the whole name runs through it."""
    rows = read_table(spark, folder, "g4_registry_floor_audit").select("audit_id", "name", "page_title").where("name IS NOT NULL AND page_title IS NOT NULL").distinct()
    overlap = text.token_overlap(text.identity_tokens(F.col("name")), text.identity_tokens(F.col("page_title")))
    return rows.select("audit_id", overlap.alias("overlap"), text.holds_token_run(text.fold_tokens(F.col("page_title")), text.fold_tokens(F.col("name"))).alias("contains_run"))


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'future' WHEN d <= 45 THEN 'fresh' WHEN d <= 365 THEN 'recent' WHEN d <= 730 THEN 'aging' ELSE 'old' END AS band
    FROM (SELECT date_diff('day', CAST(published_at AS DATE), DATE '2026-09-01') AS d FROM documents)) GROUP BY 1""")
def age_flags(spark, folder):
    band = dates.age_band(F.col("published_at").cast("date"), F.lit("2026-09-01").cast("date"))
    return read_table(spark, folder, "documents").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


_MONTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in dates.MONTHS.items()) + "}"


@query(rf"""SELECT DISTINCT value, coalesce(strftime(CAST(try_strptime(nullif(regexp_extract(t, '^(\d{{4}}-\d{{2}}-\d{{2}})(?:[T ].*)?$', 1), ''), '%Y-%m-%d') AS DATE), '%Y-%m-%d'), strftime(CAST(try_strptime(nullif(regexp_extract(t, '^(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})$', 1), ''), '%d.%m.%Y') AS DATE), '%Y-%m-%d'),
    strftime(CAST(try_strptime(nullif(regexp_extract(t, '(?i)^(?:[a-z]{{3}}, )?(\d{{1,2}})\.? ([a-zæøå]+)\.? (\d{{4}})\b', 3), '') || '-' || {_MONTHS}[lower(regexp_extract(t, '(?i)^(?:[a-z]{{3}}, )?(\d{{1,2}})\.? ([a-zæøå]+)\.? (\d{{4}})\b', 2))] || '-' ||
    regexp_extract(t, '(?i)^(?:[a-z]{{3}}, )?(\d{{1,2}})\.? ([a-zæøå]+)\.? (\d{{4}})\b', 1), '%Y-%m-%d') AS DATE), '%Y-%m-%d')) AS day FROM (SELECT value, trim(value) AS t FROM (SELECT i.date AS value FROM (SELECT unnest(activity.items) AS i FROM recovery)) WHERE value IS NOT NULL)""")
def date_parse_ladder(spark, folder):
    values = read_table(spark, folder, "recovery").select(F.explode("activity.items.date").alias("value")).where("value IS NOT NULL").distinct()
    return values.select("value", F.date_format(dates.date_ladder(F.col("value")), "yyyy-MM-dd").alias("day"))


_KIND = """CASE json_type(latest_envelope, '{0}') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE CASE WHEN json_type(latest_envelope, '{0}') IS NULL THEN 'missing' ELSE 'number' END END"""


@query(f"SELECT row_id, {_KIND.format('$.profile.employees')} AS employees, {_KIND.format('$.claims')} AS claims, {_KIND.format('$.profile.evidence.website.value.pages')} AS pages, {_KIND.format('$.profile.bankrupt')} AS bankrupt FROM (SELECT DISTINCT row_id, latest_envelope FROM companies)")
def json_path_kinds(spark, folder):
    rows = read_table(spark, folder, "companies").select("row_id", "latest_envelope").distinct()
    kind = lambda p: jsonx.json_kind(F.col("latest_envelope"), p)
    return rows.select("row_id", kind("$.profile.employees").alias("employees"), kind("$.claims").alias("claims"), kind("$.profile.evidence.website.value.pages").alias("pages"), kind("$.profile.bankrupt").alias("bankrupt"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1""")
def json_counter_merge(spark, folder):
    k = jsonx.json_read(F.col("props"), "$.k", "bigint")
    return read_table(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


@query("""SELECT organisation_number, string_agg(DISTINCT source_class, ',' ORDER BY source_class) AS classes FROM sentiment_inference_smoke WHERE organisation_number IS NOT NULL GROUP BY 1""")
def sorted_set_normalise(spark, folder):
    rows = read_table(spark, folder, "sentiment_inference_smoke").where("organisation_number IS NOT NULL").select("organisation_number", "source_class").distinct()
    joined = F.array_join(F.array_sort(F.collect_set("source_class")), ",")
    return rows.groupBy("organisation_number").agg(F.when(F.count("source_class") > 0, joined).alias("classes"))


# ---------------------------------------------------------------- evidence and cascades
@query("""WITH e AS (SELECT regexp_replace(organisation_number, '[^0-9]', '', 'g') AS org, source_class AS field, source_url AS url, id, row_number() OVER (PARTITION BY organisation_number, source_class, source_url ORDER BY sha256('evidence|' || id), id) - 1 AS i FROM (SELECT DISTINCT * FROM sentiment_inference_smoke))
    SELECT id, 'ev-' || substr(sha256(coalesce(org, '') || '|' || coalesce(field, '') || '|' || coalesce(url, '') || '|' || id || '|' || CAST(i AS VARCHAR)), 1, 16) AS evidence_id FROM e""")
def evidence_ids(spark, folder):
    rows = read_table(spark, folder, "sentiment_inference_smoke").distinct()
    return evidence.with_ids(rows, "organisation_number", "source_class", "source_url", "id").select("id", "evidence_id")


@query("""SELECT availability, count(*) AS n FROM (SELECT CASE WHEN s = 'available' AND v IN ('', 'null', '[]', '{}') THEN 'not_available' WHEN s = 'available' THEN 'available' WHEN s IN ('not_found', 'not_available') THEN 'not_available' WHEN s = 'blocked' THEN 'blocked' WHEN s IN ('failed', 'source_error') THEN 'failed'
    WHEN s = 'not_applicable' THEN 'not_applicable' WHEN s = 'ambiguous' THEN 'ambiguous' ELSE 'not_checked' END AS availability FROM (SELECT json_extract_string(latest_envelope, '$.profile.evidence.roles.status') AS s, coalesce(CAST(json_extract(latest_envelope, '$.profile.evidence.roles.value') AS VARCHAR), 'null') AS v FROM (SELECT DISTINCT row_id, latest_envelope FROM companies))) GROUP BY 1""")
def availability_counts(spark, folder):
    rows = read_table(spark, folder, "companies").select("row_id", "latest_envelope").distinct()
    document = F.try_parse_json("latest_envelope")
    status = F.try_variant_get(document, "$.profile.evidence.roles.status", "string")
    value = F.coalesce(F.to_json(F.try_variant_get(document, "$.profile.evidence.roles.value", "variant")), F.lit("null"))
    return rows.groupBy(evidence.availability(status, value).alias("availability")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT row_id, latest_envelope FROM companies), m AS (SELECT row_id, unnest(json_keys(latest_envelope, '$.modules')) AS module, latest_envelope FROM r)
    SELECT module, json_extract_string(latest_envelope, '$.modules.' || module || '.state') AS state, count(*) AS n FROM m GROUP BY 1, 2""")
def module_states(spark, folder):
    """State of every module of every envelope, unpivoted from a map."""
    rows = read_table(spark, folder, "companies").select("row_id", "latest_envelope").distinct()
    modules = F.from_json(F.get_json_object("latest_envelope", "$.modules"), "map<string, struct<state: string>>")
    flat = rows.select(F.explode(modules).alias("module", "v"))
    return flat.groupBy("module", F.col("v.state").alias("state")).agg(F.count("*").alias("n"))


@query(f"""SELECT audit_id, CASE WHEN t IS NULL THEN 'missing' WHEN n_tokens = 0 THEN 'no_name' WHEN shared = n_tokens AND n_tokens >= 2 THEN 'exact' WHEN shared = n_tokens THEN 'single' WHEN 4 * shared >= 3 * n_tokens AND shared >= 2 THEN 'likely' WHEN 2 * shared >= n_tokens THEN 'review' ELSE 'weak' END AS rule,
    CAST(CASE WHEN t IS NULL OR n_tokens = 0 THEN 0.0 WHEN shared = n_tokens AND n_tokens >= 2 THEN 0.95 WHEN shared = n_tokens THEN 0.9 WHEN 4 * shared >= 3 * n_tokens AND shared >= 2 THEN 0.85 WHEN 2 * shared >= n_tokens THEN 0.65 ELSE 0.3 END AS DOUBLE) AS score FROM
    (SELECT audit_id, page_title AS t, len(a) AS n_tokens, len(list_filter(a, lambda x: list_contains({tokens_sql("coalesce(page_title, '')")}, x))) AS shared FROM (SELECT DISTINCT audit_id, page_title, list_distinct({identity_sql('name')}) AS a FROM g4_registry_floor_audit))""")
def identity_cascade(spark, folder):
    """Ordered rules over shared name tokens: the first that holds gives rule and score."""
    rows = read_table(spark, folder, "g4_registry_floor_audit").select("audit_id", "page_title", text.identity_tokens(F.col("name")).alias("a")).distinct()
    rows = rows.withColumn("shared", F.size(F.array_intersect("a", text.fold_tokens(F.col("page_title"))))).withColumn("n", F.size("a"))
    n, shared = F.col("n"), F.col("shared")
    rules = [
        ("missing", F.col("page_title").isNull(), 0.0), ("no_name", n == 0, 0.0), ("exact", (shared == n) & (n >= 2), 0.95), ("single", shared == n, 0.9),
        ("likely", (4 * shared >= 3 * n) & (shared >= 2), 0.85), ("review", 2 * shared >= n, 0.65),
    ]
    return rows.select("audit_id", *cascade.first_rule(rules, "weak", 0.3))


_LEGAL = "[" + ", ".join(f"'{w}'" for w in identity.LEGAL_WORDS) + "]"


def core_sql(x: str, distinct: str = "list_distinct") -> str:
    """As ``identity.core_tokens``; without ``distinct`` repeats stay, in order."""
    return f"{distinct}(list_filter({tokens_sql(f'coalesce({x}, {chr(39) * 2})')}, lambda t: length(t) > 1 AND NOT list_contains({_LEGAL}, t)))"


_FOREIGN = " OR ".join(f"(NOT list_contains(core, '{w}') AND contains(folded, '{w}'))" for w in identity.GROUP_WORDS)
_PARKED = " OR ".join(f"contains(folded, '{w}')" for w in identity.PARKED)
_HOST_OF = "nullif(regexp_replace(regexp_extract(lower({}), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '')"


@query(f"""WITH p AS (SELECT DISTINCT brief_id, name, organisation_number, pages[1].url AS url, pages[1].html AS html FROM briefs WHERE pages[1].html IS NOT NULL),
    b AS (SELECT brief_id, name, regexp_replace(coalesce(organisation_number, ''), '[^0-9]', '', 'g') AS own, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, {_HOST_OF.format('url')} AS host, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS content, url IS NOT NULL AS registered FROM p),
    e AS (SELECT *, concat_ws(' ', title, host) AS home, concat_ws(' ', title, host, content) AS everything FROM b),
    s AS (SELECT * EXCLUDE (core), list_filter(core, lambda x, i: list_position(core, x) = i) AS core FROM (SELECT *, {core_sql('name', '')} AS core, {core_sql('everything')} AS words, {core_sql('title')} AS titled, {core_sql('title')} AS part1, {core_sql('host')} AS part2, {numbers_sql("home || ' ' || content")} AS at_home, {numbers_sql('everything')} AS numbers, {fold_sql('everything')} AS folded FROM e)),
    f AS (SELECT *, len(core) AS n, len(list_filter(core, lambda t: list_contains(words, t))) AS shared, own <> '' AND list_contains(at_home, own) AS has_own, list_filter(at_home, lambda x: x <> own) AS others, list_filter(numbers, lambda x: x <> own) AS contradicting,
    len(core) > 0 AND ((title IS NOT NULL AND len(list_filter(core, lambda t: NOT list_contains(part1, t))) = 0) OR (host IS NOT NULL AND len(list_filter(core, lambda t: NOT list_contains(part2, t))) = 0)) AS whole FROM s),
    r AS (SELECT brief_id, CASE WHEN n > 0 AND len(list_filter(titled, lambda t: length(t) > 3 AND NOT list_contains(core, t))) > 0 AND len(list_filter(titled, lambda t: list_contains(core, t) OR contains(t, array_to_string(core, '')))) = 0 AND ({_FOREIGN}) THEN 'group_or_brand' WHEN {_PARKED} THEN 'parked'
    WHEN has_own AND len(others) >= 3 THEN 'directory_with_own_number' WHEN len(contradicting) > 0 THEN 'contradicting_number' WHEN has_own THEN 'own_number' WHEN n >= 2 AND whole THEN 'whole_name' WHEN n = 1 AND whole AND length(content) >= 100 THEN 'single_name_with_content'
    WHEN n = 1 AND whole AND registered AND len(others) = 0 THEN 'single_name_as_registered' WHEN 4 * shared >= 3 * n AND shared >= 2 THEN 'most_of_name' WHEN 2 * shared >= n AND shared >= 2 THEN 'half_of_name' ELSE 'weak' END AS rule FROM f)
    SELECT brief_id, rule, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'exact' WHEN score >= 0.8 THEN 'review' ELSE 'related_or_uncertain' END AS status FROM
    (SELECT *, CASE rule {" ".join(f"WHEN '{name}' THEN {value}" for name, value in identity.RULES)} ELSE 0.3 END AS score FROM r)""")
def website_identity(spark, folder):
    """Whether the first page of each brief is the organisation's own: rule, score and status."""
    first = F.try_element_at("pages", F.lit(1))
    rows = read_table(spark, folder, "briefs").select("brief_id", "name", "organisation_number", first["url"].alias("url"), first["html"].alias("html")).where("html IS NOT NULL")
    title, name_of_host = F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")), urls.host(F.col("url"))
    rows = spread(rows).select("brief_id", "name", "organisation_number", title.alias("title"), name_of_host.alias("host"), text.squeezed(F.regexp_replace("html", "<[^>]*>", " ")).alias("content"), F.col("url").isNotNull().alias("registered"))
    return identity.assess(rows, ["brief_id"], F.col("name"), F.col("organisation_number"), F.array("title", "host"), F.array("content"), F.col("title"), F.col("content"), F.lit(None).cast("array<string>"), F.col("registered")).distinct()


@query(f"""WITH q AS (SELECT DISTINCT audit_id, organisation_number, name, final_url, page_title, rule_evidence FROM g4_registry_floor_audit), m AS (SELECT organisation_number, min(municipality) AS municipality FROM companies WHERE organisation_number IS NOT NULL GROUP BY 1),
    t AS (SELECT * EXCLUDE (a), list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM (SELECT audit_id, {identity_sql('name')} AS a, {tokens_sql("coalesce(page_title, '')")} AS t, {tokens_sql("coalesce(rule_evidence, '')")} AS e, {tokens_sql("coalesce(" + _HOST_OF.format('final_url') + ", '')")} AS h, list_distinct({identity_sql("coalesce(municipality, '')")}) AS m,
    coalesce(list_contains({numbers_sql("concat_ws(' ', page_title, rule_evidence)")}, organisation_number), false) AS own FROM q LEFT JOIN m USING (organisation_number)))
    SELECT audit_id, CAST(round(least(1.0, CASE WHEN own THEN 0.75 ELSE 0 END + CASE WHEN len(a) > 0 AND len(list_filter(a, lambda x: list_contains(t, x))) = len(a) THEN 0.45 WHEN len(a) > 0 AND len(list_filter(a, lambda x: list_contains(list_concat(t, list_concat(e, h)), x))) = len(a) THEN 0.25 ELSE 0 END
    + CASE WHEN len(a) > 0 AND contains(array_to_string(h, ''), array_to_string(a, '')) THEN 0.3 ELSE 0 END + CASE WHEN len(m) > 0 AND len(list_filter(m, lambda x: list_contains(e, x))) = len(m) THEN 0.1 ELSE 0 END), 4) AS DOUBLE) AS score FROM t""")
def candidate_score(spark, folder):
    """Additive score of a candidate page by number, name, host and municipality, capped at one."""
    rows = read_table(spark, folder, "g4_registry_floor_audit").select("audit_id", "organisation_number", "name", "final_url", "page_title", "rule_evidence").distinct()
    places = read_table(spark, folder, "companies").where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min("municipality").alias("municipality"))
    rows = rows.join(places, "organisation_number", "left")
    names, title, proof, host = text.identity_tokens(F.col("name")), text.fold_tokens(F.col("page_title")), text.fold_tokens(F.col("rule_evidence")), text.fold_tokens(urls.host(F.col("final_url")))
    place = text.identity_tokens(F.col("municipality"))
    whole = lambda tokens, have: (F.size(tokens) > 0) & (F.size(F.array_except(tokens, have)) == 0)
    own = F.coalesce(F.array_contains(orgid.numbers_in(F.concat_ws(" ", "page_title", "rule_evidence")), F.col("organisation_number")), F.lit(False))
    in_host = (F.size(names) > 0) & F.contains(F.array_join(host, ""), F.array_join(names, ""))
    parts = [F.when(own, 0.75), F.when(whole(names, title), 0.45).when(whole(names, F.concat(title, proof, host)), 0.25), F.when(in_host, 0.3), F.when(whole(place, proof), 0.1)]
    return rows.select("audit_id", F.round(cascade.additive_score(parts), 4).alias("score"))


@query("""SELECT audit_id, rule FROM (SELECT audit_id, unnest(list_filter([CASE WHEN NOT coalesce(page_title <> '', false) THEN 'title' END, CASE WHEN NOT coalesce(declared_url <> '', false) THEN 'declared_url' END, CASE WHEN NOT coalesce(contains(rule_evidence, name), false) THEN 'name_in_evidence' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT DISTINCT * FROM g4_registry_floor_audit))""")
def violations_report(spark, folder):
    rows = read_table(spark, folder, "g4_registry_floor_audit").distinct()
    rules = [("title", F.col("page_title") != ""), ("declared_url", F.col("declared_url") != ""), ("name_in_evidence", F.contains(F.col("rule_evidence"), F.col("name")))]
    return evidence.violations(rows, "audit_id", rules)


@query("""SELECT row_id, CAST(CASE WHEN name <> '' THEN 5 ELSE 0 END + CASE WHEN legal_name <> '' THEN 10 ELSE 0 END + CASE WHEN municipality <> '' THEN 5 ELSE 0 END + CASE WHEN latest_envelope <> '' THEN 20.5 ELSE 0 END AS DOUBLE) AS score FROM (SELECT DISTINCT * FROM companies)""")
def completeness_score(spark, folder):
    rows = read_table(spark, folder, "companies").distinct()
    return evidence.completeness(rows, "row_id", {"name": 5.0, "legal_name": 10.0, "municipality": 5.0, "latest_envelope": 20.5})


@query("""SELECT recovery_id, field, value FROM (SELECT recovery_id, unnest([{'field': 'name', 'value': name}, {'field': 'website_url', 'value': website_url}, {'field': 'activity_status', 'value': activity.status}, {'field': 'summary', 'value': brief.summary}], recursive := true) FROM (SELECT DISTINCT * FROM recovery)) WHERE value <> ''""")
def claims_build(spark, folder):
    rows = read_table(spark, folder, "recovery").select("recovery_id", "name", "website_url", F.col("activity.status").alias("activity_status"), F.col("brief.summary").alias("summary")).distinct()
    return evidence.claims_long(rows, "recovery_id", ("name", "website_url", "activity_status", "summary"))


@query("""SELECT recovery_id, array_to_string(list_filter([CASE WHEN NOT coalesce(activity.status = 'available', false) THEN 'no_activity' END, CASE WHEN NOT coalesce(len(brief.parts) > 0, false) THEN 'no_brief' END, CASE WHEN NOT coalesce(hiring.checked, false) THEN 'hiring_unchecked' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT DISTINCT * FROM recovery)""")
def gap_reasons(spark, folder):
    rows = read_table(spark, folder, "recovery").select("recovery_id", "activity.status", F.size("brief.parts").alias("parts"), "hiring.checked").distinct()
    tests = [("no_activity", F.col("status") == "available"), ("no_brief", F.col("parts") > 0), ("hiring_unchecked", F.col("checked"))]
    return rows.select("recovery_id", F.array_join(cascade.gap_reasons(tests), ",").alias("reasons"))


@query(r"""SELECT recovery_id, count(*) AS kept, count(*) FILTER (n > 1) AS agreed FROM (SELECT recovery_id, t, count(*) AS n FROM (SELECT recovery_id, trim(regexp_replace(lower(x.title), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM
    (SELECT recovery_id, unnest(list_concat(coalesce(hiring.postings, []), coalesce(hiring.company_site_postings, []), coalesce(hiring.nav_ads, []))) AS x FROM (SELECT DISTINCT recovery_id, hiring FROM recovery)) WHERE x.title <> '') GROUP BY 1, 2) GROUP BY 1""")
def posting_merge(spark, folder):
    """Postings of three lists merged by normalised title; a title that several lists have is agreed."""
    rows = read_table(spark, folder, "recovery").select("recovery_id", "hiring").distinct()
    lists = F.concat(*[F.coalesce(F.col(f"hiring.{c}"), F.array()) for c in ("postings", "company_site_postings", "nav_ads")])
    titles = rows.select("recovery_id", F.explode(lists).alias("x")).where("x.title != ''").select("recovery_id", F.trim(F.regexp_replace(F.lower("x.title"), r"[^\p{L}\p{N}]+", " ")).alias("t"))
    per = titles.groupBy("recovery_id", "t").agg(F.count("*").alias("n"))
    return per.groupBy("recovery_id").agg(F.count("*").alias("kept"), F.count_if(F.col("n") > 1).alias("agreed"))


_TITLE = "replace(replace(replace(regexp_extract(h, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(rf"""SELECT brief_id, CAST(i - 1 AS INTEGER) AS page_ord, nullif(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')), '') AS title, nullif(regexp_extract(h, '<meta name="description" content="([^"]*)"', 1), '') AS description, len(regexp_extract_all(h, '<a ')) AS n_links FROM
    (SELECT DISTINCT brief_id, i, pages[i].html AS h FROM (SELECT brief_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM briefs)) WHERE h IS NOT NULL""")
def html_metadata(spark, folder):
    """Title, description and number of links of each page, from one pass of a streaming parser."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.posexplode("pages.html").alias("page_ord", "html")).where("html IS NOT NULL")
    facts = markup.page_facts(pages, {"brief_id": F.col("brief_id"), "page_ord": F.col("page_ord")}, F.col("html"))
    return facts.select("brief_id", "page_ord", "title", "description", F.size("links").cast("bigint").alias("n_links")).distinct()


@query(r"""SELECT DISTINCT brief_id, page_ord, url, CASE WHEN url IS NULL THEN h ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END AS link, url IS NOT NULL AS internal FROM (SELECT brief_id, CAST(i - 1 AS INTEGER) AS page_ord, p.url AS url,
    unnest(regexp_extract_all(regexp_replace(p.html, '(?s)<!--.*?-->', '', 'g'), '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS h FROM (SELECT brief_id, i, pages[i] AS p FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM briefs)))""")
def html_links(spark, folder):
    """Links of every page, resolved against its URL, with whether they stay on its host."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.posexplode("pages").alias("page_ord", "p")).where("p.html IS NOT NULL").select("brief_id", "page_ord", "p.url", "p.html")
    facts = markup.page_facts(pages, {"brief_id": F.col("brief_id"), "page_ord": F.col("page_ord"), "url": F.col("url")}, F.col("html"), F.col("url"))
    links = facts.select("brief_id", "page_ord", "url", F.explode("links").alias("link")).distinct()
    return links.withColumn("internal", F.coalesce(urls.host(F.col("link")) == urls.host(F.col("url")), F.lit(False)))


@query(r"""SELECT snippet_id, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.url') AS url FROM (SELECT DISTINCT snippet_id, unnest(regexp_extract_all(html, '(?s)<script type=[''"]application/ld\+json[''"]>(.*?)</script>', 1)) AS j FROM (SELECT DISTINCT snippet_id, html FROM snippets)) WHERE json_valid(j) AND json_extract_string(j, '$."@type"') = 'Organization'""")
def jsonld_organisations(spark, folder):
    """Organisations that pages describe in JSON-LD."""
    pages = read_table(spark, folder, "snippets").select("snippet_id", "html").where("html IS NOT NULL")
    facts = markup.page_facts(pages, {"snippet_id": F.col("snippet_id")}, F.col("html"))
    return facts.select("snippet_id", F.explode("organisations").alias("o")).select("snippet_id", "o.name", "o.url").distinct()
