"""Queries that audit, queue and compare: replays, caps, promotions, noise, disagreements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.functions.orgid import numbers_in
from millrace.operators import aggregate, evidence, rank, relate, state
from millrace.plans.textual import numbers_sql
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


@query("""WITH asked AS (SELECT url, count(*) AS n FROM (SELECT website_url AS url FROM recovery UNION ALL SELECT declared_url FROM g4_registry_floor_audit) WHERE url IS NOT NULL GROUP BY 1), landed AS (SELECT declared_url AS url, max(CASE WHEN page_title IS NULL THEN 500 WHEN regexp_matches(page_title, '(?i)not found|404') THEN 404 ELSE 200 END) AS code FROM g4_registry_floor_audit WHERE declared_url IS NOT NULL GROUP BY 1)
    SELECT a.url, a.n, CAST(r.code AS INTEGER) AS code, CASE WHEN r.code IS NULL THEN 'unknown_url' END AS error, CASE WHEN r.code = 200 THEN 'available' WHEN r.code = 404 THEN 'not_found' WHEN r.code = 500 THEN 'source_error' END AS status FROM asked a LEFT JOIN landed r ON a.url = r.url""")
def replay_responses(spark, folder):
    """Requests answered from what an audit landed under each address; others are unknown. The status of a
    landed page is that of its worst delivery."""
    audit = read_table(spark, folder, "g4_registry_floor_audit")
    asked = read_table(spark, folder, "recovery").select(F.col("website_url").alias("url")).unionByName(audit.select(F.col("declared_url").alias("url"))).where("url IS NOT NULL")
    code = F.when(F.col("page_title").isNull(), 500).when(F.col("page_title").rlike("(?i)not found|404"), 404).otherwise(200)
    responses = audit.where("declared_url IS NOT NULL").groupBy(F.col("declared_url").alias("url")).agg(F.max(code).alias("code"))
    out = relate.replayed(asked.groupBy("url").agg(F.count("*").alias("n")), responses, "url", "code")
    return out.withColumn("status", F.when(F.col("code").isNotNull(), readers.statuses(out, "code")))


@query("""SELECT source, count(*) AS n_records, count(DISTINCT organisation_number) AS n_entities, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source""")
def cache_metadata(spark, folder):
    rows = read_table(spark, folder, "documents")
    return rows.groupBy("source").agg(F.count("*").alias("n_records"), F.countDistinct("organisation_number").alias("n_entities"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""SELECT snapshot_date, count(*) AS n, count(*) FILTER (a = 'complete' AND b IN ('complete', 'not_found')) AS complete FROM (SELECT DISTINCT row_id, snapshot_date, latest_envelope ->> '$.modules.registry.state' AS a, latest_envelope ->> '$.modules.group.state' AS b FROM companies) GROUP BY 1""")
def complete_envelopes(spark, folder):
    rows = read_table(spark, folder, "companies").select("row_id", "snapshot_date", "latest_envelope").distinct()
    modules = F.from_json(F.get_json_object("latest_envelope", "$.modules"), "map<string, struct<state: string>>")
    states = F.transform_values(modules, lambda _, v: v["state"])
    complete = evidence.complete_for(states, ("registry",), ("complete",)) & evidence.complete_for(states, ("group",), ("complete", "not_found"))
    return rows.groupBy("snapshot_date").agg(F.count("*").alias("n"), F.count_if(complete).alias("complete"))


_HOST = "nullif(regexp_replace(regexp_extract(lower({}), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '')"


@query(f"""SELECT how, count(*) AS n FROM (SELECT CASE WHEN g IS NULL THEN 'none' WHEN g = truth THEN 'same' WHEN coalesce(list_contains([h, g], truth), false) THEN 'redirect' ELSE 'other' END AS how FROM (SELECT organisation_number, {_HOST.format('declared_url')} AS h, {_HOST.format('final_url')} AS g FROM g4_registry_floor_audit) a
    LEFT JOIN (SELECT organisation_number, min({_HOST.format('website_url')}) AS truth FROM recovery WHERE organisation_number IS NOT NULL GROUP BY 1) t USING (organisation_number)) GROUP BY 1""")
def redirect_chain_match(spark, folder):
    """Final hosts against the hosts another table has for the entity, over the chain of redirects."""
    rows = read_table(spark, folder, "g4_registry_floor_audit").select("organisation_number", urls.host(F.col("declared_url")).alias("h"), urls.host(F.col("final_url")).alias("g"))
    truth = read_table(spark, folder, "recovery").where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min(urls.host(F.col("website_url"))).alias("truth"))
    how = relate.chain_match(F.col("truth"), F.col("g"), F.array("h", "g"))
    return rows.join(truth, "organisation_number", "left").groupBy(how.alias("how")).agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT brief_id, page_ord, coalesce(list_contains(ns, organisation_number), false) AS has_own, CAST(len(list_filter(ns, lambda x: organisation_number IS NULL OR x <> organisation_number)) AS INTEGER) AS others FROM
    (SELECT brief_id, organisation_number, CAST(i - 1 AS INTEGER) AS page_ord, {numbers_sql('pages[i].html')} AS ns FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM briefs) WHERE pages[i].html IS NOT NULL)""")
def page_numbers_vs_own(spark, folder):
    """For each page: whether it has the organisation's own number, and how many others."""
    rows = read_table(spark, folder, "briefs").select("brief_id", "organisation_number", F.posexplode("pages.html").alias("page_ord", "html")).where("html IS NOT NULL")
    found, own = numbers_in(F.col("html")), F.array(F.col("organisation_number"))
    return spread(rows).select("brief_id", "page_ord", F.coalesce(F.arrays_overlap(found, own), F.lit(False)).alias("has_own"), F.size(F.array_except(found, own)).alias("others")).distinct()


@query("""SELECT recovery_id, CAST(i - 1 AS INTEGER) AS item_ord, list_has_any(list_filter(string_split(regexp_extract(lower(u), '^[a-z][a-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> ''), ['jobb', 'stilling', 'karriere']) OR regexp_matches(t, '^(les mer|hjem|meny)') AS noise FROM
    (SELECT DISTINCT recovery_id, i, activity.items[i].url AS u, lower(trim(activity.items[i].title)) AS t FROM (SELECT recovery_id, activity, unnest(range(1, len(activity.items) + 1)) AS i FROM recovery)) WHERE u IS NOT NULL AND t IS NOT NULL""")
def activity_noise(spark, folder):
    """Items that are navigation or job pages, by path segments and by how their titles begin."""
    items = read_table(spark, folder, "recovery").select("recovery_id", F.posexplode("activity.items").alias("item_ord", "x")).where("x.url IS NOT NULL AND x.title IS NOT NULL")
    noise = F.arrays_overlap(urls.path_parts(F.col("x.url")), F.array(F.lit("jobb"), F.lit("stilling"), F.lit("karriere"))) | F.lower(F.trim("x.title")).rlike("^(les mer|hjem|meny)")
    return items.select("recovery_id", "item_ord", F.coalesce(noise, F.lit(False)).alias("noise")).distinct()


@query("""SELECT brief_id, url, CAST(weight AS INTEGER) AS weight FROM (SELECT brief_id, url, weight, row_number() OVER (PARTITION BY brief_id ORDER BY weight, url) AS r FROM (SELECT DISTINCT brief_id, url, least(9, CASE WHEN contains(lower(url), 'om-oss') THEN 1 ELSE 9 END, CASE WHEN contains(lower(url), 'kontakt') THEN 2 ELSE 9 END,
    CASE WHEN contains(lower(url), 'aktuelt') THEN 3 ELSE 9 END) AS weight FROM (SELECT brief_id, unnest(pages).url AS url FROM briefs) WHERE url IS NOT NULL)) WHERE r <= 2""")
def url_priority(spark, folder):
    """The two most promising pages of each brief by the terms in their URLs."""
    pages = read_table(spark, folder, "briefs").select("brief_id", F.explode("pages.url").alias("url")).where("url IS NOT NULL").distinct()
    weighted = pages.withColumn("weight", urls.term_weight(F.col("url"), {"om-oss": 1, "kontakt": 2, "aktuelt": 3}, 9))
    return rank.first_per_group(weighted, ["brief_id"], [F.col("weight"), F.col("url")], 2)


@query("""WITH p AS (SELECT DISTINCT source AS kind, organisation_number AS org, url AS fact, lang FROM documents WHERE source IS NOT NULL AND organisation_number IS NOT NULL AND url IS NOT NULL), f AS (SELECT DISTINCT kind, org, fact FROM p),
    s AS (SELECT run, kind, round(0.7 * CAST(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) + 0.3 * CAST(sum(hits) AS BIGINT) / CAST(sum(facts) AS DOUBLE), 6) AS recall FROM (SELECT run, f.kind, f.org, count(*) AS facts, count(h.fact) AS hits FROM f JOIN (SELECT unnest([1, 2]) AS run) r ON true
    LEFT JOIN (SELECT DISTINCT 1 AS k, kind, org, fact FROM p WHERE lang = 'nb' UNION ALL SELECT DISTINCT 2, kind, org, fact FROM p WHERE lang IN ('nb', 'nn')) h ON h.k = run AND h.kind = f.kind AND h.org = f.org AND h.fact = f.fact GROUP BY 1, 2, 3) GROUP BY 1, 2), d AS (SELECT b.kind, round(b.recall - a.recall, 6) AS delta FROM s a JOIN s b ON a.kind = b.kind AND a.run = 1 AND b.run = 2)
    SELECT count(*) AS kinds, max(delta) AS gain, min(delta) AS loss, max(delta) >= 0.02 AND min(delta) >= -0.01 AS promoted FROM d""")
def promotion_gate(spark, folder):
    """Whether a run over two languages is promoted over a run over one."""
    rows = read_table(spark, folder, "documents").select(F.col("source").alias("kind"), F.col("organisation_number").alias("org"), F.col("url").alias("fact"), "lang")
    scores = lambda found: aggregate.pool_recall(rows, found, "kind", "org", "fact")
    return evidence.promotion(scores(rows.where("lang IN ('nb', 'nn')")), scores(rows.where("lang = 'nb'")), "kind", "recall")


@query("""SELECT doc_id, source, guess, CAST(CASE WHEN guess = 'annual_report' THEN 1 WHEN guess = 'company_site' THEN 2 ELSE 3 END AS INTEGER) AS priority, name FROM (SELECT doc_id, source, organisation_number, CASE WHEN n_chars > 2000 THEN 'annual_report' WHEN n_chars > 900 THEN 'company_site' ELSE 'news_rss' END AS guess FROM documents WHERE source IS NOT NULL) d
    LEFT JOIN (SELECT organisation_number, min(name) AS name FROM briefs WHERE organisation_number IS NOT NULL GROUP BY 1) b USING (organisation_number) WHERE source <> guess""")
def disagreement_sheet(spark, folder):
    """Labels against guesses, with names, in order of a stated priority."""
    guess = F.when(F.col("n_chars") > 2000, "annual_report").when(F.col("n_chars") > 900, "company_site").otherwise("news_rss")
    rows = read_table(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", "source", "organisation_number", guess.alias("guess"))
    names = read_table(spark, folder, "briefs").where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min("name").alias("name"))
    order = F.array(F.lit("annual_report"), F.lit("company_site"), F.lit("news_rss"))
    wrong = rows.where(F.col("source") != F.col("guess")).join(names, "organisation_number", "left")
    return wrong.select("doc_id", "source", "guess", F.array_position(order, F.col("guess")).cast("int").alias("priority"), "name")


@query("""SELECT organisation_number, count(*) AS reasons FROM (SELECT organisation_number FROM g4_registry_floor_audit WHERE page_title IS NULL AND organisation_number IS NOT NULL UNION ALL SELECT organisation_number FROM documents WHERE lang IS NULL AND organisation_number IS NOT NULL) WHERE organisation_number NOT IN
    (SELECT organisation_number FROM briefs WHERE organisation_number IS NOT NULL) GROUP BY 1""")
def review_queue(spark, folder):
    """What two audits found and nobody has labelled yet."""
    a = read_table(spark, folder, "g4_registry_floor_audit").where("page_title IS NULL").select("organisation_number")
    b = read_table(spark, folder, "documents").where("lang IS NULL").select("organisation_number")
    queue = a.unionByName(b).where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.count("*").alias("reasons"))
    return relate.dangling(queue, read_table(spark, folder, "briefs"), "organisation_number")


@query("""SELECT DISTINCT audit_id, list_aggregate([q for q in ['"' || trim(regexp_replace(name, '\\s+', ' ', 'g')) || '"', organisation_number || ' "' || trim(regexp_replace(name, '\\s+', ' ', 'g')) || '"'] if q IS NOT NULL], 'string_agg', ' ; ') AS queries FROM g4_registry_floor_audit WHERE name IS NOT NULL AND trim(name) <> ''""")
def search_query_builder(spark, folder):
    rows = read_table(spark, folder, "g4_registry_floor_audit").where("name IS NOT NULL AND trim(name) != ''")
    return rows.select("audit_id", F.array_join(text.search_queries(F.col("name"), F.lit(None).cast("string"), F.col("organisation_number")), " ; ").alias("queries")).distinct()


@query("""SELECT organisation_number, CASE WHEN n = 1 THEN v END AS value FROM (SELECT s.organisation_number, count(DISTINCT s.source_class) FILTER (pr = best) AS n, min(s.source_class) FILTER (pr = best) AS v FROM (SELECT DISTINCT organisation_number, source_class, CASE source_class WHEN 'company_owned' THEN 1 ELSE 2 END AS pr FROM sentiment_inference_smoke WHERE source_class IS NOT NULL AND organisation_number IS NOT NULL) s
    JOIN (SELECT organisation_number, min(CASE source_class WHEN 'company_owned' THEN 1 ELSE 2 END) AS best FROM sentiment_inference_smoke WHERE source_class IS NOT NULL AND organisation_number IS NOT NULL GROUP BY 1) b USING (organisation_number) GROUP BY 1)""")
def sole_value_or_abstain(spark, folder):
    """The one value of the best priority of each entity; disagreement gives none."""
    rows = read_table(spark, folder, "sentiment_inference_smoke").where("source_class IS NOT NULL AND organisation_number IS NOT NULL").select("organisation_number", "source_class").distinct()
    lists = rows.groupBy("organisation_number").agg(F.collect_list("source_class").alias("v"))  # at most one of each class
    priorities = F.transform("v", lambda c: F.when(c == "company_owned", 1).otherwise(2))
    return lists.withColumn("p", priorities).select("organisation_number", evidence.sole_value(F.col("v"), F.col("p")).alias("value"))


@query("""WITH p AS (SELECT organisation_number AS o, min(name) AS name, min(website_url) AS url FROM recovery WHERE organisation_number IS NOT NULL GROUP BY 1), e AS (SELECT organisation_number AS o, arg_max(page_title, (audit_id, page_title)) FILTER (page_title IS NOT NULL) AS name, arg_max(final_url, (audit_id, final_url)) FILTER (final_url IS NOT NULL) AS url, count(*) AS n
    FROM (SELECT DISTINCT * FROM g4_registry_floor_audit) WHERE organisation_number IS NOT NULL GROUP BY 1) SELECT coalesce(p.o, e.o) AS organisation_number, coalesce(e.name, p.name) AS name, coalesce(e.url, p.url) AS url, coalesce(e.n, 0) AS n_events FROM p FULL JOIN e ON p.o = e.o""")
def crawl_event_merge(spark, folder):
    """Profiles with the latest title and address that crawl events brought; nulls take nothing away."""
    profiles = read_table(spark, folder, "recovery").where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min("name").alias("name"), F.min("website_url").alias("url"))
    events = read_table(spark, folder, "g4_registry_floor_audit").distinct().select("organisation_number", "audit_id", F.col("page_title").alias("name"), F.col("final_url").alias("url"))
    return state.merged_fields(profiles, events, "organisation_number", "audit_id", ["name", "url"])


@query("""WITH c AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT e.user_id, count(*) AS n_new, max(e.ts) AS cursor FROM events e LEFT JOIN c USING (user_id) WHERE e.ts IS NOT NULL AND (mark IS NULL OR e.ts > mark) GROUP BY 1""")
def cursor_resume(spark, folder):
    """A feed resumed from each user's cursor: what is new, and where the cursor stands then."""
    rows = read_table(spark, folder, "events").select("user_id", "ts")
    cursor = rows.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.max("ts").alias("ts"))
    new = state.after_cursor(rows, cursor, "user_id", "ts")
    counts = new.groupBy("user_id").agg(F.count("*").alias("n_new"))
    return counts.join(state.advanced(cursor, new, "user_id", "ts"), "user_id").withColumnRenamed("ts", "cursor")
