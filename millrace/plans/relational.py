"""Queries over the star-schema and registry tables: screens, counters, ranks, joins, samples, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.orgid import nine_digits
from millrace.operators import aggregate, fielddiff, rank, relate, sets, state
from millrace.plans import screen as screens
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


# ---------------------------------------------------------------- screens and serving lists
def company_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as companies: nation as municipality, segment as legal form, orders as accounts."""
    orders = read_table(spark, folder, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("employees"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("active_jobs")
    )
    nation = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read_table(spark, folder, "customer").join(nation, "c_nationkey").join(per, "c_custkey", "left")




def _screen(spark: SparkSession, folder: str, question: str) -> DataFrame:
    columns = {
        "municipality": F.col("n_name"), "legal_form": F.col("c_mktsegment"), "revenue": F.col("revenue"), "employees": F.col("employees"),
        "active_jobs": F.col("active_jobs"), "annual_result": F.col("c_acctbal"), "website": F.col("revenue").isNotNull(), "industry": F.col("c_name"),
        "job_location": F.col("n_name"), "financials": F.col("revenue").isNotNull(),
    }
    modules = {"revenue": "financials", "annual_result": "financials", "financials": "financials", "active_jobs": "external", "job_location": "external", "website": "website"}
    return screens.screen(company_facts(spark, folder), question, columns, "c_custkey", modules)


_FACTS = """WITH per AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS employees,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS active_jobs FROM orders GROUP BY 1),
    facts AS (SELECT c_custkey, n_name, c_mktsegment, c_acctbal, c_name, revenue, employees, active_jobs
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN per ON o_custkey = c_custkey) """


@query(_FACTS + "SELECT c_custkey, employees, revenue, 'financials,registry' AS citations FROM facts WHERE employees > 5 AND revenue > 1000000 ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 10")
def screen_top_revenue(spark, folder):
    return _screen(spark, folder, "companies with more than 5 employees and revenue over 1 million top 10 by revenue")


@query(_FACTS + """SELECT c_custkey, c_mktsegment AS legal_form, employees, active_jobs, c_acctbal AS annual_result, revenue IS NOT NULL AS website, c_name AS industry,
    'external,financials,registry,website' AS citations FROM facts WHERE lower(c_mktsegment) = 'building' AND employees <= 20 AND active_jobs >= 2 AND c_acctbal > 0
    AND revenue IS NOT NULL AND contains(lower(c_name), 'customer')""")
def screen_filters_all_ops(spark, folder):
    return _screen(spark, folder, "Profitable companies with legal form is BUILDING and employees <= 20 and at least 2 active jobs that have a website where industry contains 'Customer'")


@query(_FACTS + """SELECT c_custkey, active_jobs, n_name AS job_location, revenue IS NOT NULL AS financials, 'external,financials' AS citations FROM facts WHERE active_jobs > 0 AND contains(lower(n_name), 'nation_1') AND revenue IS NOT NULL""")
def screen_jobs_in_place(spark, folder):
    """A place in a question about jobs is where the jobs are; accounts are asked for as available."""
    return _screen(spark, folder, "hiring companies in NATION_1 with annual accounts")


@query("SELECT CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS BIGINT) AS employees, '' AS citations WHERE false")
def screen_abstain(spark, folder):
    return _screen(spark, folder, "companies with good sentiment and over 5 employees")


@query("""SELECT CAST(row_number() OVER (ORDER BY lower(name), o) - 2 AS INTEGER) AS place, o AS organisation_number, name, coverage_score, n_matching FROM (
    SELECT *, count(*) OVER () AS n_matching FROM (SELECT o, name, municipality, industry_label, coverage_score, row_number() OVER (PARTITION BY o ORDER BY updated_at DESC NULLS LAST, row_id) AS r
    FROM (SELECT *, CASE WHEN length(regexp_replace(organisation_number, '[^0-9]', '', 'g')) = 9 THEN regexp_replace(organisation_number, '[^0-9]', '', 'g') END AS o FROM companies))
    WHERE r = 1 AND o IS NOT NULL AND (name ILIKE '%energi%' OR municipality ILIKE '%energi%' OR industry_label ILIKE '%energi%')) ORDER BY lower(name), o LIMIT 25 OFFSET 2""")
def list_companies_page(spark, folder):
    """A page of the serving list: a pattern over several columns, newest row a company, total count."""
    from pyspark.sql.window import Window

    rows = read_table(spark, folder, "companies").withColumn("organisation_number", nine_digits(F.col("organisation_number"))).where("organisation_number IS NOT NULL")
    newest = rank.latest_per_key(rows, ["organisation_number"], [F.desc_nulls_last("updated_at"), F.col("row_id")])
    hit = newest.where(F.col("name").ilike("%energi%") | F.col("municipality").ilike("%energi%") | F.col("industry_label").ilike("%energi%"))
    page = hit.select("organisation_number", "name", "coverage_score").orderBy(F.lower("name"), "organisation_number").limit(27)
    placed = page.withColumn("place", F.row_number().over(Window.orderBy(F.lower("name"), "organisation_number")))
    return placed.where("place > 2").withColumn("place", F.col("place") - 2).withColumn("n_matching", hit.select(F.count("*")).scalar())


@query("""SELECT municipality, count(*) AS n, count(*) FILTER (coverage_score = 5) AS complete, count(*) FILTER (coverage_score < 3) AS thin, round(avg(coverage_score), 3) AS mean_score
    FROM (SELECT DISTINCT row_id, municipality, coverage_score FROM companies) GROUP BY municipality""")
def coverage_by_municipality(spark, folder):
    rows = read_table(spark, folder, "companies").select("row_id", "municipality", "coverage_score").distinct()
    return rows.groupBy("municipality").agg(
        F.count("*").alias("n"), F.count_if(F.col("coverage_score") == 5).alias("complete"), F.count_if(F.col("coverage_score") < 3).alias("thin"), F.round(F.avg("coverage_score"), 3).alias("mean_score")
    )


# ---------------------------------------------------------------- counters and percentiles
@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_nearest_rank(spark, folder):
    places = {"p50": aggregate.nearest_rank(0.5), "p95": aggregate.nearest_rank(0.95), "most": F.col("n") - 1}
    return aggregate.value_at_place(read_table(spark, folder, "events"), ["event_type"], "value", places)


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[1 + CAST(floor((count(*) - 1) * 0.5) AS INT)] AS p50, list_sort(list(value))[1 + CAST(floor((count(*) - 1) * 0.9) AS INT)] AS p90
    FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_lower_index(spark, folder):
    places = {"p50": aggregate.lower_index(0.5), "p90": aggregate.lower_index(0.9)}
    return aggregate.value_at_place(read_table(spark, folder, "events"), ["event_type"], "value", places)


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[1 + least(count(*) - 1, count(*) // 2)] AS p50,
    list_sort(list(value))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT))] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_clamped_index(spark, folder):
    places = {"p50": aggregate.clamped_index(0.5), "p95": aggregate.clamped_index(0.95)}
    return aggregate.value_at_place(read_table(spark, folder, "events"), ["event_type"], "value", places)


@query("""SELECT count(*) AS n_users, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, max(n) AS most, CAST(sum(n) AS BIGINT) AS n_requests
    FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def domain_request_summary(spark, folder):
    per = aggregate.counters(read_table(spark, folder, "events"), ["user_id"])
    places = {"p50": aggregate.nearest_rank(0.5, "n_users"), "p95": aggregate.nearest_rank(0.95, "n_users"), "most": F.col("n_users") - 1}
    ranked = aggregate.value_at_place(per, [], "n", places, n="n_users")
    return ranked.withColumn("n_requests", per.select(F.sum("n")).scalar())


@query("SELECT source_class, count(*) AS n FROM sentiment_inference_smoke GROUP BY source_class")
def counter_one_level(spark, folder):
    return aggregate.counters(read_table(spark, folder, "sentiment_inference_smoke"), ["source_class"])


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(*) FILTER (l_linestatus = 'F') AS filled_lines FROM lineitem GROUP BY 1""")
def counter_two_level_pivot(spark, folder):
    counted = read_table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return counted.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open_lines"), F.coalesce("F", F.lit(0)).alias("filled_lines"))


@query("""SELECT CAST('{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS VARCHAR) AS counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def counter_as_map(spark, folder):
    return aggregate.counter_map(read_table(spark, folder, "events"), "event_type")


@query("""SELECT source, min(n) AS fewest, max(n) AS most, round(avg(n), 3) AS mean, CAST(sum(n) AS BIGINT) AS total FROM
    (SELECT source, organisation_number, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source""")
def facts_min_max_avg(spark, folder):
    per = aggregate.counters(read_table(spark, folder, "documents"), ["source", "organisation_number"])
    return per.groupBy("source").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"), F.sum("n").alias("total"))


@query("""SELECT source_class, n, hits, CASE WHEN n > 0 THEN round((hits / n + 3.8416 / (2 * n) - 1.96 * sqrt((hits / n * (1 - hits / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 4) END AS wilson,
    round(hits / n, 4) AS share FROM (SELECT source_class, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (exact_entity) AS DOUBLE) AS hits FROM sentiment_inference_smoke GROUP BY 1)""")
def wilson_by_source(spark, folder):
    per = read_table(spark, folder, "sentiment_inference_smoke").groupBy("source_class").agg(F.count("*").cast("double").alias("n"), F.count_if("exact_entity").cast("double").alias("hits"))
    return per.select("source_class", "n", "hits", aggregate.wilson_lower(F.col("hits"), F.col("n")).alias("wilson"), aggregate.ratio(F.col("hits"), F.col("n")).alias("share"))


@query("""WITH cells AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS b, count(*) AS c FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same FROM cells),
    ra AS (SELECT a AS label, sum(c) AS x FROM cells GROUP BY 1), rb AS (SELECT b AS label, sum(c) AS y FROM cells GROUP BY 1), e AS (SELECT coalesce(sum(CAST(x AS DOUBLE) * y), 0) AS both_ FROM ra JOIN rb USING (label))
    SELECT CAST(n AS BIGINT) AS n, CASE WHEN both_ / (CAST(n AS DOUBLE) * n) = 1 THEN 1.0 ELSE round((same / CAST(n AS DOUBLE) - both_ / (CAST(n AS DOUBLE) * n)) / (1 - both_ / (CAST(n AS DOUBLE) * n)), 4) END AS kappa FROM t, e""")
def kappa_two_labels(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("second", F.when(F.col("l_linestatus") == "O", "N").otherwise("R"))
    return aggregate.cohen_kappa(rows, "l_returnflag", "second")


@query("""WITH both_ AS (SELECT source AS g, CASE WHEN n_chars > 2000 THEN 'annual_report' WHEN n_chars > 900 THEN 'company_site' ELSE 'news_rss' END AS p FROM documents WHERE source IS NOT NULL),
    l AS (SELECT DISTINCT label FROM (SELECT g AS label FROM both_ UNION ALL SELECT p FROM both_)), s AS (SELECT label, (SELECT count(*) FROM both_ WHERE g = label) AS gold, (SELECT count(*) FROM both_ WHERE p = label) AS pred,
    (SELECT count(*) FROM both_ WHERE g = label AND p = label) AS hit FROM l)
    SELECT label, CASE WHEN pred = 0 THEN 0.0 ELSE round(hit / CAST(pred AS DOUBLE), 4) END AS precision, CASE WHEN gold = 0 THEN 0.0 ELSE round(hit / CAST(gold AS DOUBLE), 4) END AS recall,
    round(2 * hit / CAST(gold + pred AS DOUBLE), 4) AS f1 FROM s""")
def class_scores_by_length(spark, folder):
    rows = read_table(spark, folder, "documents").withColumn("guess", F.when(F.col("n_chars") > 2000, "annual_report").when(F.col("n_chars") > 900, "company_site").otherwise("news_rss"))
    return aggregate.class_scores(rows, "source", "guess")


@query("""SELECT CASE WHEN o_totalprice > 200000 THEN 'tp' ELSE 'fn' END AS kind, count(*) AS n, CAST(round(sum(CAST(CAST(pop AS DOUBLE) / rows_ AS DECIMAL(20,6))), 4) AS DOUBLE) AS weight FROM
    (SELECT o_totalprice, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS rows_, 100000 + length(o_orderpriority) AS pop FROM orders) GROUP BY 1""")
def weighted_confusion(spark, folder):
    rows = read_table(spark, folder, "orders").withColumn("population", F.lit(100000) + F.length("o_orderpriority"))
    return aggregate.weighted_confusion(rows, "o_orderpriority", "population", F.when(F.col("o_totalprice") > 200000, "tp").otherwise("fn"))


@query("""SELECT count(*) AS n_queries, round(count(*) FILTER (best <= 1) / CAST(count(*) AS DOUBLE), 4) AS recall_at_1, round(count(*) FILTER (best <= 3) / CAST(count(*) AS DOUBLE), 4) AS recall_at_3,
    round(count(*) FILTER (best <= 5) / CAST(count(*) AS DOUBLE), 4) AS recall_at_5 FROM (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS best FROM lineitem GROUP BY 1)""")
def recall_at_k(spark, folder):
    return aggregate.recall_at(read_table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", (1, 3, 5))


@query("""WITH p AS (SELECT DISTINCT source AS kind, organisation_number AS org, url AS fact FROM documents WHERE source IS NOT NULL AND organisation_number IS NOT NULL AND url IS NOT NULL),
    f AS (SELECT DISTINCT source AS kind, organisation_number AS org, url AS fact FROM documents WHERE lang = 'nb' AND source IS NOT NULL AND organisation_number IS NOT NULL AND url IS NOT NULL),
    e AS (SELECT p.kind, p.org, count(*) AS facts, count(f.fact) AS hits FROM p LEFT JOIN f USING (kind, org, fact) GROUP BY 1, 2)
    SELECT kind, count(*) AS entities, CAST(sum(facts) AS BIGINT) AS facts, round(0.7 * CAST(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) + 0.3 * CAST(sum(hits) AS BIGINT) / CAST(sum(facts) AS DOUBLE), 6) AS recall FROM e GROUP BY kind""")
def pool_recall(spark, folder):
    rows = read_table(spark, folder, "documents").select(F.col("source").alias("kind"), F.col("organisation_number").alias("org"), F.col("url").alias("fact"), "lang")
    return aggregate.pool_recall(rows, rows.where("lang = 'nb'"), "kind", "org", "fact")


@query("""SELECT organisation_number, count(DISTINCT source_class) AS platforms, count(*) FILTER (exact_entity) AS exact, bool_or(source_class = 'review') AS reviewed,
    CASE WHEN count(DISTINCT source_class) >= 2 OR count(*) >= 10 THEN mode_ ELSE 'abstain' END AS verdict FROM
    (SELECT s.*, first_value(coalesce(source_class, 'none')) OVER (PARTITION BY organisation_number ORDER BY k DESC, coalesce(source_class, 'none')) AS mode_ FROM
    (SELECT *, count(*) OVER (PARTITION BY organisation_number, source_class) AS k FROM sentiment_inference_smoke WHERE organisation_number IS NOT NULL) s) GROUP BY organisation_number, mode_""")
def company_rollup(spark, folder):
    """Roll-up by company that abstains with too few publishers and observations."""
    rows = read_table(spark, folder, "sentiment_inference_smoke").where("organisation_number IS NOT NULL")
    per = rows.groupBy("organisation_number", "source_class").agg(F.count("*").alias("k"), F.count_if("exact_entity").alias("exact"))
    top = F.max(F.struct(F.col("k"), F.struct((-F.ascii(F.coalesce("source_class", F.lit("none")))).alias("o"), F.coalesce("source_class", F.lit("none")).alias("c"))))["col2"]["c"]
    total = F.sum("k")
    out = per.groupBy("organisation_number").agg(F.count("source_class").alias("platforms"), F.sum("exact").alias("exact"), F.bool_or(F.col("source_class") == "review").alias("reviewed"), top.alias("mode"), total.alias("n"))
    verdict = F.when((F.col("platforms") >= 2) | (F.col("n") >= 10), F.col("mode")).otherwise("abstain")
    return out.select("organisation_number", "platforms", "exact", "reviewed", verdict.alias("verdict"))


_QUARTERS = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS s{i}" for i in range(4))


@query(f"SELECT n, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS sha256 FROM (SELECT count(*) AS n, {_QUARTERS} FROM (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))")
def dataset_digest(spark, folder):
    return aggregate.digest(read_table(spark, folder, "orders"), "o_orderkey")


# ---------------------------------------------------------------- ranks, samples, quotas
@query("""SELECT * FROM (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS population_n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1|' || c_custkey), c_custkey) - 1 AS place FROM customer) x,
    LATERAL (SELECT CASE WHEN place < round_even(0.6 * population_n, 0) THEN 'development' WHEN place < round_even(0.8 * population_n, 0) THEN 'held_out' ELSE 'validation' END AS split)""")
def split_assignment(spark, folder):
    rows = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return rank.split_assignment(rows, "c_mktsegment", "c_custkey", "s1", {"development": 0.6, "held_out": 0.2, "validation": 0.2})


@query("""SELECT c_custkey, c_name, sha256('s2:' || c_custkey) AS sample_rank FROM customer ORDER BY 3, 1 LIMIT 40""")
def hash_topk_sample(spark, folder):
    return rank.hash_sample(read_table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 40, "s2")


@query("""SELECT doc_id, source, organisation_number, sample_rank FROM (SELECT doc_id, source, organisation_number, sha256('s3:' || doc_id) AS sample_rank, row_number() OVER (PARTITION BY organisation_number ORDER BY sha256('s3:' || doc_id), doc_id) AS r
    FROM documents WHERE organisation_number IS NOT NULL AND organisation_number NOT IN (SELECT organisation_number FROM briefs WHERE organisation_number IS NOT NULL)) WHERE r = 1 ORDER BY sample_rank, doc_id LIMIT 30""")
def distinct_owner_sample(spark, folder):
    rows = read_table(spark, folder, "documents").select("doc_id", "source", "organisation_number")
    return rank.distinct_group_sample(rows, "doc_id", "organisation_number", 30, "s3", read_table(spark, folder, "briefs").where("organisation_number IS NOT NULL"))


_QUOTA = """WITH s AS (SELECT o_orderpriority AS g, count(*) AS size FROM orders GROUP BY 1), e AS (SELECT g, size, CAST(size * 137 AS DOUBLE) / CAST(sum(size) OVER () AS DOUBLE) AS exact FROM s),
    b AS (SELECT g, size, least(size, CAST(floor(exact) AS BIGINT)) AS base, exact - floor(exact) AS fraction FROM e),
    q AS (SELECT g, size, base + CASE WHEN row_number() OVER (ORDER BY fraction DESC, g) <= 137 - sum(base) OVER () AND base < size THEN 1 ELSE 0 END AS quota FROM b) """


@query(_QUOTA + "SELECT g AS o_orderpriority, size, CAST(quota AS BIGINT) AS quota FROM q")
def largest_remainder_quota(spark, folder):
    sizes = read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("size"))
    return rank.largest_remainder(sizes, "o_orderpriority", "size", 137)


@query(_QUOTA + """SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s4:' || o_orderkey), o_orderkey) AS r FROM orders)
    JOIN q ON g = o_orderpriority WHERE r <= quota""")
def stratified_hash_sample(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return rank.stratified_sample(rows, "o_orderpriority", "o_orderkey", 137, "s4")


@query("""SELECT event_id, event_type, CAST(turn AS INTEGER) AS turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('s5:' || event_id), event_id) AS turn FROM events) ORDER BY turn, event_type, event_id LIMIT 23""")
def round_robin_quota(spark, folder):
    return rank.round_robin(read_table(spark, folder, "events").select("event_id", "event_type"), ["event_type"], "event_id", 23, "s5")


@query("""SELECT c_custkey, c_mktsegment || '|' || CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN '0-999' WHEN c_acctbal < 5000 THEN '1000-4999' ELSE '5000+' END AS stratum FROM customer""")
def stratum_key(spark, folder):
    band = F.when(F.col("c_acctbal").isNull(), "missing").when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 1000, "0-999").when(F.col("c_acctbal") < 5000, "1000-4999").otherwise("5000+")
    return read_table(spark, folder, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", band).alias("stratum"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, coalesce(o_totalprice = next_, false) AS ambiguous FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS r, lead(o_totalprice) OVER w AS next_ FROM
    (SELECT o_custkey, o_orderkey, round(o_totalprice / 20000) AS o_totalprice FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey)) WHERE r = 1""")
def tie_aware_best(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 20000).alias("o_totalprice"))
    return rank.best_unless_tied(rows, "o_custkey", "o_totalprice", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AND count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) <= 2 AS publishable FROM lineitem""")
def per_group_cap(spark, folder):
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("publishable"))
    return rank.none_above_cap(rows, ["l_orderkey"], "publishable", 2)


@query("""SELECT o_custkey, year, revenue, previous, round(revenue - previous, 2) AS delta, CASE WHEN previous <> 0 THEN round(100 * (revenue - previous) / abs(previous), 2) END AS percent FROM
    (SELECT *, lag(revenue) OVER (PARTITION BY o_custkey ORDER BY year) AS previous FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2))""")
def revenue_lag_change(spark, folder):
    per = read_table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return rank.change_from_previous(per, "o_custkey", "year", "revenue")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_snapshot(spark, folder):
    rows = read_table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return rank.latest_per_key(rows, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")]).drop("ts")


# ---------------------------------------------------------------- sets
@query("""SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1""")
def dedupe_first_wins(spark, folder):
    rows = read_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return sets.first_wins(rows, ["digest"], [F.col("doc_id")]).drop("digest")


@query("""SELECT organisation_number, name, source FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY source, id) AS r FROM (SELECT organisation_number, name, 0 AS source, audit_id AS id FROM g4_registry_floor_audit
    UNION ALL SELECT organisation_number, name, 1, brief_id FROM briefs UNION ALL SELECT organisation_number, name, 2, recovery_id FROM recovery)) WHERE r = 1""")
def union_first_wins(spark, folder):
    parts = [read_table(spark, folder, t).select("organisation_number", "name", F.col(k).alias("id")) for t, k in (("g4_registry_floor_audit", "audit_id"), ("briefs", "brief_id"), ("recovery", "recovery_id"))]
    return sets.union_first_wins(parts, "organisation_number", F.col("id")).drop("id")


_AUDITS = """WITH a AS (SELECT organisation_number, CASE WHEN bool_or(coalesce(page_title, '') <> '') THEN 'ok' ELSE 'weak' END AS v FROM g4_registry_floor_audit WHERE organisation_number IS NOT NULL GROUP BY 1),
    b AS (SELECT organisation_number, CASE WHEN bool_or(len(pages) > 1) THEN 'ok' ELSE 'weak' END AS v FROM briefs WHERE organisation_number IS NOT NULL GROUP BY 1) """


@query(_AUDITS + """SELECT coalesce(a.organisation_number, b.organisation_number) AS organisation_number, a.v AS before, b.v AS after, CASE WHEN a.organisation_number IS NULL THEN 'gained' WHEN b.organisation_number IS NULL THEN 'lost' ELSE 'changed' END AS kind
    FROM a FULL JOIN b ON a.organisation_number = b.organisation_number WHERE a.v IS DISTINCT FROM b.v""")
def verdict_changes(spark, folder):
    """Verdicts of two audits over all their organisations: some were looked at by one of them only."""
    verdict = lambda table, test: read_table(spark, folder, table).where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.when(F.bool_or(test), "ok").otherwise("weak").alias("v"))
    titled = verdict("g4_registry_floor_audit", F.coalesce("page_title", F.lit("")) != "")
    return sets.verdict_changes(titled, verdict("briefs", F.coalesce(F.size("pages") > 1, F.lit(False))), "organisation_number", "v")


@query("""SELECT o_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not_found' ELSE 'available' END AS status FROM (SELECT c_custkey AS o_custkey FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)""")
def missing_row_fill(spark, folder):
    present = aggregate.counters(read_table(spark, folder, "orders"), ["o_custkey"]).withColumn("status", F.lit("available"))
    expected = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return sets.missing_rows(expected, present, "o_custkey", {"n": F.lit(0).cast("bigint"), "status": F.lit("not_found")})


# ---------------------------------------------------------------- joins
@query("""SELECT n_nationkey, n_name, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS suppliers, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def lookup_join_lists(spark, folder):
    suppliers = read_table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    out = relate.attach_list(read_table(spark, folder, "nation").select("n_nationkey", "n_name"), suppliers, "n_nationkey", "list", F.col("s_name"), F.col("s_suppkey"))
    return out.select("n_nationkey", "n_name", F.array_join("list", ",").alias("suppliers"), F.size("list").cast("bigint").alias("n"))


@query("""SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS old_value, round(c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END, 2) AS new_value FROM customer""")
def strict_one_to_one_join(spark, folder):
    old = read_table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("old_value"))
    new = read_table(spark, folder, "customer").select("c_custkey", F.round(F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0), 2).alias("new_value"))
    return relate.strict_pairs(old, new, "c_custkey")


_SNAP = "(SELECT DISTINCT regexp_replace(organisation_number, '[^0-9]', '', 'g') AS o FROM entry_companies WHERE snapshot_date = (SELECT {}(snapshot_date) FROM entry_companies) AND length(regexp_replace(organisation_number, '[^0-9]', '', 'g')) = 9)"


@query(f"SELECT count(a.o) FILTER (b.o IS NOT NULL) AS \"both\", count(*) FILTER (b.o IS NULL) AS previous_only, count(*) FILTER (a.o IS NULL) AS current_only FROM {_SNAP.format('min')} a FULL JOIN {_SNAP.format('max')} b ON a.o = b.o")
def membership_intersection(spark, folder):
    rows = read_table(spark, folder, "entry_companies").select(nine_digits(F.col("organisation_number")).alias("o"), "snapshot_date")
    first, last = _first_and_last_date(spark, folder)
    return relate.membership(rows.where(F.col("snapshot_date") == first), rows.where(F.col("snapshot_date") == last), "o")


@query("""WITH a AS (SELECT DISTINCT organisation_number, 'review' AS family FROM sentiment_inference_smoke WHERE source_class = 'review'), b AS (SELECT DISTINCT organisation_number, 'review' AS family FROM documents WHERE source = 'review')
    SELECT organisation_number, family, CASE WHEN y IS NULL THEN 'reference_only' WHEN x IS NULL THEN 'ours_only' ELSE 'matched' END AS side FROM (SELECT *, 1 AS x FROM a) FULL JOIN (SELECT *, 1 AS y FROM b) USING (organisation_number, family)""")
def full_outer_compare(spark, folder):
    a = read_table(spark, folder, "sentiment_inference_smoke").where("source_class = 'review'").select("organisation_number", F.lit("review").alias("family"))
    b = read_table(spark, folder, "documents").where("source = 'review'").select("organisation_number", F.lit("review").alias("family"))
    return relate.compare_sides(a, b, ["organisation_number", "family"])


@query("""SELECT doc_id, organisation_number FROM documents d WHERE NOT EXISTS (SELECT 1 FROM briefs b WHERE b.organisation_number = d.organisation_number)""")
def dangling_refs_anti(spark, folder):
    return relate.dangling(read_table(spark, folder, "documents").select("organisation_number", "doc_id"), read_table(spark, folder, "briefs"), "organisation_number").select("doc_id", "organisation_number")


@query("""WITH p AS (SELECT DISTINCT organisation_number AS k, o AS parent FROM (SELECT organisation_number, regexp_replace(organisation_number, '[^0-9]', '', 'g') AS o FROM entry_companies) WHERE length(o) = 9), known AS (SELECT DISTINCT parent FROM p)
    SELECT how, count(*) AS n, count(DISTINCT entity) AS entities FROM (SELECT coalesce(p.parent, known.parent) AS entity, CASE WHEN p.parent IS NOT NULL THEN 'mapped' WHEN known.parent IS NOT NULL THEN 'already_parent' ELSE 'unmapped' END AS how
    FROM sentiment_inference_smoke s LEFT JOIN p ON p.k = s.organisation_number LEFT JOIN known ON known.parent = s.organisation_number) GROUP BY 1""")
def rekey_to_parent(spark, folder):
    """Observations re-keyed from the number as written to the registry's nine digits; not all are in the registry."""
    rows = read_table(spark, folder, "sentiment_inference_smoke").select(F.col("organisation_number").alias("k"))
    written = read_table(spark, folder, "entry_companies").select(F.col("organisation_number").alias("k"), nine_digits(F.col("organisation_number")).alias("parent"))
    parents = written.where("parent IS NOT NULL").distinct()
    out = relate.rekey(rows, "k", parents, "parent", parents.select("parent").distinct())
    return out.groupBy("how").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


@query(r"""SELECT host, count(DISTINCT organisation_number) AS owners FROM (SELECT organisation_number, regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host FROM sentiment_inference_smoke)
    WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT organisation_number) >= 2""")
def shared_key_counts(spark, folder):
    """Hosts that several organisations are written about on."""
    from millrace.functions.urls import host

    rows = read_table(spark, folder, "sentiment_inference_smoke").select("organisation_number", host(F.col("source_url")).alias("host"))
    return relate.shared_keys(rows, "host", "organisation_number")


_DOMAIN = """WITH r AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_returnflag = 'N' AS exempt FROM lineitem), o AS (SELECT l_partkey, count(*) AS owners, min(e) AS e FROM
    (SELECT l_partkey, l_suppkey, min(CAST(exempt AS INT)) AS e FROM r GROUP BY 1, 2) GROUP BY 1) """


@query(_DOMAIN + "SELECT l_orderkey, l_linenumber, owners >= 2 AND e = 0 AND NOT exempt AS demoted FROM r JOIN o USING (l_partkey)")
def domain_uniqueness_exempt(spark, folder):
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return relate.demote_shared(rows, "l_partkey", "l_suppkey", F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber", "demoted")


@query(_DOMAIN + "SELECT l_orderkey, l_linenumber, owners >= 2 AS demoted FROM r JOIN o USING (l_partkey)")
def domain_uniqueness_strict(spark, folder):
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return relate.demote_shared(rows, "l_partkey", "l_suppkey", F.lit(False)).select("l_orderkey", "l_linenumber", "demoted")


@query("""SELECT audit_id, coalesce(nullif(declared_url, ''), b.url) AS declared_url, coalesce(nullif(page_title, ''), b.name) AS page_title FROM (SELECT DISTINCT audit_id, organisation_number, declared_url, page_title FROM g4_registry_floor_audit) a
    LEFT JOIN (SELECT organisation_number, min(website_url) AS url, min(name) AS name FROM recovery WHERE organisation_number IS NOT NULL GROUP BY 1) b USING (organisation_number)""")
def bulk_enrichment(spark, folder):
    left = read_table(spark, folder, "g4_registry_floor_audit").select("audit_id", "organisation_number", "declared_url", "page_title").distinct()
    right = read_table(spark, folder, "recovery").where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min("website_url").alias("declared_url"), F.min("name").alias("page_title"))
    return relate.fill_empty(left, right, "organisation_number", ["declared_url", "page_title"]).drop("organisation_number")


# ---------------------------------------------------------------- differences and state
_FIELDS = ("name", "municipality_number", "industry_code", "website")
_SNAPSHOTS = f"""WITH r AS (SELECT organisation_number, snapshot_date, {", ".join(_FIELDS)}, website IS NULL AS lost, row_number() OVER (PARTITION BY o, snapshot_date ORDER BY loaded_at DESC NULLS LAST, organisation_number DESC NULLS LAST, name DESC NULLS LAST, website DESC NULLS LAST) AS place, o
    FROM (SELECT *, regexp_replace(organisation_number, '[^0-9]', '', 'g') AS o FROM entry_companies) WHERE length(o) = 9), old AS (SELECT * FROM r WHERE place = 1 AND snapshot_date = (SELECT min(snapshot_date) FROM entry_companies)),
    new AS (SELECT *, CASE WHEN lost THEN 'failed' ELSE 'available' END AS status FROM r WHERE place = 1 AND snapshot_date = (SELECT max(snapshot_date) FROM entry_companies)),
    d AS ({" UNION ALL ".join(f"SELECT old.o AS organisation_number, '{f}' AS field, old.{f} AS old_value, new.{f} AS new_value, status FROM old JOIN new USING (o) WHERE old.{f} IS DISTINCT FROM new.{f}" for f in _FIELDS)}) """


def _first_and_last_date(spark, folder) -> tuple[Column, Column]:
    """The first and the last snapshot date, as scalar subqueries over the one column."""
    dates = read_table(spark, folder, "entry_companies").select("snapshot_date")
    return dates.select(F.min("snapshot_date")).scalar(), dates.select(F.max("snapshot_date")).scalar()


def _first_and_last(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Organisations in the first and in the last snapshot; one whose website is gone could not be looked at."""
    rows = read_table(spark, folder, "entry_companies").withColumn("o", nine_digits(F.col("organisation_number"))).where("o IS NOT NULL")
    first, last = _first_and_last_date(spark, folder)
    rows = rows.withColumn("is_first", F.col("snapshot_date") == first).where(F.col("is_first") | (F.col("snapshot_date") == last))
    newest = rank.latest_per_key(rows, ["o", "snapshot_date"], [F.desc_nulls_last(c) for c in ("loaded_at", "organisation_number", "name", "website")])
    picked = newest.select(F.col("o").alias("organisation_number"), *_FIELDS, F.when(F.col("website").isNull(), "failed").otherwise("available").alias("status"), "is_first")
    return picked.where("is_first").drop("is_first", "status"), picked.where("NOT is_first").drop("is_first")


@query(_SNAPSHOTS + "SELECT organisation_number, field, old_value, new_value FROM d")
def field_diff(spark, folder):
    """Differences between the first and the last snapshot, field by field."""
    return fielddiff.field_changes(*_first_and_last(spark, folder), "organisation_number", _FIELDS)


@query(_SNAPSHOTS + "SELECT organisation_number, field, old_value, new_value FROM d WHERE status <> 'failed'")
def transient_suppression(spark, folder):
    return fielddiff.field_changes(*_first_and_last(spark, folder), "organisation_number", _FIELDS, "status", ("failed", "source_error", "blocked", "not_checked"))


@query(_SNAPSHOTS + """SELECT count(*) AS expected, count(*) FILTER (status <> 'failed') AS observed, count(*) FILTER (status <> 'failed') AS common, 1.0 AS precision,
    round(count(*) FILTER (status <> 'failed') / CAST(count(*) AS DOUBLE), 4) AS recall FROM d""")
def replay_precision_recall(spark, folder):
    """What suppression of transient states keeps of all differences."""
    return fielddiff.replay_scores(field_diff(spark, folder), transient_suppression(spark, folder), ["organisation_number", "field"])


@query(_SNAPSHOTS + "SELECT count(*) AS compared, 0 AS changed FROM new")
def change_roundtrip_idempotent(spark, folder):
    """The last snapshot against itself: everything is compared and nothing changed."""
    _, new = _first_and_last(spark, folder)
    changed = fielddiff.field_changes(new.drop("status"), new, "organisation_number", _FIELDS)
    both = new.select(F.lit(1).alias("compared"), F.lit(0).alias("changed")).unionByName(changed.select(F.lit(0).alias("compared"), F.lit(1).alias("changed")))
    return both.agg(F.sum("compared").alias("compared"), F.sum("changed").alias("changed"))


# ---------------------------------------------------------------- state
@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, ts) AS decision, count(*) AS n_events FROM events GROUP BY 1""")
def ledger_state(spark, folder):
    """The ledger of all events, merged from those of two halves of the time line."""
    rows = read_table(spark, folder, "events")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return state.merge_ledgers(state.ledger(rows.where(early), "user_id", "ts", "event_type"), state.ledger(rows.where(~early), "user_id", "ts", "event_type"), "user_id")


@query("""SELECT user_id, arg_max(event_type, ts) AS decision, max(ts) AS last_seen FROM events GROUP BY 1 HAVING arg_max(event_type, ts) IN ('error', 'view') AND max(ts) > TIMESTAMP '2024-01-31' - INTERVAL 2 DAY""")
def negative_cache_skip(spark, folder):
    rows = state.ledger(read_table(spark, folder, "events"), "user_id", "ts", "event_type")
    return state.to_skip(rows, F.lit("2024-01-31").cast("timestamp_ntz"), 2, ("error", "view")).select("user_id", "decision", "last_seen")


@query("""SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1""")
def cursor_newest_state(spark, folder):
    """The newest state of each key, though everything is delivered twice."""
    rows = read_table(spark, folder, "events").select("user_id", "ts", "event_type")
    return state.newest_state(rows.unionByName(rows), "user_id", "ts", "event_type")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (ts + CASE event_type WHEN 'click' THEN INTERVAL 5 DAY WHEN 'view' THEN INTERVAL 10 DAY ELSE INTERVAL 20 DAY END <= TIMESTAMP '2024-01-25') AS expired FROM events GROUP BY 1""")
def retention_sweep(spark, folder):
    gone = state.expired(None, "ts", "event_type", {"click": 5, "view": 10}, 20, F.lit("2024-01-25").cast("timestamp_ntz"))
    return read_table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(gone).alias("expired"))


@query("""WITH a AS (SELECT organisation_number, min(name) AS name, min(website_url) AS url FROM recovery WHERE organisation_number IS NOT NULL GROUP BY 1), b AS (SELECT organisation_number, min(CASE WHEN page_title <> '' THEN page_title END) AS name, min(final_url) AS url FROM g4_registry_floor_audit WHERE organisation_number IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.organisation_number, b.organisation_number) AS organisation_number, CASE WHEN b.organisation_number IS NULL THEN a.name ELSE coalesce(b.name, a.name) END AS name, CASE WHEN b.organisation_number IS NULL THEN a.url ELSE b.url END AS url
    FROM a FULL JOIN b ON a.organisation_number = b.organisation_number""")
def upsert_coalesce(spark, folder):
    """Two states of the organisations, each lacking some, merged; null names don't overwrite, null addresses do."""
    state_of = lambda table, name, url: read_table(spark, folder, table).where("organisation_number IS NOT NULL").groupBy("organisation_number").agg(F.min(name).alias("name"), F.min(url).alias("url"))
    newer = state_of("g4_registry_floor_audit", F.nullif("page_title", F.lit("")), F.col("final_url"))
    return state.upsert(state_of("recovery", F.col("name"), F.col("website_url")), newer, "organisation_number", keep_old=["name"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def resume_anti_join(spark, folder):
    work = read_table(spark, folder, "orders").select("o_orderkey")
    return state.pending(work, read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN landed_at IS NULL OR date_diff('day', CAST(landed_at AS DATE), DATE '2026-09-01') < 0 THEN 'unusable' WHEN date_diff('day', CAST(landed_at AS DATE), DATE '2026-09-01') > 14 THEN 'stale'
    WHEN date_diff('day', CAST(landed_at AS DATE), DATE '2026-09-01') > 7 THEN 'warn' ELSE 'fresh' END AS band FROM documents) GROUP BY 1""")
def index_freshness(spark, folder):
    band = state.freshness(F.col("landed_at"), F.lit("2026-09-01").cast("date"))
    return read_table(spark, folder, "documents").groupBy(band.alias("band")).agg(F.count("*").alias("n"))
