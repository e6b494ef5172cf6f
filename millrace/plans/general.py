"""Queries of the general training-data problems (nested records, snapshots, timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.canon import folded_text, json_digest
from millrace.functions.orgid import nine_digits
from millrace.operators import instants, shred, snapshots
from millrace.session import cut_lineage, spread
from millrace.sources.tables import read_table

#: Volatile keys of an envelope, left out when contents are compared.
VOLATILE = ("run_id", "started_at", "completed_at", "final_timestamp", "retry_count", "retrieved_at", "run_metrics")
#: Compared fields of a registry row.
TRACKED_TEXTS = ("name", "legal_form", "municipality_number", "industry_code", "website", "latest_submitted_accounts")
TRACKED_OTHERS = ("employees", "bankrupt", "liquidating")
#: Nested columns of a record, and the scalars of a brief's part.
NESTED = ("activity", "brief", "hiring")
PARTS = ("text", "source_class", "source_url", "claim_span", "kind")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of lists in the nested records and in the envelopes' JSON, with their parents."""
    recovery = read_table(spark, folder, "recovery")
    companies = read_table(spark, folder, "companies")
    elements = lambda objects, table: objects.where("filled > 0 AND ordinal IS NOT NULL").select(F.lit(table).alias("source_table"), "record_key", "child_path", "parent_path")
    typed = shred.object_nodes(recovery, F.col("recovery_id"), shred.struct_text(NESTED), pairs=(), scalars=False)
    found = shred.object_nodes(companies, F.col("row_id"), F.col("latest_envelope"), scalars=False)
    return elements(typed, "recovery").unionByName(elements(found, "companies")).distinct()


def p1_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency table of the nested records: every node with its parent, label, ordinal and scalar."""
    recovery = read_table(spark, folder, "recovery")
    nodes = shred.adjacency(recovery, F.col("recovery_id"), shred.struct_text(NESTED), pairs=())
    return nodes.select("record_key", "path", "element_path", "label", "ordinal", "kind", "scalar").distinct()


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entity table of the brief's parts: object nodes of the stored adjacency table, joined with their
    scalar children and pivoted."""
    recovery = read_table(spark, folder, "recovery")
    nodes = shred.adjacency(recovery, F.col("recovery_id"), shred.struct_text(NESTED), pairs=())
    return shred.objects_of(cut_lineage(nodes.where("element_path LIKE 'brief.parts[%' OR path LIKE 'brief.parts[%'")), "parts", dict.fromkeys(PARTS, "string"))


def p1_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Entity table of the role holders in the envelopes, each with its link to the record."""
    companies = read_table(spark, folder, "companies")
    objects = shred.object_nodes(companies, F.col("row_id"), F.col("latest_envelope"))
    columns = {"name": "string", "role_code": "string", "role": "string", "last_changed": "date", "inactive": "boolean", "organisation_number": "string"}
    return shred.entity_table(objects, "roles", columns).distinct()


def p1_activity_items(spark: SparkSession, folder: str) -> DataFrame:
    """Entity table of the activity items of the nested records, natively exploded."""
    items = read_table(spark, folder, "recovery").select("recovery_id", F.posexplode("activity.items").alias("item_ord", "item"))
    return items.where("item IS NOT NULL").select("recovery_id", "item_ord", "item.title", "item.date", "item.url", "item.claim_span", "item.source_class").distinct()


def entry_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the registry snapshots: ``organisation_number, snapshot_date, change_kind``."""
    rows = read_table(spark, folder, "entry_companies")
    texts = [folded_text(F.col(c)) for c in TRACKED_TEXTS]
    others = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TRACKED_OTHERS]
    content = F.concat_ws("\u001f", *texts, *others)
    latest = snapshots.latest_versions(rows, nine_digits(F.col("organisation_number")), F.col("snapshot_date"), F.col("loaded_at"), content)
    return _named(snapshots.changes(latest, rows.select("snapshot_date")))


def envelope_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the envelopes' content between snapshots: as ``entry_changes``."""
    rows = spread(read_table(spark, folder, "companies").select("organisation_number", "snapshot_date", "updated_at", "latest_envelope"))
    content = json_digest(VOLATILE)(F.col("latest_envelope"))
    latest = snapshots.latest_versions(rows, nine_digits(F.col("organisation_number")), F.col("snapshot_date"), F.col("updated_at"), content)
    return _named(snapshots.changes(latest, read_table(spark, folder, "companies").select("snapshot_date")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("organisation_number"), F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot_date"), "change_kind")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations added, removed or changed between consecutive snapshots of both tables."""
    columns = ("source_table", "organisation_number", "snapshot_date", "change_kind")
    entry = entry_changes(spark, folder).withColumn("source_table", F.lit("entry_companies"))
    envelopes = envelope_changes(spark, folder).withColumn("source_table", F.lit("companies"))
    return entry.select(*columns).unionByName(envelopes.select(*columns))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One unambiguous form of each usable timestamp of both tables."""
    recovery = read_table(spark, folder, "recovery").select("recovery_id", F.posexplode("activity.items").alias("pos", "item"))
    columns = lambda table, key, position: {"source_table": F.lit(table), "record_key": key.cast("string"), "item_ord": position.cast("int")}
    dates = instants.normal_forms(recovery, F.col("item.date"), columns("recovery", F.col("recovery_id"), F.col("pos")), "Europe/Oslo")
    smoke = read_table(spark, folder, "sentiment_inference_smoke")
    retrieved = instants.normal_forms(smoke, F.col("retrieved_at"), columns("sentiment_inference_smoke", F.col("id"), F.lit(0)), "UTC")
    return dates.unionByName(retrieved).distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_roles": p1_roles,
    "p1_adjacency": p1_adjacency,
    "p1_entities": p1_entities,
    "p1_activity_items": p1_activity_items,
    "p2_found": p2_found,
    "p2_entry_changes": entry_changes,
    "p2_envelope_changes": envelope_changes,
    "p3_found": p3_found,
}

_KEY = "CASE WHEN length(regexp_replace(organisation_number, '[^0-9]', '', 'g')) = 9 THEN regexp_replace(organisation_number, '[^0-9]', '', 'g') END"
_FOLD = "lower(nfc_normalize(trim(regexp_replace(coalesce({}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))))"
_CONTENT = " || chr(31) || ".join([_FOLD.format(c) for c in TRACKED_TEXTS] + [f"coalesce(CAST({c} AS VARCHAR), '')" for c in TRACKED_OTHERS])


def _instants_sql() -> str:
    """The usable timestamps of both tables: five written forms and digits only, each read by one pattern."""
    months = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in instants.MONTHS.items()) + "}"
    abbreviations = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in instants.ABBREVIATIONS.items()) + "}"
    rest = r"( ?[a-z]+)?(?: ?([-+]\d{2}:?(?:\d{2})?))?((?: \[?|\[)[a-z]+/[a-z_]+\]?)?$"
    names = ["h", "mi", "s", "f", "x", "o", "z"]
    forms = {  # the pattern, and for each of its groups the part of a timestamp it holds
        "iso": (r"^\d{4}-\d{2}-\d{2}(?:[t ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?" + rest[:-1] + r")?$", names),
        "packed": (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(z)$", ["y", "mo", "d", "h", "mi", "s", "x"]),
        "day_first": (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:(?:,| kl\.?)? (\d{1,2})[.:](\d{2})( ?[a-z]+)?)?$", ["d", "mo", "y", "h", "mi", "x"]),
        "worded": (r"^(?:\p{L}+[.:,]? )?(\d{1,2})\.? (\p{L}+)\.? (\d{4})(?: (?:kl\.? )?(\d{2}):(\d{2})(?::(\d{2}))?( ?[a-z]+)?(?: ?([-+]\d{4}))?)?$", ["d", "w", "y", "h", "mi", "s", "x", "o"]),
        "month_first": (r"^(\p{L}+) (\d{1,2}), (\d{4})(?: (\d{1,2}):(\d{2}) ([ap]m)( ?[a-z]+)?)?$", ["w", "d", "y", "h", "mi", "half", "x"]),
    }
    every = ["y", "mo", "d", *names, "w", "half"]
    placed = {"y": "substr(v, 1, 4)", "mo": "substr(v, 6, 2)", "d": "substr(v, 9, 2)"}  # of the first form
    cases = []
    for name, (pattern, groups) in forms.items():
        fields = ", ".join(f"'{g}': " + (f"nullif(trim(regexp_extract(v, '{pattern}', {groups.index(g) + 1})), '')" if g in groups else placed[g] if name == "iso" and g in placed else "NULL::VARCHAR") for g in every)
        cases.append(f"WHEN regexp_matches(v, '{pattern}') THEN {{{fields}}}")
    number = lambda c: f"CAST(p.{c} AS BIGINT)"
    return f"""WITH r AS (SELECT 'recovery' AS source_table, CAST(recovery_id AS VARCHAR) AS record_key, CAST(i - 1 AS INTEGER) AS item_ord, activity.items[i].date AS raw, 'Europe/Oslo' AS zone FROM (SELECT *, unnest(range(1, len(activity.items) + 1)) AS i FROM recovery)
        UNION SELECT 'sentiment_inference_smoke', id, 0, retrieved_at, 'UTC' FROM sentiment_inference_smoke),
        v AS (SELECT source_table, record_key, item_ord, zone, lower(trim(regexp_replace(raw, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS v FROM r WHERE raw IS NOT NULL),
        p AS (SELECT *, CASE {" ".join(cases)} END AS p FROM v WHERE NOT regexp_full_match(v, '[0-9]*')),
        q AS (SELECT *, TRY_CAST(p.y || '-' || lpad(coalesce(p.mo, CAST({months}[p.w] AS VARCHAR)), 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day, p.h IS NOT NULL AS timed, CASE p.half WHEN 'am' THEN {number('h')} % 12 WHEN 'pm' THEN {number('h')} % 12 + 12 ELSE {number('h')} END AS hour, {number('mi')} AS minute, coalesce({number('s')}, 0) AS second,
        CASE WHEN p.o IS NOT NULL THEN (CASE WHEN p.o[1] = '-' THEN -1 ELSE 1 END) * (CAST(p.o[2:3] AS BIGINT) * 60 + coalesce(TRY_CAST(nullif(regexp_replace(p.o[4:], ':', ''), '') AS BIGINT), 0)) ELSE {abbreviations}[p.x] END AS shift, coalesce(regexp_extract(p.z, '[a-z]+/[a-z_]+'), zone) AS tz FROM p WHERE p IS NOT NULL),
        t AS (SELECT *, day + to_hours(hour) + to_minutes(minute) + to_seconds(second) AS local FROM q WHERE day IS NOT NULL AND timed AND hour < 24 AND minute < 60 AND second < 60 AND (p.half IS NULL OR {number('h')} BETWEEN 1 AND 12) AND (p.x IS NULL OR {abbreviations}[p.x] IS NOT NULL)),
        u AS (SELECT *, CASE WHEN shift IS NOT NULL THEN local - to_minutes(shift) ELSE timezone('UTC', CASE WHEN timezone(tz, timezone(tz, local) - INTERVAL 1 HOUR) = local THEN timezone(tz, local) - INTERVAL 1 HOUR ELSE timezone(tz, local) END) END AS utc FROM t)
        SELECT source_table, record_key, item_ord, strftime(day, '%Y-%m-%d') AS normal_form FROM q WHERE day IS NOT NULL AND NOT timed
        UNION SELECT source_table, record_key, item_ord, strftime(utc, '%Y-%m-%dT%H:%M:%S.') || rpad(coalesce(p.f, '')[1:6], 6, '0') || 'Z' FROM u
        UNION SELECT source_table, record_key, item_ord, strftime(make_timestamp(CAST(v AS BIGINT) * CASE WHEN length(v) <= 11 THEN 1000000 WHEN length(v) <= 14 THEN 1000 ELSE 1 END), '%Y-%m-%dT%H:%M:%S.%fZ') FROM v WHERE regexp_full_match(v, '[0-9]{{1,17}}')"""


def _changes_sql(versions: str) -> str:
    """Changes between consecutive snapshots of ``versions(o, d, content)``."""
    return f"""WITH {versions}, s AS (SELECT d, lag(d) OVER (ORDER BY d) AS before FROM (SELECT DISTINCT d FROM v)), a AS (SELECT o, v.d, content FROM v JOIN s ON v.d = s.d WHERE before IS NOT NULL), b AS (SELECT o, s.d, content FROM v JOIN s ON v.d = s.before)
        SELECT coalesce(a.o, b.o) AS organisation_number, strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS snapshot_date, CASE WHEN b.o IS NULL THEN 'added' WHEN a.o IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM a FULL JOIN b ON a.o = b.o AND a.d = b.d WHERE a.content IS DISTINCT FROM b.content"""


def _envelopes_sql() -> str:
    """Envelopes by the sorted paths and values of their leaves: positions are dropped, numbers read, arrays in
    texts opened, volatile keys left out at any depth."""
    leaf = "(t.type NOT IN ('OBJECT', 'ARRAY') OR CAST(t.value AS VARCHAR) IN ('{}', '[]'))"
    path = "regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g')"
    value = "CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(t.value AS DOUBLE) AS VARCHAR) WHEN t.type = 'VARCHAR' THEN 's' || json_extract_string(t.value, '$') ELSE CAST(t.value AS VARCHAR) END"
    opened = "t.type = 'VARCHAR' AND json_extract_string(t.value, '$') LIKE '[%]' AND json_valid(json_extract_string(t.value, '$'))"
    volatile = "|".join(VOLATILE)
    return f"""e AS (SELECT DISTINCT row_id, organisation_number, snapshot_date, updated_at, latest_envelope FROM companies), l AS (SELECT row_id, {path} AS k, {value} AS x, {opened} AS opened, t.value AS raw FROM e, json_tree(e.latest_envelope) t WHERE {leaf}),
        m AS (SELECT row_id, k, x FROM l WHERE NOT opened UNION ALL SELECT row_id, l.k || substr({path}, 2), {value} FROM l, json_tree(json_extract_string(l.raw, '$')) t WHERE l.opened AND {leaf}),
        c AS (SELECT row_id, md5(string_agg(k || '=' || x, chr(10) ORDER BY k, x)) AS content FROM m WHERE NOT regexp_matches(k, '\\."?({volatile})"?([.\\[]|$)') GROUP BY 1),
        v AS (SELECT o, snapshot_date AS d, arg_max(content, updated_at) AS content FROM (SELECT {_KEY} AS o, snapshot_date, updated_at, content FROM e LEFT JOIN c USING (row_id)) WHERE o IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2)"""


_ENTRIES_SQL = f"v AS (SELECT o, snapshot_date AS d, arg_max(content, loaded_at) AS content FROM (SELECT {_KEY} AS o, snapshot_date, loaded_at, {_CONTENT} AS content FROM entry_companies) WHERE o IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2)"


def _adjacency_sql() -> str:
    """Nodes of the nested columns, kind by kind: records, structs, their scalars, lists, elements, and the elements' scalars."""
    structs = {"activity": ("status",), "brief": ("status", "summary"), "hiring": ("status", "careers_page_found", "checked")}
    lists = {("activity", "items"): ("title", "date", "url", "claim_span", "source_class"), ("brief", "parts"): PARTS, **{("hiring", x): ("title", "url") for x in ("postings", "company_site_postings", "nav_ads")}}
    row = "SELECT CAST(recovery_id AS VARCHAR) AS record_key, {} AS path, {} AS element_path, {} AS label, {} AS ordinal, {} AS kind, CAST({} AS VARCHAR) AS scalar FROM {} WHERE {}"
    none = "CAST(NULL AS INTEGER)"
    parts = [row.format("''", "'$'", "''", none, "'object'", "NULL", "recovery", "true")]
    for s, leaves in structs.items():
        parts.append(row.format(f"'{s}'", "'$'", f"'{s}'", none, "'object'", "NULL", "recovery", f"{s} IS NOT NULL"))
        parts += [row.format(f"'{s}.{x}'", "'$'", f"'{x}'", none, "'scalar'", f"{s}.{x}", "recovery", f"{s}.{x} IS NOT NULL") for x in leaves]
    for (s, a), leaves in lists.items():
        parts.append(row.format(f"'{s}.{a}'", "'$'", f"'{a}'", none, "'list'", "NULL", "recovery", f"{s}.{a} IS NOT NULL"))
        items = f"(SELECT recovery_id, i - 1 AS i, {s}.{a}[i] AS e FROM (SELECT *, unnest(range(1, len({s}.{a}) + 1)) AS i FROM recovery))"
        here = f"'{s}.{a}[' || i || ']'"
        parts.append(row.format(here, "'$'", f"'{a}'", "CAST(i AS INTEGER)", "CASE WHEN e IS NULL THEN 'scalar' ELSE 'object' END", "NULL", items, "true"))
        parts += [row.format(f"{here} || '.{x}'", here, f"'{x}'", none, "'scalar'", f"e.{x}", items, f"e.{x} IS NOT NULL") for x in leaves]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


ORACLE = {
    "p3_found": _instants_sql(),
    "p1_adjacency": _adjacency_sql(),
    "p1_entities": f"""SELECT DISTINCT CAST(recovery_id AS VARCHAR) AS record_key, 'brief.parts[' || (i - 1) || ']' AS child_path, '$' AS parent_path, {", ".join(f"e.{c} AS {c}" for c in PARTS)}
        FROM (SELECT recovery_id, i, brief.parts[i] AS e FROM (SELECT *, unnest(range(1, len(brief.parts) + 1)) AS i FROM recovery)) WHERE e IS NOT NULL""",
    "p1_activity_items": """SELECT DISTINCT recovery_id, CAST(i - 1 AS INTEGER) AS item_ord, items[i].title AS title, items[i].date AS date, items[i].url AS url, items[i].claim_span AS claim_span, items[i].source_class AS source_class
        FROM (SELECT recovery_id, activity.items AS items, unnest(range(1, len(activity.items) + 1)) AS i FROM recovery) WHERE items[i] IS NOT NULL""",
    "p2_entry_changes": _changes_sql(_ENTRIES_SQL),
    "p2_envelope_changes": _changes_sql(_envelopes_sql()),
    "p2_found": f"SELECT 'entry_companies' AS source_table, * FROM ({_changes_sql(_ENTRIES_SQL)}) UNION ALL SELECT 'companies', * FROM ({_changes_sql(_envelopes_sql())})",
}
