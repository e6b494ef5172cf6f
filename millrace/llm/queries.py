"""Queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, main_body, packing, repetition, residue
from millrace.session import cut_lineage
from millrace.sources.tables import read_table


def _brief_pages(spark: SparkSession, folder: str) -> DataFrame:
    briefs = read_table(spark, folder, "briefs")
    return briefs.select("brief_id", F.posexplode("pages.html").alias("page_ord", "html"))


_COLUMNS = ("source_table", "record_key", "page_ord")


def _residue_records(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of all pages of briefs and of all audit titles, written once: they are mined, and then
    read again for the verdicts."""
    keys = {"source_table": F.lit("briefs"), "record_key": F.col("brief_id").cast("string"), "page_ord": F.col("page_ord")}
    pages = residue.page_records(_brief_pages(spark, folder), keys, F.col("html"))
    audit = read_table(spark, folder, "g4_registry_floor_audit")
    keys = {"source_table": F.lit("g4_registry_floor_audit"), "record_key": F.col("audit_id").cast("string"), "page_ord": F.lit(0)}
    return cut_lineage(pages.unionByName(residue.title_records(audit, keys, F.col("page_title"))))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and titles that hold residue instead of content."""
    rows = residue.record_verdicts(_residue_records(spark, folder), _COLUMNS)
    return rows.where("verdict != 'ordinary'").select(*_COLUMNS).distinct()


def p4_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages and audit titles each verdict holds for, by table."""
    rows = residue.record_verdicts(_residue_records(spark, folder), _COLUMNS)
    return rows.groupBy("source_table", "verdict").agg(F.count("*").alias("n_messages"))


def p4_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates mined from the messages of pages and audit titles, each classified once, with how many
    messages it has."""
    return residue.mined_templates(_residue_records(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the own bodies of pages; pages that hold residue are passed over."""
    keys = {"source_table": F.lit("briefs"), "record_key": F.col("brief_id").cast("string"), "page_ord": F.col("page_ord")}
    briefs = main_body.main_body_hashes(_brief_pages(spark, folder), keys, F.col("html"), leave_out=residue.is_residue)
    snippets = read_table(spark, folder, "snippets")
    keys = {"source_table": F.lit("snippets"), "record_key": F.col("snippet_id").cast("string"), "page_ord": F.lit(0)}
    others = main_body.main_body_hashes(snippets, keys, F.col("html"))
    return briefs.unionByName(others).select(*_COLUMNS, "block_md5").distinct()


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in containers, for each capacity of ``pack_specs``."""
    documents, specs = read_table(spark, folder, "documents"), read_table(spark, folder, "pack_specs")
    packed = packing.pack_texts(documents, F.col("doc_id"), F.col("text"), specs)
    return packed.withColumnRenamed("item_id", "doc_id")


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers of each capacity: how many documents they have, and how many
    containers are overfull, documents split that fit, and pieces that don't follow the one before."""
    packed = p6_packed(spark, folder).where("doc_id IS NOT NULL")
    specs = read_table(spark, folder, "pack_specs").distinct()
    fill = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(specs), "spec_id")
    overfull = fill.groupBy("spec_id").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    split = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    whole = pieces.join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if(split).alias("split_small"), F.count_if(F.col("end") != F.col("tokens")).alias("broken"))
    return whole.join(overfull, "spec_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")
    return leakage.leaked_passages(documents, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("prompt"), least=0.5)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages that hold at least half of the words of a test item."""
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The test items that leaked, and into how many documents."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that say the same thing over and over."""
    documents = read_table(spark, folder, "documents")
    return repetition.repetitive_documents(documents, F.col("doc_id"), F.col("text")).select("doc_id").distinct()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated content, and the other statistics, of each document."""
    documents = read_table(spark, folder, "documents")
    return repetition.repetition_statistics(documents, F.col("doc_id"), F.col("text"))


QUERIES = {"p4_found": p4_found, "p4_verdicts": p4_verdicts, "p4_templates": p4_templates, "p5_found": p5_found, "p6_packed": p6_packed, "p6_checks": p6_checks, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_shares": p8_shares}


# ---------------------------------------------------------------- SQL
#: Character references that the SQL decodes; the library decodes all.
_REFERENCES = (("&oslash;", "ø"), ("&aring;", "å"), ("&aelig;", "æ"), ("&Oslash;", "ø"), ("&Aring;", "å"), ("&AElig;", "æ"), ("&nbsp;", " "), ("&amp;", "&"))


def words_sql(text: str) -> str:
    """Words as ``words.words`` has them, as a SQL list."""
    t = f"regexp_replace({text}, '(?i)</?(?:a|abbr|b|em|i|small|span|strong|u)(?:\\s[^<>]*)?/?>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>', ' ', 'g')"
    for reference, char in _REFERENCES:
        t = f"replace({t}, '{reference}', '{char}')"
    t = f"lower(replace({t}, chr(65279), ''))"
    for char, plain in (("ø", "o"), ("æ", "ae"), ("å", "a")):
        t = f"replace({t}, '{char}', '{plain}')"
    return f"regexp_extract_all(regexp_replace(strip_accents({t}), '\\p{{M}}', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _runs_sql(rows: str, key: str, words: str, size: int) -> str:
    """``key, pos, run`` of all runs of ``size`` words in ``rows``."""
    return f"SELECT {key}, pos, array_to_string(list_slice({words}, pos, pos + {size - 1}), ' ') AS run FROM (SELECT *, unnest(range(1, greatest(len({words}) - {size - 2}, 1))) AS pos FROM {rows})"


_LEAKS = f"""WITH i AS (SELECT DISTINCT item_id, {words_sql('prompt')} AS w FROM eval_items WHERE prompt IS NOT NULL), d AS (SELECT DISTINCT doc_id, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL),
    ir AS ({_runs_sql('i', 'item_id', 'w', 6)}), dr AS (SELECT DISTINCT doc_id, run FROM ({_runs_sql('d', 'doc_id', 'w', 6)})),
    hit AS (SELECT doc_id, item_id, count(DISTINCT pos + k) AS n FROM dr JOIN ir USING (run), (SELECT unnest(range(0, 6)) AS k) GROUP BY 1, 2),
    leaks AS (SELECT doc_id, item_id FROM hit JOIN i USING (item_id) WHERE 2 * n >= len(w)) """
_DOC_WORDS = f"list_filter({words_sql('text')}, lambda x: NOT regexp_full_match(x, '[0-9]+'))"
ORACLE = {
    "p6_checks": "SELECT DISTINCT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS overfull, 0 AS split_small, 0 AS broken FROM pack_specs",
    "p7_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM leaks",
    "p7_items": _LEAKS + "SELECT item_id, count(DISTINCT doc_id) AS n_documents FROM leaks GROUP BY 1",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents WHERE text IS NOT NULL), r AS ({_runs_sql('d', 'doc_id', 'w', 5)}),
        again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS place FROM r) WHERE place > 1),
        inside AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1) SELECT DISTINCT doc_id FROM inside JOIN d USING (doc_id) WHERE n >= 0.3 * len(w)""",
}
