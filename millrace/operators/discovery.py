"""From candidate addresses to one state an entity, over landed tables.

Candidates are made from columns of the entities, made distinct by domain with the strongest source first,
left-joined with the pages that landed under their hosts, judged, and folded into one row an entity. What
fetches pages is elsewhere; an address without a landed page has failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import host, registered_domain, under_any
from millrace.operators.cascade import final_state
from millrace.operators.rank import first_per_group


def candidates(entities: DataFrame, key: str, sources: Sequence[tuple[str, Column]]) -> DataFrame:
    """``key, source, place, url, host`` of the candidate addresses of each entity: one a domain, of the first
    of ``sources`` (name and address column) that has it. Addresses without a host, and null ones, are none.
    An entity has as many candidates as there are sources at most, however often it is delivered."""
    made = F.array(*[F.struct(F.lit(name).alias("source"), F.lit(i).alias("place"), url.alias("url")) for i, (name, url) in enumerate(sources)])
    rows = entities.where(F.col(key).isNotNull()).select(key, F.explode(made).alias("c")).select(key, "c.*")
    rows = rows.withColumn("host", host(F.col("url"))).where("host IS NOT NULL").withColumn("__domain", registered_domain(F.col("url")))
    return first_per_group(rows, [key, "__domain"], [F.col("place"), F.col("url")]).drop("__domain")


def judged(found: DataFrame, pages: DataFrame, gate: Column, blocked: Sequence[str] = ()) -> DataFrame:
    """``found`` with ``state``: ``blocked`` for hosts under ``blocked``, ``failed`` without a row of ``pages``
    (one a ``host``), ``available`` where ``gate`` (over columns of both) holds, else ``ambiguous``."""
    joined = found.join(pages.withColumn("__landed", F.lit(True)), "host", "left")
    state = (
        F.when(under_any(F.col("host"), list(blocked)), "blocked").when(F.col("__landed").isNull(), "failed").when(F.coalesce(gate, F.lit(False)), "available").otherwise("ambiguous")
    )
    return joined.withColumn("state", state).drop("__landed")


def entity_results(entities: DataFrame, key: str, decided: DataFrame, strong: str) -> DataFrame:
    """``key, state, source, url, n_candidates`` of every entity: source and address of its first available
    candidate, and the state by all of them (``cascade.final_state``; ``strong`` is the source whose failure
    makes the entity's). Entities without candidates are there too. Candidates of an entity are bounded by the
    number of sources."""
    per = decided.groupBy(key).agg(
        F.collect_list("state").alias("__states"), F.min(F.when(F.col("state") == "available", F.struct("place", "source", "url"))).alias("__best"),
        F.bool_or((F.col("source") == strong) & (F.col("state") == "failed")).alias("__strong"), F.count("*").alias("n_candidates"),
    )
    joined = entities.select(key).where(F.col(key).isNotNull()).distinct().join(per, key, "left")
    state = final_state(F.col("__states"), F.col("__best").isNotNull(), F.coalesce("__strong", F.lit(False)))
    return joined.select(key, state.alias("state"), F.col("__best.source").alias("source"), F.col("__best.url").alias("url"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
