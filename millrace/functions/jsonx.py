"""JSON text: kinds and paths, with missing told from null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_kind(text: Column, path: str) -> Column:
    """``missing``, ``null``, ``boolean``, ``number``, ``string``, ``array`` or ``object`` at ``path``; null
    for text that is no JSON."""
    document = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(document.isNull(), F.lit(None)).otherwise(
        F.when(kind.isNull(), "missing")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(F.startswith(kind, F.lit("OBJECT")), "object")
        .otherwise("number")
    )


def json_read(text: Column, path: str, kind: str) -> Column:
    """The value at ``path`` as ``kind``; null if it is missing, null or of another kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def canonical_map(value: Column) -> Column:
    """JSON text of a map with sorted keys: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
