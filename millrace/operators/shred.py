"""Nested records as related flat tables.

A record becomes an *adjacency table*: one row per node with its parent, label, ordinal and scalar.
Object nodes are then joined with their scalar children and pivoted into entity tables. Typed structs
go through their JSON text, so both kinds of record become the same nodes.

A record's nodes are made by one task, one after another, and a node's number is its place among them.
``object_nodes`` therefore joins each batch of the adjacency table to itself by row numbers where it is
made, and shuffles nothing; ``objects_of`` is the same join over an adjacency table that was stored.

JSON arrays may come in several shapes (a list, one object, an object keyed by positions, a list's JSON
text in a string); where the corpus shows a list under a pair of labels, all of these under the same pair
count as that list. Text that is no JSON, or is nested too deep to be read, gives a node of kind
``error`` that says so. Null text gives no nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: A pair of labels: that of the enclosing value ("" at the record, and the list's own label for an
#: element of a list) and that of the list.
Pair = tuple[str, str]


# ---------------------------------------------------------------- JSON text
def _read(text: str) -> tuple[object, str | None]:
    """The value of JSON text, or what is wrong with it."""
    try:
        return json.loads(text), None
    except RecursionError:
        return None, "nested too deep"
    except ValueError:
        return None, "no JSON"


def _parsed(text: str | None) -> object:
    return None if text is None else _read(text)[0]


def list_pairs_of(value: object, enclosing: str = "", label: str = "") -> Iterator[Pair]:
    """Pairs of labels under which ``value`` holds a list with an object in it, or one below that."""
    stack = [(value, enclosing, label)]
    while stack:
        v, outer, inner = stack.pop()
        if isinstance(v, dict):
            stack += [(x, inner, k) for k, x in v.items() if isinstance(x, dict | list)]
        elif isinstance(v, list):
            if any(isinstance(x, dict) for x in v):
                yield outer, inner
            stack += [(x, inner, inner) for x in v if isinstance(x, dict | list)]


def list_pairs(df: DataFrame, text: Column, most: int = 100_000) -> frozenset[Pair]:
    """All pairs of labels under which some document holds a list of objects. Their number grows with
    the vocabulary of the documents, not with their count; more than ``most`` is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[Pair] = set()
        for b in batches:
            new = {p for t in b.column(0).to_pylist() for p in list_pairs_of(_parsed(t))} - seen
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.string()) for i in (0, 1)], names=["enclosing", "label"])

    rows = spread(df.select(text.alias("text"))).mapInArrow(run, "enclosing string, label string").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs of labels hold lists; these documents are no records of one kind")
    return frozenset((r[0], r[1]) for r in rows)


def as_list(value: object) -> dict[int, object] | None:
    """The list that a value under a list's label stands for, as values by position in order; null if it
    stands for none. An object whose keys are all positions is that list, however sparse; positions that
    no array can have (beyond 32 bits) make it a single object."""
    if isinstance(value, str):
        if not value.lstrip()[:1] in ("[", "{"):
            return None
        value = _parsed(value)
    if isinstance(value, dict):
        if value and all(k.isdecimal() and k.isascii() and len(k) <= 10 for k in value):
            placed = {int(k): x for k, x in value.items()}
            if max(placed) < 2**31 - 1:
                return dict(sorted(placed.items()))
        return {0: value}
    return dict(enumerate(value)) if isinstance(value, list) else None


def walk(record: object, pairs: frozenset[Pair]) -> Iterator[tuple[int, int | None, str, int | None, str, object, str, str]]:
    """Adjacency rows of one record, parents first: node, parent, label, ordinal, kind (object, list or
    scalar), scalar, path, and the path of the nearest enclosing element of a list (``$`` if none)."""
    count = 0
    stack: list[tuple[object, int | None, str, int | None, str, str, str]] = [(record, None, "", None, "", "", "$")]
    while stack:
        value, parent, label, ordinal, path, enclosing, element = stack.pop()
        node, count = count, count + 1
        placed = as_list(value) if ordinal is None and label and (enclosing, label) in pairs else None
        if placed is None and isinstance(value, list):
            placed = dict(enumerate(value))
        if placed is not None:
            yield node, parent, label, ordinal, "list", None, path, element
            inner = path if ordinal is not None else element
            for i, x in reversed(placed.items()):
                stack.append((x, node, label, i, f"{path}[{i}]", label, inner))
        elif isinstance(value, dict):
            yield node, parent, label, ordinal, "object", None, path, element
            inner = path if ordinal is not None else element
            for k, x in reversed(value.items()):
                stack.append((x, node, k, None, f"{path}.{k}" if path else k, label, inner))
        else:
            yield node, parent, label, ordinal, "scalar", value, path, element


_NODE = (("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.string()), ("element_path", pa.string()))
_ADJACENCY = "record_key string, node int, parent int, label string, ordinal int, kind string, scalar string, path string, element_path string"
#: Nodes after which a batch of the adjacency table is closed, at the end of a record.
_BATCH_NODES = 100_000


def _scalar_text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def adjacency_batches(batches: Iterable[pa.RecordBatch], pairs: frozenset[Pair]) -> Iterator[pa.RecordBatch]:
    """The adjacency table of ``(record_key, text)`` batches, in batches of whole records."""
    keys: list[str | None] = []
    nodes: list[tuple] = []

    def closed() -> pa.RecordBatch:
        columns = list(zip(*nodes, strict=True)) or [()] * len(_NODE)
        columns[5] = [_scalar_text(x) for x in columns[5]]
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _NODE, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *arrays], names=["record_key", *(name for name, _ in _NODE)])

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            record, error = _read(text)
            before = len(nodes)
            if error is None:
                nodes.extend(walk(record, pairs))
            else:
                nodes.append((0, None, "", None, "error", error, "", "$"))
            keys.extend([key] * (len(nodes) - before))
            if len(nodes) >= _BATCH_NODES:
                yield closed()
                keys, nodes = [], []
    yield closed()


def joined_batch(b: pa.RecordBatch, scalars: bool) -> pa.RecordBatch:
    """The object nodes of an adjacency batch of whole records, joined with their scalar children."""
    column = lambda name: b.column(b.schema.get_field_index(name))
    node = column("node").to_numpy(zero_copy_only=False)
    row = np.arange(len(node))
    first = row - node  # the row of the record's first node
    parent = column("parent").fill_null(-1).to_numpy(zero_copy_only=False)
    kind = column("kind")
    is_object = pc.equal(kind, "object").to_numpy(zero_copy_only=False)
    owner = np.where(parent >= 0, first + parent, -1)
    child = (owner >= 0) & is_object[owner]
    is_scalar = pc.equal(kind, "scalar").to_numpy(zero_copy_only=False)
    blank = pc.equal(column("scalar").fill_null(""), "").to_numpy(zero_copy_only=False)
    filled = np.bincount(owner[child & ~(is_scalar & blank)], minlength=len(node))
    at = np.flatnonzero(is_object)
    take = lambda name: column(name).take(pa.array(at))
    path = take("path")
    paths = pc.if_else(pc.equal(path, ""), "$", path)
    if scalars:
        mine = np.flatnonzero(child & is_scalar)
        mine = mine[np.argsort(owner[mine], kind="stable")]
        offsets = np.searchsorted(owner[mine], np.append(at, len(node))).astype(np.int32)
        maps = pa.MapArray.from_arrays(pa.array(offsets), column("label").take(pa.array(mine)), column("scalar").take(pa.array(mine)))
    else:
        maps = pa.nulls(len(at), pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays(
        [take("record_key"), take("node"), take("label"), take("ordinal"), paths, take("element_path"), pa.array(filled[at], pa.int32()), maps],
        names=["record_key", "node", "label", "ordinal", "child_path", "parent_path", "filled", "scalars"],
    )


def _keyed(df: DataFrame, key: Column, text: Column) -> DataFrame:
    return spread(df.select(key.cast("string").alias("record_key"), text.alias("text")))


def adjacency(df: DataFrame, key: Column, text: Column, pairs: Iterable[Pair] | None = None) -> DataFrame:
    """The adjacency table of the JSON documents in ``text``: ``record_key`` and one row per node.
    ``pairs`` as from ``list_pairs``; none for typed records, whose lists are lists."""
    known = frozenset(pairs) if pairs is not None else list_pairs(df, text)
    return _keyed(df, key, text).mapInArrow(lambda batches: adjacency_batches(batches, known), _ADJACENCY)


def object_nodes(df: DataFrame, key: Column, text: Column, pairs: Iterable[Pair] | None = None, scalars: bool = True) -> DataFrame:
    """Object nodes joined with their scalar children: ``record_key, node, label, ordinal, child_path,
    parent_path, filled, scalars``. ``parent_path`` is the nearest enclosing element of a list, ``$`` if
    none; ``filled`` counts values that are neither null nor an empty string; ``scalars`` is a map
    (null if not asked for). Made and joined in the same task."""
    known = frozenset(pairs) if pairs is not None else list_pairs(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (joined_batch(b, scalars) for b in adjacency_batches(batches, known))

    schema = "record_key string, node int, label string, ordinal int, child_path string, parent_path string, filled int, scalars map<string,string>"
    return _keyed(df, key, text).mapInArrow(run, schema)


def struct_text(columns: Iterable[str]) -> Column:
    """The JSON text of struct columns, for ``adjacency`` and ``object_nodes``; null fields are left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))


def objects_of(nodes: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Entity table from a stored adjacency table: the elements of the lists under ``label`` joined with
    their scalar children and pivoted, ``record_key, child_path, parent_path`` and a typed column for each
    of ``columns``. Keys may repeat if the records under one key are the same; a record with a null key has
    no rows here, as it can't be told from others."""
    keyed = nodes.where("record_key IS NOT NULL")
    objects = keyed.where((F.col("kind") == "object") & (F.col("label") == label) & F.col("ordinal").isNotNull())
    children = keyed.where((F.col("kind") == "scalar") & F.col("ordinal").isNull() & F.col("label").isin(list(columns)))
    picked = children.groupBy("record_key", F.col("parent").alias("node")).pivot("label", list(columns)).agg(F.max("scalar"))
    links = objects.select("record_key", "node", F.col("path").alias("child_path"), F.col("element_path").alias("parent_path")).distinct()
    joined = links.join(picked, ["record_key", "node"], "left")
    return joined.select("record_key", "child_path", "parent_path", *[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])


def entity_table(objects: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Pivot of the objects under one label: ``record_key, child_path, parent_path`` and one typed column
    per scalar in ``columns`` (name to type). Scalars that don't fit their type, or are missing, are null."""
    of = objects.where((F.col("label") == label) & F.col("ordinal").isNotNull())
    return of.select("record_key", "child_path", "parent_path", *[F.try_element_at("scalars", F.lit(c)).try_cast(t).alias(f"{c}") for c, t in columns.items()])
