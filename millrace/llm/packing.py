"""Filling fixed-capacity containers with items.

Best-two-fit. A container is filled greedily, always with the largest item that still fits. Then its
smallest item is taken out again if two unpacked items fill the widened gap more tightly than it did.
An item is split only if it is larger than a container: its full-length pieces fill containers of
their own, the rest is an item like any other.

Items are packed in groups of bounded size (``group_tokens``, ``group_items``), drawn by a hash of their
id, so that no task grows with the corpus; a group leaves at most about one container partly filled
beyond what the fit itself leaves.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage, spread

#: Rank file of a public byte-level BPE for many languages; a parameter, never part of the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """``item_id, n_tokens`` of the non-null texts, in tokens of the tokenizer's file at ``tokenizer``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["item_id", "n_tokens"])

    picked = df.select(key.alias("item_id"), text.alias("text")).where("text IS NOT NULL")
    return spread(picked).mapInArrow(run, picked.select("item_id").schema.add("n_tokens", "long"))


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; every size is from 1 to ``capacity``."""
    pool: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        pool.setdefault(sizes[i], []).append(i)
    order = sorted(pool)  # distinct sizes that are left

    def take(size: int) -> int:
        left = pool[size]
        item = left.pop()
        if not left:
            del pool[size]
            order.pop(bisect_left(order, size))
        return item

    containers = []
    while order:
        gap, held = capacity, []
        while gap > 0 and (k := bisect_right(order, gap)):
            size = order[k - 1]
            held.append((size, take(size)))
            gap -= size
        if gap > 0 and len(held) > 1:
            smallest = held[-1][0]  # sizes were taken in falling order
            if pair := _tightest_pair(order, pool, gap + smallest, smallest):
                size, item = held.pop()
                if size not in pool:
                    order.insert(bisect_left(order, size), size)
                pool.setdefault(size, []).append(item)
                held += [(s, take(s)) for s in pair]
        containers.append([i for _, i in held])
    return containers


def _tightest_pair(order: list[int], pool: dict[int, list[int]], room: int, more_than: int) -> tuple[int, int] | None:
    """Two sizes that are left, with the largest sum that is over ``more_than`` and within ``room``."""
    best, pair = more_than, None
    low, high = 0, bisect_right(order, room) - 1
    while low <= high:
        a, b = order[low], order[high]
        total = a + b
        if total > room or (low == high and len(pool[a]) < 2):
            high -= 1
            continue
        if total > best:
            best, pair = total, (a, b)
            if total == room:
                break
        low += 1
    return pair


#: Copies of an item that one row stands for while they are numbered.
_COPIES = 10_000


def _numbered_copies(counts: DataFrame) -> DataFrame:
    """``item_id, n_tokens, copy``: the rows of ``counts``, copies numbered from 0. They come out of blocks of
    bounded size, which are dealt out where there is more than one."""
    of = ["item_id", "n_tokens"]
    alike = counts.groupBy(*of).agg(F.count("*").alias("copies"))
    last = F.floor((F.col("copies") - 1) / _COPIES)
    single = alike.where(F.col("copies") <= _COPIES).select(*of, "copies", F.lit(0).cast("bigint").alias("block"))
    blocks = alike.where(F.col("copies") > _COPIES).select(*of, "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")).repartition(*of, "block")
    start = F.col("block") * _COPIES
    end = F.least(start + _COPIES, F.col("copies")) - 1
    return single.unionByName(blocks).select(*of, F.explode(F.sequence(start, end)).alias("copy"))


_SCHEMA = "spec_id int, container_id bigint, item_id {kind}, piece int, first_token bigint, n_tokens bigint"


def pack(
    counts: DataFrame, specs: list[tuple[int, int]], group_tokens: int = 4_000_000, group_items: int = 100_000
) -> DataFrame:
    """``spec_id, container_id, item_id, piece, first_token, n_tokens``: where each piece of each item of
    ``counts(item_id, n_tokens)`` goes, for each ``(spec_id, capacity)``.

    An item has one piece unless it is larger than the capacity; ``first_token`` is where the piece
    starts. Items without tokens go to their group's first container. Items with a repeated id are
    packed each; null ids are packed too. Copies of one id and length are counted before anything is
    shuffled and dealt over all groups, so a third of all rows may be copies. ``counts`` is read once for its
    totals and once to be packed: pass a written table."""
    for spec, capacity in specs:
        if capacity <= 0:
            raise ValueError(f"capacity {capacity} of specification {spec} is not positive")
    total, items = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // group_tokens), -(-items // group_items))
    capacities = dict(specs)
    kind = counts.schema["item_id"].dataType.simpleString()
    member = F.pmod(F.xxhash64("item_id", "n_tokens", "copy"), F.lit(groups))
    rows = _numbered_copies(counts).select(F.explode(F.array(*[F.lit(s).cast("int") for s in capacities] or [F.lit(None).cast("int")])).alias("spec_id"), member.alias("grp"), "item_id", "n_tokens")

    def run(table: pa.Table) -> pa.Table:
        spec, group = table.column("spec_id")[0].as_py(), table.column("grp")[0].as_py()
        capacity = capacities[spec]
        ids = table.column("item_id").combine_chunks()
        tokens = table.column("n_tokens").to_pylist()
        ranks = [hash_order(x) for x in ids.to_pylist()]
        order = sorted(range(len(ranks)), key=lambda i: (tokens[i], ranks[i]))
        container, at, piece, first, size = [], [], [], [], []
        small, where = [], []
        count = 0
        empty = []
        for i in order:
            n = tokens[i]
            full = (n - 1) // capacity if n > capacity else 0
            for p in range(full):
                container.append(count)
                at.append(i)
                piece.append(p)
                first.append(p * capacity)
                size.append(capacity)
                count += 1
            if n == 0:
                empty.append(i)
            else:
                small.append(n - full * capacity)
                where.append((i, full))
        for held in best_two_fit(small, capacity):
            for j in held:
                i, full = where[j]
                container.append(count)
                at.append(i)
                piece.append(full)
                first.append(full * capacity)
                size.append(small[j])
            count += 1
        for i in empty:
            container.append(0)
            at.append(i)
            piece.append(0)
            first.append(0)
            size.append(0)
        n = len(at)
        return pa.table(
            {
                "spec_id": pa.array([spec] * n, pa.int32()),
                "container_id": pa.array(np.array(container, np.int64) * groups + group),
                "item_id": ids.take(pa.array(at, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "first_token": pa.array(first, pa.int64()),
                "n_tokens": pa.array(size, pa.int64()),
            }
        )

    return rows.where("spec_id IS NOT NULL").groupBy("spec_id", "grp").applyInArrow(run, _SCHEMA.format(kind=kind))


def hash_order(value: object) -> tuple[bool, str]:
    """A total order of ids of any type, nulls last; makes packing independent of the order of rows."""
    return value is None, str(value)


def pack_texts(documents: DataFrame, key: Column, text: Column, specs: DataFrame, tokenizer: str = TOKENIZER, **bounds: int) -> DataFrame:
    """Pack the texts of ``documents`` for each row of ``specs(spec_id, capacity_tokens)``, a small table
    read by the driver (at most 1,000 rows). Texts are tokenised once; their lengths are written to the
    shared checkpoint folder, and only ids and lengths are shuffled."""
    wanted = specs.select("spec_id", "capacity_tokens").where("spec_id IS NOT NULL AND capacity_tokens IS NOT NULL").distinct().limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1,000 specifications")
    return pack(cut_lineage(token_counts(documents, key, text, tokenizer)), [(int(r[0]), int(r[1])) for r in wanted], **bounds)
