"""Passages of held-out test items in a corpus.

Wu-Manber multi-pattern search over words. The patterns are all runs of ``run`` words of the items. A
table over blocks of two words says how far a window may move on (a word of no pattern lets it jump
past that word), a hash of the window selects the patterns that may stand there, and words are
compared directly before an occurrence counts. Whole documents are searched, where they lie: nothing
of the corpus is shuffled or collected.

The items are a stated query set held by each worker, in blocks of at most about ``block_words`` words,
as arrays. A document's words are made once for ``blocks_at_once`` blocks; with more, the corpus is read
once for each so many.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import words
from millrace.session import spread


class PhraseIndex:
    """Search tables of the word runs of some items. Items shorter than a run have none."""

    def __init__(self, items: list[tuple[object, list[str]]], run: int = 6):
        self.run = run
        self.keys = [k for k, _ in items]
        self.lengths = [len(w) for _, w in items]
        self.ids: dict[str, int] = {}
        for _, ws in items:
            for w in ws:
                self.ids.setdefault(w, len(self.ids))
        self.base = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.flat = array("l")
        self.starts: list[int] = []
        found: list[tuple[int, int, int]] = []
        for item, (_, ws) in enumerate(items):
            coded = [self.ids[w] for w in ws]
            self.starts.append(len(self.flat))
            self.flat.extend(coded)
            for start in range(len(coded) - run + 1):
                window = tuple(coded[start : start + run])
                for end in range(1, run):
                    block = window[end - 1] * self.base + window[end]
                    self.shift[block] = min(self.shift.get(block, run), run - 1 - end)
                found.append((hash(window), item, start))
        found.sort()
        self.hashes = array("q", [h for h, _, _ in found])
        self.items, self.places = array("l", [i for _, i, _ in found]), array("l", [p for _, _, p in found])

    def _standing(self, window: list[int]) -> Iterator[tuple[int, int]]:
        """Item and start of the patterns that are the window, word for word. The hash of a tuple of integers
        is the same in every process."""
        h = hash(tuple(window))
        for k in range(bisect_left(self.hashes, h), bisect_right(self.hashes, h)):
            first = self.starts[self.items[k]] + self.places[k]
            if self.flat[first : first + self.run].tolist() == window:
                yield self.items[k], self.places[k]

    def covered(self, document: list[str]) -> dict[int, int]:
        """For each item with a run in ``document``: the bits of its covered word positions."""
        run, base, default, shift = self.run, self.base, self.run - 1, self.shift
        get = self.ids.get
        coded = [get(w, -1) for w in document]
        found: dict[int, int] = {}
        ones = (1 << run) - 1
        at, n = run - 1, len(coded)
        while at < n:
            last = coded[at]
            if last < 0:
                at += run
                continue
            before = coded[at - 1]
            if before < 0:
                at += run - 1
                continue
            block = before * base + last
            step = shift.get(block, default)
            if step:
                at += step
                continue
            for item, start in self._standing(coded[at - run + 1 : at + 1]):
                found[item] = found.get(item, 0) | (ones << start)
            at += 1
        return found


def leaked_passages(
    documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, prompt: Column, run: int = 6, least: float = 0.0, block_words: int = 500_000, blocks_at_once: int = 4
) -> DataFrame:
    """``doc_id, item_id, covered_words, item_words``: documents that hold runs of at least ``run``
    consecutive words of an item, and how many of the item's words such runs cover together, if they are at
    least the share ``least`` (told where the document is searched, so that a phrase of many items gives no
    rows for each).

    Null or short prompts and null texts match nothing. A document or item delivered twice gives the
    same row twice; take distinct rows. Columns are renamed inside, so extra ones never clash."""
    picked = documents.select(doc_id.alias("doc_id"), text.alias("text"))
    queries = items.select(item_id.alias("item_id"), prompt.alias("prompt")).where("prompt IS NOT NULL")
    size = queries.agg(F.coalesce(F.sum(F.length("prompt")), F.lit(0))).first()[0]
    blocks = 1 + size // (6 * block_words)
    schema = picked.select("doc_id").schema.add(queries.schema["item_id"]).add("covered_words", "integer").add("item_words", "integer")
    context = documents.sparkSession.sparkContext
    text_rows = picked.where("text IS NOT NULL")
    out = None
    for first in range(0, blocks, blocks_at_once):
        indexes = []
        for block in range(first, min(first + blocks_at_once, blocks)):
            part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
            indexes.append(context.broadcast(PhraseIndex([(r[0], words(r[1])) for r in part.distinct().collect()], run)))
        found = spread(text_rows).mapInArrow(_search(indexes, least), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(indexes: list, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[PhraseIndex] = [x.value for x in indexes]
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                ws = words(t)
                for table in tables:
                    for item, bits in table.covered(ws).items():
                        if (n := bits.bit_count()) >= least * table.lengths[item]:
                            rows.append((i, table.keys[item], n, table.lengths[item]))
            if rows:
                at, keys, covered, lengths = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int32())), pa.array(keys), pa.array(covered, pa.int32()), pa.array(lengths, pa.int32())],
                    names=["doc_id", "item_id", "covered_words", "item_words"],
                )

    return run
