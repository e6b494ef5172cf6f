"""Repetition inside single documents.

A decision list, learned from labelled statistics of a bounded sample, sorts all documents: its rules say
which are *varied*, what no rule covers is *repetitive*. The statistics it reads are cheap shares of
repeated phrases, words, lines and sentences; the quantity the labels are made from, the share of words in
passages that occurred before, is none of them. What the list calls repetitive is then counted exactly.
Nothing of the corpus is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.decision_list import Condition, DecisionList, learn
from millrace.llm.words import words_but_numbers
from millrace.session import spread

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words of a phrase, whose repetition is a statistic, and of a passage, whose repetition counts.
PHRASE, PASSAGE = 3, 5
#: Statistics in the order in which the learner prefers them; all are shares from 0 to 1.
STATISTICS = ("repeated_phrases", "repeated_vocabulary", "repeated_lines", "repeated_sentences", "top_phrase_share")


def coded(words: list[str]) -> np.ndarray:
    """64-bit codes of words."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit codes of the runs of ``size`` words."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * _MIX + codes[i : n + i]
    return out


def repeated_in(codes: np.ndarray, passage: int = PASSAGE) -> int:
    """Number of words that lie in passages of at least ``passage`` words that occurred before, starting
    earlier, in the same document; words as ``coded``."""
    n = len(codes)
    if n <= passage:
        return 0
    windows = _windows(codes, passage)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    again = np.zeros(windows.size, bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    edges[: windows.size] += again
    edges[passage : passage + windows.size] -= again
    return int((np.cumsum(edges)[:n] > 0).sum())


def repeated_words(words: list[str], passage: int = PASSAGE) -> int:
    """As ``repeated_in``, of words."""
    return repeated_in(coded(words), passage)


def repeated_words_plainly(words: list[str], passage: int = PASSAGE) -> int:
    """As ``repeated_words``, word by word from the definition: what samples are labelled by."""
    seen: set[tuple[str, ...]] = set()
    inside = [False] * len(words)
    for i in range(len(words) - passage + 1):
        window = tuple(words[i : i + passage])
        if window in seen:
            inside[i : i + passage] = [True] * passage
        seen.add(window)
    return sum(inside)


def _repeated_part(units: list[str]) -> float:
    """Share of characters in units that stood before."""
    total = sum(map(len, units))
    if not total or len(units) < 2:
        return 0.0
    counts = Counter(units)
    return sum((c - 1) * len(u) for u, c in counts.items() if c > 1) / total


def statistics_of(text: str | None) -> tuple[int, float, float, float, float, float]:
    """Words, and STATISTICS, of a text; all zero for null, blank and wordless texts."""
    return _statistics_of(text, words_but_numbers(text))


def _statistics_of(text: str | None, ws: list[str]) -> tuple[int, float, float, float, float, float]:
    n = len(ws)
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    phrases = np.sort(_windows(coded(ws), PHRASE))
    again, top = 0.0, 0.0
    if phrases.size > 1:
        starts = np.flatnonzero(np.concatenate(([True], phrases[1:] != phrases[:-1])))
        again = (phrases.size - starts.size) / n
        most = int(np.diff(np.append(starts, phrases.size)).max())
        top = min(1.0, PHRASE * most / n) if most > 1 else 0.0
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    sentences = [x for x in map(str.strip, _SENTENCE_END.split(text)) if x]
    return n, again, 1 - len(set(ws)) / n, _repeated_part(lines), _repeated_part(sentences), top


def bounds_of(share: float) -> dict[str, float]:
    """What a document with the ``share`` of words in repeated passages has of some statistics at least.

    Every word of a repeated passage occurred before, so the share of repeated words is no less. Of the
    words of a repeated passage all but the last two start a repeated phrase, and so do, where passages
    overlap, no fewer than three fifths: the share of repeated phrases is no less than that of ``share``."""
    return {"repeated_phrases": share * (PASSAGE - PHRASE + 1) / PASSAGE - 1e-9, "repeated_vocabulary": share - 1e-9}


def repetition_statistics(documents: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, n_words, repeated_words, repeated_share`` and STATISTICS of each document. Null and empty
    texts have no words and share 0; repeated ids give a row each."""

    def of(t: str | None) -> tuple:
        ws = words_but_numbers(t)
        n, *rest = _statistics_of(t, ws)
        repeated = repeated_words(ws)
        return n, repeated, repeated / n if n else 0.0, *rest

    picked = spread(documents.select(doc_id.alias("doc_id"), text.alias("text")))
    return _counted(picked, of, {"n_words": "long", "repeated_words": "long", "repeated_share": "double", **dict.fromkeys(STATISTICS, "double")})


_ARROW = {"long": pa.int64(), "double": pa.float64()}


def _counted(picked: DataFrame, of: Callable[[str | None], tuple], columns: dict[str, str], keep_text: bool = False) -> DataFrame:
    """``doc_id`` (and ``text``) of ``picked`` and what ``of`` says of each text."""
    kept = ["doc_id", "text"] if keep_text else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(of, b.column("text").to_pylist()), strict=True)) or [()] * len(columns)
            made = [pa.array(c, _ARROW[kind]) for c, kind in zip(found, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + made, names=[*kept, *columns])

    schema = picked.select(*kept).schema
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return picked.mapInArrow(run, schema)


def guarded(rules: DecisionList, share: float) -> DecisionList:
    """``rules`` for varied documents, made safe for every document: a rule that asks for no statistic below
    what a repetitive document has at least (``bounds_of``) is given that condition too. So whatever the
    sample taught, no repetitive document meets a rule."""
    bounds = bounds_of(share)
    name = next(iter(bounds))
    safe = lambda c: not c.at_least and c.threshold <= bounds.get(c.statistic, -1.0)
    wider = lambda c: c.statistic == name and not c.at_least
    kept = [r if any(map(safe, r)) else (*(c for c in r if not wider(c)), Condition(name, False, bounds[name])) for r in rules.rules]
    return DecisionList(rules.positive, rules.negative, kept)


def fitted_list(rows: list[dict], share: float) -> DecisionList:
    """The guarded list learned from labelled statistics. A sample that teaches nothing (one label only, or
    rules worth nothing on the part they are pruned on) gives the list without rules: then every document
    counts as repetitive until its count says otherwise, and none is lost."""
    thresholds = {s: sorted({*(round(0.05 * i, 2) for i in range(1, 20)), *([bounds_of(share)[s]] if s in bounds_of(share) else [])}) for s in STATISTICS}
    return guarded(learn(rows, "label", "varied", "repetitive", thresholds), share)


def learned_list(documents: DataFrame, doc_id: Column, text: Column, share: float = 0.3, sample: int = 4000) -> DecisionList:
    """The decision list that tells varied documents from those whose repeated share may be ``share``.

    It is fitted on at most ``sample`` documents, those with the smallest hashes of their ids (the bound on
    what is fitted; everything else covers all documents), labelled word by word from the definition.
    Their statistics, not their texts, are sorted. Thresholds are multiples of 0.05 and the bounds."""
    picked = documents.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id).alias("draw"))
    count = documents.count()
    if count > 2 * sample:
        picked = picked.where(F.col("draw") < F.lit(int(-(2**63) + 2**64 * (2 * sample / count))))
    picked = picked.select(F.struct("draw", "doc_id").alias("doc_id"), "text")

    def of(t: str | None) -> tuple:
        ws = words_but_numbers(t)
        return *_statistics_of(t, ws), repeated_words_plainly(ws)

    drawn = _counted(spread(picked), of, {"n_words": "long", **dict.fromkeys(STATISTICS, "double"), "by_definition": "long"})
    rows = []
    for r in drawn.orderBy(*drawn.columns).limit(sample).drop("doc_id").collect():
        row = {s: r[s] for s in STATISTICS}
        row["label"] = "repetitive" if r["n_words"] and r["by_definition"] >= share * r["n_words"] else "varied"
        rows.append(row)
    return fitted_list(rows, share)


def suspected_documents(documents: DataFrame, doc_id: Column, text: Column, rules: DecisionList) -> DataFrame:
    """``doc_id, text`` and statistics of the documents that ``rules`` calls repetitive."""
    picked = spread(documents.select(doc_id.alias("doc_id"), text.alias("text")).where("text IS NOT NULL"))
    rows = _counted(picked, statistics_of, {"n_words": "long", **dict.fromkeys(STATISTICS, "double")}, keep_text=True)
    return rows.where((F.col("n_words") > 0) & (rules.column() == "repetitive"))


def repetitive_documents(documents: DataFrame, doc_id: Column, text: Column, share: float = 0.3, sample: int = 4000) -> DataFrame:
    """``doc_id, n_words, repeated_words`` of the documents that the learned list calls repetitive and whose
    exact count confirms it. Null and wordless texts are not repetitive; repeated ids give a row each."""
    suspected = suspected_documents(documents, doc_id, text, learned_list(documents, doc_id, text, share, sample))

    def of(t: str) -> tuple[int, int]:
        ws = words_but_numbers(t)
        return len(ws), repeated_words(ws)

    rows = _counted(suspected.select("doc_id", "text"), of, {"n_words": "long", "repeated_words": "long"})
    return rows.where(F.col("repeated_words") >= F.lit(share) * F.col("n_words"))
