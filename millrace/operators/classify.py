"""Labels from an injected classifier, batch by batch.

A classifier is any picklable object with ``labels`` and ``scores(texts)``; one that loads a model does so
when it is first asked for scores, once in each worker. Texts go out and scores come back in Arrow batches,
in the stage that reads them; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import spread


class Classifier(Protocol):
    labels: Sequence[str]

    def scores(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """A score for each label, for each text; higher is likelier."""


@dataclass
class WordClassifier:
    """Scores by the words of each label: how many of a text's words are among them, and one half for the
    first label, so that it is the label of texts with none."""

    words: dict[str, frozenset[str]]
    labels: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.labels = list(self.words)

    def scores(self, texts: Sequence[str]) -> list[list[float]]:
        found = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
        return [[sum(w in self.words[label] for w in ws) + (0.5 if i == 0 else 0.0) for i, label in enumerate(self.labels)] for ws in found]


#: Classifiers by name, for queries that name one; others are passed as objects.
FACTORIES = {"words": WordClassifier}


def classified(df: DataFrame, keep: dict[str, Column], text: Column, model: Classifier) -> DataFrame:
    """``keep`` columns, ``label`` and ``confidence`` of each row: the label with the highest score (of equal
    ones the earlier) and its share of all scores, to six places. Null texts have null in both; a text whose
    scores are all 0 has the first label with confidence 0."""
    picked = df.select(*[c.alias(k) for k, c in keep.items()], text.alias("__text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = list(model.labels)
        for b in batches:
            texts = b.column("__text").to_pylist()
            given = iter(model.scores([t for t in texts if t is not None]))
            label: list[str | None] = []
            confidence: list[float | None] = []
            for t in texts:
                if t is None:
                    label.append(None)
                    confidence.append(None)
                    continue
                scores = list(next(given))
                best = max(range(len(labels)), key=lambda i: (scores[i], -i))  # noqa: B023
                total = sum(scores)
                label.append(labels[best])
                confidence.append(round(scores[best] / total, 6) if total else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(label, pa.string()), pa.array(confidence, pa.float64())], names=[*names, "label", "confidence"])

    schema = T.StructType(list(picked.select(*names).schema.fields)).add("label", "string").add("confidence", "double")
    return spread(picked).mapInArrow(run, schema)


def agreement(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``label, n, agreed`` by the first of two label columns; null labels are a label."""
    same = F.col(first).eqNullSafe(F.col(second))
    return rows.groupBy(F.col(first).alias("label")).agg(F.count("*").alias("n"), F.count_if(same).alias("agreed"))
