"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = sigmoid(w . x - cut[k])`` with ordered cuts and one weight vector for all of them; the expected
severity is the sum of these over k. The model is fitted in numpy on a bounded sample of labelled documents and is a
small table of at most ``FEATURES`` weights, so scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Most labelled documents of each class that are used to fit, and most features that the model keeps.
SAMPLE, FEATURES = 1500, 2000
#: Characters of the longest text that is used to fit.
LONGEST = 200_000
#: Grades above 0, and the weight of the ridge.
GRADES, RIDGE = 3, 2e-5
#: Where labels are 0 or 1 only, a toxic document's grade by its count of marker words: below 3, below 6, or more.
GRADE_COUNTS = (3, 6)
_WORD = re.compile(r"[^\W\d_]+")
_HEAD = 4


def features(word: str) -> tuple[str, ...]:
    """A word stands for itself and, if longer, for its beginning."""
    return (word, word[:_HEAD] + "*") if len(word) > _HEAD else (word,)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def heads(self) -> set[str]:
        return {f.rstrip("*")[:_HEAD] for f in self.weights}

    def scorer(self):
        """A function from a text to (expected severity, grade)."""
        weights, heads, cuts = self.weights, self.heads(), np.array(self.cuts)

        def score(text: str) -> tuple[float, int]:
            seen: Counter = Counter()
            if weights:
                for w in _WORD.findall(text.lower()):
                    if w[:_HEAD] in heads:
                        seen.update(f for f in features(w) if f in weights)
            x = sum(weights[f] * (1 + np.log(n)) for f, n in seen.items())
            above = 1 / (1 + np.exp(np.clip(cuts - x, -500, 500)))
            return float(above.sum()), int((above >= 0.5).sum())

        return score


def _distinct(texts: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Words of the sample's texts, without texts of whose five-word shingles (one of eight, by hash) over half came before:
    copies would make any of their words look like a marker."""
    seen: set[int] = set()
    kept = []
    for text, y in texts:
        words = [sys.intern(w) for w in _WORD.findall(text.lower())]
        shingles = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        own = {h for i, x in enumerate(shingles) if not (h := xxhash.xxh64_intdigest(x)) % 8 or i == 0}
        if len(own & seen) * 2 <= len(own):
            kept.append((words, y))
        seen |= own
    return kept


@dataclass(frozen=True)
class Design:
    """What the regression sees: rows, features and values of the non-zero entries, and the rows' grades."""

    names: list[str]
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    grade: np.ndarray


def design(texts: list[tuple[str, int]]) -> Design | None:
    """Features and grades of labelled texts, or None without both classes or any telling feature.

    Features whose frequency differs between clean and toxic texts beyond chance (chi-squared, corrected for their
    number) and that lean to toxic are kept. Grades above 1 are taken as given. Where labels are only 0 or 1 they say
    nothing of how severe a toxic text is; then its grade is 1 to 3 by its count of marker words, which are kept words
    that clean texts hardly ever have. Such grades order texts by how much they hold, no more.
    """
    rows = _distinct(texts)
    y = np.array([min(t, 1) for _, t in rows])
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return None
    counts = [Counter(f for w in words for f in features(w)) for words, _ in rows]
    held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for c, t in zip(counts, y):
        for f in c:
            held[f][t] += 1
    total, need = n0 + n1, 2 * np.log(max(2, len(held))) + 4
    strength = {}
    for f, (a0, a1) in held.items():
        if a1 < 3 or a1 / n1 <= a0 / n0:
            continue
        a = a0 + a1
        chi = total * (a1 * n0 - a0 * n1) ** 2 / (n1 * n0 * a * (total - a)) if a < total else 0
        if chi >= need:
            strength[f] = chi
    chosen = sorted(strength, key=lambda f: (-strength[f], f))[:FEATURES]
    if not chosen:
        return None
    grade = np.array([min(t, GRADES) for _, t in rows])
    if grade.max() == 1:
        markers = {f for f in chosen if held[f][0] / n0 <= 0.002}
        hits = np.array([sum(any(f in markers for f in features(w)) for w in words) for words, _ in rows])
        grade = np.where(y == 1, 1 + np.searchsorted(GRADE_COUNTS, hits, side="right"), 0)
    index = {f: i for i, f in enumerate(chosen)}
    at = [(i, index[f], 1 + np.log(n)) for i, c in enumerate(counts) for f, n in c.items() if f in index]
    return Design(chosen, *(np.array(x) for x in zip(*at)), grade)


def fit(texts: list[tuple[str, int]], rounds: int = 400) -> Model:
    """Fit on (text, grade) pairs: one weight for each feature, shared by the ordered thresholds, by the likelihood of
    the cumulative-link model with a small ridge. Without both classes the model has no weights and finds nothing
    toxic."""
    d = design(texts)
    if d is None:
        return Model({}, (20.0, 21.0, 22.0))
    n, r, k, v = len(d.grade), d.row, d.feature, d.value
    w, cuts = np.zeros(len(d.names)), np.arange(1.0, GRADES + 1)
    above = (d.grade[:, None] > np.arange(GRADES)).astype(float)
    m1, m2, step = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES), 0.1
    for t in range(1, rounds + 1):
        x = np.bincount(r, weights=v * w[k], minlength=n)
        off = 1 / (1 + np.exp(np.clip(cuts - x[:, None], -500, 500))) - above
        gw = np.bincount(k, weights=v * off.sum(axis=1)[r], minlength=len(w)) / n + RIDGE * w
        g = np.concatenate([gw, -off.mean(axis=0)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, cuts = w - move[: len(w)], np.maximum.accumulate(cuts - move[len(w) :])
        w = np.maximum(w, 0)  # the features chosen lean to toxic
    return Model({f: float(x) for f, x in zip(d.names, w) if x > 0}, tuple(map(float, cuts)))


def _fitted(sample: pa.Table) -> pa.Table:
    rows = sorted(zip(*(sample[c].to_pylist() for c in ("id", "text", "toxic"))))
    model = fit([(text, y) for _, text, y in rows])
    return pa.table({"features": [list(model.weights)], "weights": [list(model.weights.values())], "cuts": [list(model.cuts)]}, pa.schema([("features", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("cuts", pa.list_(pa.float64()))]))


def fit_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on at most ``sample`` labelled documents of each grade, chosen by a hash of their id, of texts of up to
    ``longest`` characters (longer ones are left out of the fit, not cut).

    Labels other than 0 to 3, labels without a document and documents without a label are left out; of several
    documents of one id the first by text counts, of several labels the highest. This sample, at most ``4 * sample``
    texts, meets in one task; the driver gets the weights alone. Empty tables give a model that finds nothing toxic.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").between(0, GRADES))
    own = own.groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).where(F.length("text") <= longest)
    rows = None
    for y in range(GRADES + 1):
        ids = own.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        rows = ids if rows is None else rows.unionAll(ids)
    found = texts.join(F.broadcast(rows), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    fitted = found.select("id", "text", "toxic").groupBy().applyInArrow(_fitted, "features array<string>, weights array<double>, cuts array<double>").first()
    return Model(dict(zip(fitted["features"], fitted["weights"])), tuple(fitted["cuts"])) if fitted else fit([])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            got = [score(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([g for _, g in got], pa.int32())]
            cols.append(pa.array([g > 0 for _, g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_severity", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, expected_severity (0 to 3), grade (most likely to be exceeded less one half the
    time), toxic (grade over 0).

    A null or empty text has no features and is not toxic. Repeated rows get a row each, other columns are not read,
    an empty table gives no rows. A text is read whole; memory grows with its number of words.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_score(model), f"doc_id {kind}, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns. Rules of ``severity``."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        score = model.scorer()
        return texts.map(lambda t: score(t)[1] == 0).astype(bool)

    return docs.where(clean(text_or_empty()))
