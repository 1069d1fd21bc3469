"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight vector over sparse word features is shared by the ordered
thresholds, and the expected severity is the sum of these probabilities.

The labels are binary, so the grades of the fitting rows are made from them: 0 is not toxic; toxic rows are graded 1 to
``grades`` by how many words they hold that are typical of toxic rows (by smoothed log odds).  Fitting takes a bounded
sample of labelled rows (``sample_docs``, ``sample_bytes``); scoring reads all words of every text.  Features are
log(1 + count) of at most ``vocabulary`` words and word stems, chosen by their association with the label.

Null and empty texts have no features and get the severity of the thresholds alone.  Rows are scored one by one, so ties
and repeats agree; a long text is read word by word.  Documents with contradicting labels are not used.  Without toxic
and clean labels severity is 0.  An empty table gives an empty table; further columns of docs don't matter.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_cnn import fold
from .shared import modest_batches, with_fields

WORD = re.compile(r"[^\W\d_]+")


STEMS = (3, 4, 5)


def features(text: str | None) -> list[str]:
    """The words of a text in lower case, and the first three, four and five letters of longer words."""
    found = WORD.findall((text or "").lower())
    return [*found, *(f"{w[:n]}*" for n in STEMS for w in found if len(w) > n)]


def counted(text: str | None, known: dict[str, float]) -> Counter:
    """How often each known feature occurs in a text; the same as counting ``features``, without a list of all words."""
    found: Counter = Counter()
    for m in WORD.finditer((text or "").lower()):
        w = m[0]
        if w in known:
            found[w] += 1
        for n in STEMS:
            if len(w) > n and (stem := f"{w[:n]}*") in known:
                found[stem] += 1
    return found


class OrdinalModel:
    def __init__(self, grades: int = 3, vocabulary: int = 4096) -> None:
        self.grades, self.most = grades, vocabulary
        self.weights: dict[str, float] = {}
        self.thresholds = np.full(grades, 40.0)

    def fit(self, texts: list[str], toxic: np.ndarray, steps: int = 300, ridge: float = 0.3) -> OrdinalModel:
        toxic = np.asarray(toxic, int)
        if not len(toxic) or toxic.min() == toxic.max():
            return self
        counts = [Counter(features(t)) for t in texts]
        df = [Counter(), Counter()]
        for c, y in zip(counts, toxic, strict=True):
            df[y].update(c.keys())
        n = np.bincount(toxic, minlength=2)
        odds = {w: np.log((df[1][w] + 0.5) / (n[1] - df[1][w] + 0.5)) - np.log((df[0][w] + 0.5) / (n[0] - df[0][w] + 0.5)) for w in df[1] if df[1][w] >= 3}
        typical = {w for w, o in odds.items() if o > 2}
        strength = np.array([sum(k for w, k in c.items() if w in typical) for c in counts], float)
        cuts = np.quantile(strength[toxic == 1], np.arange(1, self.grades) / self.grades)
        grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, strength, "left"), 0)
        seen = df[0] + df[1]
        lift = {w: abs(df[1][w] / n[1] - df[0][w] / n[0]) / np.sqrt((seen[w] / n.sum()) * (1 - seen[w] / n.sum()) + 1e-9) for w in seen if seen[w] >= 3}
        chosen = sorted(sorted(lift), key=lambda w: -lift[w])[: self.most]
        place = {w: i for i, w in enumerate(chosen)}
        rows, cols, vals = [], [], []
        for i, c in enumerate(counts):
            for w, k in c.items():
                if w in place:
                    rows.append(i)
                    cols.append(place[w])
                    vals.append(np.log1p(k))
        rows, cols, vals = np.array(rows, int), np.array(cols, int), np.array(vals)
        w, t = np.zeros(len(chosen)), np.linspace(1.0, 2.0, self.grades)
        want = (grade[:, None] > np.arange(self.grades)[None]).astype(float)
        m, s = np.zeros(len(w) + self.grades), np.zeros(len(w) + self.grades)
        for step in range(1, steps + 1):
            z = np.bincount(rows, vals * w[cols], len(texts))
            error = (1 / (1 + np.exp(-np.clip(z[:, None] - t[None], -40, 40))) - want) / len(texts)
            g = np.concatenate([np.bincount(cols, vals * error.sum(1)[rows], len(w)) + ridge * w / len(texts), -error.sum(0)])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            move = 0.15 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w, t = w - move[: len(w)], np.maximum.accumulate(t - move[len(w) :])  # thresholds stay ordered
        self.weights = {x: float(v) for x, v in zip(chosen, w, strict=True) if abs(v) > 1e-6}
        self.thresholds = t
        return self

    def probabilities(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1 to grades."""
        found = counted(text, self.weights)
        z = sum(self.weights[x] * np.log1p(found[x]) for x in sorted(found))
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = 6000, sample_bytes: int = 16 << 20) -> OrdinalModel:
    """Fit on at most so many labelled rows, in the order of a hash of doc_id, and bytes."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where(usable).select("doc_id", "toxic")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # one row for each labelled id, so that an id with very many rows sends no more than one text
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, marks, left = [], [], sample_bytes
    for r in found.toLocalIterator():
        size = len(r.text.encode())
        if size <= left:
            left -= size
            texts.append(r.text)
            marks.append(r.toxic)
    return OrdinalModel().fit(texts, np.array(marks))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, severity (expected grade), grade (most thresholds passed with 0.5 or more), score (P of grade 1
    or more), predicted (1 if score >= 0.5).  A null doc_id counts as not held out."""
    modest_batches(docs.sparkSession)
    model = fit_toxicity(docs, labels, fold() != 1)
    schema = with_fields(docs.select("doc_id").schema, "severity double, grade int, score double, predicted int")

    def rows(batches):
        for batch in batches:
            p = np.array([model.probabilities(t) for t in batch.column(1).to_pylist()]).reshape(-1, model.grades)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))], schema.fieldNames())

    scored = docs.select("doc_id", "text").mapInArrow(rows, schema)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "severity", "grade", "score", "predicted")
