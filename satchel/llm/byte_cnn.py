"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a small embedding; filters over 8 bytes slide by 4 bytes over the whole text.  The text is covered by
chunks of 512 bytes that overlap by half, each filter is max-pooled in each chunk, and the document is the mean and the
maximum of its chunks, combined by a logistic unit into one probability.

Fitting takes a bounded sample of labelled rows (``sample_docs``, ``sample_bytes``); documents with contradicting labels
are not used.  Scoring reads all of every text, with the fitted embedding and filters rounded to whole numbers whose
sums are exact: a text's score doesn't depend on its neighbours.  A long text takes a tile and 0.4 bytes a byte.

Null and empty texts are one chunk of padding and get the probability of that chunk.  Repeated rows and ties get equal
scores, an empty table gives an empty result, and without labelled rows of both classes the score is the share of class
1 (0.5 if there are no labels at all).  Further columns are kept as they are, also those named score or predicted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, text_bytes, unused, with_fields

EMBED, STEP, FILTERS, CHUNK = 6, 4, 24, 512
HALF = CHUNK // 2 // STEP  # filter positions in half a chunk
TILE = 64  # half chunks in a tile


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with 0 to whole blocks of STEP bytes, two blocks at least; and block offsets."""
    lengths = np.diff(offsets)
    n = np.maximum(2, -(-lengths // STEP))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1] * STEP, np.uint8)
    shift = np.repeat(at[:-1] * STEP - (offsets[:-1] - offsets[0]), lengths)
    out[np.arange(len(data)) + shift] = data
    return out, at


class ByteCNN:
    def __init__(self, seed: int = 7) -> None:
        g = np.random.Generator(np.random.PCG64(seed))
        f = np.float32
        self.p = {
            "emb": (g.standard_normal((256, EMBED)) * 0.5).astype(f),
            "w1": (g.standard_normal((STEP * EMBED, FILTERS)) * 0.25).astype(f),
            "w2": (g.standard_normal((STEP * EMBED, FILTERS)) * 0.25).astype(f),
            "b": np.zeros(FILTERS, f),
            "v": (g.standard_normal(2 * FILTERS) * 0.1).astype(f),
            "c": np.zeros(1, f),
        }
        self.prior: float | None = None

    def _forward(self, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
        p = self.p
        raw, at = _blocks(data, offsets)
        x = p["emb"][raw].reshape(-1, STEP * EMBED)
        y = x @ p["w1"]
        y[:-1] += (x @ p["w2"])[1:]
        y[at[1:] - 1] = -np.inf  # the last block of a text has no right half
        # half chunks of HALF positions, then chunks of two neighbours
        halves = np.maximum(1, -(-(np.diff(at) - 1) // HALF))
        h_at = np.concatenate([[0], np.cumsum(halves)])
        begin = np.repeat(at[:-1], halves) + HALF * (np.arange(h_at[-1]) - np.repeat(h_at[:-1], halves))
        best = np.maximum.reduceat(y, begin, axis=0)
        last = np.zeros(h_at[-1], bool)
        last[h_at[1:] - 1] = True
        single = np.repeat(halves == 1, halves)
        pair = ~last | single
        chunk = best.copy()
        chunk[:-1] = np.where((~last[:-1])[:, None], np.maximum(best[:-1], best[1:]), best[:-1])
        act = np.maximum(chunk[pair] + p["b"], 0)
        c_n = np.maximum(1, halves - 1)
        c_at = np.concatenate([[0], np.cumsum(c_n)])
        mean = np.add.reduceat(act, c_at[:-1], axis=0) / c_n[:, None]
        top = np.maximum.reduceat(act, c_at[:-1], axis=0)
        feats = np.concatenate([mean, top], 1)
        z = feats @ p["v"] + p["c"]
        if not keep:
            return z
        return z, (raw, x, y, begin, best, last, pair, act, c_n, c_at, top, feats, at)

    def _whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Embedding and filters as whole numbers, and what one unit of their products is worth.

        At most 127 * 2,047 * 2 * STEP * EMBED is below 2^24, so float32 sums of them are exact in any order."""
        p, most = self.p, (127, 2047)
        size = [max(float(max(np.abs(p[k]).max() for k in keys)), 1e-30) for keys in (("emb",), ("w1", "w2"))]
        emb, w1, w2 = (np.rint(p[k].astype(np.float64) * (most[i] / size[i])).astype(np.float32) for k, i in (("emb", 0), ("w1", 1), ("w2", 1)))
        return emb, w1, w2, size[0] * size[1] / (most[0] * most[1])

    def _halves(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each filter's maximum, in units of _whole, over half chunks that begin at these places of texts which end there."""
        (emb, w1, w2, _), width = self._whole(), (HALF + 1) * STEP
        out = np.empty((len(begin), FILTERS), np.float32)
        place, step = np.arange(width), np.arange(HALF)
        for a in range(0, len(begin), TILE):
            at, to = begin[a : a + TILE], end[a : a + TILE]
            n, byte = len(at), at[:, None] + place
            raw = np.where(byte < to[:, None], data[np.minimum(byte, len(data) - 1)], 0) if len(data) else np.zeros((n, width), np.uint8)
            x = emb[raw].reshape(n, HALF + 1, STEP * EMBED)
            y = np.ascontiguousarray(x[:, :-1]).reshape(-1, STEP * EMBED) @ w1
            y += np.ascontiguousarray(x[:, 1:]).reshape(-1, STEP * EMBED) @ w2
            # the last block of a text has no right half; the first position always counts
            blocks = np.maximum(1, -(-(to - at) // STEP) - 1)
            y = np.where((step < blocks[:, None])[:, :, None], y.reshape(n, HALF, FILTERS), -np.inf)
            out[a : a + TILE] = y.max(1)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text; exactly the same for equal texts, whatever stands beside them.

        Filters are applied in whole numbers, and their sums over chunks and features are exact before they are rounded."""
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        lengths, at = np.diff(offsets), offsets[:-1] - offsets[0]
        halves = np.maximum(1, -(-(np.maximum(2, -(-lengths // STEP)) - 1) // HALF))
        h_at = np.concatenate([[0], np.cumsum(halves)])
        begin = np.repeat(at, halves) + HALF * STEP * (np.arange(h_at[-1]) - np.repeat(h_at[:-1], halves))
        best = self._halves(data, begin, np.repeat(at + lengths, halves))
        out, unit = np.empty(len(lengths)), self._whole()[3]
        v, c = self.p["v"].astype(np.float64), float(self.p["c"][0])
        floor = np.rint(self.p["b"].astype(np.float64) / unit)  # the bias in the same units
        for i, (a, b) in enumerate(zip(h_at[:-1].tolist(), h_at[1:].tolist(), strict=True)):
            mine = best[a:b]
            chunk = np.maximum((np.maximum(mine[:-1], mine[1:]) if b - a > 1 else mine) + floor, 0)
            z = math.fsum((np.concatenate([chunk.sum(0) / len(chunk), chunk.max(0)]) * unit * v).tolist()) + c
            out[i] = 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))
        return out

    def _gradients(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray):
        p = self.p
        z, (raw, x, y, begin, best, last, pair, act, c_n, c_at, top, feats, at) = self._forward(data, offsets, True)
        dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) * weight / len(label)).astype(np.float32)
        grads = {"v": feats.T @ dz, "c": np.array([dz.sum()], np.float32)}
        dfeat = dz[:, None] * p["v"][None]
        doc = np.repeat(np.arange(len(c_n)), c_n)
        dact = dfeat[doc, :FILTERS] / c_n[doc, None].astype(np.float32)
        tops = (act == top[doc]).astype(np.float32)  # overlapping chunks may share their maximum
        dact = dact + dfeat[doc, FILTERS:] * tops / np.add.reduceat(tops, c_at[:-1], axis=0)[doc]
        dact = dact * (act > 0)
        grads["b"] = dact.sum(0)
        # of the two halves of a chunk the larger one gets the gradient
        half = np.flatnonzero(pair)
        right = np.where(last[half][:, None], False, best[np.minimum(half + 1, len(best) - 1)] > best[half])
        dhalf = np.zeros_like(best)
        np.add.at(dhalf, half, dact * ~right)
        np.add.at(dhalf, np.minimum(half + 1, len(best) - 1), dact * right)
        # within a half the first position that attains the maximum
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(y))))
        hit = (y == best[owner]) & (dhalf[owner] != 0)
        pos, filt = np.nonzero(hit)
        first = np.unique(owner[pos] * FILTERS + filt, return_index=True)[1]
        pos, filt = pos[first], filt[first]
        dy = dhalf[owner[pos], filt]
        grads["w1"], grads["w2"] = np.zeros_like(p["w1"]), np.zeros_like(p["w2"])
        np.add.at(grads["w1"].T, filt, dy[:, None] * x[pos])
        np.add.at(grads["w2"].T, filt, dy[:, None] * x[pos + 1])
        grads["emb"] = np.zeros_like(p["emb"])
        for w, shift in (("w1", 0), ("w2", 1)):
            dx = (dy[:, None] * p[w].T[filt]).reshape(-1, STEP, EMBED)
            bytes_ = raw.reshape(-1, STEP)[pos + shift]
            np.add.at(grads["emb"], bytes_.ravel(), dx.reshape(-1, EMBED))
        return grads

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch_bytes: int = 1 << 17, rate: float = 0.02, seed: int = 11) -> ByteCNN:
        labels = np.asarray(labels, np.float64)
        if not len(labels) or labels.min() == labels.max():
            self.prior = float(labels.mean()) if len(labels) else 0.5
            return self
        share = np.clip(labels.mean(), 0.02, 0.98)
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        g = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        lengths = np.array([len(t) for t in texts])
        batch_bytes = int(np.clip((lengths + 64).sum() // 24, 1 << 12, batch_bytes))
        step, total = 0, max(1, int(epochs * max(1, lengths.sum() / batch_bytes)))
        for _ in range(epochs):
            order = g.permutation(len(texts))
            ends = np.searchsorted(np.cumsum(lengths[order] + 64), np.arange(batch_bytes, (lengths + 64).sum() + batch_bytes, batch_bytes), "right")
            at = 0
            for to in [*ends[:-1], len(order)]:
                if to <= at:
                    continue
                rows, at = order[at:to], to
                data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
                offsets = np.concatenate([[0], np.cumsum(lengths[rows])])
                grads = self._gradients(data, offsets, labels[rows], weights[rows])
                step += 1
                now = rate * max(0.05, 1 - step / total) * min(1, step / 10)
                for k, d in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.98 * s[k] + 0.02 * d * d
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = 3000, sample_bytes: int = 6 << 20) -> ByteCNN:
    """Fit on at most ``sample_docs`` labelled rows, taken in the order of a hash of doc_id, and ``sample_bytes``."""
    rows = labels.where("quality in (0, 1) and doc_id is not null").where(usable).select("doc_id", "quality")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # one row for each labelled id, so that an id with very many rows sends no more than one text
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, marks, left = [], [], sample_bytes
    for r in found.toLocalIterator():
        raw = r.text.encode()
        if len(raw) <= left:
            left -= len(raw)
            texts.append(raw)
            marks.append(r.quality)
    return ByteCNN().fit(texts, np.array(marks))


def score_quality(docs: DataFrame, model: ByteCNN, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, then score and predicted (with underscores behind, where docs has such columns)."""
    modest_batches(docs.sparkSession)
    score_name, predicted_name = unused(keep, "score", "predicted")
    schema = with_fields(docs.select(*keep).schema, f"{score_name} double, {predicted_name} int")
    carried = list(dict.fromkeys([*keep, "text"]))
    text_at = carried.index("text")

    def score(batches):
        for batch in batches:
            s = model.scores(*text_bytes(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema.fieldNames())

    return docs.select(*carried).mapInArrow(score, schema)


def accepted(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """The rows of docs that the model predicts to be of class 1."""
    scored = score_quality(docs, model, docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, mod 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  A null doc_id counts as not held out."""
    model = fit_quality(docs, labels, fold() != 1)
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
