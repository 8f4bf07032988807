"""A quality classifier from positive and unlabelled text (non-negative PU learning).

Trusted positives are training rows labelled 1; every other training text is unlabelled, and
labels of 0 are used for nothing but the class prior (the share of 1 among the training
labels). A small network on dense text statistics minimises the non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
in numpy on the driver, over samples of at most MAX_POSITIVE and MAX_UNLABELLED rows (the
documented bounds). Scoring reads every whole text, a few MB at a time.

Nulls: a null text is scored as the empty one; rows with a null label are not used. Empty tables
give no rows; without training labels every score is the default prior. Other columns of docs
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm import common as C

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
MODULUS, REMAINDER = 3, 1
MARKS = b"!#$%&*|.,;:?/<>=@-_(){}[]\"'"


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each document."""
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    s, e, doc = C.word_bounds(data, offsets, C.SPACE)
    n_words = np.bincount(doc, minlength=docs).astype(np.float64)
    some, words = np.maximum(size, 1), np.maximum(n_words, 1)
    rank = np.arange(docs)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offsets[1:]] - c[offsets[:-1]]) / some

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, docs) / words

    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:], kinds[10] = 1, 2, 3, 4, 5
    kind = kinds[data]
    length = (e - s).astype(np.float64)
    h = C.spans_hash(data, s, e)
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(len(s), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, docs)
    line = np.zeros(256, bool)
    line[10] = True
    ls, le, ld = C.word_bounds(data, offsets, line)
    lh = C.spans_hash(data, ls, le)
    lo = np.lexsort((lh, ld))
    lf = np.ones(len(ls), bool)
    lf[1:] = (lh[lo][1:] != lh[lo][:-1]) | (ld[lo][1:] != ld[lo][:-1])
    lines = np.maximum(np.bincount(ld, minlength=docs), 1)
    last = data[e - 1] if len(e) else data[:0]
    first = data[s] if len(s) else data[:0]
    second = data[np.minimum(s + 1, max(len(data) - 1, 0))] if len(s) else data[:0]
    mean = per_word(length)
    cols = [
        np.log1p(size), np.log1p(n_words), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)),
        *(share(kind == k) for k in range(1, 6)), *(share(data == m) for m in MARKS),
        per_word(same), distinct / words, np.log1p(n_words) * distinct / words, np.bincount(ld[lo], lf, docs) / lines, np.log1p(lines),
        per_word(length == 1), per_word(length > 20), per_word(kinds[last] == 0), per_word(last == ord(".")), per_word(last == ord(",")),
        per_word((kinds[first] == 1) & (kinds[second] == 1)), per_word(kinds[first] == 0),
    ]
    out = np.stack(cols, 1)
    out[size == 0] = 0
    return np.sign(out) * np.minimum(np.abs(out), 30) if len(rank) else out


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, off in C.text_chunks(b, "text"):
            x = features(data, off).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])


def _matrix(texts: DataFrame) -> np.ndarray:
    rows = texts.select("text").mapInArrow(_map_features, "x binary").toPandas()["x"]
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64) if len(rows) else np.zeros((0, 1))


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"])
    return hidden, hidden @ net["w2"] + net["b2"]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, rate: float = 0.01, seed: int = 3) -> dict:
    """Non-negative PU risk with the logistic loss, by Adam on mini-batches."""
    both = np.concatenate([positive, unlabelled])
    rng, d = np.random.default_rng(seed), both.shape[1]
    net = {"mean": both.mean(0), "scale": both.std(0) + 1e-3, "w1": rng.normal(0, d**-0.5, (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(())}
    moments = {k: [np.zeros_like(net[k]), np.zeros_like(net[k])] for k in ("w1", "b1", "w2", "b2")}
    step, batches = 0, max(1, min(len(positive), len(unlabelled)) // 500)
    for epoch in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True):
            x = np.concatenate([positive[p], unlabelled[u]])
            h, z = _forward(net, x)
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            zp, zu = z[: len(p)], z[len(p) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = np.empty(len(z))
            if negative >= 0:
                g[: len(p)] = prior * ((q[: len(p)] - 1) - q[: len(p)]) / len(p)
                g[len(p) :] = q[len(p) :] / len(u)
            else:  # the bound is broken: climb back
                g[: len(p)] = prior * q[: len(p)] / len(p)
                g[len(p) :] = -q[len(p) :] / len(u)
            back = np.outer(g, net["w2"]) * (1 - h**2)
            grads = {"w2": h.T @ g, "b2": g.sum(), "w1": ((x - net["mean"]) / net["scale"]).T @ back + 1e-4 * net["w1"], "b1": back.sum(0)}
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, v in grads.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * v, 0.999 * m[1] + 0.001 * v**2
                net[k] = net[k] - lr * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The trained network; {"constant": prior} where there is nothing to learn from."""
    known = labels.where(F.col("quality").isin(0, 1) & ~C.held_out(F.col("doc_id"), MODULUS, REMAINDER))
    prior = known.agg(F.avg("quality")).first()[0]
    positive = _matrix(C.labelled(docs, labels, "quality", MODULUS, REMAINDER, 1, MAX_POSITIVE))
    rest = docs.select("doc_id", "text").where(~C.held_out(F.col("doc_id"), MODULUS, REMAINDER))
    unlabelled = _matrix(C.bounded(rest, MAX_UNLABELLED, seed=12))
    if prior is None or not 0 < prior < 1 or not len(positive) or not len(unlabelled):
        return {"constant": 0.5 if prior is None else float(prior)}
    return train(positive, unlabelled, float(prior))


def _map_score(net: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, off in C.text_chunks(b, "text"):
                if "constant" in net:
                    p = np.full(n, net["constant"])
                else:
                    p = 1 / (1 + np.exp(-np.clip(_forward(net, features(data, off))[1], -30, 30)))
                yield C.with_columns(b.slice(at, n), {"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return run


def score(docs: DataFrame, net: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    rows = docs.select("doc_id", C.held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(_map_score(net), "doc_id long, held_out boolean, score double, predicted int")


def _map_keep(net: dict):
    score_rows = _map_score(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.struct_field(b.column("row"), "text")
            good = [x.column("predicted") for x in score_rows(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))]
            if good:
                yield b.filter(pc.equal(pa.concat_arrays(good), 1))

    return run


def keep_good(docs: DataFrame, net: dict) -> DataFrame:
    """The documents that score at least a half, with all their columns, whatever their names."""
    rows = docs.select(C.packed(docs))
    return rows.mapInArrow(_map_keep(net), rows.schema).select("row.*")
