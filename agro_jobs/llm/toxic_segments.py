"""Toxic passages by maximum-scoring segment search over token log-odds.

A token (lower-cased word) has three features: the word, its first four and its first five
characters. A feature's log-odds compare in how many contexts (the word with its neighbours) of
toxic and clean training texts it occurs, so that copies count once; the Dirichlet prior is worth
PRIOR contexts a feature, split between the classes as all counts are. A token's log-odds are the largest of its features', where at least SIGNIFICANT standard
errors above 0, and 0 elsewhere: what speaks for clean text makes a passage no less toxic. Its
score is that less DRIFT.

All maximal segments are found in time linear in the words (Ruzzo and Tompa). Their significance
follows the extreme-value law of such segments (Karlin and Altschul): lambda from the scores of
non-toxic text, evidence = lambda * S - ln(words). A document's evidence is that of the best of
its r strongest segments taken together, by the law of sums of such segments. A logistic fit on
rows not used for the counts turns it into the document's score.

Fitting reads about MAX_ROWS distinct labelled training rows of each class (the documented bound);
counts and log-odds are columns, and only features that raise a score reach the driver. Scoring
reads every whole text, a MB of texts (or one text) at a time.

Nulls: a null text is scored as the empty one; rows with a null label are not used. Rows that
repeat an id are scored each, and taught each if their texts differ. Evidence is null and the
score 0 where no token speaks for toxicity, and without training labels. Empty tables give no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm import common as C

MAX_ROWS, DRIFT, PRIOR, SIGNIFICANT = 8_000, 1.0, 1.0, 4.0
MODULUS, REMAINDER, CUT = 4, 2, 0.3
NEAR_BITS = 20
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[128:] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and three feature hashes of every token."""
    data = C.LOWER[data]
    s, e, doc = C.word_bounds(data, offsets, SEPARATOR)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    index = np.searchsorted(begins, s)
    begins = np.append(begins, np.full(6, len(data)))
    kinds = [C.spans_hash(data, s, e)] + [C.mix(C.spans_hash(data, s, np.minimum(e, begins[index + k])) + np.uint64(k)) for k in (4, 5)]
    return doc, np.stack(kinds)


def _map_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """half, toxic, context and the token's features, once for each context of a chunk."""
    for b in batches:
        sides = 2 * b.column("half").to_numpy() + b.column("toxic").to_numpy()
        for at, _, data, off in C.text_chunks(b, "text"):
            doc, kinds = tokens(data, off)
            word, side = kinds[0], sides[at + doc].astype(np.int64)
            before, after = np.zeros_like(word), np.zeros_like(word)
            before[1:], after[:-1] = np.where(doc[1:] == doc[:-1], word[:-1], 0), np.where(doc[1:] == doc[:-1], word[1:], 0)
            context = C.mix(before * np.uint64(3) + word + after * np.uint64(7))
            order = np.lexsort((side, context))
            some = order[np.append(True, (context[order][1:] != context[order][:-1]) | (side[order][1:] != side[order][:-1]))] if len(order) else order
            cols = [(side[some] // 2).astype(np.int32), (side[some] % 2).astype(np.int32), context[some].view(np.int64), *(k[some].view(np.int64) for k in kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["half", "toxic", "context", "f0", "f1", "f2"])


def counts(rows: DataFrame) -> DataFrame:
    """feature, t0, c0, t1, c1: in how many toxic and clean contexts of each half it occurs. rows: text, toxic, half."""
    seen = rows.select("text", "toxic", "half").mapInArrow(_map_contexts, "half int, toxic int, context long, f0 long, f1 long, f2 long").dropDuplicates(["half", "toxic", "context"])
    one = seen.select("half", "toxic", F.explode(F.array("f0", "f1", "f2")).alias("feature"))
    return one.groupBy("feature").agg(*[F.count_if((F.col("toxic") == y) & (F.col("half") == k)).alias(f"{name}{k}") for k in (0, 1) for name, y in (("t", 1), ("c", 0))])


def log_odds(seen: DataFrame, halves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features that raise a token's score, sorted, and their log-odds, by what the halves of the sample have taught."""
    both = seen.select("feature", *[sum(F.col(f"{name}{k}") for k in halves).alias(name) for name in ("t", "c")])
    all_t, all_c = both.agg(F.sum("t"), F.sum("c")).first()
    if not all_t or not all_c:
        return np.zeros(0, np.uint64), np.zeros(0)
    share = all_t / (all_t + all_c)
    t, c = F.col("t") + PRIOR * share, F.col("c") + PRIOR * (1 - share)
    delta, sigma = F.log(t / share) - F.log(c / (1 - share)), F.sqrt(1 / t + 1 / c)
    found = both.select("feature", delta.alias("delta"), sigma.alias("sigma")).where((F.col("delta") > DRIFT) & (F.col("delta") >= SIGNIFICANT * F.col("sigma"))).toPandas()
    keys, odds = found["feature"].to_numpy(np.int64).view(np.uint64), found["delta"].to_numpy(float)
    order = np.argsort(keys)
    return keys[order], odds[order]


def lookup(odds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-odds with a table of which leading bits occur."""
    near = np.zeros(1 << NEAR_BITS, bool)
    near[(odds[0] >> np.uint64(64 - NEAR_BITS)).astype(np.int64)] = True
    return (near, *odds)


def token_scores(table: tuple[np.ndarray, np.ndarray, np.ndarray], kinds: np.ndarray) -> np.ndarray:
    near, keys, odds = table
    best = np.zeros(kinds.shape[1])
    for row in kinds:
        pick = np.flatnonzero(near[(row >> np.uint64(64 - NEAR_BITS)).astype(np.int64)])
        if len(pick):
            at = np.minimum(np.searchsorted(keys, row[pick]), len(keys) - 1)
            best[pick] = np.maximum(best[pick], np.where(keys[at] == row[pick], odds[at], 0))
    return best - DRIFT


def segments(at: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of a sequence that is -DRIFT but at the given positions.

    Ruzzo and Tompa's single pass, over the positive tokens only: what lies between two of them
    is known from their distance.
    """
    done: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for p, x in zip(at.tolist(), scores.tolist(), strict=True):
        total -= DRIFT * (p - last - 1)
        cur, last = (p, p, total, total + x), p
        total += x
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= cur[2]:
                j -= 1
            if j < 0 or done[j][3] >= cur[3]:
                done.append(cur)
                break
            cur = (done[j][0], cur[1], done[j][2], cur[3])
            del done[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in done]


def _documents(table: tuple, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Document, words, segments, for documents with any."""
    doc, kinds = tokens(data, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    score = token_scores(table, kinds)
    up = np.flatnonzero(score > 0)
    begin = np.cumsum(n) - n
    for d, idx in zip(*_split(doc[up], up), strict=True):
        yield d, int(n[d]), segments(idx - begin[d], score[idx])


def _split(doc: np.ndarray, up: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(doc):
        return [], []
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    return doc[np.concatenate([[0], cut])].tolist(), np.split(up, cut)


def together(each: np.ndarray) -> float:
    """The evidence of a document from its segments': the best sum of the r strongest.

    The chance that r segments reach the sum T is about exp(-T) T^(r-1) / (r! (r-1)!); each further
    segment costs a factor of two, as r is chosen after the fact.
    """
    total, best, fact = 0.0, -math.inf, 0.0  # fact: ln (r! (r-1)!)
    for r, x in enumerate(np.sort(each)[::-1].tolist(), 1):
        total += x
        if r > 1:
            fact += math.log(r) + math.log(r - 1)
            if x <= 0 or total <= r - 1:  # no surprise to be added
                break
        best = max(best, total - (r - 1) * (math.log(max(total, 1)) + math.log(2)) + fact)
    return best


def _map_evidence(table, model):
    """A document's evidence (null: no token speaks for toxicity), score, and its significant passages."""

    def run(batches):
        for b in batches:
            for at, n, data, off in C.text_chunks(b, "text"):
                best, spans = np.full(n, np.nan), [[] for _ in range(n)]
                for d, words, found in _documents(table.value, data, off):
                    each = model["lambda"] * np.array([s for _, _, s in found]) - np.log(max(words, 1))
                    best[d] = together(each)
                    spans[d] = [{"first": a, "last": z, "evidence": x} for (a, z, _), x in zip(found, each.tolist(), strict=True) if x > model["significant"]]
                none = np.isnan(best)
                p = np.where(none, 0.0, 1 / (1 + np.exp(-np.clip(model["a"] * np.where(none, 0, best) + model["b"], -30, 30))))
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))
                yield C.with_columns(b.slice(at, n), {"evidence": pa.array(best, mask=none), "score": p, "predicted": (p >= CUT).astype(np.int32), "passages": pa.array(spans, kind)})

    return run


PASSAGES = "evidence double, score double, predicted int, passages array<struct<first: int, last: int, evidence: double>>"


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple, dict]:
    """The table of log-odds and the calibration."""
    sides = [C.labelled(docs, labels, "toxic", MODULUS, REMAINDER, y, MAX_ROWS).select("text", F.lit(y).alias("toxic")).distinct() for y in (1, 0)]
    rows = C.materialize(sides[0].unionByName(sides[1]).withColumn("half", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2))), "toxic-sample")
    spread = docs.sparkSession.sparkContext.broadcast
    model, rates, ev, ys = {"lambda": 1.0, "a": 1.0, "b": 0.0, "significant": 0.0}, [], [], []
    seen = C.materialize(counts(rows), "toxic-counts")
    for k in (0, 1):  # each half is judged by what the other half has taught
        mine, table = rows.where(f"half = {k}"), spread(lookup(log_odds(seen, (1 - k,))))
        rates.append(_lambda(table, mine.where("toxic = 0")))
        pdf = mine.select("toxic", "text").mapInArrow(_map_evidence(table, model | {"lambda": rates[-1]}), "toxic int, " + PASSAGES).select("toxic", "evidence").toPandas()  # a row of the sample each
        ev.append(pdf["evidence"].to_numpy(float))
        ys.append(pdf["toxic"].to_numpy(float))
    x, y = np.concatenate(ev), np.concatenate(ys)
    found = ~np.isnan(x)
    model["lambda"] = float(np.mean(rates))
    if found.any() and 0 < y.sum() < len(y):
        model["a"], model["b"] = _logistic(x[found], y[found])
        model["significant"] = (np.log(CUT / (1 - CUT)) - model["b"]) / model["a"]
    return lookup(log_odds(seen, (0, 1))), model


def _map_histogram(table):
    def run(batches):
        for b in batches:
            for _, _, data, off in C.text_chunks(b, "text"):
                v, n = np.unique(np.round(token_scores(table.value, tokens(data, off)[1]), 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(float)), pa.array(n)], names=["s", "n"])

    return run


def _lambda(table, clean: DataFrame) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 over token scores (to one decimal) of non-toxic text."""
    hist = clean.select("text").mapInArrow(_map_histogram(table), "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    s, n = hist["s"].to_numpy(float), hist["n"].to_numpy(float)
    odds = table.value[2]
    s, n = np.append(s, (odds.mean() if len(odds) else 1 + DRIFT) - DRIFT), np.append(n, 0.5)  # what was never seen may still come
    p = n / n.sum()
    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return max(lo, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))), a kept positive, by Newton steps with a weak prior."""
    m, s = x.mean(), x.std() + 1e-6
    z, w = np.stack([(x - m) / s, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - y) + 0.1 * w)
    a = max(w[0] / s, 0.02)
    return float(a), float(w[1] - a * m)


def score(docs: DataFrame, table: tuple, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence and the significant passages (word positions), one row per row of docs."""
    rows = docs.select("doc_id", C.held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "text")
    out = rows.mapInArrow(_map_evidence(docs.sparkSession.sparkContext.broadcast(table), model), "doc_id long, held_out boolean, " + PASSAGES)
    return out.select("doc_id", "held_out", "score", "predicted", "evidence", "passages")
