"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

Base spans follow four patterns with checks. The tagger is trained in numpy on the driver, from
windows (about MAX_WINDOWS of about MAX_TEXTS distinct texts, the documented bounds) labelled by their
base spans, with copies in other spellings (a phone without its country code, a card with dots).
Every kind needs a digit or an @, so only stretches around those are tagged. Windows of a stretch
overlap; their scores are averaged character by character, and one Viterbi pass with the learned
transitions over the whole stretch reconciles them. A tagged span is added if it overlaps no
base span, is confident and passes its kind's check.

Nulls: a null text is the empty one. Empty tables give no rows; repeated rows are separate;
other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm import common as C

KINDS = ("email", "ip", "card", "phone")
MAX_TEXTS, MAX_WINDOWS, WINDOW, STRIDE, MARGIN, GAP, CONFIDENT = 1_500, 9_000, 48, 24, 12, 8, 0.9
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER, RUN = re.compile(r"[0-9@]"), re.compile(r"\S+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "email":
        at = s.find("@")
        return at > 0 and DOMAIN.fullmatch(s, at + 1) is not None
    if kind == "ip":
        return s.count(".") == 3 and all(p and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """The four patterns, leftmost and without overlap per kind, failing matches dropped; linear in the text."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        while m and start > free and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if TRIGGER.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span could be: digits with MARGIN characters around, an @ with all that stands next to it, near ones together."""
    out: list[list[int]] = []
    run = 0, 0
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if m.group() == "@":
            if m.start() >= run[1]:
                start = m.start()
                while start > run[1] and not text[start - 1].isspace():
                    start -= 1
                run = start, RUN.match(text, m.start()).end()
            a, b = min(a, run[0]), max(b, run[1])
        if out and a <= out[-1][1] + GAP:
            out[-1] = [min(a, out[-1][0]), max(b, out[-1][1])]
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---------------------------------------------------------------- the network

LABELS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
CODES = 100  # 0 padding, 1..95 printable ASCII, 96 line breaks, 97 other letters, 98 the rest


def encode(s: str) -> np.ndarray:
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c - 31, np.where((c == 10) | (c == 13), 96, np.where(c >= 0xC0, 97, 98))).astype(np.int64)


def initial(embed: int = 12, hidden: int = 20, seed: int = 4) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {"e": rng.normal(0, 0.3, (CODES, embed)), "out": rng.normal(0, 0.2, (2 * hidden, LABELS)), "bias": np.zeros(LABELS), "trans": np.zeros((LABELS, LABELS))}
    for d in "fb":
        net |= {f"w{d}": rng.normal(0, 0.25, (embed + hidden, 4 * hidden)), f"c{d}": np.repeat([1.0, 0, 0, 0], hidden)}  # gates: forget, input, output, candidate
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (batch, time, hidden) of x (batch, time, embed), and what the way back needs."""
    b, t, _ = x.shape
    n = len(bias) // 4
    h, c, hs, tape = np.zeros((b, n)), np.zeros((b, n)), np.empty((b, t, n)), []
    for i in range(t):
        z = np.concatenate([x[:, i], h], 1)
        g = z @ w + bias
        gates, cand = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
        f, a, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        old, c = c, f * c + a * cand
        tc = np.tanh(c)
        h = o * tc
        hs[:, i] = h
        tape.append((z, f, a, o, cand, old, tc))
    return hs, tape


def _lstm_back(dh_all: np.ndarray, tape: list, w: np.ndarray, embed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, t, n = dh_all.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * n), np.empty((b, t, embed))
    dh, dc = np.zeros((b, n)), np.zeros((b, n))
    for i in range(t - 1, -1, -1):
        z, f, a, o, cand, old, tc = tape[i]
        dh = dh + dh_all[:, i]
        dc = dc + dh * o * (1 - tc**2)
        g = np.concatenate([dc * old * f * (1 - f), dc * cand * a * (1 - a), dh * tc * o * (1 - o), dc * a * (1 - cand**2)], 1)
        dw += z.T @ g
        db += g.sum(0)
        dz = g @ w.T
        dx[:, i], dh, dc = dz[:, :embed], dz[:, embed:], dc * f
    return dw, db, dx


def emissions(net: dict, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    x = net["e"][codes]
    hf, tf = _lstm(x, net["wf"], net["cf"])
    hb, tb = _lstm(x[:, ::-1], net["wb"], net["cb"])
    h = np.concatenate([hf, hb[:, ::-1]], 2)
    return h @ net["out"] + net["bias"], (h, tf, tb)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def posteriors(em: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label posteriors, log Z, and forward and backward scores of the CRF."""
    _, t, _ = em.shape
    fw, bw = np.empty_like(em), np.zeros_like(em)
    fw[:, 0] = em[:, 0]
    for i in range(1, t):
        fw[:, i] = em[:, i] + _lse(fw[:, i - 1, :, None] + trans, 1)
    for i in range(t - 2, -1, -1):
        bw[:, i] = _lse(trans + (em[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
    z = _lse(fw[:, -1], 1)
    return np.exp(fw + bw - z[:, None, None]), z, fw, bw


def gradients(net: dict, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the gold labels and its gradients."""
    b, t = codes.shape
    em, (h, tf, tb) = emissions(net, codes)
    p, z, fw, bw = posteriors(em, net["trans"])
    rows = np.arange(b)[:, None]
    score = em[rows, np.arange(t), gold].sum(1) + net["trans"][gold[:, :-1], gold[:, 1:]].sum(1)
    dem = p.copy()
    dem[rows, np.arange(t), gold] -= 1
    dem /= b
    pair = np.exp(fw[:, :-1, :, None] + net["trans"] + (em[:, 1:] + bw[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    grads = {"trans": pair / b, "out": h.reshape(-1, h.shape[2]).T @ dem.reshape(-1, LABELS), "bias": dem.sum((0, 1))}
    dh = dem @ net["out"].T
    n, embed = h.shape[2] // 2, net["e"].shape[1]
    grads["wf"], grads["cf"], dx1 = _lstm_back(dh[:, :, :n], tf, net["wf"], embed)
    grads["wb"], grads["cb"], dx2 = _lstm_back(dh[:, ::-1, n:], tb, net["wb"], embed)
    grads["e"] = np.zeros_like(net["e"])
    np.add.at(grads["e"], codes, dx1 + dx2[:, ::-1])
    return float((z - score).mean()), grads


def train(codes: np.ndarray, gold: np.ndarray, epochs: int = 14, rate: float = 0.02, batch: int = 48, seed: int = 9) -> dict:
    net, rng, step = initial(), np.random.default_rng(seed), 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    for epoch in range(epochs):
        for idx in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
            _, grads = gradients(net, codes[idx], gold[idx])
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g, m = g * min(1.0, 5 / (norm + 1e-9)), moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
                net[k] = net[k] - rate * (1 - epoch / epochs) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return net


# ---------------------------------------------------------------- training windows

VARIANTS = {"phone": (lambda s: re.sub(r"^\+[0-9]{1,3} ?", "", s), lambda s: re.sub(r"[() ]+", "-", s).replace("+-", "+")), "card": (lambda s: ".".join(s[i : i + 4] for i in range(0, len(s), 4)),)}


def _label(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    return y


def examples(text: str, seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """Windows of the text with labels; where a kind has other spellings, some windows use one."""
    spans = base_spans(text)
    for i, (a, b) in enumerate(stretches(text)):
        inside = sorted((s for s in spans if a <= s[1] and s[2] <= b), key=lambda s: (s[1], -s[2]))
        flat, end = [], a
        for s in inside:
            if s[1] >= end:
                flat.append(s)
                end = s[2]
        piece, moved, at = "", [], a
        for j, (kind, x, y) in enumerate(flat):
            piece += text[at:x]
            said, forms = text[x:y], VARIANTS.get(kind, ())
            pick = (seed + i + j) % (2 * len(forms) + 1) if forms else 0
            if 0 < pick <= len(forms):
                said = forms[pick - 1](said)
            moved.append((kind, len(piece), len(piece) + len(said)))
            piece, at = piece + said, y
        piece += text[at:b]
        labels = _label(len(piece), moved)
        for s in range(0, max(1, len(piece) - STRIDE), STRIDE):
            yield piece[s : s + WINDOW], labels[s : s + WINDOW]


def _map_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(w, y.tolist()) for t in b.column("text").to_pylist() for w, y in examples(t or "", len(t or ""))]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([y for _, y in got], pa.list_(pa.int64()))], names=["window", "labels"])


def fit(docs: DataFrame) -> dict | None:
    """The trained tagger, or None if no text holds a digit or an @."""
    texts = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    windows = C.materialize(C.bounded(texts, MAX_TEXTS).mapInArrow(_map_examples, "window string, labels array<bigint>"), "pii-windows")
    rows = C.bounded(windows, MAX_WINDOWS).toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["window"][i], list(rows["labels"][i])))]  # one order, whatever the partitioning
    if not len(rows):
        return None
    codes, gold = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for i, (w, y) in enumerate(zip(rows["window"], rows["labels"], strict=True)):
        codes[i, : len(w)], gold[i, : len(w)] = encode(w), y
    return {k: v.astype(np.float32) for k, v in train(codes, gold).items()}


# ---------------------------------------------------------------- tagging


def _viterbi(logp: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = logp[0], []
    for row in logp[1:]:
        s = best[:, None] + trans
        back.append(s.argmax(0))
        best = s.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def tag(net: dict, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, confidence) of the spans the tagger sees in each text."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    slots, windows = [], []
    for j, (i, a, b) in enumerate(jobs):
        code = encode(texts[i][a:b])
        for s in range(0, max(1, len(code) - STRIDE), STRIDE):
            w = np.zeros(WINDOW, np.int64)
            w[: len(code[s : s + WINDOW])] = code[s : s + WINDOW]
            slots.append((j, s))
            windows.append(w)
    sums, scores, held = [np.zeros((b - a, LABELS)) for _, a, b in jobs], [np.zeros((b - a, LABELS)) for _, a, b in jobs], [np.zeros((b - a, 1)) for _, a, b in jobs]
    weight = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]))[:, None]  # a window knows its middle best
    for at in range(0, len(windows), 256):
        em = emissions(net, np.stack(windows[at : at + 256]))[0]
        p = posteriors(em, net["trans"])[0]
        for (j, s), e, q in zip(slots[at : at + 256], em, p, strict=True):
            n = min(WINDOW, len(sums[j]) - s)
            sums[j][s : s + n] += (q * weight)[:n]
            scores[j][s : s + n] += (e * weight)[:n]
            held[j][s : s + n] += weight[:n]
    trans = net["trans"].copy()
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        trans[[x for x in range(LABELS) if x not in (inside, inside - 1)], inside] = -1e9
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for (i, a, _), q, e, h in zip(jobs, sums, scores, held, strict=True):
        q = q / h
        path = _viterbi(e / h, trans)
        starts = np.flatnonzero(path % 2 == 1)
        for s in starts:
            e = s + 1
            while e < len(path) and path[e] == path[s] + 1:
                e += 1
            out[i].append((KINDS[path[s] // 2], a + int(s), a + int(e), float(q[np.arange(s, e), path[s:e]].mean())))
    return out


def _map_spans(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                near = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
                seen = dict(zip(near, tag(net, [texts[i] for i in near]), strict=True)) if net else {}
                rows = []
                for i, t in enumerate(texts):
                    base = base_spans(t) if i in seen or not net else []
                    more = [
                        (k, s, e) for k, s, e, p in seen.get(i, []) if p >= CONFIDENT and valid(k, t[s:e]) and not any(s < y and x < e for _, x, y in base)
                    ]
                    rows.append([{"kind": k, "start": s, "end": e, "added": False} for k, s, e in base] + [{"kind": k, "start": s, "end": e, "added": True} for k, s, e in more])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))
                yield C.with_columns(part, {"found": pa.array(rows, kind)})

    return run


def find(docs: DataFrame, net: dict | None) -> DataFrame:
    """doc_id, found: kind, start, end and whether the tagger added it, one row per row of docs."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_map_spans(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, found array<struct<kind: string, start: int, end: int, added: boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256, spans."""
    ordered = F.expr(f"array_sort(transform(found, x -> struct(array_position(array({', '.join(repr(k) for k in KINDS)}), x.kind) as r, x.start as s, x.end as e, x.kind as k, x.added as added)))")
    said = "concat(x.k, ':', x.s, ':', x.e)"
    rows = found.withColumn("o", ordered)
    return rows.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(found, x -> x.kind = '{k}' and not x.added)) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(f"concat_ws(',', transform(filter(o, x -> not x.added), x -> {said}))").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(o, x -> {said}))").alias("spans"),
    )
