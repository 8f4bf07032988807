"""The operators on texts against brute force, on small tables with nulls, empties, ties, copies and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from agro_jobs.llm import common, fingerprint_index, icws, kd_shards, mixing, pii_tagger, toxic_segments, url_filter, winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 long, predicted int, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x") for i, t, s in rows], DOCS)


def odd_rows():
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["a", "b", "É", "c-d", "12"]) for _ in range(rnd.randint(0, 50))), f"s{i % 3}") for i in range(40)]
    return rows + [(None, None, None), (7, "", "s1"), (7, "", "s1"), (99, "z " * 400, "s2"), (5, "one two", None), (5, "one two", None), (6, "x" * 5000, "s0")]


def test_word_bounds_do_not_cross_documents():
    data = np.frombuffer("ab cd\x0bé".encode(), np.uint8)
    s, e, d = common.word_bounds(data, np.array([0, 2, 2, len(data)]), common.SPACE)
    assert [(bytes(data[a:b]).decode(), int(x)) for a, b, x in zip(s, e, d, strict=True)] == [("ab", 0), ("cd", 2), ("é", 2)]


def test_bitmap_reaches_the_driver_in_few_parts(spark, monkeypatch):
    def refused(self):
        raise AssertionError("one row a word of the bitmap")

    frame = type(spark.range(1))
    seen, rows_of = [], frame.toLocalIterator
    monkeypatch.setattr(frame, "toPandas", refused)
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a, **k: (seen.append(r["part"]) or r for r in rows_of(self, *a, **k)))
    df = spark.range(70_000).selectExpr("xxhash64(id) AS h")
    bits = fingerprint_index.bitmap(df, "h").value
    want = np.zeros(len(bits) * 64, bool)
    want[np.array([r["h"] & (len(want) - 1) for r in df.collect()])] = True
    assert (np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert sorted(seen) == list(range(len(bits) // fingerprint_index.PART_WORDS)) and len(seen) > 1
    few = fingerprint_index.bitmap(spark.createDataFrame([(-1,), (0,)], "h long"), "h").value
    assert len(few) * 64 == 1 << 16 and few[0] == 1 and few[-1] == 1 << 63 and not few[1:-1].any()
    assert not fingerprint_index.bitmap(spark.createDataFrame([], "h long"), "h").value.any()


def test_sliding_argmin():
    x = np.random.default_rng(0).integers(0, 9, 200)
    for w in (1, 2, 7, 30):
        assert [int(i) for i in common.sliding_argmin(x, w)] == [i + int(np.argmin(x[i : i + w])) for i in range(len(x) - w + 1)]


def brute_substrings(rows, n):
    split = [(d, (t or "").encode().split()) for d, t, _ in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in split for k in range(len(w) - n + 1))
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 28, 0])
def test_substrings(spark, monkeypatch, bits):
    monkeypatch.setattr(fingerprint_index, "MOST_BITS", bits)  # without room for a bitmap, texts are found by a join
    rows = odd_rows()
    got = [tuple(r) for r in fingerprint_index.dedup_substrings(docs(spark, rows), window=8).collect()]
    assert sorted(got, key=str) == brute_substrings(rows, 8)
    assert fingerprint_index.dedup_substrings(docs(spark, []), window=8).count() == 0


def test_index_merges_runs(spark):
    index = fingerprint_index.FingerprintIndex(spark, fanout=2)
    for part in ([(1, 1, 2), (2, 5, 1)], [(1, 1, 3), (3, 1, 1)], [(2, 5, 1)]):
        index.append(spark.createDataFrame(part, "h long, g long, n long"))
    assert sorted(tuple(r) for r in index.table().collect()) == [(1, 1, 5), (2, 5, 2), (3, 1, 1)]
    index.drop()


def brute_leaks(rows, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t, _ in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if x := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_leaks(spark):
    rows = odd_rows() + [(70, "p Q r s t u v w x y z", "s1"), (71, "q r s t u v w x y z 1 2", "s1")]
    items = [(1, "p q r s t u v w x y"), (2, "One, TWO!"), (3, "é"), (4, None), (5, ""), (6, "q r s t u v w x y z"), (10, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in winnow.contamination(docs(spark, rows), bench).collect()]
    assert sorted(got, key=str) == brute_leaks(rows, items)
    kept = winnow.keep_clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([r[0] for r in brute_leaks(rows, items) if not r[5]], key=str)
    assert winnow.contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert winnow.contamination(docs(spark, []), bench).count() == 0


def shingle_set(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 150, 420, 600]))]
        for k in range(rnd.randint(1, 40) if g else 60):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 60))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(t), "s"))
    rows += [(None, None, None), (900, "", "s"), (901, "", "s"), (902, "one two", "s"), (903, "One two", "s"), (904, "!!", "s"), (rows[0][0], rows[0][1], "s")]
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) / len(a | b) >= 0.8):
                parent[find(i)] = find(j)
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), []).append(rows[i][0])
    got = {}
    for r in icws.near_duplicates(docs(spark, rows)).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    # weighted similarity may also link what plain similarity just misses, never the reverse
    finer = [set(map(str, v)) for v in want.values()]
    coarser = [set(map(str, v)) for v in got.values()]
    assert all(any(f <= c for c in coarser) for f in finer)
    assert len(finer) - len(coarser) <= 2
    kept = icws.keep_one(docs(spark, rows))
    assert kept.count() == len(got)
    assert icws.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_inside_a_template_family(spark):
    """Buckets of a template stay large whatever they are met with; the pairs inside must be found all the same."""
    boilerplate = [f"b{i}" for i in range(160)]
    rows = []
    for g in range(600):
        own = [f"g{g}x{i}" for i in range(23)]
        rows.append((2 * g, " ".join(boilerplate + own), "s"))
        if g % 6 == 0:  # a true partner, with eight of these words
            rows.append((2 * g + 1, " ".join(boilerplate + own[:8] + [f"g{g}y{i}" for i in range(15)]), "s"))
    sets = {i: shingle_set(t) for i, t, _ in rows}
    assert len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8 < len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_near_duplicates_just_below_the_limit(spark):
    """One large family of edited copies, most pairs of which miss the limit: the classes are those of all pairs."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(500):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(t[: rnd.randint(52, 60)]), "s"))
    d = docs(spark, rows)
    texts = sorted({t for _, t, _ in rows})
    idf = icws.document_frequencies(d.select("text"))
    raw = [t.encode() for t in texts]
    doc, h, w = icws.shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), idf)
    n = len(texts)
    plain, heavy = np.zeros((n, n)), np.zeros((n, n))
    for x in np.unique(h):
        at = np.flatnonzero(h == x)
        plain[np.ix_(doc[at], doc[at])] += 1
        heavy[np.ix_(doc[at], doc[at])] += np.minimum.outer(w[at], w[at])
    link = np.zeros((n, n), bool)
    for m in (plain, heavy):
        size = np.diag(m)
        link |= m / (size[:, None] + size[None] - m) >= 0.8
    label = np.arange(n)
    while True:
        new = np.array([label[link[i]].min() for i in range(n)])
        if (new == label).all():
            break
        label = new
    at = {t: i for i, t in enumerate(texts)}
    first: dict = {}
    for i, t, _ in rows:
        first.setdefault(label[at[t]], i)
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(d).collect()}
    assert len(set(label)) > 20
    assert got == {i: first[label[at[t]]] for i, t, _ in rows}


def test_samples_are_those_of_all_draws():
    rng = np.random.default_rng(0)
    n = [3, 5, 40, 130, 900]
    doc, h, w = np.repeat(np.arange(5), n), rng.integers(1, 1 << 62, sum(n)).astype(np.uint64), rng.uniform(0.5, 1.5, sum(n))
    some = icws.samples(doc, h, w, 5)
    draws = icws._draws()
    low, draws[4] = draws[4], np.ones_like(draws[4])
    everything = icws.samples(doc, h, w, 5)
    draws[4] = low
    assert (some == everything).all()


def test_long_items_cost_their_words(spark):
    """An item of thousands of words is split once, not once for each of its windows."""
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 400)}" for _ in range(3000)]
    items = [(1, " ".join(words)), (2, " ".join(words[500:530])), (3, "alone here")]
    rows = [(1, "x y z " + " ".join(words[100:140]), "s"), (2, "he is alone here", "s"), (3, " ".join(words), "s"), (4, "nothing of it", "s"), (5, "q " * 300_000 + " ".join(words[7:17]), "s")]
    got = [tuple(r) for r in winnow.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_leaks(rows, items)


def test_luhn_and_base_spans():
    t = "mail a.b+c@d-e.co.uk, 10.0.0.256 10.0.0.25; 4111 1111 1111 1111, +1 (415) 555-2671 +12"
    assert [(k, t[a:b]) for k, a, b in pii_tagger.base_spans(t)] == [("email", "a.b+c@d-e.co.uk"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (415) 555-2671")]
    assert pii_tagger.base_spans("a" * 200_000 + "@") == []


def test_base_spans_equal_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(8)
    for _ in range(3000):
        t = "".join(rnd.choice("a1@.+- (é4") for _ in range(rnd.randint(0, 40)))
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if k == "email" or pii_tagger.valid(k, m.group())]
        assert pii_tagger.base_spans(t) == want


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    net, codes, gold = pii_tagger.initial(4, 3), rng.integers(0, 99, (2, 6)), rng.integers(0, 9, (2, 6))
    _, grads = pii_tagger.gradients(net, codes, gold)
    for k, v in net.items():
        i = (codes[0, 1], 2) if k == "e" else tuple(rng.integers(0, s) for s in v.shape)
        old, side = v[i], []
        for d in (1e-5, -1e-5):
            v[i] = old + d
            side.append(pii_tagger.gradients(net, codes, gold)[0])
        v[i] = old
        assert abs((side[0] - side[1]) / 2e-5 - grads[k][i]) < 1e-7


def test_personal_data(spark):
    rows = [(i, f"call +1 (415) 555-{2000 + i} or user{i}@mail.com now, card 4111 1111 1111 1111 and 10.1.2.{i}", "s") for i in range(60)] + [(None, None, None), (5, "", "s"), (6, "no data", "s"), (6, "no data", "s")]
    d = docs(spark, rows)
    got = pii_tagger.digests(pii_tagger.find(d, pii_tagger.fit(d))).collect()
    assert len(got) == len(rows)
    assert sum(r.n_phone for r in got) == sum(r.n_email for r in got) == 60
    assert next(r for r in got if r.doc_id is None).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii_tagger.digests(pii_tagger.find(d, None)).where("n_card = 1").count() == 60
    assert pii_tagger.fit(docs(spark, [(1, "no data", "s")])) is None


def test_segments_are_maximal():
    found = toxic_segments.segments(np.array([0, 1, 3, 30]), np.array([1.0, 2, 6, 1]))
    assert found == [(0, 3, 8.0), (30, 30, 1.0)]
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 14)
        x = [rnd.choice([-toxic_segments.DRIFT, 1.5, 0.75]) for _ in range(n)]
        at = [i for i, v in enumerate(x) if v > 0]
        best = max((sum(x[i : j + 1]) for i in range(n) for j in range(i, n)), default=0)
        got = toxic_segments.segments(np.array(at, int), np.array([x[i] for i in at]))
        assert abs(max((s for _, _, s in got), default=best if not at else 0) - best) < 1e-9 or not at


def test_log_odds_are_those_of_the_prior(spark):
    rnd = random.Random(9)
    plain = [f"{a}{b}en" for a in ("riv", "sto", "fie", "clo", "mea", "cal") for b in "abcdef"]
    rows = [(" ".join(rnd.choice(plain) if i % 5 or rnd.random() < 0.6 else "réeux" + rnd.choice("abc") for _ in range(9)), int(i % 5 == 0), i % 2) for i in range(300)]
    rows += rows[3:9] + [("", 1, 0), ("", 0, 1)]
    keys, odds = toxic_segments.log_odds(toxic_segments.counts(spark.createDataFrame(rows, "text string, toxic int, half int")), (0, 1))
    contexts = {0: set(), 1: set()}
    for t, y, half in rows:
        w = ["", *t.split(), ""]
        contexts[y] |= {(half, *w[k - 1 : k + 2]) for k in range(1, len(w) - 1)}
    seen = {y: Counter(f for _, _, w, _ in found for f in {(0, w), (4, w[:4]), (5, w[:5])}) for y, found in contexts.items()}
    total = {y: sum(c.values()) for y, c in seen.items()}
    share, want = total[1] / (total[0] + total[1]), []
    for f in seen[0] | seen[1]:
        t, c = seen[1][f] + toxic_segments.PRIOR * share, seen[0][f] + toxic_segments.PRIOR * (1 - share)
        delta = np.log(t / share) - np.log(c / (1 - share))
        if delta > toxic_segments.DRIFT and delta >= toxic_segments.SIGNIFICANT * np.sqrt(1 / t + 1 / c):
            want.append(delta)
    assert len(want) >= 2
    assert np.allclose(sorted(odds), sorted(want))
    assert (np.sort(keys) == keys).all()


def test_toxicity_of_odd_rows(spark):
    rnd = random.Random(1)
    plain = [f"{a}{b}en" for a in ("riv", "sto", "fie", "clo", "mea", "cal") for b in "abcdef"]
    rows = [(i, " ".join(rnd.choice(plain) if k % 3 or i % 3 else rnd.choice(["idiot", "clown"]) for k in range(12)), "s") for i in range(150)]
    rows += [(None, None, None), (0, "", "s"), (0, "another text of one id", "s"), (0, "another text of one id", "s"), (200, "calm water " * 60_000 + "idiot clown and idiot and clown clown", "s")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(150)] + [(None, 1, 1), (200, None, None)], "doc_id long, toxic int, quality int")
    got = toxic_segments.score(d, *toxic_segments.fit(d, labels)).collect()
    assert len(got) == len(rows)
    said = {r.doc_id: r for r in got if r.doc_id not in (None, 0)}
    assert all(said[i].predicted == int(i % 3 == 0) for i in said if i < 150)
    assert all(r.score == 0 and r.evidence is None for r in got if r.doc_id is None)
    long = said[200]
    assert long.passages and long.passages[0].first >= 120_000
    assert toxic_segments.score(d.limit(0), *toxic_segments.fit(d, labels)).count() == 0


def test_samples_are_bounded_by_rows(spark):
    """Neither an id with many texts nor a row that repeats fills the sample or vanishes from it."""
    same = [(1, f"text {i}") for i in range(4000)] + [(2, "again")] * 4000 + [(None, "nobody")] * 50 + [(i, "x") for i in range(10, 400)]
    d = spark.createDataFrame(same, "doc_id long, text string")
    got = common.bounded(d, 500).collect()
    assert 350 < len(got) < 650
    assert len(set(got)) == len(got)
    assert {tuple(r) for r in common.bounded(d, 10_000).collect()} == set(same)
    labels = spark.createDataFrame([(1, 1)] * 100 + [(2, 1), (3, 0)], "doc_id long, toxic int")
    assert 350 < common.labelled(d, labels, "toxic", 4, 2, 1, 500).count() < 650


def test_mix_reaches_its_targets(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "c", "d"]) if i % 3 else "a") for i in range(400)] + [(None, None, None), (1, "w w w", None), (1, "w w w", None)]
    got = mixing.fair_mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] <= 2 * got["size"]).all()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = dict(zip(sorted(k for k in sizes if k) + [None], [3, 1, 2, 3, 1], strict=True))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), dict(weights)
    while open_:
        share = left / sum(open_.values())
        full = [k for k, w in open_.items() if share * w >= 2 * sizes[k]]
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            del open_[k]
        if not full:
            target |= {k: share * w for k, w in open_.items()}
            break
    for k, part in got.groupby(got["source"].where(got["source"].notna(), "none")):
        k = None if k == "none" else k
        assert abs(part["target"].iloc[0] - target[k]) < 1e-6
        assert abs(part["taken"].sum() - target[k]) <= mixing.PACKET
    assert got["taken"].sum() == int(sum(target.values()) + 1e-6)
    queue: dict = {}
    for i, t, src in rows:
        said = "17:" + "".join("-" if x is None else f"{len(x)}:{x}" for x in (None if i is None else str(i), src, t))
        queue.setdefault(src, []).append((hashlib.md5(said.encode()).hexdigest(), -1 if i is None else i, len((t or "").split())))
    packets, share = [], Counter()
    for src, line in queue.items():
        served, seen = 0, Counter()
        for k, (key, _, n) in enumerate(sorted(line)):
            each = -(-n // mixing.PACKET)
            for x in range(2 * each):
                turn, j = divmod(x, each)
                upto = min((j + 1) * mixing.PACKET, n)
                packets.append(((turn * sizes[src] + served + upto) / target[src], key, seen[key], x, upto - j * mixing.PACKET, (src, k)))
            served += n
            seen[key] += 1
    left = int(sum(target.values()) + 1e-6)
    for *_, n, doc in sorted(packets, key=lambda p: p[:4]):  # all packets in the order of their finish times, until the budget is spent
        share[doc] += min(n, left)
        left -= min(n, left)
    want = [(i, n, share[src, k]) for src, line in queue.items() for k, (_, i, n) in enumerate(sorted(line))]
    assert sorted(want) == sorted((int(i) if i == i else -1, int(n), int(k)) for i, n, k in got[["doc_id", "size", "taken"]].astype(float).values.tolist())
    again = mixing.fair_mix(docs(spark, rows).repartition(7)).toPandas()
    assert sorted(map(str, got[["doc_id", "size", "taken"]].values.tolist())) == sorted(map(str, again[["doc_id", "size", "taken"]].values.tolist()))
    assert mixing.mixed_documents(docs(spark, rows)).columns == docs(spark, []).columns
    assert mixing.fair_mix(docs(spark, [])).count() == 0


def test_sources_that_are_spelled_alike(spark):
    rows = [(4, "one two", None), (4, "one two", "-"), (5, "c d", "a:b"), (5, "b:c d", "a"), (6, "x", "1:a"), (6, "1:ax", ""), (7, "", "a"), (7, None, "e"), (8, "", "e"), (None, "9 9 9", "z")]
    got = mixing.fair_mix(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    mixed = mixing.mixed_documents(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in mixed} <= set(rows)
    assert {r["source"] for r in got if r["taken"] == 2 * r["size"] > 0} <= {r["source"] for r in mixed}
    assert Counter((r["doc_id"], r["source"]) for r in mixed if not r["text"])[8, "e"] == 1  # a source without words is there once
    assert mixing.mixed_documents(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [(1, None, None)] * 3)).count() == 3


def test_mixed_rows_keep_their_own_share(spark):
    rows = [(None if i % 3 == 0 else i % 7, f"w{i} " * (5 + i % 11), "abc"[i % 3 if i % 2 else i % 5 % 3]) for i in range(600)] + [(None, "same words here", "a")] * 30
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = mixing.fair_mix(docs(spark, rows)).groupBy("source").agg({"target": "max"}).collect()
    mixed = Counter()
    for r in mixing.mixed_documents(docs(spark, rows)).collect():
        mixed[r.source] += len(r.text.split())
    for s, t in target:
        assert abs(mixed[s] - t) <= 15 + mixing.PACKET, (s, mixed[s], t, sizes[s])


@pytest.mark.parametrize("n", [1, 5, 16])
def test_shards_are_even(spark, n):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randint(0, 300), rnd.choice(["a", "b"])) for i in range(600)] + [(None, None, None)] + [(1000 + i, "same text " * 10, "a") for i in range(300)]
    got = kd_shards.kd_shards(docs(spark, rows), n).toPandas()
    assert len(got) == len(rows)
    assert set(got["shard"]) == set(range(n))
    per = got.groupby("shard")["size"].sum()
    assert per.max() - per.min() <= 0.1 * per.mean() + 600
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert kd_shards.kd_shards(docs(spark, []), n).count() == 0


def test_copies_stay_together(spark, data):
    for path, n in ((data, 16), (data.replace("sf0.001", "sf0.01"), 16)):
        table = spark.read.parquet(f"{path}/documents.parquet")
        got = kd_shards.kd_shards(table, n).join(table.selectExpr("doc_id", "coalesce(text, '') AS text"), "doc_id").toPandas()
        shard, whole = got["size"].sum() / n, got.groupby("text").agg(bytes=("size", "sum"), shards=("shard", "nunique"), copies=("size", "count"))
        assert (whole["copies"] > 1).sum() >= 5
        assert (whole["shards"][whole["bytes"] <= kd_shards.GROUP_SHARE * shard] == 1).all()
        per = got.groupby("shard")["size"].sum()
        assert per.max() - per.min() <= 2 * max(kd_shards.GROUP_SHARE * shard, got["size"].max())


def test_medians_equal_a_plain_search(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["same words", "other words " * 5, "x" * rnd.randint(0, 400)]), rnd.choice(["a", "b", "c"])) for i in range(200)]
    placed, splits = kd_shards.kd_tree(kd_shards.points(docs(spark, rows)), 8)
    points = [r.asDict() for r in placed.collect()]
    assert len(splits) == 7 and len(points) == 200

    def path(p):
        node = 1
        while node in at:
            cut = at[node]
            node = 2 * node + (tuple(p[d] for d in (cut["dim"], *kd_shards.KEYS)[: len(cut["cut"])]) >= tuple(cut["cut"]))
        return node

    at = {s["node"]: s for s in splits}
    inside = {}
    for p in points:
        node = path(p)
        while node:
            inside.setdefault(node, []).append(p)
            node //= 2
    assert len({(path(p), p["shard"]) for p in points}) == len({p["shard"] for p in points}) == 8
    whole = kd_shards.GROUP_SHARE * sum(p["size"] for p in points) / 8
    for node, s in at.items():  # no cut between two texts of a node comes nearer to half of its bytes
        mine = inside[node]
        groups = Counter()
        for p in mine:
            groups[tuple(p[d] for d in (s["dim"], "text_crc32", "text_key"))] += p["size"]
        total, left = sum(groups.values()), sum(p["size"] for p in inside.get(2 * node, []))
        upto, best = 0, total
        for _, w in sorted(groups.items()):
            upto += w
            best = min(best, abs(upto - total / 2))
        assert abs(left - total / 2) <= max(best, kd_shards.TOLERANCE * total) + 1 or max(groups.values()) > whole


def test_a_pile_of_one_row_is_split(spark):
    rows = [(7, "the same row", "a")] * 500 + [(None, None, None)] * 100 + [(i, "x" * (i % 90), "b") for i in range(200)]
    got = kd_shards.kd_shards(docs(spark, rows), 4).toPandas()
    assert len(got) == len(rows)
    per = got.groupby("shard")["size"].sum()
    assert per.max() - per.min() <= 120
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in got.groupby("shard"))


def test_stretches_hold_whole_addresses():
    t = "write to a.very.long.local-part@some-very-long-domain.example.org, or 12 then"
    (a, b), *rest = pii_tagger.stretches(t)
    assert t[a:b].startswith("a.very") or "a.very.long.local-part@some-very-long-domain.example.org" in t[a:b]
    assert pii_tagger.stretches("@" * 100_000) == [(0, 100_000)]
    assert not pii_tagger.stretches("nothing here")


def test_tagging_very_long_and_repeated_texts(spark):
    rows = [(i, f"call +1 (415) 555-{2000 + i} or user{i}@mail.com", "s") for i in range(40)] + [(None, "1 " * 40_000 + "x@y.zz", "s")] + [(3, "call +1 (415) 555-2003 now", "s")] * 200
    d = docs(spark, rows)
    net = pii_tagger.fit(d)
    got = pii_tagger.digests(pii_tagger.find(d, net)).collect()
    assert len(got) == len(rows)
    assert sum(r.n_email for r in got) == 41
    again = pii_tagger.fit(d.repartition(5))
    assert all(np.array_equal(v, again[k]) for k, v in net.items())


def test_urls(spark):
    rows = [
        (1, "https://www.Example.com/en/5?x", "www.example.com", "/en/5", "www.example.com/en/", "allow"), (2, "http://m.example.com/en/#a", "m.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"), (4, None, "", "", None, "allow"), (5, "nothing", "", "", None, "allow"), (None, "x://y.com?/en/", "y.com", "", None, "allow"),
        (7, "http://y.com/EN/", "y.com", "/EN/", "com/", "allow"), (8, "http://cheappills.org/x", "cheappills.org", "/x", None, "block"), (8, "http://cheappills.org/x", "cheappills.org", "/x", None, "block"),
        (9, "http://com/", "com", "/", "com/", "allow"), (10, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow")]
    filler = [(100 + i, f"http://site{i}.org/news/{i}", None, None, None, None) for i in range(30)]
    df = spark.createDataFrame([(r[0], r[1], "odd") for r in rows + filler], "page_id long, url string, word string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df.select("page_id", "url")).collect()}
    assert all(got[r[0], r[1]] == r[2:] for r in rows)
    assert url_filter.judged(df.select("page_id", "url")).count() == len(rows + filler)
    assert url_filter.judged(df.select("page_id", "url").limit(0)).count() == 0


def test_a_site_name_is_cut_whatever_its_pages(spark):
    mine = [f"http://{h}/p{k}" for h in ("cheappills.org", "www.cheappills.com", "cheappills24.co.uk:80") for k in range(40)]
    rows = list(enumerate(mine + [f"http://site{i}.org/{w}/{i}" for i in range(30) for w in ("news", "gardening")]))
    got = {r.url: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}
    assert {u for u, v in got.items() if v == "block"} == set(mine)


def test_viterbi_prefers_known_words():
    known = [{"start": 0, "length": 5, "n": 50}, {"start": 5, "length": 5, "n": 50}]
    assert url_filter.viterbi("cheappills", known, 1000.0) == ["cheap", "pills"]
    assert url_filter.viterbi("", [], 10.0) == []
