"""Spelling variants, byte-level BPE and term search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from agro_jobs.llm import byte_bpe, queries, spelling, term_search

DOCS = "doc_id long, text string, no int, word string, n long, ids string, terms int, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, 0.5) for i, t in rows], DOCS)


def some_words(seed, size, letters="abÉé"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 7))) for _ in range(size)]


def odd_rows():
    words = some_words(3, 60)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(60)]
    long = "q" * 3000
    return [*rows, (None, None), (None, "AAAAA bbbbb"), (7, ""), (7, ""), (5, "ÀÉaba-aab×÷ " * 3), (6, f"{long} {long}r {long} {long}r {long} {long}r"), (6, "Word word WORD words Words words")]


# ---------------------------------------------------------------- spelling variants


def brute_variants(rows, shortest=5, least=3, slip=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    counts = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = [], {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out.append([w, forms[w], None, n, len(others), counts[best] if forms[w] else None])
    for r in out:
        r[2] = r[0]
        while forms[r[2]]:
            r[2] = forms[r[2]]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("slip", [97, 2])
def test_variants(spark, slip):
    rows = odd_rows()
    got = spelling.variants(docs(spark, rows).repartition(3), slip=slip)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows, slip=slip)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] for r in want) and any(r[4] == 0 for r in want) and ("q" * 3001, "q" * 3000) not in [r[:2] for r in want]


def test_variants_chain_and_ties(spark):
    text = " ".join(["abcde"] * 48 + ["abcdf"] * 24 + ["abcff"] * 12 + ["abfff"] * 6 + ["bbfff"] * 3 + ["xxxxx"] * 3 + ["yxxxx"] * 6 + ["xxxxy"] * 6)
    got = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in spelling.variants(docs(spark, [(1, text)]), slip=10**9).collect()}
    assert got["bbfff"] == ("abfff", "abcde", 6) and got["abcdf"] == ("abcde", "abcde", 48) and got["abcde"] == (None, "abcde", None)
    assert got["xxxxx"] == ("xxxxy", "xxxxy", 6)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (None, "ab cd"), (2, "word words")])).count() == 0


def test_variants_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    counts = Counter()
    got = {r["word"]: r for r in queries.op11_spelling_variants(spark, data).collect()}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert {w: r["n"] for w, r in got.items()} == {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    alphabet = sorted({c for w in got for c in w})
    for w, r in got.items():
        cuts = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ("", *alphabet)} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        near = [v for v in cuts if v in got and v != w]
        best = min(near, key=lambda v: (-got[v]["n"], v), default=None)
        assert (r["n_near"], r["form"]) == (len(near), best if best and got[best]["n"] >= 2 * r["n"] else None)


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    content = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = byte_bpe.ranks_of(content)
    return content, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tricky_texts():
    rnd = random.Random(8)
    plain = ["", " ", "  a", "a\n b \n\n  c", "it's  John'S 12345", "naïve café — 日本語 हिन्दी 🙂🙂", "\x1c \x85 \xa0 x\x00y", "a" * 5000, " " * 777 + "x", "é" * 2001, "don't " * 500]
    return plain + ["".join(rnd.choice("aabethn  éñकि日ab0 1.,-—\n\x1c\xa0🙂") for _ in range(rnd.randint(1, 120))) for _ in range(400)]


def test_encoder_equals_the_public_library(vocabulary, monkeypatch):
    _, ranks, public = vocabulary
    texts = tricky_texts()
    want = [public.encode_ordinary(t) for t in texts]
    assert [list(byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(t)) for t in texts] == want
    monkeypatch.setattr(byte_bpe, "MOST", 50)  # states are forgotten all the time
    monkeypatch.setattr(byte_bpe, "CHARACTERS_AT_ONCE", 7)
    assert [list(byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(t)) for t in texts[:40]] == want[:40]


def test_transducer_on_any_bytes():
    rnd = random.Random(2)
    ranks = {bytes([i]): i for i in range(256)}
    for rank in range(256, 330):  # merges of a small alphabet, as training would add them
        ranks.setdefault(rnd.choice([t for t in ranks if len(t) < 5 and set(t) <= set(b"abc")]) + rnd.choice([t for t in ranks if len(t) < 5 and set(t) <= set(b"abc")]), rank)
    machine, public = byte_bpe.Transducer(ranks), tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(1500):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30)))
        assert list(machine.encode(data)) == public._encode_single_piece(data)
    assert len(machine.states) < 20_000


def test_decoder_streams(vocabulary):
    _, ranks, _ = vocabulary
    decoder, rnd, tokens = byte_bpe.Decoder(ranks), random.Random(3), list(ranks.values())
    for _ in range(1500):
        ids = np.array([rnd.choice(tokens) for _ in range(rnd.randint(0, 12))], np.uint32)
        want = b"".join(decoder.bytes[i] for i in ids).decode("utf-8", "replace")
        assert decoder.decode(ids) == want
        assert "".join([decoder.feed(ids[k : k + 1]) for k in range(len(ids))]) + decoder.close() == want
    euro = np.array([ranks[bytes([b])] for b in "€".encode()], np.uint32)
    assert [decoder.feed(euro[k : k + 1]) for k in range(3)] == ["", "", "€"]


def test_encode_and_decode_tables(spark, vocabulary):
    content, _, public = vocabulary
    rows = [(i, t) for i, t in enumerate(tricky_texts()[:60])] + [(None, None), (3, "same"), (3, "same")]
    coded = byte_bpe.encode(docs(spark, rows), content, public_tokenizers.PATTERN)
    assert coded.columns == [c for c in docs(spark, rows).columns if c != "ids"] + ["ids"]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in coded.collect()] == [public.encode_ordinary(t or "") for _, t in rows]
    assert [r["decoded"] for r in byte_bpe.decode(coded, content).collect()] == [t or "" for _, t in rows]
    assert byte_bpe.digests(docs(spark, []), content, public_tokenizers.PATTERN).count() == 0


def test_digests_of_the_table(spark, data, vocabulary):
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = vocabulary[2].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, data).collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- term search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, top):
    split = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    split = [(i, Counter(w), len(w)) for i, w in split if w]
    n_docs, n_terms = len(split), sum(n for *_, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, n in split:
            m = 10 + 90 * n * n_docs // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms & set(c)), i is None, i or 0))
        out += [(item, k + 1, None if u else i, -s) for k, (s, u, i) in enumerate(sorted(scores)[:top]) if s < 0]
    return sorted(out, key=str)


def search_rows():
    rnd = random.Random(6)
    words = ["a", "B", "É", "12", "naïve", "x y", "rare", "the", "The"]
    rows = [(i, rnd.choice([" ", "-", "  ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(80)]
    return [*rows, (None, None), (None, "rare the rare"), (7, ""), (9, "rare"), (9, "rare"), (4, "the " * 9000), (3, "...")]


ITEMS = [("1", "the rare"), ("2", ""), (None, "É, naïve!"), ("3", None), ("1", "12 12 the"), ("4", "absent"), ("5", "A b x y")]


@pytest.mark.parametrize(("top", "bounds"), [(1, (1 << 20, 1000)), (200, (1 << 20, 1000)), (3, (24, 1000)), (3, (1 << 20, 2))])
def test_search(spark, top, bounds):
    rows = search_rows()
    items = spark.createDataFrame([(i, t, 9, 8, 7) for i, t in ITEMS], "item_id string, text string, no int, rank int, term int")
    got = [tuple(r) for r in term_search.search(docs(spark, rows).repartition(5), items, top, *bounds).collect()]
    assert sorted(got, key=str) == brute_search(rows, ITEMS, top)


def test_search_in_steps(spark, monkeypatch):
    monkeypatch.setattr(term_search, "CELLS", 8)  # a document or two at a time
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    counted = term_search.count_terms(docs(spark, search_rows()), ["rare", "the"]).coalesce(1)
    total = (sum(r["n"] > 0 for r in counted.collect()), sum(r["n"] for r in counted.collect()))
    best = term_search.best_documents(counted, total, [5, 7], [[0], [0, 1], []], 4).collect()
    assert max(Counter(r["item"] for r in best).values()) == 4 and {r["item"] for r in best} == {0, 1}
    assert items.count() == len(ITEMS)


def test_search_for_or_in_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert term_search.search(docs(spark, []), items).count() == 0
    assert term_search.search(docs(spark, [(1, None), (2, " .. ")]), items).count() == 0
    assert term_search.search(docs(spark, search_rows()), items.where("false")).count() == 0
