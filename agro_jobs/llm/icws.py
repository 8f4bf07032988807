"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five lower-cased words (all its words, if fewer). A shingle
weighs (1 + ln tf) * (1 + mean idf of its words) / 2, the idf scaled to 0..1. Word document
frequencies come from all texts, in a table of IDF_BUCKETS hashed counts, a fixed size.

SAMPLES consistent weighted samples (Ioffe) make BANDS band keys, for texts of any length. A
pair with similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**20 = 0.99997.

Texts of a bucket are compared with each other if there are at most SMALL of them. A larger
bucket is compared with its leader, the text that meets the most others. A text that is then in
another class than its leader is open: it is held against all that large buckets have left (less
what the triangle inequality of Jaccard distance rules out) by an exact prefix join. Shingles are
put in one order, rare ones first; the first shingle that two linked texts share lies in a short
prefix of the smaller text and a longer one of the other, under either similarity, so no link
between texts of different classes is missed, however large a bucket is. Every compared pair is
verified on its whole texts: weighted Jaccard or plain Jaccard of the shingle sets of at least 0.8
is a link, and linked texts form a class. Equal texts are one node, keyed by a 64-bit hash.

Nulls: a null text is the empty one; empty texts are one class. class_id is the smallest doc_id of
the class (null only where it has none). Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm import common as C
from agro_jobs.llm.graph import components

SHINGLE, SIMILARITY, SAMPLES, BANDS, SMALL = 5, 0.8, 80, 20, 32
IDF_BUCKETS, DRAW_BITS, LOW, HUB = 1 << 18, 12, 0.125, 256
DRAWS = 1 << DRAW_BITS
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[128:] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = C.LOWER[data]
    s, e, doc = C.word_bounds(data, offsets, SEPARATOR)
    return C.spans_hash(data, s, e), doc


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, heads and counts of the distinct (doc, value)."""
    order = np.lexsort((value, doc))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    head = np.flatnonzero(new)
    return order, head, np.diff(np.append(head, len(order)))


def shingles(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of every distinct shingle, sorted by document and hash."""
    word, doc = _words(data, offsets)
    value = idf[(word & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)].astype(np.float64) if len(idf) else np.ones(len(word))
    n = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    begin = np.cumsum(n) - n
    full = np.flatnonzero(doc[: len(doc) - SHINGLE + 1] == doc[SHINGLE - 1 :]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    small = np.flatnonzero((n > 0) & (n < SHINGLE))
    start = np.concatenate([full, begin[small]])
    end = np.concatenate([full + SHINGLE, begin[small] + n[small]])
    h, d = C.spans_hash(word, start, end), np.concatenate([doc[full], small])
    sums = np.concatenate([[0.0], np.cumsum(value)])
    mean = (sums[end] - sums[start]) / np.maximum(end - start, 1)
    order, head, tf = _distinct(d, h)
    first = order[head]
    return d[first], h[first], (1 + np.log(tf)) * (1 + mean[first]) / 2


_DRAWN: list[np.ndarray] = []


def _draws() -> list[np.ndarray]:
    """Of DRAWS draws for every sample: r, beta, ln c + r (beta - 1), ln c - r; odd multipliers; which are low, and above what the others are."""
    if not _DRAWN:
        rng = np.random.default_rng(20)
        shape = (SAMPLES, DRAWS)
        r, logc, beta = rng.gamma(2, 1, shape), np.log(rng.gamma(2, 1, shape)), rng.random(shape)
        least = logc - r
        edge = np.quantile(least, LOW, axis=1)
        odd = rng.integers(1, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        _DRAWN.extend([r, beta, logc + r * (beta - 1), odd, least <= edge[:, None], edge])
    return _DRAWN


def _draw(h: np.ndarray, logw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of sample k; ln a carries a trace of the hash, so ties break alike everywhere."""
    r_, beta, shifted = _draws()[:3]
    r = r_[k][at]
    t = np.floor(logw / r + beta[k][at])
    return shifted[k][at] - r * t + (h & np.uint64(0xFFFFF)).astype(np.float64) * 1e-10, t


def _smallest(a: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the smallest a in every group; groups are sorted and adjacent."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    if not len(start):
        return start
    size = np.diff(np.append(start, len(a)))
    hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, start), size))
    return hit[np.searchsorted(hit, start)]


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, docs: int) -> np.ndarray:
    """The SAMPLES consistent weighted samples of each document that has shingles, in order of document.

    ln a is at least ln c - r - ln w. A draw that isn't low can therefore only win where no low one
    falls below `edge` less the document's greatest ln w: low draws are tried first, all draws where
    they don't settle it. The result is the same as with all draws.
    """
    n, logw = np.bincount(doc, minlength=docs), np.log(w)
    some = np.flatnonzero(n)
    out = np.empty((len(some), SAMPLES), np.uint64)
    if not len(some):
        return out
    start = np.cumsum(n[some]) - n[some]
    row = np.repeat(np.arange(len(some)), n[some])
    most = np.maximum.reduceat(logw, start)
    _, _, _, odd, low, edge = _draws()
    for k in range(SAMPLES):
        at = ((h * odd[k]) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)

        def fill(pick: np.ndarray, at=at, k=k) -> tuple[np.ndarray, np.ndarray]:
            a, t = _draw(h[pick], logw[pick], at[pick], k)
            i = _smallest(a, row[pick])
            won = row[pick[i]]
            out[won, k] = h[pick[i]] + t[i].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return won, a[i]

        won, best = fill(np.flatnonzero(low[k][at]))
        open_ = np.ones(len(some), bool)
        open_[won[best <= edge[k] - most[won]]] = False
        if open_.any():
            fill(np.flatnonzero(open_[row]))
    return out


def band_keys(doc: np.ndarray, h: np.ndarray, w: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and their keys (documents x BANDS)."""
    got = samples(doc, h, w, docs)
    key = np.zeros((len(got), BANDS), np.uint64)
    for j in range(SAMPLES // BANDS):
        key = C.mix(key * np.uint64(31) + C.mix(got[:, j :: SAMPLES // BANDS]) + np.arange(BANDS, dtype=np.uint64))
    return np.flatnonzero(np.bincount(doc, minlength=docs)), key


def _fresh(b: pa.RecordBatch) -> pa.RecordBatch:
    """Equal texts of a batch once."""
    _, first = np.unique(b.column("k1").to_numpy(), return_index=True)
    return b.take(pa.array(np.sort(first)))


def _map_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): in how many of the task's texts a bucket's words occur."""
    seen = np.zeros(IDF_BUCKETS, np.int64)
    for b in batches:
        for _, _, data, off in C.text_chunks(b, "text"):
            word, doc = _words(data, off)
            bucket = (word & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)
            pairs = np.unique(doc * IDF_BUCKETS + bucket)
            seen += np.bincount(pairs & (IDF_BUCKETS - 1), minlength=IDF_BUCKETS)
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])


def _map_bands(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _fresh(b)
            k1 = b.column("k1").to_numpy()
            for at, n, data, off in C.text_chunks(b, "text"):
                doc, h, w = shingles(data, off, idf.value)
                ids, keys = band_keys(doc, h, w, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(k1[at + ids]), lists], names=["k1", "bands"])

    return run


def _pair_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of pairs whose texts have CHUNK_BYTES together, or of one pair."""
    size = np.cumsum(pc.add(pc.binary_length(b.column("ta")), pc.binary_length(b.column("tb"))).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(b):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + C.CHUNK_BYTES, "right")))
        yield b.slice(at, end - at)
        at = end


def _map_verify(idf):
    """Adds similarity (weighted) and plain (of the sets) to pairs with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pair_slices(b):
                (_, n, da, oa), (_, _, db, ob) = (next(C.text_chunks(part, c, 1 << 60)) for c in ("ta", "tb"))
                d1, h1, w1 = shingles(da, oa, idf.value)
                d2, h2, w2 = shingles(db, ob, idf.value)
                d, h, w = np.concatenate([d1, d2]), np.concatenate([h1, h2]), np.concatenate([w1, w2])
                o = np.lexsort((h, d))
                both = np.flatnonzero((d[o][1:] == d[o][:-1]) & (h[o][1:] == h[o][:-1])) if len(o) else o
                low = np.minimum(w[o[both]], w[o[both + 1]]) if len(both) else np.zeros(0)
                shared, common = np.bincount(d[o[both]], low, n), np.bincount(d[o[both]], minlength=n)
                total, size = np.bincount(d, w, n), np.bincount(d, minlength=n)
                sim, plain = shared / np.maximum(total - shared, 1e-12), common / np.maximum(size - common, 1)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim), pa.array(plain.astype(float))], names=["a", "b", "similarity", "plain"])

    return run


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Scaled idf of every word bucket, float32."""
    rows = texts.select("text").mapInArrow(_map_words, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most IDF_BUCKETS rows
    n = texts.count()
    df = np.zeros(IDF_BUCKETS)
    df[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return (np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(2 + n)).astype(np.float32)


def _pairs(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and the members of large buckets with their leader.

    members: key, k1. Small buckets give all their pairs, large ones a pair (leader, member).
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = C.materialize(members.join(sizes, "key"), f"{name}-members")
    small = (
        held.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("k1")).alias("ids"))
        .select("ids", F.posexplode("ids").alias("i", "a"))
        .select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    )
    large = held.where(F.col("n") > SMALL)
    meets = large.groupBy("k1").agg(F.sum("n").alias("meets"))
    leaders = large.join(meets, "k1").groupBy("key").agg(F.max(F.struct("meets", "k1"))["k1"].alias("leader"))
    star = C.materialize(large.select("key", "k1").join(leaders, "key"), f"{name}-stars")
    pairs = small.union(star.where("k1 != leader").select(F.least("k1", "leader"), F.greatest("k1", "leader")))
    return C.materialize(pairs.distinct(), f"{name}-pairs"), star


def _verified(pairs: DataFrame, texts: DataFrame, idf, name: str) -> DataFrame:
    """a, b, similarity, plain of the pairs."""
    from agro_jobs.llm.fingerprint_index import _map_flagged, bitmap  # noqa: PLC0415

    ids = C.materialize(pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct(), f"{name}-ids")
    near = texts.mapInArrow(_map_flagged(bitmap(ids, "k1")), "k1 long, text string").join(ids, "k1", "left_semi").dropDuplicates(["k1"])
    near = C.materialize(near, f"{name}-texts")
    # A leader meets many texts: its own text goes to as many places as it has HUB pairs, so that no task holds them all.
    degrees = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("places"))
    hubs = degrees.where("places > 1").select(F.col("a").alias("k1"), "places")
    spread = C.materialize(near.join(hubs, "k1", "left").select("k1", "text", F.coalesce("places", F.lit(1)).alias("places")), f"{name}-spread")
    copies = spread.select("k1", "places", "text", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    placed = pairs.join(hubs.select(F.col("k1").alias("a"), F.col("places").alias("pa")), "a", "left").join(hubs.select(F.col("k1").alias("b"), F.col("places").alias("pb")), "b", "left")
    placed = placed.select("a", "b", *[F.pmod(F.xxhash64(other), F.coalesce(p, F.lit(1))).cast("int").alias(p) for other, p in (("b", "pa"), ("a", "pb"))])
    both = placed.join(copies.select(F.col("k1").alias("a"), F.col("place").alias("pa"), F.col("text").alias("ta")), ["a", "pa"]).join(
        copies.select(F.col("k1").alias("b"), F.col("place").alias("pb"), F.col("text").alias("tb")), ["b", "pb"]
    )
    return C.materialize(both.select("a", "b", "ta", "tb").mapInArrow(_map_verify(idf), "a long, b long, similarity double, plain double"), f"{name}-verified")


def _links(verified: DataFrame, similarity: float) -> DataFrame:
    return verified.where((F.col("similarity") >= similarity) | (F.col("plain") >= similarity))


def _unexplained(star: DataFrame, verified: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """k1, c (its class), open, for the texts that large buckets have left to compare.

    A bucket is left if a member is in another class than its leader; such members are open. A
    member m can only be linked to an open x if d(m, leader) >= d(x, leader) - (1 - similarity),
    for the distance by which they are linked, so both are kept apart.
    """
    d = verified.select("a", "b", (1 - F.col("similarity")).alias("dw"), (1 - F.col("plain")).alias("dp"))
    far = star.withColumns({"a": F.least("k1", "leader"), "b": F.greatest("k1", "leader")}).join(d, ["a", "b"], "left")
    far = far.select("key", "k1", "leader", F.coalesce("dw", F.lit(0.0)).alias("dw"), F.coalesce("dp", F.lit(0.0)).alias("dp"))
    own, its = labels.select(F.col("id").alias("k1"), F.col("label").alias("c")), labels.select(F.col("id").alias("leader"), F.col("label").alias("lc"))
    classed = far.join(own, "k1", "left").join(its, "leader", "left").withColumn("other", (F.col("k1") != F.col("leader")) & ~F.coalesce(F.col("c") == F.col("lc"), F.lit(False)))
    left = classed.where("other").groupBy("key").agg(*[(F.min(x) - (1 - similarity) - 1e-9).alias(f"least_{x}") for x in ("dw", "dp")])
    some = classed.join(left, "key").where("dw >= least_dw or dp >= least_dp")
    return C.materialize(some.groupBy("k1").agg(F.coalesce(F.first("c"), "k1").alias("c"), F.max("other").alias("open")), "near-left")


def _map_shingle_counts(idf):
    """(bucket, n): how many of the task's distinct shingles of texts fall in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(IDF_BUCKETS, np.int64)
        for b in batches:
            for _, _, data, off in C.text_chunks(b, "text"):
                seen += np.bincount((shingles(data, off, idf.value)[1] & np.uint64(IDF_BUCKETS - 1)).astype(np.int64), minlength=IDF_BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    return run


def _map_prefixes(idf, counts, similarity: float):
    """token, k1, c, open, size, rest, short: the shingles of a text's prefix, for either similarity.

    rest is the weight from a shingle on. A shingle is in the prefix if the rest could still be
    enough overlap: a share `similarity` of the text's own size, or (short) what the smaller one
    of a pair must share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, off in C.text_chunks(b, "text"):
                d, h, w = shingles(data, off, idf.value)
                many = counts.value[(h & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((h, many, d))
                d, h, w, many = d[order], h[order], w[order], many[order]
                for kind, x in enumerate((np.ones(len(d)), w)):
                    size = np.bincount(d, x, n)
                    ends = np.cumsum(size)
                    rest = ends[d] - (np.cumsum(x) - x)
                    least = rest + 1e-9 * ends[-1] if len(ends) else rest
                    use = np.flatnonzero((least >= similarity * size[d]) & (many > 1))  # what occurs once has no partner
                    token = C.mix(h[use] * np.uint64(2) + np.uint64(kind)).view(np.int64)
                    part = b.slice(at, n).select(["k1", "c", "open"]).take(pa.array(d[use]))
                    short = least[use] >= 2 * similarity / (1 + similarity) * size[d[use]]
                    yield pa.RecordBatch.from_arrays([pa.array(token), *part.columns, pa.array(size[d[use]]), pa.array(least[use]), pa.array(short)], names=["token", "k1", "c", "open", "size", "rest", "short"])

    return run


def _prefix_pairs(left: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes, one of them open, that can reach the similarity: no such pair is left out."""
    from agro_jobs.llm.fingerprint_index import _map_flagged, bitmap  # noqa: PLC0415

    near = texts.mapInArrow(_map_flagged(bitmap(left, "k1")), "k1 long, text string").join(left, "k1").dropDuplicates(["k1"])
    near = C.materialize(near, "near-left-texts")
    rows = near.select("text").mapInArrow(_map_shingle_counts(idf), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most IDF_BUCKETS rows
    counts = np.zeros(IDF_BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    held = left.sparkSession.sparkContext.broadcast(counts)
    tokens = C.materialize(near.mapInArrow(_map_prefixes(idf, held, similarity), "token long, k1 long, c long, open boolean, size double, rest double, short boolean"), "near-prefixes")
    shared = tokens.groupBy("token").agg(F.max("short").alias("s"), F.max("open").alias("o"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("s and o and c0 != c1").select("token")
    tokens = C.materialize(tokens.join(shared, "token", "left_semi"), "near-tokens")
    sides = []
    for smaller, larger in (("short and open", "true"), ("short and not open", "open")):
        x = tokens.where(smaller).select("token", F.col("k1").alias("x"), F.col("c").alias("cx"), F.col("size").alias("sx"), F.col("rest").alias("rx"))
        y = tokens.where(larger).select("token", F.col("k1").alias("y"), F.col("c").alias("cy"), F.col("size").alias("sy"), F.col("rest").alias("ry"))
        fits = (F.col("cx") != F.col("cy")) & (F.col("sx") <= F.col("sy") * (1 + 1e-9)) & (F.col("sx") >= F.col("sy") * (similarity - 1e-9))
        # At the first shingle that two texts share, no more than either's rest can be shared.
        fits = fits & (F.least("rx", "ry") >= similarity / (1 + similarity) * (1 - 1e-9) * (F.col("sx") + F.col("sy")))
        sides.append(x.join(y, "token").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return sides[0].union(sides[1]).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_copies (rows of the same text), one row per row of docs."""
    return _classes(docs, similarity).select("doc_id", "class_id", "n_copies")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("k1"), text.alias("text"))
    texts, spark = keyed.select("k1", "text"), docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(texts))
    bands = C.materialize(texts.mapInArrow(_map_bands(idf), "k1 long, bands array<bigint>").dropDuplicates(["k1", "bands"]), "near-bands")
    pairs, star = _pairs(bands.select(F.explode("bands").alias("key"), "k1").distinct(), "near")
    verified = _verified(pairs, texts, idf, "near")
    links = _links(verified, similarity)
    labels = components(links)
    left = _unexplained(star, verified, labels, similarity)
    if left.limit(1).count():
        apart = _prefix_pairs(left, texts, idf, similarity).join(pairs, ["a", "b"], "left_anti")
        verified2 = _verified(C.materialize(apart, "near2-apart"), texts, idf, "near2")
        links = links.unionByName(_links(verified2, similarity))
        labels = components(links)
    rows = C.materialize(keyed.select("doc_id", "k1"), "near-rows")
    nodes = rows.groupBy("k1").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    nodes = nodes.join(labels.withColumnRenamed("id", "k1"), "k1", "left")
    nodes = C.materialize(nodes.select("k1", "first", "n_copies", F.coalesce("label", "k1").alias("label")), "near-nodes")
    least = nodes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "k1")).alias("head"))
    ids = nodes.join(least, "label").select("k1", F.col("head.first").alias("class_id"), F.col("head.k1").alias("class_key"), "n_copies")
    return rows.join(C.materialize(ids, "near-classes"), "k1")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns."""
    heads = _classes(docs, similarity).where("k1 = class_key and doc_id <=> class_id").groupBy("doc_id", "k1").agg(F.count("*").alias("n"))
    heads = C.materialize(heads, "near-heads")
    rows = docs.select(C.packed(docs), docs["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("k1"))
    found = rows.join(heads.withColumnRenamed("doc_id", "id"), "k1").where("doc_id <=> id")
    kept = found.where("n = 1").select("row")
    if heads.where("n > 1").limit(1).count():  # rows with one id and one text, repeated
        kept = kept.unionByName(found.where("n > 1").dropDuplicates(["id", "k1"]).select("row"))
    return kept.select("row.*")
