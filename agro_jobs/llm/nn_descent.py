"""Approximate nearest neighbours (cosine): an NN-descent graph, searched greedily.

Nodes are the distinct vectors. The graph starts from the best neighbours inside small blocks
(random hyperplanes; crowded blocks are split by a hash), and each round joins every node's
neighbours and reverse neighbours with each other, if one of the two is new since the last
round: neighbours of neighbours that are nearer than a node's worst neighbour replace it. Rounds
end when few edges change, whatever their number. A query walks the graph from its own node,
always expanding the nearest nodes not yet expanded, each step one join, until all of its BEAM
nearest are expanded.

Only the smallest TOP + 1 ids of a vector can be among a query's TOP nearest, so a vector keeps
those; it is exact, as ties go to the smaller id. The graph search is approximate; tests hold
its recall against brute force. A hub's reverse list is cut to the DEGREE nearest, in building
and in searching; each of its neighbours still leads to it.

Vectors are scaled by a power of two before they are measured, which changes no digit of a cosine
and keeps squares from overflowing. Vectors of different lengths are never compared. Vectors that
are null, zero or hold null or non-finite components, and rows without an id, take no part. Empty
tables give no rows. A repeated row is a candidate of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.llm.common import materialize

TOP, DEGREE, BLOCK, PROJECTIONS, ENOUGH = 5, 40, 384, 8, 0.02
BEAM, EXPAND, SALTS = 128, 32, 64


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ids): the smallest ids of every distinct vector; (node, vec): the vector as doubles in bytes."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    ).withColumn("node", F.xxhash64("embedding"))
    some = rows.groupBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, TOP + 1).alias("ids"))
    ids = some.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, TOP + 1).alias("ids"))
    vecs = rows.select("node", "embedding").dropDuplicates(["node"]).mapInArrow(_map_pack, "node long, vec binary")
    return materialize(ids, "ann-ids"), materialize(vecs, "ann-vectors")


def _map_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.column("embedding").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([np.asarray(x, np.float64).tobytes() for x in rows], pa.binary())], names=["node", "vec"])


def _matrix(column, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, split by the length of their vectors."""
    for b in batches:
        size = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)
        for n in np.unique(size):
            yield b.filter(pa.array(size == n))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component of each is at least a half and below one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _map_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one in half precision: a quarter of the bytes, enough to compare neighbours by."""
    for b in _by_length(batches, "vec"):
        x = _scaled(_matrix(b.column("vec")))
        x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16)
        dim = pa.array(np.full(len(b), x.shape[1], np.int32))
        yield pa.RecordBatch.from_arrays([b.column("node"), dim, pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "dim", "vec"])


def _units(column) -> np.ndarray:
    return _matrix(column, np.float16).astype(np.float32)


def _map_blocks(many: dict[int, int]):
    """Blocks of about BLOCK vectors; many: how many vectors there are of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_length(batches, "vec"):
            x = _units(b.column("vec"))
            bits = int(np.ceil(np.log2(max(many[x.shape[1]] / BLOCK, 1))))
            for k in range(PROJECTIONS):
                planes = np.random.default_rng(100 + k).normal(size=(x.shape[1], bits))
                code = (x @ planes > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([pa.array(code * PROJECTIONS + k), *(b.column(c) for c in ("dim", "node", "vec"))], names=["block", "dim", "node", "vec"])

    return run


EDGES = "a long, b long, sim float"


def _nearest(node: np.ndarray, sims: np.ndarray, floor: np.ndarray | None = None) -> pa.Table:
    """Each node's DEGREE best others of the block, if better than its floor."""
    np.fill_diagonal(sims, -2)
    k = min(DEGREE, len(node) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), np.int64)
    a = np.repeat(np.arange(len(node)), k)
    b, s = best.ravel(), np.take_along_axis(sims, best, 1).ravel()
    ok = s > (-2 if floor is None else floor[a])
    return pa.table({"a": node[a[ok]], "b": node[b[ok]], "sim": s[ok].astype(np.float32)})


def _block_edges(t: pa.Table) -> pa.Table:
    x = _units(t.column("vec"))
    node, first = np.unique(t.column("node").to_numpy(), return_index=True)
    x = x[first]
    return _nearest(node, x @ x.T)


def _join_edges(t: pa.Table) -> pa.Table:
    """The neighbours of one node among each other, one of the two being new: edges nearer than what they have."""
    node, x, new = t.column("node").to_numpy(), _units(t.column("vec")), t.column("new").to_numpy()
    sims = x @ x.T
    sims[np.ix_(~new, ~new)] = -2
    return _nearest(node, sims, t.column("worst").to_numpy())


def _best(edges: DataFrame) -> DataFrame:
    """The DEGREE nearest b of each a; an edge found again is not new."""
    near = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return near.withColumn("r", rank).where(F.col("r") <= DEGREE).drop("r")


def _reverse(graph: DataFrame) -> DataFrame:
    """The DEGREE nearest edges into each node, turned round."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))
    return graph.withColumn("r", rank).where(F.col("r") <= DEGREE).select(F.col("b").alias("a"), F.col("a").alias("b"), "new")


def build(vecs: DataFrame) -> DataFrame:
    """The graph: a, b, sim, new."""
    vecs = materialize(vecs.mapInArrow(_map_unit, "node long, dim int, vec binary"), "ann-units")
    many = {r["dim"]: r["count"] for r in vecs.groupBy("dim").count().collect()}  # a row for each length of vector
    blocks = vecs.mapInArrow(_map_blocks(many), "block long, dim int, node long, vec binary")
    sizes = materialize(blocks.groupBy("block", "dim").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("long").alias("parts")), "ann-blocks")
    dealt = blocks.join(sizes, ["block", "dim"]).withColumn("part", F.pmod(F.xxhash64("node", "block"), F.col("parts")))
    first = dealt.select("block", "dim", "part", "node", "vec").groupBy("block", "dim", "part").applyInArrow(_block_edges, EDGES)
    graph = materialize(_best(first.withColumn("new", F.lit(True))), "ann-graph")
    while True:
        worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= DEGREE, F.min("sim")).otherwise(-2).cast("float").alias("worst"))
        known = vecs.join(worst, "node").select("node", "vec", "worst")
        lists = graph.select("a", "b", "new").union(_reverse(graph)).groupBy(F.col("a").alias("at"), F.col("b").alias("node")).agg(F.max("new").alias("new"))
        fresh = F.max("new").over(Window.partitionBy("at"))
        lists = lists.withColumn("fresh", fresh).where("fresh").drop("fresh")
        found = lists.join(known, "node").groupBy("at").applyInArrow(_join_edges, EDGES)
        graph = materialize(_best(graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True)))), "ann-graph")
        total, changed = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("new").cast("long")), F.lit(0))).first()
        if changed <= ENOUGH * total:
            return graph


def _map_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _by_length(batches, "vec"):
        x, y = _scaled(_matrix(b.column("qvec"))), _scaled(_matrix(b.column("vec")))
        s = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(s)], names=["q", "node", "score"])


def search(queries: DataFrame, graph: DataFrame, vecs: DataFrame, starts: DataFrame) -> DataFrame:
    """q, node, score: the beam of every query. queries: q, qvec; starts: q, node."""
    links = materialize(graph.select("a", "b").union(_reverse(graph).select("a", "b")).distinct(), "ann-links")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(vecs, "node").join(queries, "q").select("q", "qvec", "node", "vec").mapInArrow(_map_scores, "q long, node long, score double")

    beam = materialize(scored(starts.distinct()).withColumn("open", F.lit(True)), "ann-beam")
    while True:
        turn = F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("score"), "node"))
        marked = materialize(beam.withColumn("go", F.col("open") & (turn <= EXPAND)), "ann-marked")
        go = marked.where("go")
        if not go.limit(1).count():
            return beam.select("q", "node", "score")
        reached = go.select("q", F.col("node").alias("a")).join(links, "a").select("q", F.col("b").alias("node")).distinct()
        fresh = scored(reached.join(marked, ["q", "node"], "left_anti")).withColumn("open", F.lit(True))
        seen = marked.select("q", "node", "score", (F.col("open") & ~F.col("go")).alias("open"))
        beam = materialize(seen.unionByName(fresh).withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"), "ann-beam")


def nearest(vectors: DataFrame, every: int = 50, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest rows of every row whose vec_id is divisible by `every`."""
    ids, vecs = nodes_of(vectors)
    graph = build(vecs)
    chosen = materialize(
        vectors.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64(F.transform("embedding", lambda x: x.cast("double"))).alias("q")).join(
            vecs.select(F.col("node").alias("q")), "q", "left_semi"), "ann-queries"
    )
    asked = chosen.select("q").distinct()
    queries = materialize(asked.join(vecs.withColumnRenamed("node", "q"), "q").withColumnRenamed("vec", "qvec"), "ann-asked")
    found = search(queries, graph, vecs, asked.select("q", F.col("q").alias("node")))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    ties = F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))
    few = found.withColumn("r", F.least(best, ties)).where(F.col("r") <= top + 1).join(ids, "node").select("q", "score", F.explode("ids").alias("vec_id"))
    own = F.row_number().over(Window.partitionBy("query_id", "vec_id", "copy").orderBy("score"))
    order = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    # A query row asks for itself once; its repeated rows ask again and find each other.
    asked_rows = chosen.groupBy("q", F.col("vec_id").alias("query_id")).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    out = asked_rows.join(few, "q").withColumn("o", own).where((F.col("vec_id") != F.col("query_id")) | (F.col("o") > 1))
    return out.withColumn("rank", order.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
