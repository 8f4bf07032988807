"""Sharding by k-d tree partitioning (DataFrame functions only).

Documents are points in metadata space: the ranks of their source and language, and their
size. A node is split across its widest dimension, relative to the whole table's range, at
the byte-weighted median, until every leaf holds the target share of bytes. Copies of one
text are one point (their smallest source and language) and are told from other texts by
hashes of the text, so they stay in one shard: a cut that falls into a group goes to its nearer side. Only a
group with more than `GROUP_SHARE` of a shard's bytes is itself too large to balance; it is split by document.

The weighted median is found by refining histograms: all nodes of a level are counted into
at most BINS bins each, the bin that holds the median is refined next, and only that bin's
bounds reach the driver. No row is sorted or moved for it, and no value can be hot.

Nulls: a null text has 0 bytes and a null source or language comes first. Empty tables give
no rows; repeated rows are separate documents and copies of one text; other columns are ignored, whatever their
names. Texts are only measured and hashed, whatever their length. Ties are broken by hashes of text, then row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.llm.common import materialize

BINS = 1 << 16
TOLERANCE = 0.0005  # of a node's bytes: a median this near is taken, so that ties need no breaking
ROWS_PER_CHUNK, PILE = 50_000, 1 << 16
DIMS = ("source_key", "lang_key", "size")
KEYS = ("text_crc32", "text_key", "row_key")  # 32 bits each; ties are broken by these, in this order
GROUP_SHARE = 0.25  # of a shard's bytes: a group of equal texts up to this stays whole


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows with name_key, the rank of name's value among all values; one row per value is windowed, null first."""
    ranks = rows.select(name).distinct().select(F.col(name).alias("_v"), (F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())) - 1).cast("long").alias(f"{name}_key"))
    return rows.join(ranks, F.col(name).eqNullSafe(F.col("_v"))).drop("_v", name)


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every document; small rows, kept in the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    # Rows that repeat are counted and dealt out again, each with a key of its own.
    piles = keys.groupBy(*keys.columns).agg(F.count("*").alias("n"))
    parts = piles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PILE))))
    each = parts.withColumn("i", F.explode(F.sequence(F.col("part") * PILE, F.least(F.col("n"), (F.col("part") + 1) * PILE) - 1)))
    rows = materialize(each.select(*keys.columns, F.shiftrightunsigned(F.xxhash64("doc_id", "i", F.lit(5)), 32).alias("row_key")), "shard-rows")
    ranked = _ranked(_ranked(rows, "source"), "lang")
    # Only texts with copies need a common point; the rest keep their own.
    groups = ranked.groupBy("text_hash", "size").agg(F.min("source_key").alias("sk"), F.min("lang_key").alias("lk"), F.count("*").alias("n"))
    copies = groups.where("n > 1").select(F.col("text_hash").alias("th"), F.col("size").alias("sz"), "sk", "lk")
    out = ranked.join(copies, (F.col("text_hash") == F.col("th")) & (F.col("size") == F.col("sz")), "left")
    return materialize(
        out.withColumn("source_key", F.coalesce("sk", "source_key")).withColumn("lang_key", F.coalesce("lk", "lang_key")).withColumn("text_key", F.shiftrightunsigned("text_hash", 32))
        .drop("th", "sz", "sk", "lk", "text_hash"),
        "shard-points",
    )


def _is_left(dim: str, cut: list[int]) -> Column:
    """(dim, *KEYS) is before the cut, which may name only the first of them."""
    left, same = F.lit(False), F.lit(True)
    for name, x in zip((dim, *KEYS), cut, strict=False):
        left, same = left | (same & (F.col(name) < x)), same & (F.col(name) == x)
    return left


def _medians(rows: DataFrame, nodes: dict[int, dict], whole: float) -> dict[int, list[int]]:
    """The cut of each node {node: {dim, lo, hi, share}}; rows have a node column. Groups of at most `whole` bytes stay whole."""
    active = {k: {**v, "prefix": [], "key": 0, "rest": None} for k, v in nodes.items()}
    cuts: dict[int, list[int]] = {}
    while active:
        value, inside = F.lit(None).cast("long"), F.lit(False)
        for k, v in active.items():
            names = (v["dim"], *KEYS)
            width = (v["hi"] - v["lo"]) // BINS + 1
            here = (F.col("node") == k) & F.col(names[v["key"]]).between(v["lo"], v["hi"])
            for name, x in zip(names, v["prefix"], strict=False):
                here = here & (F.col(name) == x)
            inside = inside | here
            value = F.when(here, F.floor((F.col(names[v["key"]]) - v["lo"]) / width)).otherwise(value)
            v["width"] = width
        bins = rows.where(inside).groupBy("node", value.alias("bin")).agg(F.sum("size").alias("w"))
        by = Window.partitionBy("node")
        share = F.coalesce(*[F.when(F.col("node") == k, F.lit(float(v["want"]) if v["rest"] is not None else None)) for k, v in active.items()])
        portion = F.coalesce(*[F.when(F.col("node") == k, F.lit(float(v["share"]))) for k, v in active.items()])
        found = (
            bins.withColumn("total", F.sum("w").over(by))
            .withColumn("cum", F.sum("w").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("want", F.coalesce(share, portion * F.col("total")))
            .where((F.col("cum") - F.col("w") < F.col("want")) & (F.col("cum") >= F.col("want")))
            .select("node", "bin", "w", "cum", "want", "total")
            .collect()  # one row per node
        )
        for r in found:
            v = active[r["node"]]
            v["rest"] = v["rest"] or r["total"]
            lo = v["lo"] + int(r["bin"]) * v["width"]
            hi = min(v["hi"], lo + v["width"] - 1)
            before, after = r["want"] - (r["cum"] - r["w"]), r["cum"] - r["want"]
            last = lo == hi and (v["key"] == len(KEYS) or v["key"] == len(KEYS) - 1 and r["w"] <= whole)
            if min(before, after) <= TOLERANCE * v["rest"] or last:
                cuts[r["node"]] = [*v["prefix"], lo if before <= after else hi + 1]
                del active[r["node"]]
            elif lo == hi:
                v |= {"prefix": [*v["prefix"], lo], "key": v["key"] + 1, "lo": 0, "hi": (1 << 32) - 1, "want": before}
            else:
                v |= {"lo": lo, "hi": hi, "want": before}
        missed = set(active) - {r["node"] for r in found}
        for k in missed:  # rounding left the median at the very end of the node
            cuts[k] = [*active[k]["prefix"], active[k]["hi"] + 1]
            del active[k]
    return cuts


def kd_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, list[dict]]:
    """rows with their shard, and the splits that were made (at most shards - 1).

    Each level's node numbers are written once: histograms then read a plain column, and the
    plan stays flat however deep the tree is.
    """
    at = rows.withColumn("node", F.lit(1))
    leaves, splits, spread = {1: (0, shards)}, [], None
    whole = GROUP_SHARE * (rows.agg(F.sum("size")).first()[0] or 0) / shards
    while any(n > 1 for _, n in leaves.values()):
        open_nodes = {k: v for k, v in leaves.items() if v[1] > 1}
        bounds = {
            r["node"]: r
            for r in at.where(F.col("node").isin(*open_nodes)).groupBy("node").agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).collect()
        }
        if spread is None:
            if not bounds:
                break
            spread = {d: max(1, bounds[1][f"max_{d}"] - bounds[1][f"min_{d}"]) for d in DIMS}
        todo = {}
        for k, (first, n) in open_nodes.items():
            if k not in bounds:  # no document reached this node: its other leaves stay empty
                leaves[k] = (first, 1)
                continue
            b = bounds[k]
            dim = max(DIMS, key=lambda d: ((b[f"max_{d}"] - b[f"min_{d}"]) / spread[d], -DIMS.index(d)))
            todo[k] = {"dim": dim, "lo": b[f"min_{dim}"], "hi": b[f"max_{dim}"], "share": (n // 2) / n}
        if not todo:
            break
        node = F.col("node")
        moved = node
        for k, cut in _medians(at, todo, whole).items():
            first, n = leaves.pop(k)
            leaves[2 * k], leaves[2 * k + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            splits.append({"node": k, "dim": todo[k]["dim"], "cut": cut})
            moved = F.when(node == k, F.when(_is_left(todo[k]["dim"], cut), 2 * k).otherwise(2 * k + 1)).otherwise(moved)
        at = materialize(at.withColumn("node", moved), "shard-level")
    shard = F.lit(0)
    for k, (first, _) in leaves.items():
        shard = F.when(F.col("node") == k, F.lit(first)).otherwise(shard)
    return at.withColumn("shard", shard.cast("int")), splits


def numbered(rows: DataFrame, by: str, name: str, key: Column) -> DataFrame:
    """rows with `name` running from 0 without gaps inside each `by`, in bounded chunks."""
    chunks = max(1, -(-rows.count() // ROWS_PER_CHUNK))
    rows = rows.withColumn("_chunk", F.pmod(key, F.lit(chunks)))
    counts = rows.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_chunk").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, (F.col(by) == F.col("_by")) & (F.col("_chunk") == F.col("_c")))
        .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_chunk", "_in", "_by", "_c", "_start")
    )


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per row of docs."""
    rows = points(docs)
    placed = kd_tree(rows, shards)[0].select("doc_id", "size", "text_crc32", "row_key", "shard")
    return numbered(placed, "shard", "slot", F.col("row_key")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
