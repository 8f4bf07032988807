"""What the operators share: tables, scratch storage, and vectorised work on text buffers.

The text helpers work on whole Arrow buffers with numpy, a few MB at a time, so a task's
memory depends on neither the batch size nor the length of the corpus (one document is the
smallest unit).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, so that they can't clash with those of an operator; `row.*` brings them back."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, LOWER_FROM, LOWER_TO)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---------------------------------------------------------------- text buffers

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << int(np.ceil(np.log2(n + 2)))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (base, inverse))
        _POWERS[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _B1) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from prefix sums modulo 2**64."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _B2)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; separator: 256 booleans. Words never cross documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:n]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets from 0) over the batch; null texts are empty."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(col):
        return
    raw = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(raw, raw[at] + limit, "right")) - 1)
        end = min(end, len(col))
        yield at, end - at, data[raw[at] : raw[end]], raw[at : end + 1] - raw[at]
        at = end


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window x[i:i+w], the index of its smallest value, the leftmost one on ties."""
    n = len(x) - w + 1
    best = np.arange(len(x))
    span = 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        span += step
    return best[:n]


def bounded(df: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """About `most` distinct rows of df at most, chosen by a hash of the row: the same whatever the partitioning.

    Rows are counted by distinct hashes (within 1 %), so that neither an id nor a row that repeats can fill the sample or
    vanish from it.
    """
    n = df.agg(F.approx_count_distinct(F.xxhash64(*df.columns), 0.01)).first()[0]
    share = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))
    return (df if n <= most else df.where(share)).distinct()


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int, positive: int, most: int, seed: int = 11) -> DataFrame:
    """doc_id, text: a bounded sample of distinct rows whose label is `positive` and which are not held out.

    The ids are about `most` at most, so they are broadcast and no text is moved to find theirs.
    """
    ids = bounded(labels.where((F.col(column) == positive) & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id"), most, seed)
    return bounded(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"), most, seed)


def with_columns(batch: pa.RecordBatch, columns: dict[str, np.ndarray], drop: str = "text") -> pa.RecordBatch:
    """The batch without its text, with further columns."""
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(v) for v in columns.values()], names=[*names, *columns])
