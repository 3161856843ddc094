"""Embedding whitening by weighted multiplicities.

Vectors become whole numbers first, so many are equal: equal ones are grouped, and all products are over distinct vectors
with their counts (or one) as weights. Sums are exact. The centred product gives the covariance, d * d numbers of which
reach the driver for its eigenvectors; each distinct vector is whitened once and joined back to its rows. A group with a
large share of all rows is joined by broadcast: of those there are HOT at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import cut, join_many, one_thread, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows that a task multiplies at once.
STRIP = 2048
#: Whole numbers beyond are held at it, so that they fit into 64 bits.
MOST = 1 << 61
#: Components whose variance is a smaller share of the largest have no direction of their own in double precision.
LEAST = 1e-12
RESULT = "n long, deviation long, component int, whitened double, explained double, identity_error double"


def packed(values: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """floor(SCALE * c) of each vector as bytes, equal for equal ones: the fewest bytes a number that hold all of a vector, then the numbers."""
    y = np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        low, high = (int(y[a:b].min()), int(y[a:b].max())) if b > a else (0, 0)
        size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
        out.append(bytes([size]) + y[a:b].astype(f"<i{size}").tobytes())
    return out


def unpacked(rows: list[bytes], d: int) -> np.ndarray:
    """x of vectors of d numbers: what was packed plus SHIFT."""
    out, sizes = np.zeros((len(rows), d), np.int64), np.array([r[0] for r in rows])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(rows[k][1:] for k in at), f"<i{size}").reshape(len(at), d)
    return out + SHIFT


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offs = np.asarray(lists.offsets).astype(np.int64)
        x = packed(np.asarray(lists.flatten(), float), offs - offs[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(np.diff(offs).astype(np.int32))], names=["vec_id", "x", "d"])


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: by Python's numbers where 64 bits don't hold it."""
    if n * int(np.abs(x).max(initial=0)) < MOST and max(map(abs, sums), default=0) < MOST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(away: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where 63 bits don't hold it."""
    d = away.shape[1]
    if away.dtype != object and d * int(np.abs(away).max(initial=0)) ** 2 < MOST:
        return (away * away).sum(axis=1).tolist()
    each = (away.astype(object) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in each.tolist()]


def _per_strip(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    one_thread()
    for batch in batches:
        for at in range(0, batch.num_rows, STRIP):
            part = batch.slice(at, STRIP)
            rows = part.column(0).to_pylist()
            yield rows, unpacked(rows, d), part.column(1).to_numpy()


def _sums(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for _, x, m in _per_strip(batches, d):
            small = int(m.max(initial=0)) * int(np.abs(x).max(initial=0)) * len(m) < MOST
            total += (m @ x if small else m.astype(object) @ x.astype(object)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(v) for v in total])], names=["i", "v"])

    return run


def _products(d: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Weighted sums of the products of ``rows_of`` a strip: i, j, v for i <= j, a set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for _, x, m in _per_strip(batches, d):
            y = rows_of(x)
            total = total + (y * m[:, None]).T @ y
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _matrix(distinct: DataFrame, d: int, size: int, rows_of: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((size, size))
    each = distinct.mapInArrow(_products(d, rows_of), "i int, j int, v double")
    for i, j, v in each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = out[j, i] = v / n
    return out


def axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and unit eigenvectors (columns) by falling variance, each one's largest entry positive; those without variance are left out."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    keep = np.flatnonzero(e > LEAST * max(e[0], 0.0))[:most] if len(e) else np.zeros(0, int)
    v = v[:, keep]
    return e[keep], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(keep))] < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """vec_id, component (1, 2, ...), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``weights``: 'counts', so that all vectors are fitted to, or 'one', each distinct one once; n is what they add up to.

    Vectors that are null, or hold null, NaN or infinite entries, are left out; so are those of another length than most
    rows have (of equally many, the longest). Repeated vectors and rows are fitted as often as they come and each returned;
    a null vec_id is a row like others; extra columns are dropped. A component without variance, as where all vectors are
    equal, isn't returned. An empty table gives no rows. A deviation that doesn't fit into 63 bits is null; entries beyond
    2**55 count as that.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"no weights {weights!r}: counts or one")
    spark = vectors.sparkSession
    kind = next(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name == "vec_id")
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = whole.mapInArrow(_vectors, f"{kind}, x binary, d int")
    counted = cut(rows.groupBy("x", "d").agg(F.count(F.lit(1)).alias("m")))
    sizes = counted.groupBy("d").agg(F.sum("m").alias("rows"), F.count(F.lit(1)).alias("distinct")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    none = spark.createDataFrame([], f"{kind}, {RESULT}").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if not sizes or not sizes[0]["d"]:
        return none
    d, many = sizes[0]["d"], sizes[0]["rows"]
    n = many if weights == "counts" else sizes[0]["distinct"]
    distinct = counted.where(F.col("d") == d).select("x", "m")
    fitted = distinct if weights == "counts" else distinct.select("x", F.lit(1).cast("long").alias("m"))
    sums = [0] * d
    for i, v in fitted.mapInArrow(_sums(d), "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[i] = int(v)

    def centred(x: np.ndarray) -> np.ndarray:
        return apart(x, n, sums).astype(float) / n

    covariance = _matrix(fitted, d, d, centred, n)
    e, v = axes(covariance, components)
    if not len(e):
        return none
    scaled = v / np.sqrt(e)
    # the whitened vectors are centred, as what they are made from is centred by exact sums
    after = _matrix(fitted, d, len(e), lambda x: centred(x) @ scaled, n)
    error = float(np.abs(after - np.eye(len(e))).max())

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, m in _per_strip(batches, d):
            away = apart(x, n, sums)
            z = (away.astype(float) / n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(m), pa.array(deviations(away), pa.int64()), lists], names=["x", "m", "deviation", "z"])

    done = distinct.mapInArrow(whiten, "x binary, m long, deviation long, z array<double>")
    back = join_many(rows.where(F.col("d") == d).select("vec_id", "x"), done, "x", "m", many)
    explained = F.array(*[F.lit(float(s)) for s in e / np.trace(covariance)])
    each = back.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
