"""Embedding near-duplicates by lattice hashing.

A table projects unit vectors at random to BLOCKS times eight numbers and takes, in every block, the nearest point of each
of the two cosets that make up the E8 lattice: the home cell and its neighbour, whichever is nearer. A vector enters the
cells of all combinations, so two vectors share a cell of a table if either's cell is among the other's. Cosines in double
precision verify what shares a cell. Cells are compared in blocks of BLOCK vectors, a large cell as pairs of its blocks in
different tasks; a comparison yields one row a vector, never one a pair. Ids go first, in TURNS over the tables: vectors
are only sent to cells whose members earlier turns have not all connected. Links found so give components; the links
of a vector are then counted exactly within its component, by larger blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import cut, dropped, one_thread, table, without
from glimmer.llm.graph import components

TABLES, BLOCKS, SCALE, SEED = 10, 2, 0.7, 20240901
COSINE = 0.95
#: Vectors of a block, of one where links are only counted, and rows of a product at once there.
BLOCK, COUNTED, STRIP = 1024, 4096, 512
#: The last table of each turn, as shares of the tables.
TURNS = (0.1, 0.4, 1.0)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of the lattice D8 (whole numbers of even sum) to each row: round, and where the sum is odd round the worst number the other way."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=1)
    at = np.arange(len(x))
    r[at, worst] += np.where(off[at, worst] >= 0, 1.0, -1.0) * (r.sum(axis=1) % 2)
    return r


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Keys of the cells of each unit vector, in all tables, one table after the other."""
    n, d = unit.shape
    rng = np.random.default_rng([seed, d])
    out = []
    with np.errstate(over="ignore"):
        for t in range(tables):
            keys = np.full((n, 1), d * tables + t, np.int64)
            for _ in range(blocks):
                y = unit @ (rng.normal(size=(d, 8)) / 8**0.5 / scale)
                salt = rng.integers(1, 1 << 62, 8) | 1
                both = np.stack([2 * nearest(y), 2 * nearest(y - 0.5) + 1], axis=1).astype(np.int64)
                keys = ((keys[:, :, None] * np.int64(6364136223846793005)) ^ (both * salt).sum(axis=2)[:, None, :]).reshape(n, -1)
            out.append(keys)
    return np.concatenate(out, axis=1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector's doubles as bytes; null where it can't link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if e is None else e for e in v or []], "<f8") + 0.0
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def units(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length 1 (first by the largest number, so that squares stay finite)."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(tables: int, blocks: int, scale: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                nodes, raw = part.column(0).to_numpy(), part.column(1).to_pylist()
                sizes = np.array([len(r) for r in raw])
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    keys = cells(units([raw[k] for k in rows]), tables, blocks, scale, seed)
                    of = np.tile(np.repeat(np.arange(tables, dtype=np.int32), keys.shape[1] // tables), len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes[rows], keys.shape[1])), pa.array(of)], names=["key", "node", "table"])

    return run


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (key, node, v, n) of keys that hold several, dealt to block pairs: columns key, low, high, part are added.

    A key of up to ``block`` rows is one block; a larger one is cut by a hash of the node, and each row goes to all pairs
    of its block with others, so no task holds more than about two blocks.
    """
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").withColumn("parts", F.ceil(F.col("many") / block).cast("int"))
    dealt = rows.join(many, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "v", "n")


def linked(u: np.ndarray, part: np.ndarray, across: bool, cosine: float, low: int = 0, high: int | None = None) -> np.ndarray:
    """Which vectors of a block pair link, of rows low to high; of two different blocks only across, for pairs within a block have a comparison of their own."""
    rows = slice(low, len(u) if high is None else high)
    out = u[rows] @ u.T >= cosine
    out[np.arange(len(out)), np.arange(rows.start, rows.stop)] = False
    if across:
        out &= part[rows, None] != part[None, :]
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    root = np.arange(len(links))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(root)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _star(nodes: np.ndarray, weights: np.ndarray, u: np.ndarray, *how) -> tuple[np.ndarray, np.ndarray]:
    root = _roots(linked(u, *how))
    at = np.flatnonzero(root != np.arange(len(root)))
    return nodes[root[at]], nodes[at]


def _degrees(nodes: np.ndarray, weights: np.ndarray, u: np.ndarray, *how) -> tuple[np.ndarray, np.ndarray]:
    return nodes, np.concatenate([linked(u, *how, low, min(len(u), low + STRIP)) @ weights for low in range(0, len(u), STRIP)])


def _compare(make: Callable, cosine: float):
    """Sorted rows in; each block pair, however it falls into batches, gives the two columns that ``make`` takes from it."""

    def done(group: list[tuple], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by_size: dict[int, list[tuple]] = {}
        for row in group:
            by_size.setdefault(len(row[2]), []).append(row)
        for rows in by_size.values():
            if len(rows) > 1:
                part, node, v, n = zip(*rows, strict=True)
                yield make(np.array(node), np.array(n), units(list(v)), np.array(part), across, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        last, group, out = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, low, high) != last:
                    out += done(group, last is not None and last[1] != last[2])
                    last, group = (key, low, high), []
                group.append(tuple(row))
            if sum(len(o[0]) for o in out) > 10_000:
                yield flush()
                out.clear()
        out += done(group, last is not None and last[1] != last[2])
        yield flush()

    return run


def compared(rows: DataFrame, make: Callable, cosine: float, block: int = BLOCK) -> DataFrame:
    dealt = in_blocks(rows, block).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(_compare(make, cosine), "a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id = component_id), one row for each row.

    Links join vectors of the same length whose cosine is ``cosine`` or more; n_links counts the other rows linked
    directly. Vectors that are null, empty or zero or hold nulls, NaN or infinities link with nothing: no links, a
    component of their own. So do rows with a null vec_id, whose component is null and which are kept. Rows of one
    vec_id are rows on their own that share what is linked to any of them. Extra columns are ignored.
    """
    vectors = without(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = cut(vectors.mapInArrow(_vectors, "vec_id long, v binary"))
    able = known.where("v is not null and vec_id is not null")
    classes = cut(able.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    keyed = classes.select("node", "v").mapInArrow(_keys(tables, blocks, scale, seed), "key long, node long, table int").distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    keyed = cut(keyed.join(shared, "key"))
    found, labels, turn = [], None, 0
    for share in TURNS:
        low, turn = turn, max(turn + 1, round(share * tables))
        rows = keyed.where(F.col("table").between(low, turn - 1)).select("key", "node")
        if labels is not None:
            # by ids alone: the cells whose members aren't all connected
            placed = rows.join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
            apart = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
            rows = rows.join(apart, "key")
        found.append(cut(compared(rows.join(classes, "node").select("key", "node", "v", "n"), _star, cosine).distinct()))
        last, labels = labels, components(reduce(DataFrame.unionByName, found))
        if last is not None:
            dropped(last)
    dropped(keyed)
    links = reduce(DataFrame.unionByName, found)
    member = able.join(classes.select("v", F.col("node"), F.col("n").alias("same")), "v").select("vec_id", "node", "same")
    tied = member.select("vec_id", "node").distinct().join(member.groupBy("vec_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last"), "vec_id").select(F.col("first").alias("a"), F.col("node").alias("b"))
    labels = components(links.unionByName(tied))
    counted = compared(labels.join(classes, labels.id == classes.node).select(F.col("label").alias("key"), "node", "v", "n"), _degrees, cosine, COUNTED).groupBy("a").agg(F.sum("b").alias("near"))
    of = cut(member.join(counted.withColumnRenamed("a", "node"), "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left").select("vec_id", "node", (F.col("same") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("found")))
    rest = known.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    alone = rest.join(of.groupBy("vec_id").agg(F.min("found").alias("found")), "vec_id", "left")
    out = of.select("vec_id", "n_links", "found").unionByName(alone).withColumn("component_id", F.coalesce("found", "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
