"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

A text's set holds its distinct shingles. One hash deals the shingles to bins and gives each bin its least value; an
empty bin takes that of another one, chosen by a fixed random order of its own. Bands of bins make bucket keys. Texts of
equal sets are one node from here on. In every bucket each member is compared with one pivot, so candidates grow with
the members, not with their pairs, and pairs are confirmed on their full sets. Buckets whose members are not all
connected by then may still hide links. Their members get new, sharper buckets, one for each shingle of a prefix: in an
order by rarity, two sets of similarity s share a shingle among the first (1 - s) n + 1 of the larger and the first
(1 - 2 s / (1 + s)) n + 1 of the smaller one, so no link is lost, while what many texts have in common stands last.
There, the smaller ones are pivots for the larger, some each round, until no bucket has an unused pivot and, beside what
it has met, two unconnected members. A bucket of two is settled by its star, so few texts come so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from glimmer.llm.common import cut, dropped, flat, free_name, lists, mix, shingle_sets, sliced, table, tidy, without
from glimmer.llm.graph import components

#: A pair at the least similarity shares no bucket with probability (1 - 0.75**5)**40, about 2 in 100,000.
BANDS, ROWS = 40, 5
WORDS, PERCENT = 5, 75


def _orders(bins: int) -> np.ndarray:
    """For each bin, all bins in a random order of its own."""
    keys = mix(np.arange(1, bins * bins + 1, dtype=np.uint64)).reshape(bins, bins)
    return np.argsort(keys, axis=1, kind="stable")


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The least value of each bin, one row for each (not empty, sorted) set."""
    edges = (np.arange(bins, dtype=np.float64) * (2.0**64 / bins)).astype(np.uint64)
    out, empty = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        empty[k] = at == np.append(at[1:], len(s))
        out[k] = s[np.minimum(at, len(s) - 1)]
    order = _orders(bins)
    for k in np.flatnonzero(empty.any(axis=1)).tolist():
        full = ~empty[k]
        take = order[empty[k]]
        out[k, empty[k]] = out[k, take[np.arange(len(take)), full[take].argmax(axis=1)]]
    return out


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signs), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signs[:, r::rows])
    return keys


def _describe(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(*flat(batch.column(1)), words)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [np.zeros(0, np.uint64)] * len(sets)
            if full:
                for k, row in zip(full, band_keys(signatures([sets[k] for k in full], bands * rows), bands, rows), strict=True):
                    keys[k] = row
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), lists(keys)], schema=schema)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(shingle_sets(*flat(batch.column(1)), words))], names=["id", "members"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left, right = sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    # b, the member, comes first: many members meet one pivot, so that side is the one that may be uneven
    both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("ma").alias("na"), F.size("mb").alias("nb"), F.size(F.array_intersect("ma", "mb")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b").distinct()


def _distinct(met: DataFrame) -> DataFrame:
    """Each pair of a member and a pivot once: a, the pivot, and b."""
    return cut(met.select(F.col("p_node").alias("a"), F.col("node").alias("b")).distinct())


#: A row of a sharp bucket: a node's set, its component so far, its place in the bucket's prefix order, and whether it is yet to be a pivot.
_ROW = ["key", "node", "which", "n", "label", "alone", "at", "pivot"]


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open nodes (node, label) in a bucket for each shingle of their prefixes.

    Shingles that one node has alone come first and make no pairs: they only use up the prefix. A row holds its place,
    not the prefix, so rows stay as small for long texts as for short ones.
    """
    held = sets.join(nodes, sets.id == nodes.node).select("node", "label", F.xxhash64("members").alias("which"), F.size("members").alias("n"), F.explode("members").alias("key"))
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = held.join(often, "key").groupBy("node", "label", "which", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rest"))
    alone = F.col("n") - F.size("rest")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    first = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int") + 1 - alone
    kept = common.where(room > 0).select("node", "label", "which", "n", alone.alias("alone"), first.alias("first"), F.posexplode(F.slice("rest", F.lit(1), room)).alias("at", "shingle"))
    return kept.select("*", F.col("shingle.key").alias("key"), (F.col("at") < F.col("first")).alias("pivot")).select(*_ROW)


def _still_open(rows: DataFrame) -> DataFrame:
    """The rows that may hide links: in buckets with an unused pivot, it and all larger members, where they aren't all connected."""
    low = rows.where("pivot").groupBy("key").agg(F.min(F.struct("n", "node")).alias("low"))
    later = rows.join(low, "key").where(F.struct("n", "node") >= F.col("low")).select(*_ROW)
    apart = later.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    return later.join(apart, "key").select(*_ROW)


def _sharp_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between open nodes (node, label) of different components, enough to connect all that are linked.

    In a bucket the smallest unused pivots, some each round, meet the larger members of other components.
    """
    rows, pivots, links = cut(_still_open(cut(_prefixes(nodes, sets, percent)))), 1, []
    while rows.limit(1).count():
        part = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots)).alias("part")
        told = ["n", "node", "label", "alone", "at", "which"]
        chosen = rows.where("pivot").groupBy("key", part).agg(F.min(F.struct(*told)).alias("p"))
        chosen = cut(chosen.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in told]))
        # if this bucket's shingle is the first that both prefixes have, what they share stands from here on in either order
        rest = F.least(F.col("n") - F.col("alone") - F.col("at"), F.col("p_n") - F.col("p_alone") - F.col("p_at"))
        met = rows.join(chosen, "key").where((F.col("label") != F.col("p_label")) & (F.struct("p_n", "p_node") < F.struct("n", "node")))
        met = met.where((rest * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent) & (F.col("p_n") * 100 >= F.col("n") * percent))
        pairs = _distinct(met)
        new = cut(_confirmed(pairs, sets, percent))
        links.append(new)
        moved = components(_labelled(new, rows.select("node", "label").distinct())).select(F.col("id").alias("label"), F.col("label").alias("found"))
        used = chosen.select("key", F.col("p_node").alias("node"), F.col("p_which").alias("which"), F.lit(True).alias("used"))
        left = rows.join(used, ["key", "node", "which"], "left").join(moved, "label", "left")
        left = left.withColumn("label", F.coalesce("found", "label")).withColumn("pivot", F.col("pivot") & F.col("used").isNull())
        now = cut(_still_open(cut(left.select(*_ROW))))
        dropped(rows, chosen, pairs)
        rows, pivots = now, pivots * 8
    return reduce(DataFrame.unionByName, links) if links else None


def _labelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of nodes as links of their components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    return links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), one row for each row.

    Links join documents whose shingle sets have a Jaccard similarity of ``percent`` in 100 or more. Null, empty and
    blank texts have empty sets and link with nothing; so do rows with a null doc_id, whose component is null and which
    are kept. Rows with one doc_id count as one document, linked where any of its texts is. Extra columns are ignored.
    """
    docs = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = cut(docs.mapInArrow(tidy(_describe(words, bands, rows)), "doc_id long, n_shingles long, set_hash binary, keys array<long>"))
    sized = known.where("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    members = cut(sized.select("doc_id", "set_hash").join(classes, "set_hash").select("doc_id", "node").distinct())
    firsts = members.where("doc_id = node").select("node")
    placed = sized.join(firsts, sized.doc_id == firsts.node).select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n"))
    stars = placed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("n", "node")).alias("p")).where("many > 1")
    stars = cut(stars.select("key", F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n")))
    met = cut(placed.join(stars, "key").where("node <> p_node or n <> p_n"))
    # sets whose sizes differ by more can't reach the similarity; the pivot is the smallest
    pairs = _distinct(met.where((F.col("p_n") * 100 >= F.col("n") * percent) & (F.col("node") != F.col("p_node"))))
    wanted = met.select(F.col("node").alias("doc_id")).union(pairs.select("a")).distinct()
    sets = cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(_sets(words)), "id long, members array<long>"))
    links = cut(_confirmed(pairs, sets, percent))
    # a doc_id with several texts ties their nodes
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = links.unionByName(members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")))
    graph = components(links)
    # the pivots have met all; what else is in a bucket is open where it isn't all connected
    rest = met.select("key", "node").join(graph.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    nodes = cut(rest.join(apart, "key").select("node", "label").distinct())
    dropped(stars, met, pairs)
    more = _sharp_links(nodes, sets, percent)
    if more is not None:
        graph = components(links.unionByName(more))
    dropped(sets, nodes)
    found = graph.select(F.col("id").alias("node"), F.col("label").alias("found"))
    of = members.groupBy("doc_id").agg(F.min("node").alias("node")).join(found, "node", "left").select("doc_id", F.coalesce("found", "node").alias("component"))
    out = known.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: a row of its smallest doc_id.

    Of several rows of that doc_id the one of the least hash stays. Rows with a null doc_id and texts without words all
    stay, but a doc_id still has one row.
    """
    ids = cut(near_duplicates(docs, words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("many")).where("kept").select("doc_id", "many"))
    of, name = F.col("doc_id").cast("long"), free_name(docs, "kept_id")
    within = lambda condition: docs.join(ids.where(condition).select(F.col("doc_id").alias(name)), of == F.col(name), "left_semi")
    single, several = within("many = 1"), within("many > 1")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]))
    one = several.groupBy(of.alias("of")).agg(first.alias("row")).select("row.*")
    return single.unionByName(one).unionByName(docs.where(of.isNull()))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
