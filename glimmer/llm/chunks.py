"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes sets the borders of chunks, with a strict mask before the normal length and a loose
one after it (normalised chunking), so an edit moves only the borders near it. A fingerprint is the set of digests of a
text's chunks, each with its length; the likeness of two texts is the length they share over the length of the shorter.
Written as text it is that whole set, so the likeness of any two texts can be told from their fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm.common import mix, sliced, table, without

#: Normal, least and most bytes of a chunk. Masks have a bit more and a bit less than the normal length asks for.
NORMAL, LEAST, MOST = 32, 8, 128
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Ranges of documents that a task has.
PARTS = 4
#: Bytes of a chunk's digest in a fingerprint; one more holds its length.
DIGEST = 8


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 bytes' numbers, each shifted by its distance. Spans double at each step."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    return h


def borders(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of a text's bytes."""
    n = len(data)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    bits = NORMAL.bit_length() - 1
    h = gear(data)
    loose = np.flatnonzero(h >> np.uint32(32 - (bits - 1)) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - (bits + 1)) == 0]
    loose, strict, out, at = loose.tolist(), strict.tolist(), [], 0
    i = j = 0
    while n - at > LEAST:
        low, mid, high = at + LEAST, at + NORMAL, min(at + MOST, n)
        while j < len(strict) and strict[j] < low:
            j += 1
        if j < len(strict) and strict[j] <= min(mid, n):
            at = strict[j]
        else:
            while i < len(loose) and loose[i] <= mid:
                i += 1
            at = loose[i] if i < len(loose) and loose[i] <= high else high
        out.append(at)
    if at < n:
        out.append(n)
    return np.array(out, np.int64)


def fingerprint(text: str) -> dict[bytes, int]:
    """Digests of the distinct chunks of a text, and their lengths in bytes."""
    raw = text.encode()
    view, ends = memoryview(raw), borders(np.frombuffer(raw, np.uint8)).tolist()
    return {hashlib.blake2b(view[a:b], digest_size=DIGEST).digest(): b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)} if ends else {}


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Length of the shared chunks over that of all chunks of the shorter text, 0 to 1; two empty texts: 1, one: 0."""
    if not a or not b:
        return float(not a and not b)
    both = sum(a[k] for k in a.keys() & b.keys())
    return both / min(sum(a.values()), sum(b.values()))


def written(mark: dict[bytes, int]) -> str:
    """A fingerprint as text: its digests in order, each with the chunk's length, in base 64."""
    return base64.b64encode(b"".join(k + bytes([mark[k]]) for k in sorted(mark))).decode()


def read(text: str) -> dict[bytes, int]:
    """The fingerprint that ``written`` wrote."""
    raw = base64.b64decode(text)
    return {raw[k : k + DIGEST]: raw[k + DIGEST] for k in range(0, len(raw), DIGEST + 1)}


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(doc: int | None, text: str, mark: dict, after: str, next_mark: dict) -> tuple:
    new = edited(text, after)
    new_mark = fingerprint(new)
    return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), written(mark), written(new_mark), likeness(mark, new_mark), likeness(mark, next_mark)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, guest) in order; each is compared with the next of its part. A part ends with a guest, the first row of the next one."""
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    before, last = None, None
    for batch in sliced(batches, "text"):
        rows = []
        for part, doc, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mark = fingerprint(text)
            if before is not None and part == last:
                rows.append(_compare(*before, text, mark))
            before, last = None if guest else (doc, text, mark), part
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of the text edited with the next one, and their likenesses (the columns of ``_SCHEMA``).

    The next document is the one with the next lower doc_id; after the last comes the first; a lone document is its own
    next. Ties go by text, null ids come last; a null text is empty. Repeated rows each give a row; no rows give none;
    extra columns are ignored. Documents go to parts by ranges of doc_id, whose bounds (one number a part) are all that
    reaches the driver, and texts are shuffled once; the first text of every part also goes to the part before it.
    """
    spark = docs.sparkSession
    docs = without(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several parts a task even out how a hash deals them
    parts = PARTS * n
    found = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if n > 1 else []
    bounds = np.array(sorted({int(b) for b in found}), np.int64)

    @F.arrow_udf("long")
    def part(ids: pa.Array) -> pa.Array:
        """From the largest ids down; null ids are a part of their own."""
        at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at))

    placed = docs.select(part("doc_id").alias("part"), "doc_id", "text")
    # the first row of each part: its largest doc_id, of the least text
    firsts = docs.select("doc_id", part("doc_id").alias("part")).groupBy("part").agg(F.max("doc_id").alias("first_id"))
    order = Window.orderBy("part")
    # a row a part, without texts: the part before each one, and before the first the last
    firsts = firsts.select(F.col("part").alias("own"), "first_id", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("before"))
    heads = placed.join(F.broadcast(firsts), (placed.part == firsts.own) & placed.doc_id.eqNullSafe(firsts.first_id))
    guests = heads.groupBy("before").agg(F.min("text").alias("text")).select(F.col("before").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = rows.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_neighbours, _SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
