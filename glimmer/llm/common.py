"""Helpers that the operators of this subpackage share: tables, checkpoints, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes of rows that Spark sends a Python worker at once under ``small_batches``: a batch then is one slice.
BATCH_BYTES = SLICE_BYTES // 16 * 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id, modulus: int = 5):
    """crc32 of the id as text, modulo ``modulus``; the fold rule of the learning operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glimmer-")
        weakref.finalize(sc, shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(f"file://{base}")
        base = sc.getCheckpointDir()
    return f"{base}/glimmer-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends here, on storage all executors see."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if re.search(r"/glimmer-[0-9a-f]{32}/[^/]*$", f)}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those an operator makes."""
    return df.select(*[F.col(f"`{c}`") for c in keep])


#: Keys that ``join_many`` joins by broadcast, at most.
HOT = 1024


def join_many(rows: DataFrame, by_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with a table of distinct keys that says in ``count`` how many of the ``total`` rows have each.

    Keys that have more than the HOT-th part of all rows, fewer than HOT therefore, are broadcast, so no task gets a large
    key's rows; the others are shuffled. Keys must not be null.
    """
    hot = F.broadcast(by_key.where(F.col(count) * HOT > total))
    cold = by_key.where(F.col(count) * HOT <= total)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the table has a column of that name."""
    while name.lower() in [c.lower() for c in df.columns]:
        name = f"_{name}"
    return name


def rows_where(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``keep`` accepts, with all their columns, in one pass: each row is judged on its own, whatever its doc_id."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at, SLICE_BYTES // 2):
            yield batch.filter(pa.array(keep(batch.column(at))))

    return docs.mapInArrow(tidy(run), docs.schema)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row, and where each text starts (and the last one ends); null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column`` at most, one row at least."""
    for batch in batches:
        _, offs = flat(batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python rows by BATCH_BYTES at most (and a row), unless it has a lower limit already.

    By Spark's default a batch has 10,000 rows, some 35 MB of texts, which the JVM holds twice beside what Python holds.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Give freed memory back to the system: a worker outlives its task, and what it keeps counts against its executor while others work."""
    _POWERS.clear()  # 32 MB
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work on batches, after which its worker gives memory back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return work


def one_thread() -> None:
    """Let numpy's products run on one thread in this worker: the cores belong to Spark's tasks, and waiting threads cost as much as working ones.

    By the library that is loaded, as its environment variable counts only before; where it isn't found nothing changes.
    """
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class Memo:
    """What ``make`` gave for strings. Keeps the first ``most`` and no long ones, the others are made anew: it bounds memory and changes no result."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 500_000) -> None:
        self.make, self.most, self.kept = make, most, {}

    def all(self, keys: list[str]) -> list:
        kept, miss = self.kept, object()
        out = [kept.get(k, miss) for k in keys]
        new = [k for k, v in enumerate(out) if v is miss]
        if new:
            for k, v in zip(new, self.make([keys[k] for k in new]), strict=True):
                out[k] = v
                if len(keys[k]) < 64 and len(kept) < self.most:
                    kept[keys[k]] = v
        return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of spans that begin at ``starts`` and have ``sizes`` elements, one span after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary rows of 32-bit numbers: row k joins the spans of ``pool`` with codes[first[k] : first[k + 1]]."""
    each = sizes[codes]
    out = pool[ragged(starts[codes], each)]
    offs = np.concatenate([[0], np.cumsum(each)])[first] * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)])


def joined(values: list[bytes], codes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary rows of 32-bit numbers: row k joins the values with codes[first[k] : first[k + 1]]."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    pool, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
    return gathered(pool, starts, sizes, codes, first).cast(pa.binary())


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or runs of bytes that ``white`` doesn't mark), and for each text (and the end) the number of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    white = white[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, white[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, white[1:]
    after[offs[1:] - 1] = True
    after[-1] = True
    solid = ~white
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = pow(_STEP, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, SLICE_BYTES + 1024), v, np.uint64))]) for v in (_STEP, inverse)]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand: prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of ``size`` lower-cased words (fewer words: of all of them; none: empty)."""
    data = lowered(data)
    starts, ends, first = words(data, offs)
    each = span_hashes(data, starts, ends)
    n = len(each)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        whole += each[k : k + len(whole)] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    whole = mix(whole + np.uint64(size))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            h = sum(int(each[a + k]) * pow(_STEP, k + 1, 1 << 64) for k in range(b - a)) + (b - a)
            out.append(mix(np.array([h % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))
