"""Packing: token streams of documents, in their order, cut into sequences with little padding.

A document's tokens are its ids and one end id. The stream is cut into windows of at most ``size`` tokens by dynamic
programming over the places where a document or a sentence ends (and, within longer sentences, places ``size`` apart).
A window of length n costs its padding, none if n is a power of two, a little for being a sequence at all (or texts would
be broken into crumbs of such lengths), and where it ends inside a document a penalty for the truncation. With ``size - n`` as padding the best start of a window that ends at p minimises cost(start) + start
over the last ``size`` tokens, so a monotone queue gives it in constant time; windows of the few lengths without padding
are looked up beside it.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import flat, gathered, ragged, sliced, table, tidy, without

VOCABULARY = "word_bpe_49k.json"
SIZE, END = 2048, 1
#: Padding tokens that a cut inside a document is worth: at a sentence's end, and inside a sentence.
SENTENCE, INSIDE = 4, 64
#: Padding tokens that a sequence more is worth.
EACH = 8
#: Tokens that are cut into windows at once in a task; only the last window of such a run can be short for want of text.
RUN = 1 << 20
#: Words whose ids a task keeps, at most, and a kept word's bytes; the others are encoded anew.
WORDS, LONG = 500_000, 64
#: Bytes of text that are encoded at once, and pieces that are handed on at once.
SLICE, ROWS = 4 << 20, 1024
_MARK = "<|endoftext|>"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


#: What ``_characters`` and ``_plain`` do for a vocabulary that says so: lower case, then letters, single numerals, other characters, and these endings.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: First letters of those endings.
_ENDINGS = "strvmld"
#: Kinds of characters; the tokenizer alone handles words with odd ones.
ODD, LETTER, NUMERAL, OTHER = range(4)
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def _characters(tokenizer) -> Spans:
    """Kinds of the code points that stand for themselves whatever is beside them and their lower case, and what stands for each byte of these, all as the tokenizer says; the last code point is odd, as all beyond are."""
    kind, low, shown = np.zeros(0x2029, np.uint8), np.arange(0x2029, dtype=np.uint32), np.arange(256, dtype=np.uint32)
    if json.loads(tokenizer.normalizer.__getstate__()) != _NORMALIZER or json.loads(tokenizer.pre_tokenizer.__getstate__())["pretokenizers"][0] != _SPLIT:
        return kind, low, shown
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str
    for code in (*range(0x21, 0x530), *range(0x2010, 0x2028)):
        c = chr(code)
        # what combines with a character before it has a class, in these ranges
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            continue
        small = tokenizer.normalizer.normalize_str(c)
        if len(small) == 1 and len(small.encode()) <= len(c.encode()) and ord(small) < len(kind) and pieces(small):
            low[code] = ord(small)
            shown[list(small.encode())] = [ord(b) for b in pieces(small)[0][0]]
            kind[code] = LETTER if len(pieces(small + "a")) == 1 else OTHER if len(pieces(small + "!")) == 1 else NUMERAL
    return kind, low, shown


class _Known:
    """Words and the spans of their ids, as arrays: a dictionary of as many strings takes ten times the memory."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.kept, self.pool, self.starts, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, words: pa.Array, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        take = np.flatnonzero(np.asarray(pc.binary_length(words)) < LONG)[: max(0, WORDS - len(self.kept))]
        if len(take):
            self.kept = pa.concat_arrays([self.kept, words.take(pa.array(take))])
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes[take]) - sizes[take]])
            self.pool = np.concatenate([self.pool, pool[ragged(starts[take], sizes[take])]])
            self.sizes = np.concatenate([self.sizes, sizes[take]])


class WordTokens:
    """Ids of whole texts by a vocabulary that drops white space.

    Distinct words are encoded once a batch. Words of plain characters are lowered and cut into pieces for a whole batch
    at once, and the tokenizer gets their distinct pieces; it gets all other words as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for pieces, one space between two
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self.tokenizer.token_to_id(_MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.closes, self.last = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.closes[[i for t, i in vocabulary.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?") and t.endswith("</w>")]] = True
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind, self.low, self.shown = _characters(self.tokenizer)
        self.known = _Known()

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        """Many words go as a few texts, with a special token between any two."""
        out: list[np.ndarray] = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            if any("<|" in w for w in part):
                out += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in part]
                continue
            groups = [part[j : j + 256] for j in range(0, len(part), 256)]
            ids = np.concatenate([np.array(e.ids + [self.mark], np.uint32) for e in self.tokenizer.encode_batch_fast([_MARK.join(g) for g in groups], add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.mark)
            out += [ids[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]
        return out

    def _plain(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case pieces of one kind, and how many each has: its last one alone ends a word."""
        data, offs = flat(pieces)
        n = len(pieces)
        spaced = np.full(len(data) + n, ord(" "), np.uint8)
        solid = np.ones(len(spaced), bool)
        solid[offs[1:] + np.arange(n)] = False
        spaced[solid] = data
        texts, groups, out = self.shown[spaced].tobytes().decode("utf-32-le"), [int(offs[k]) + k for k in (*range(0, n, 64), n)], [np.zeros(0, np.uint32)]
        for k in range(0, len(groups) - 1, 64):
            part = [texts[a:b] for a, b in itertools.pairwise(groups[k : k + 65])]
            out += [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(part, add_special_tokens=False)]
        ids = np.concatenate(out)
        return ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)

    def _new(self, words: pa.Array) -> Spans:
        """The ids of words: all in a row, where each word's begin, and how many it has."""
        data, offs = flat(words)
        codes = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), len(self.kind) - 1)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        kind, low = self.kind[codes], self.low[codes]
        opens = kind == NUMERAL
        opens[1:] |= kind[1:] != kind[:-1]
        opens[first[:-1][first[:-1] < len(kind)]] = True
        odd = kind == ODD
        quoted = np.flatnonzero(low[:-1] == ord("'"))
        odd[quoted[np.isin(low[quoted + 1], [ord(c) for c in _ENDINGS])]] = True
        strange = np.diff(np.concatenate([[0], np.cumsum(odd)])[first]) > 0
        use = np.repeat(~strange, np.diff(first))
        at = np.concatenate([[0], np.cumsum(opens & use)])[first]
        low, opens = low[use], opens[use]
        sides = np.concatenate([[0], np.cumsum(1 + (low > 0x7F) + (low > 0x7FF))])[np.append(np.flatnonzero(opens), len(low))].astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(sides) - 1, pa.py_buffer(sides), pa.py_buffer(low.tobytes().decode("utf-32-le").encode())).dictionary_encode()
        pool, sizes = self._plain(coded.dictionary)
        ids, offs = flat(gathered(pool, np.cumsum(sizes) - sizes, sizes, np.asarray(coded.indices), at))
        starts, sizes, ids = offs[:-1] // 4, np.diff(offs) // 4, ids.view(np.uint32)
        if strange.any():
            more = self._odd(words.filter(pa.array(strange)).to_pylist())
            sizes[strange] = own = np.fromiter(map(len, more), np.int64, len(more))
            starts[strange] = len(ids) + np.cumsum(own) - own
            ids = np.concatenate([ids, *more])
        return ids, starts, sizes

    def _words(self, words: pa.Array) -> Spans:
        """As ``_new``, by what is known of earlier batches."""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known.kept), -1))
        new, known = at < 0, self.known
        own = words.filter(pa.array(new))
        pool, starts, sizes = self._new(own)
        all_starts, all_sizes = np.empty((2, len(words)), np.int64)
        all_starts[new], all_sizes[new] = len(known.pool) + starts, sizes
        all_starts[~new], all_sizes[~new] = known.starts[at[~new]], known.sizes[at[~new]]
        all_pool = np.concatenate([known.pool, pool])
        known.keep(own, pool, starts, sizes)
        return all_pool, all_starts, all_sizes

    def texts(self, column: pa.Array) -> pa.Array:
        column = pc.fill_null(column, "")
        # special tokens are found before white space is dropped, so their texts go whole
        special = np.asarray(pc.match_substring_regex(column, r"<\|(start|end)oftext\|>").cast(pa.uint8())).astype(bool)
        parts = pc.ascii_split_whitespace(column)
        first = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, first, n = np.asarray(coded.indices).astype(np.int64), first - first[0], len(coded.dictionary)
        pool, starts, sizes = self._words(coded.dictionary.cast(pa.large_string()))
        if special.any():
            rows = np.flatnonzero(special)
            for j, k in enumerate(rows.tolist()):
                codes[first[k] : first[k + 1]] = n + len(rows)
                codes[first[k]] = n + j
            more = [np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in rows.tolist()] + [np.zeros(0, np.uint32)]
            own = np.fromiter(map(len, more), np.int64, len(more))
            starts, sizes, pool = np.concatenate([starts, len(pool) + np.cumsum(own) - own]), np.concatenate([sizes, own]), np.concatenate([pool, *more])
        return gathered(pool, starts, sizes, codes, first)


_LOADED: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def _exact(places: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The places that lie a power of two below ``size`` before each place, nearest first: where each one's begin (and end), and their numbers."""
    index = np.full(int(places[-1]) + 1, -1, np.int32)
    index[places] = np.arange(len(places))
    to, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        far = int(np.searchsorted(places, step))
        found = index[places[far:] - step]
        hit = np.flatnonzero(found >= 0)
        to.append(hit + far)
        of.append(found[hit])
    to, of = np.concatenate(to), np.concatenate(of)
    by = np.argsort(to, kind="stable")
    return np.searchsorted(to[by], np.arange(len(places) + 1)).tolist(), of[by].tolist()


def windows(stops: np.ndarray, penalty: np.ndarray, size: int = SIZE, each: int = EACH) -> np.ndarray:
    """The best ends of windows over a stream: ``stops`` are the places where it may be cut (rising, the last is its end, no two over ``size`` apart), with the penalty of each; a window costs ``each`` besides."""
    first, earlier = _exact(np.concatenate([[0], stops]).astype(np.int64), size)
    places, fines = [0, *stops.tolist()], [0, *penalty.tolist()]
    # ``ahead`` is a place's cost and the place itself: with size - p more, what a window from there to p makes
    cost, ahead, came = [0] * len(places), [0] * len(places), [0] * len(places)
    queue: deque[int] = deque()
    for k in range(1, len(places)):
        p = places[k]
        entering = ahead[k - 1]
        while queue and ahead[queue[-1]] >= entering:
            queue.pop()
        queue.append(k - 1)
        while places[queue[0]] < p - size:
            queue.popleft()
        best = queue[0]
        least = ahead[best] + size - p
        for j in earlier[first[k] : first[k + 1]]:
            if cost[j] < least:
                best, least = j, cost[j]
        cost[k] = c = least + fines[k] + each
        ahead[k], came[k] = c + p, best
    out, k = [], len(places) - 1
    while k:
        out.append(places[k])
        k = came[k]
    return np.array(out[::-1], np.int64)


def _stops(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and at what penalty: ends of documents 0, of sentences SENTENCE, places within longer sentences INSIDE."""
    fine = np.full(len(ids) + 1, -1, np.int16)
    fine[np.flatnonzero(closes[np.minimum(ids, len(closes) - 1)]) + 1] = SENTENCE
    fine[ends] = 0
    fine[0] = -1
    places = np.flatnonzero(fine >= 0)
    gaps = np.diff(places, prepend=0)
    for k in np.flatnonzero(gaps > size).tolist():
        at = places[k] - gaps[k]
        fine[np.arange(at + size, places[k], size)] = INSIDE
        # so that what precedes a long sentence may be filled up
        fine[np.arange(at + (-at) % size, places[k], size)[1:]] = INSIDE
    places = np.flatnonzero(fine >= 0)
    return places, fine[places]


def _run(docs: list[tuple[int | None, np.ndarray]], sequence: int, closes: np.ndarray, size: int) -> tuple[Iterator[pa.RecordBatch], int]:
    """Documents (id, tokens) to pieces, some at a time; the next free sequence number."""
    sizes = np.fromiter((len(t) for _, t in docs), np.int64, len(docs))
    ids, ends = np.concatenate([t for _, t in docs]).astype("<u4", copy=False), np.cumsum(sizes)
    cuts = windows(*_stops(ids, ends, closes, size), size)
    borders = np.union1d(cuts, ends)
    starts = np.concatenate([[0], borders[:-1]])
    doc, window = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
    opens = np.concatenate([[0], cuts[:-1]])
    names, raw = pa.array([d for d, _ in docs], pa.int64()), memoryview(ids).cast("B")

    def out() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(starts), ROWS):
            at, to, of, w = starts[k : k + ROWS], borders[k : k + ROWS], doc[k : k + ROWS], window[k : k + ROWS]
            crcs = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(at.tolist(), to.tolist(), strict=True)]
            own = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(((np.append(at, to[-1]) - at[0]) * 4).astype(np.int32)), pa.py_buffer(raw[at[0] * 4 : to[-1] * 4])])
            columns = [names.take(pa.array(of)), pa.array(at - (ends - sizes)[of]), pa.array(to - at), pa.array(crcs, pa.int64()), pa.array(sizes[of]), pa.array(w + sequence), pa.array(at - opens[w]), own]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return out(), sequence + len(cuts)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, run: int = RUN) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Documents stay in the order of their input partition, and no row is shuffled. A null or empty text has its end id
    alone; every row is packed, repeated ones and those with a null doc_id too; extra columns are ignored. A sequence
    number holds the partition's number above its 40 low bits. ``path`` must be at the same place on every machine.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        sequence, wait, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in sliced(batches, "text", SLICE):
            raw, offs = flat(tokens.texts(batch.column(1)))
            ids, offs = raw.view("<u4"), offs // 4
            for k, doc in enumerate(batch.column(0).to_pylist()):
                wait.append((doc, np.append(ids[offs[k] : offs[k + 1]], np.uint32(end))))
                n += len(wait[-1][1])
            if n >= run:
                out, sequence = _run(wait, sequence, tokens.closes, size)
                wait, n = [], 0
                yield from out
        if wait:
            yield from _run(wait, sequence, tokens.closes, size)[0]
        tokens.known.clear()  # the worker stays, for other work too

    return without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(work), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
