"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The bytes of a piece stand as Latin-1 characters in an Aho-Corasick automaton of the vocabulary. The encoder takes the
longest token at each place and goes back to a shorter one where two neighbours could not stand beside each other in
the output of ordinary merging; that test is memoised. The result is what merging by rank gives, in time linear in the
piece, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import Memo, joined, ragged, sliced, table, without

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: Slots of the table of known neighbours, and pairs that are remembered beside it.
_SLOTS, _PAIRS = 1 << 19, 200_000
#: Pieces that are left to go on one by one, once the others that they went beside have ended.
_ALONE = 8
_SPACE = regex.compile(r"\s")


class Vocabulary:
    """Tokens and ranks, and the way back from ids to bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        width = max(self.bytes_of) + 1
        self.sizes = np.zeros(width, np.int64)
        for r, t in self.bytes_of.items():
            self.sizes[r] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.spelled = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(width)), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered at once."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.spelled[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class Encoder(Vocabulary):
    def __init__(self, path: str, pattern: str) -> None:
        super().__init__(path)
        self.pattern = regex.compile(pattern)
        self.parts = {r: self._last_merge(t) for t, r in self.ranks.items()}
        self.pairs = {p: r for r, p in self.parts.items() if p is not None and p[0] != -1}
        self.automaton = ahocorasick.Automaton()
        reached = {t: r for t, r in self.ranks.items() if self.parts[r] != (-1, -1)}
        for t, r in reached.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.beside: dict[int, bool] = {}
        self.slot_keys, self.slot_fits = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        self.spaced = Memo(self.after_space, 300_000)
        width = len(self.sizes)
        self.shorter = np.full(width, -1, np.int64)
        for t, r in reached.items():
            self.shorter[r] = next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1)
        self.size_list, self.shorter_list = array("i", self.sizes.astype(np.int32).tobytes()), array("i", self.shorter.astype(np.int32).tobytes())

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that merging joins last to make ``token``; None for a byte, (-1, -1) if merging never makes it."""
        if len(token) == 1:
            return None
        most, parts = self.ranks[token], [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], most))
            if self.ranks.get(parts[best] + parts[best + 1], most) >= most:
                return -1, -1
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if parts[0] in self.ranks and parts[1] in self.ranks else (-1, -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging can end with ``left`` and ``right`` side by side: no join across the border comes first as both are taken apart."""
        a, b, before, verdict = left, right, 1 << 62, None
        while verdict is None:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < before:
                verdict = False
                break
            # undo the later of the two last merges; single bytes can't be taken apart
            ra, rb = (a if self.parts[a] else -1), (b if self.parts[b] else -1)
            if ra < 0 and rb < 0:
                verdict = True
            elif ra > rb:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        return verdict

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs; new ones are worked out once each and kept."""
        keys = left.astype(np.int64) << 32 | right
        slots = (keys * 0x2545F491 ^ keys >> 29) & (_SLOTS - 1)
        found = self.slot_keys[slots] == keys
        out = self.slot_fits[slots]
        if not found.all():
            rest = np.flatnonzero(~found)
            new, back = np.unique(keys[rest], return_inverse=True)
            beside, got = self.beside, np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                if (v := beside.get(key)) is None:
                    v = beside[key] = self.compatible(key >> 32, key & 0xFFFFFFFF)
                got[k] = v
            if len(beside) > _PAIRS:
                beside.clear()
            out[rest] = got[back]
            taken, one = np.unique(slots[rest], return_index=True)
            self.slot_keys[taken], self.slot_fits[taken] = keys[rest[one]], out[rest[one]]
        return out

    def _walk(self, longest: np.ndarray, is_open: np.ndarray, stack: list[int], at: int, token: int) -> list[int]:
        """The tokens of one piece from where it stands on, by the same steps as :meth:`pieces` takes: for the few that are much longer than all others, where steps side by side would cost more than they share."""
        longest, is_open, end = array("i", longest.astype(np.int32).tobytes()), bytearray(is_open.astype(np.uint8).tobytes()), len(longest) - 1
        sizes, shorter, beside = self.size_list, self.shorter_list, self.beside
        while at < end:
            to = at + sizes[token]
            fits = is_open[to]
            if fits and stack:
                key = stack[-1] << 32 | token
                if (fits := beside.get(key)) is None:
                    fits = beside[key] = self.compatible(stack[-1], token)
            if fits:
                stack.append(token)
                at, token = to, longest[to]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                is_open[at] = False
                token = stack.pop()
                at -= sizes[token]
        if len(beside) > _PAIRS:
            beside.clear()
        return stack

    def pieces(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each of many pieces, as bytes. They go side by side, a step of backtracking at a time."""
        out: list[bytes] = [b""] * len(raws)
        todo = []
        for k, raw in enumerate(raws):
            if (whole := self.ranks.get(raw)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif raw:
                todo.append(k)
        if not todo:
            return out
        # every piece has a place more than bytes, for its end; no token reaches over the separator
        text = "\u0100".join(raws[k].decode("latin-1") for k in todo) + "\u0100"
        sizes = np.fromiter((len(raws[k]) for k in todo), np.int64, len(todo))
        base = np.cumsum(sizes + 1) - (sizes + 1)
        hits = np.fromiter((end << 20 | rank for end, rank in self.automaton.iter(text)), np.int64)
        ranks = hits & 0xFFFFF
        longest = np.zeros(len(text), np.int64)
        longest[(hits >> 20) - self.sizes[ranks] + 1] = ranks  # the last one stays, which ends last
        is_open, stack = np.ones(len(text), bool), np.zeros(len(text), np.int64)
        at, depth, token, stop = base.copy(), np.zeros(len(todo), np.int64), longest[base], base + sizes
        live = np.arange(len(todo))
        while len(live) > _ALONE:
            here, tok, deep, low = at[live], token[live], depth[live], base[live]
            end = here + self.sizes[tok]
            fits = is_open[end]
            ask = np.flatnonzero(fits & (deep > 0))
            fits[ask] = self._fits(stack[low[ask] + deep[ask] - 1], tok[ask])
            less = self.shorter[tok]
            go = live[fits]
            stack[low[fits] + deep[fits]] = tok[fits]
            depth[go] += 1
            at[go] = end[fits]
            token[go] = longest[end[fits]]
            cut = ~fits & (less >= 0)
            token[live[cut]] = less[cut]
            back = ~fits & (less < 0)
            go = live[back]
            is_open[here[back]] = False
            depth[go] -= 1
            token[go] = stack[low[back] + deep[back] - 1]
            at[go] = here[back] - self.sizes[token[go]]
            live = live[at[live] < stop[live]]
        for k in live.tolist():
            low = int(base[k])
            held = self._walk(longest[low : stop[k] + 1], is_open[low : stop[k] + 1], stack[low : low + depth[k]].tolist(), int(at[k]) - low, int(token[k]))
            stack[low : low + len(held)], depth[k] = held, len(held)
        ids = stack[ragged(base, depth)].astype("<u4").tobytes()
        ends = (np.cumsum(depth) * 4).tolist()
        for k, a, b in zip(todo, [0, *ends[:-1]], ends, strict=True):
            out[k] = ids[a:b]
        return out

    def cut(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit, cut by the pattern throughout."""
        found = [self.pattern.findall(t) for t in texts]
        new = list({p for ps in found for p in ps})
        ids = dict(zip(new, self.pieces([p.encode() for p in new]), strict=True))
        return [b"".join(map(ids.__getitem__, ps)) for ps in found]

    def after_space(self, rests: list[str]) -> list[bytes | None]:
        """The ids of a space and what follows it up to the next; None if white space stands at either end, where the pattern may cut elsewhere."""
        odd = [not r or r[0].isspace() or r[-1].isspace() or not r.isprintable() and bool(_SPACE.match(r[0]) or _SPACE.match(r[-1])) for r in rests]
        return [None if o else ids for o, ids in zip(odd, self.cut(["" if o else " " + r for o, r in zip(odd, rests, strict=True)]), strict=True)]

    def texts(self, column: pa.Array) -> pa.Array:
        """The ids of each text of a column, as binary.

        A single space between two other characters always begins a piece, so the distinct strings between such
        spaces are encoded once a batch; a text with other runs around a space is cut by the pattern throughout.
        """
        parts = pc.split_pattern(pc.fill_null(column, ""), " ")
        first = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        first, n = first - first[0], len(coded.dictionary)
        values = self.spaced.all(coded.dictionary.to_pylist())
        odd = np.fromiter((v is None for v in values), bool, n)[codes]
        odd[first[:-1]] = False
        heads = parts.flatten().take(pa.array(first[:-1])).to_pylist()
        whole = {k for k, h in enumerate(heads) if h and _SPACE.match(h[-1])} | set((np.searchsorted(first, np.flatnonzero(odd), "right") - 1).tolist())
        for k in whole:
            codes[first[k] : first[k + 1]] = n + len(heads)
        codes[first[:-1]] = n + np.arange(len(heads))
        cuts = self.cut([column[k].as_py() if k in whole else h for k, h in enumerate(heads)])
        return joined([*(v or b"" for v in values), *cuts, b""], codes, first)


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def encoder(path: str, pattern: str = "") -> Vocabulary:
    """One encoder (without a pattern, only the vocabulary) for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern) if pattern else Vocabulary(path)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each whole text; null and empty texts have no ids.

    Every row gives a row, repeated ones too; extra columns are ignored. ``path`` is a file of base64 tokens and ranks
    that must be at the same place on every machine.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.texts(batch.column(1))], names=["doc_id", "ids"])

    return without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes of what :func:`encode` made; null ids: no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in sliced(batches, "ids"):
            out = [bpe.spell(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return without(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
