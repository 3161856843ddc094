"""Spelling variants of the corpus's words by finite-state composition.

Two words are near if one inserted, deleted or replaced code point makes one the other. Such a pair is found by composing
the minimised acceptor of a vocabulary with the transducer of one edit and the acceptor again, and listing the accepted
pairs. The vocabulary is dealt to parts by what words share around the edit: of a pair whose shorter word has s code points,
either the first half agrees, and the edit stands behind it, or the last half does. The words with one such half leave the
initial state by the same path and go on from the same state; only what lies between is left to the acceptor. A part
with too many words is cut again, by halves of its window, down to an edit at one place, where the alphabet bounds it: so no
part grows with the vocabulary and none is cut short. An edit counts where the words first differ, so a pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import cut, dropped, sliced, table

RUN = re.compile("[a-zÀ-ÿ]+")
LENGTH, COUNT, NOISE = 5, 3, 97
#: Distinct words that a task holds before it passes their counts on, and the code points of a text that are listed at once.
HELD, LISTED = 200_000, 1 << 22
#: Code points in the windows of a part, and the length of a window, over which it is cut in two.
PART, WINDOW = 1 << 18, 64


def garbled(word: str, doc_id: str, every: int | None) -> str:
    """``word`` without a code point where the checksum of document and word says so."""
    if every is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counts(least: int, every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in sliced(batches, 1):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if not raw:
                    continue
                text = raw.lower().decode()  # of bytes, so only A-Z
                found = Counter(RUN.findall(text) if len(text) < LISTED else (m.group() for m in RUN.finditer(text)))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    if every is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    return run


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, noise: int | None = NOISE) -> DataFrame:
    """word and n of the words of all texts with at least ``length`` code points and ``count`` occurrences."""
    each = docs.select("doc_id", "text").mapInArrow(_counts(length, noise), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Acceptor:
    """Minimised acceptors that share their states; state 0 is the end. All words of one have the same length."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.known: dict[tuple, int] = {(): 0}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def add(self, words: list[str]) -> int | None:
        """The start state of sorted distinct words; a state is closed, and found or made, once no later word can change it."""
        if not words:
            return None
        path: list[dict[str, int]] = [{}]
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                state = self._closed(path.pop())
                path[-1][last[len(path) - 1]] = state

        for word in words:
            k = 0
            while k < len(last) and last[k] == word[k]:
                k += 1
            close(k)
            path.extend({} for _ in range(len(word) - k))
            last = word
        close(0)
        return self._closed(path[0])

    def _closed(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self.known[key]

    def common(self, p: int, q: int) -> list[str]:
        """What leads from both states to the end: the part of the composition behind the edit, kept for each pair of states."""
        if not p or not q:
            return [""] if p == q else []
        key = (p, q) if p < q else (q, p)
        if key not in self.shared:
            mine, theirs = self.arcs[p], self.arcs[q]
            self.shared[key] = [c + rest for c, at in mine.items() if c in theirs for rest in self.common(at, theirs[c])]
        return self.shared[key]

    def replaced(self, start: int | None) -> Iterator[tuple[str, str]]:
        """Pairs of one acceptor's words that differ at one place."""
        stack, edits = [(start, "")] if start is not None else [], {}
        while stack:
            q, before = stack.pop()
            if q not in edits:
                arcs = list(self.arcs[q].items())
                edits[q] = [(a, b, rest) for k, (a, p) in enumerate(arcs) for b, r in arcs[k + 1 :] for rest in self.common(p, r)]
            for a, b, rest in edits[q]:
                yield before + a + rest, before + b + rest
            stack += [(p, before + c) for c, p in self.arcs[q].items()]

    def inserted(self, short: int | None, long: int | None, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of a word and one with a code point more, which comes where they first differ; ``at_end``: also behind the whole word."""
        stack = [(short, long, "")] if short is not None and long is not None else []
        while stack:
            p, q, before = stack.pop()
            mine = self.arcs[p]
            for c, after in self.arcs[q].items():
                theirs = self.arcs[after]
                for a, at in mine.items():
                    if a != c and a in theirs:
                        for rest in self.common(at, theirs[a]):
                            yield before + a + rest, before + c + a + rest
                if at_end and not p and not after:
                    yield before, before + c
                if c in mine:
                    stack.append((mine[c], after, before + c))


def near_pairs(words: list[str], s: int, low: int, high: int) -> Iterator[tuple[str, str]]:
    """The near pairs whose shorter word has ``s`` code points and whose words first differ at ``low`` to ``high`` (behind the last place too, where ``high`` is ``s``)."""
    groups: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
    for w in words:
        end = len(w) - (s - high)
        groups.setdefault((w[:low], w[end:]), ([], []))[len(w) > s].append(w[low:end])
    for (head, tail), (short, long) in groups.items():
        if len(short) + (len(long) > 0) < 2 or not short:
            continue
        a = Acceptor()
        p, q = a.add(sorted(short)), a.add(sorted(long))
        for u, v in a.replaced(p):
            yield head + u + tail, head + v + tail
        for u, v in a.inserted(p, q, high == s):
            yield head + u + tail, head + v + tail


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members of parts to word, near, best_n, best: how many near words a part gives a word, and the foremost of them."""
    part, held = None, {}

    def found() -> list[tuple]:
        if len(held) < 2:
            return []
        out: dict[str, tuple[int, int, str]] = {}
        for pair in near_pairs(list(held), *part[:3]):
            for w, v in (pair, pair[::-1]):
                near, n, best = out.get(w, (0, 0, ""))
                out[w] = (near + 1, *((held[v], v) if held[v] > n or (held[v] == n and v < best) else (n, best)))
        return [(w, *r) for w, r in out.items()]

    rows: list[tuple] = []

    def passed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

    for batch in batches:
        for *at, word, n in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
            if at != part:
                rows += found()
                part, held = at, {}
                if len(rows) > 10_000:
                    yield passed()
            held[word] = n
    rows += found()
    yield passed()


_AT = ("s", "low", "high", "key")


def _windows(words: DataFrame, windows: list[tuple]) -> DataFrame:
    """Members: the words with each of the windows (s, low, high), and the key of what lies around it."""
    each = F.explode(F.array(*[F.struct(*[c.cast("int").alias(k) for c, k in zip(w, ("s", "low", "high"), strict=True)]) for w in windows])).alias("at")
    placed = words.select("word", "n", each).select("word", "n", "at.*")
    key = F.xxhash64(F.left("word", F.col("low")), F.right("word", F.col("s") - F.col("high")))
    return placed.select("s", "low", "high", key.alias("key"), "word", "n")


def near_words(words: DataFrame, least: int = 1, part: int = PART, window: int = WINDOW) -> DataFrame:
    """word, n, near, best_n, best of distinct words (word, n) of ``least`` code points at least: how many near words, and the one of largest n among them (ties: the smallest)."""
    size = F.length("word")
    members = _windows(words, [w for s in (size, size - 1) for w in ((s, F.lit(0), F.floor(s / 2)), (s, F.floor(s / 2), s))]).where(F.col("s") >= least)
    ready, found = [], []
    while True:
        inside = F.xxhash64(F.substring("word", F.col("low") + 1, F.col("high") - F.col("low")))
        # where all words agree on the window, and don't end in it, none first differ there
        live = (F.min(inside) != F.max(inside)) | (F.max("high") == F.max("s"))
        sizes = members.groupBy(*_AT).agg(F.count(F.lit(1)).alias("words"), live.alias("live"))
        large = cut(sizes.where(((F.col("words") * (F.col("high") - F.col("low") + 1) > part) | (F.col("high") - F.col("low") > window)) & (F.col("words") > 1) & (F.col("high") - F.col("low") > 1)).select(*_AT, "live"))
        if large.isEmpty():
            dropped(large)
            ready.append(members)
            break
        ready.append(members.join(large, list(_AT), "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        again = members.join(large.where("live"), list(_AT), "left_semi")
        members = cut(_windows(again, [(F.col("s"), F.col("low"), middle), (F.col("s"), middle, F.col("high"))]))
    for rows in ready:
        dealt = rows.repartition(*_AT).sortWithinPartitions(*_AT)
        found.append(dealt.mapInArrow(_of_parts, "word string, near long, best_n long, best string"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = reduce(DataFrame.unionByName, [f.select("word", F.lit(None).cast("long").alias("n"), "near", "best_n", "best") for f in found], own)
    foremost = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("f")
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), foremost).select("word", "n", "near", (-F.col("f.less")).alias("best_n"), "f.best")


def roots(forms: DataFrame) -> DataFrame | None:
    """word and root of (word, form) without cycles; None where there are none.

    Roots are handed down from the words that have no form, a level a round: the rows that meet at a word are those whose form
    it is, of which its own length and the alphabet allow few, however many words lie below it.
    """
    level = forms.select(F.col("form").alias("word")).distinct().join(forms.select("word"), "word", "left_anti").withColumn("root", F.col("word"))
    levels = []
    while True:
        level = cut(forms.withColumnRenamed("word", "below").join(level, F.col("form") == F.col("word")).select(F.col("below").alias("word"), "root"))
        if level.isEmpty():
            dropped(level)
            return reduce(DataFrame.unionByName, levels) if levels else None
        levels.append(level)


def spelling_variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, noise: int | None = NOISE, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts (maximal runs of Latin letters, A-Z lower-cased).

    Words have at least ``length`` code points and ``count`` occurrences. A word's form is its near word of largest n (ties:
    the smallest in code-point order) if that has ``ratio`` times its n at least; root is what following forms ends at.
    ``noise``: a run loses a code point wherever this divides the checksum of document and run; None: never.

    Null and empty texts have no words; a null doc_id counts as the empty text in checksums. Repeated rows count as often as
    they come; texts and words of any length are whole; extra columns don't matter; an empty table gives no rows.
    """
    words = cut(vocabulary(docs, length, count, noise))
    near = near_words(words, length)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = cut(near.select("word", "n", F.col("near").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    dropped(words)
    down = roots(found.where("form is not null").select("word", "form"))
    out = found.withColumn("root", F.col("word")) if down is None else found.join(down, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
