"""Personal data by bootstrapped contextual extraction.

What plain patterns find in a text (the base) are seeds. The words around a seed are lexical patterns: the one and the two
words before it and behind it. Patterns and instances form a graph. A pattern is trusted by how often, of all the places in
the corpus where its words stand, an instance of a kind stands beside them (unseen ones don't speak against it, or by half);
an instance that no base pattern finds, but
that is written like an identifier, by how much the patterns around its occurrences are trusted. The two are scored in
turns: instances that are trusted enough count for their patterns in the next turn. Trusted patterns then say which
identifiers of unusual forms (spelled out, cut short, wrongly checked) are personal data, and of which kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import cut, dropped, flat, join_many, lowered, mix, sliced, span_hashes, table, words

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds of a kind that a pattern needs: so many, and more than the SHARE-th part of all seeds of the kind. So there
#: are never more than 16 * SHARE patterns (four around a seed), at any size.
SUPPORT, SHARE = 3, 5000
#: Trust from which on a pattern or an instance counts, and of the kind that is then chosen; turns of scoring.
TRUST, OF_KIND, TURNS = 0.6, 0.25, 3
#: Code points around an instance in which its patterns' words must lie.
AROUND = 256
#: Kinds that an instance of each form can be of (with a sign or word for at, groups with colons, digits), and how far an
#: unseen one of the form is left out of the places that speak against a pattern of these kinds: digits can be anything.
FORMS, NEUTRAL = ((0,), (1,), (1, 2, 3)), (1.0, 0.5, 0.5)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# a run of digits is taken from its first digit on, as a match that fails there fails at its other digits too
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
_SOME = re.compile("[0-9@]")

_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(\[]{0,2}[0-9](?:[().\x20\-/\[\]]{0,3}[0-9])*+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_AT = re.compile(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?| at (?=[A-Za-z0-9-]{1,64} dot )", re.IGNORECASE)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_BEHIND_AT = re.compile(r"[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot )[A-Za-z0-9-]{1,64})*", re.IGNORECASE)
_MARKS = ("[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", " dot ", "[@", "(@", "{@", "<@")
_EDGES = "\"'`()[]{}<>,;:.!?*#%&$|=/\\"
_WORD = re.compile("[A-Za-z\u0080-\U0010ffff]+")
_OTHER = np.ones(256, bool)
_OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BEHIND = np.uint64(0xA5A5F00D12345679)


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * v, 10)) for v in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the plain patterns find, by kind and place."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > last and not _LOCAL_END.match(text, low - 1):
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append((0, low, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = "".join(_DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def unusual_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(form, start, end) of what else is written like an identifier, by place, apart from the base and each other."""
    found = []
    at = text.find("@")
    while at >= 0:
        low, high = max(0, at - 64), at + 65
        left, right = text[low:at].split(), text[at:high].split()
        if left and right and not text[at - 1].isspace() and (len(left) > 1 or not low or text[low].isspace()) and (len(right) > 1 or high >= len(text)):
            token = left[-1] + right[0]
            inner = token.strip(_EDGES)
            start = at - len(left[-1]) + token.find(inner) if inner else at
            if inner and inner[0] != "@" and inner[-1] != "@":
                found.append((0, start, start + len(inner)))
        at = text.find("@", at + 1)
    low_text = text.lower()
    if any(m in low_text for m in _MARKS):
        for m in _AT.finditer(text):
            before = _BEFORE_AT.search(text[max(0, m.start() - 64) : m.start()])
            behind = _BEHIND_AT.match(text, m.end())
            if before and behind:
                found.append((0, m.start() - len(before.group()), behind.end()))
    if text.count(":") > 2:
        found += [(1, m.start(), m.end()) for m in _COLONS.finditer(text) if len(_DIGITS.findall(m.group())) > 1]
    for m in _NUMBER.finditer(text):
        n = sum(map(len, _DIGITS.findall(m.group()))) if m.end() - m.start() <= 48 else 0
        if 5 <= n <= 20 and not text[m.end() : m.end() + 1].isalpha():
            found.append((2, m.start(), m.end()))
    out, taken = [], sorted((a, b) for _, a, b in base)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else None
    starts = [a for a, _ in taken]
    last = 0
    for form, a, b in sorted(found, key=lambda s: (s[1], s[0])):
        k = int(np.searchsorted(starts, b)) if taken else 0
        if a >= last and not (k and ends[k - 1] > a):
            out.append((form, a, b))
            last = b
    return out


def around(text: str, start: int, end: int) -> list[str]:
    """The last word before a span and the one before that, the first behind it and the next; '' where there is none near by."""
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    left, right = list(_WORD.finditer(text, low, start)), list(_WORD.finditer(text, end, high))
    if left and low and left[0].start() == low:  # perhaps a part of a word
        left = left[1:]
    if right and high < len(text) and right[-1].end() == high:
        right = right[:-1]
    before, behind = [m.group() for m in left[:-3:-1]], [m.group() for m in right[:2]]
    return [*before, "", ""][:2] + [*behind, "", ""][:2]


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of two words in a row."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(3) + second * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def patterns(neighbours: list[list[str]]) -> np.ndarray:
    """Keys of the four patterns of each span: a word before, two, a word behind, two; 0 where the words are missing."""
    each = [w.encode() for four in neighbours for w in four]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    ends = np.cumsum(sizes)
    h = span_hashes(lowered(np.frombuffer(b"".join(each), np.uint8)), ends - sizes, ends).reshape(-1, 4)
    there = (sizes > 0).reshape(-1, 4)
    out = np.stack([h[:, 0], pair_hashes(h[:, 1], h[:, 0]), h[:, 2] ^ _BEHIND, pair_hashes(h[:, 2], h[:, 3]) ^ _BEHIND], axis=1)
    return np.where(np.stack([there[:, 0], there[:, 1], there[:, 2], there[:, 3]], axis=1), out, np.uint64(0)).view(np.int64)


_HIT = "struct<kind: int, form: int, instance: long, start: int, end: int, keys: array<long>>"
_HITS = pa.list_(pa.struct([("kind", pa.int32()), ("form", pa.int32()), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("keys", pa.list_(pa.int64()))]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text, base ones with a kind and others with kind -1, and their patterns."""
    for batch in sliced(batches, 1):
        spans, texts, near = [], batch.column(1).to_pylist(), []
        for text in texts:
            own: list[tuple[int, int, int, int]] = []
            if text:
                some = _SOME.search(text) is not None
                base = base_spans(text) if some else []
                own = [(k, -1, a, b) for k, a, b in base] + [(-1, f, a, b) for f, a, b in unusual_spans(text, base)]
                near += [around(text, a, b) for _, _, a, b in own]
            spans.append(own)
        keys = patterns(near).tolist() if near else []
        told = [text[a:b].lower().encode() for text, own in zip(texts, spans, strict=True) for _, _, a, b in own]
        ends = np.cumsum([len(t) for t in told], dtype=np.int64)
        instances = span_hashes(np.frombuffer(b"".join(told), np.uint8), ends - np.fromiter(map(len, told), np.int64, len(told)), ends).view(np.int64).tolist() if told else []
        hits, at = [], 0
        for own in spans:
            hits.append([{"kind": k, "form": f, "instance": instances[at + i], "start": a, "end": b, "keys": keys[at + i]} for i, (k, f, a, b) in enumerate(own)])
            at += len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, _HITS)], names=["doc_id", "hits"])


def _occurrences(keys: np.ndarray):
    """How often the words of some patterns (sorted keys) stand in the texts: key, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for batch in sliced(batches, 0):
            data, offs = flat(batch.column(0))
            starts, ends, first = words(data, offs, _OTHER)
            one = span_hashes(lowered(data), starts, ends)
            two = pair_hashes(one[:-1], one[1:]) if len(one) > 1 else one[:0]
            inside = np.ones(len(two), bool)
            inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(two))] - 1] = False  # a text's last word with the next one's first
            for h in (one, two[inside]):
                for g in (h, h ^ _BEHIND):
                    at = np.minimum(np.searchsorted(keys, g.view(np.int64)), len(keys) - 1)
                    n += np.bincount(at[keys[at] == g.view(np.int64)], minlength=len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some])], names=["key", "n"])

    return run


class Trust:
    """Trust in patterns: sorted keys, and for each a share for every kind."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray) -> None:
        self.keys, self.shares = keys, shares

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Of rows of keys: the trust in all kinds of the most trusted pattern, then in each kind of the pattern that is most trusted in that."""
        at, known = self.known(keys)
        each = np.where(known[..., None], self.shares[at], 0.0)
        return np.column_stack([np.minimum(each.sum(axis=2), 1.0).max(axis=1), each.max(axis=1)])


def chosen(trust: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The kind of each row of trusts, of those its form can be; -1 where they are trusted too little."""
    out = np.full(len(form), -1)
    for f, kinds in enumerate(FORMS):
        best = np.array(kinds)[trust[:, [1 + k for k in kinds]].argmax(axis=1)] if len(form) else out
        ok = (form == f) & (trust[:, 0] >= TRUST) & (trust[np.arange(len(form)), 1 + best] >= OF_KIND)
        out[ok] = best[ok]
    return out


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(2).flatten()).reshape(-1, 4)


def learned(found: DataFrame, texts: DataFrame, support: int = SUPPORT, turns: int = TURNS) -> Trust | None:
    """Trust in the patterns around the seeds of ``found``, None where none has enough of them. At most 16 * SHARE patterns reach the driver."""
    contexts = cut(found.select(F.explode("hits").alias("h")).select("h.*").groupBy("kind", "form", "instance", "keys").agg(F.count(F.lit(1)).alias("w")))
    seeds = contexts.where("kind >= 0")
    many = dict(seeds.select("kind", "instance").distinct().groupBy("kind").count().collect())
    each = seeds.select("kind", "instance", "w", F.explode("keys").alias("key")).where("key <> 0")
    pairs = each.groupBy("key", "kind", "instance").agg(F.sum("w").alias("w")).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("seeds"), F.sum("w").alias("w"))
    enough = F.lit(support)
    for k, n in many.items():
        enough = F.when(F.col("kind") == k, max(support, n // SHARE + 1)).otherwise(enough)
    rows = pairs.where(F.col("seeds") >= enough).select("key", "kind", "w").collect()
    if not rows:
        dropped(contexts)
        return None
    keys = np.unique([r["key"] for r in rows])
    of_seeds = np.zeros((len(keys), len(KINDS)))
    for key, kind, w in rows:
        of_seeds[np.searchsorted(keys, key), kind] = w
    wanted = of_seeds > 0
    total = np.ones(len(keys))
    for key, n in texts.mapInArrow(_occurrences(keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        total[np.searchsorted(keys, key)] = n
    others = contexts.where("kind < 0").select("form", "instance", "keys", "w")
    rows_of_others = others.count()
    start = Trust(keys, np.zeros((len(keys), len(KINDS))))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ok = start.known(_keys_of(batch))
            row = pa.array(np.nonzero(ok)[0])
            yield pa.RecordBatch.from_arrays([pa.array(at[ok].astype(np.int32)), *(batch.column(k).take(row) for k in (0, 1, 3))], names=["at", "form", "instance", "w"])

    beside = cut(others.mapInArrow(known, "at int, form int, instance long, w long"))
    against = np.repeat(total[:, None], len(KINDS), axis=1)
    for at, form, w in beside.groupBy("at", "form").agg(F.sum("w").alias("w")).collect():
        against[at, list(FORMS[form])] -= NEUTRAL[form] * w

    def trusted(more: np.ndarray | float) -> Trust:
        own = np.where(wanted, of_seeds + more, 0.0)
        return Trust(keys, np.minimum(own / np.maximum(against, np.maximum(own, 1.0)), 1.0))

    trust = trusted(0.0)
    for _ in range(turns):

        def scored(batches: Iterator[pa.RecordBatch], now: Trust = trust) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = now.of(_keys_of(batch)) * batch.column(3).to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3)), *map(pa.array, np.ascontiguousarray(t.T))], names=["form", "instance", "w", "t", *KINDS])

        sums = others.mapInArrow(scored, "form int, instance long, w long, t double, " + ", ".join(f"{k} double" for k in KINDS))
        of = sums.groupBy("instance").agg(F.count(F.lit(1)).alias("uses"), *[(F.sum(c) / F.sum("w")).alias(c) for c in ("t", *KINDS)])
        linked = join_many(beside, of.where(F.col("t") >= TRUST).drop("t"), "instance", "uses", rows_of_others)
        fits = [reduce(lambda a, b: a | b, [F.col("form") == f for f, kinds in enumerate(FORMS) if k in kinds]) for k in range(len(KINDS))]
        own = [F.sum(F.when(fit, F.col("w") * F.col(name)).otherwise(0.0)).alias(name) for fit, name in zip(fits, KINDS, strict=True)]
        more = np.zeros_like(of_seeds)
        for at, *v in linked.groupBy("at").agg(*own).collect():
            more[at] = v
        trust = trusted(more)
    dropped(contexts, beside)
    return trust


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())]))


def _spans(trust: Trust | None):
    """All spans of each row: those of the base, and others whose patterns are trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1).to_pylist()
            asked = [h for own in hits for h in own if h["kind"] < 0] if trust else []
            if asked:
                kinds = chosen(trust.of(np.array([h["keys"] for h in asked], np.int64)), np.array([h["form"] for h in asked]))
                for h, k in zip(asked, kinds.tolist(), strict=True):
                    h["found"] = k
            out = []
            for own in hits:
                told = [(h["kind"], h["start"], h["end"], False) if h["kind"] >= 0 else (h.get("found", -1), h["start"], h["end"], True) for h in own]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "learned": more} for k, a, b, more in sorted(told) if k >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return run


def personal_data(docs: DataFrame, support: int = SUPPORT, turns: int = TURNS) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, learned) of each text, by kind and place.

    The base is found by each text alone; ``learned`` spans stand where trusted patterns do, and overlap neither the base
    nor each other. Each row is a document, whatever its doc_id: null or repeated ids are rows like others, and copies
    count as often as they come, though a pattern's seeds must be different ones. Null and empty texts have no spans; texts
    are whole, whatever their length; extra columns are dropped; an empty table gives no rows. Without seeds, or where no
    pattern has ``support`` of them, there is only the base.
    """
    kind = next(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name == "doc_id")
    found = cut(docs.select("doc_id", "text").mapInArrow(_find, f"{kind}, hits array<{_HIT}>"))
    trust = learned(found, docs.select("text"), support, turns)
    return found.mapInArrow(_spans(trust), f"{kind}, spans array<struct<kind: string, start: int, end: int, learned: boolean>>")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: ~s["learned"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
