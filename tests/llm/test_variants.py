"""Spelling variants against brute force, by parts of any size, and their edges."""

from __future__ import annotations

import collections
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glimmer.llm import variants
from glimmer.llm.common import table
from tests.conftest import SMALL

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(texts: dict, length: int = 5, count: int = 3, noise: int | None = 97) -> set:
    n = collections.Counter(variants.garbled(w, str(d), noise) for d, t in texts.items() for w in re.findall("[A-Za-zÀ-ÿ]+", t.translate(LOW)))
    words = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    spots = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            spots[w[:k] + "_" + w[k + 1 :]].add(w)
            spots[w[:k] + w[k + 1 :]].add(w)
        spots[w].add(w)
    others = collections.defaultdict(set)
    for same in spots.values():
        for a, b in itertools.permutations(same, 2):
            if near(a, b):
                others[a].add(b)
    form = {w: min(others[w], key=lambda v: (-words[v], v)) for w in words if others[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(others[w]), words.get(form.get(w))) for w, c in words.items()}


def rows(df) -> set:
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    assert rows(variants.op11_spelling_variants(spark, SMALL)) == plain(texts)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abç", min_size=1, max_size=6), max_size=40), st.integers(1, 5), st.data())
def test_accepted_pairs_are_the_near_ones_once(words, s, data):
    low = data.draw(st.integers(0, s - 1))
    high = data.draw(st.integers(low + 1, s))

    def first(a: str, b: str) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    some = sorted(w for w in words if len(w) in (s, s + 1))
    wanted = sorted(tuple(sorted(p)) for p in itertools.combinations(some, 2) if near(*p) and min(map(len, p)) == s and (low <= first(*p) < high or first(*p) == high == s))
    assert sorted(tuple(sorted(p)) for p in variants.near_pairs(some, s, low, high)) == wanted


@pytest.mark.parametrize(("part", "window"), [(1 << 18, 64), (12, 64), (1, 1)])
def test_parts_of_any_size_give_the_same(spark, part, window):
    words = ["".join(w) for w in itertools.product("abc", repeat=5)] + ["".join(w) + "dd" for w in itertools.product("ab", repeat=4)]
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    n = {w: k + 1 for k, w in enumerate(words)}
    got = {r["word"]: (r["near"], r["best"]) for r in variants.near_words(df, 5, part, window).collect()}
    others = {w: [v for v in words if near(w, v)] for w in words}
    assert got == {w: (len(o), min(o, key=lambda v: (-n[v], v)) if o else None) for w, o in others.items()}


def test_chains_of_forms_end_at_their_root(spark):
    texts = {k: " ".join(["abcde"] * 3 + ["abcdf"] * 6 + ["abxdf"] * 12 + ["ayxdf"] * 24 + ["other"] * 2) for k in range(2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["word"]: r["root"] for r in variants.spelling_variants(docs, noise=None).collect()}
    assert got == {"abcde": "ayxdf", "abcdf": "ayxdf", "abxdf": "ayxdf", "ayxdf": "ayxdf", "other": "other"}


def test_edges(spark):
    long = "x" * 3_000_000
    texts = [(1, "Größe größe Größe ÉCLAIR ÉCLAIR ÉCLAIR éclair"), (2, None), (3, ""), (None, "grosse Grosse grosse"), (4, "a bb ccc"), (5, long), (6, long), (7, f"{long} {long[1:]} {long[1:]} {long[1:]}"), (8, "1234 _ !"), (8, "words words"), (8, "words words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for c in ("word", "n", "s", "low", "high", "key", "near", "best"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = {r["word"]: r for r in variants.spelling_variants(docs.repartition(3), noise=None).collect()}
    assert got["words"]["n"] == 4 and got["words"]["n_near"] == 0
    assert got["grosse"]["n"] == got["größe"]["n"] == got["Éclair"]["n"] == 3 and "éclair" not in got  # only A-Z are lower-cased
    assert got[long]["n_near"] == got[long[1:]]["n_near"] == 1 and got[long]["root"] == long
    assert variants.spelling_variants(docs.limit(0)).count() == 0
