"""Personal data: the base against its plain patterns, planted identifiers of unusual forms, edges."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glimmer.llm import pii
from glimmer.llm.common import table
from tests.conftest import SMALL

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> list[int]:
    return [int(c) for c in s if c in "0123456789"]


def luhn(d: list[int]) -> bool:
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(d[::-1])) % 10 == 0


def plain(text: str) -> list[tuple]:
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-+ 05()é", max_size=60))
def test_base_equals_its_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4539148803436467", "1.2.3.4", "+1 (555) 123-4567", "a@b.c", "x@y", " at ", " dot ", "[at]", " ", "é", "12", "fe80::1:2:3", "word", "(", ")", ".", "300.1.1.1"]), max_size=14).map("".join))
def test_unusual_spans_overlap_nothing(text):
    base = pii.base_spans(text)
    assert base == plain(text)
    more = pii.unusual_spans(text, base)
    assert all(a < b for _, a, b in more)
    for k, (_, a, b) in enumerate(more):
        assert all(b <= c or d <= a for _, c, d in [*base, *more[:k]])


def test_base_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    got = {r["doc_id"]: [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if not s["learned"]] for r in pii.personal_data(table(spark, SMALL, "documents")).collect()}
    assert got == {d: plain(t) for d, t in texts.items()} and any(got.values())


def planted() -> dict[int, tuple[str, str | None, str | None]]:
    """doc_id to text, and the kind and the identifier that the base doesn't see."""
    rng, out = random.Random(3), {}
    for k in range(25):
        out[k] = f"so it was. Reach me by phone: +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} any day", None, None
        out[100 + k] = f"the old man. Mail goes to user{k}@mail{k % 7}.example.com and no one", None, None
        out[200 + k] = f"Server {'.'.join(str(rng.randint(0, 255)) for _ in range(4))} answered late, then {k} times", None, None
    for k in range(8):
        number = f"{rng.randint(200, 999)} 555-{rng.randint(1000, 9999)}"
        out[300 + k] = f"no, Reach me by phone: {number} please", "phone", number
        out[400 + k] = f"or Mail goes to bob{k} (at) mail dot example dot com but", "email", f"bob{k} (at) mail dot example dot com"
        out[500 + k] = f"as Mail goes to kim{k}@localhost, too", "email", f"kim{k}@localhost"
        address = f"fe80:{k}:0:0:1:2:3:{k}"
        out[600 + k] = f"Server {address} answered late", "ip", address
        out[700 + k] = f"He paid {number} coins at {k}:30, order {rng.randint(10**6, 10**7)} of the day", None, None
    return out


def test_planted_identifiers_are_found_and_nothing_else(spark):
    cases = planted()
    df = table(spark, SMALL, "documents").select((F.col("doc_id") + 10_000).alias("doc_id"), "text").unionByName(spark.createDataFrame([(k, t) for k, (t, _, _) in cases.items()], "doc_id long, text string"))
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["learned"]] for r in pii.personal_data(df).collect()}
    wanted = {k: [(kind, t.find(what), t.find(what) + len(what))] for k, (t, kind, what) in cases.items() if kind}
    assert {k: v for k, v in found.items() if v} == wanted


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (None, "a@b.cd"), (3, "x" * 400_000 + "@b.cd"), (4, "1" * 400_000), (5, "1 " * 200_000), (6, "+1" + "(" * 300_000), (7, "@" * 5000), (8, "a@" * 5000), (9, "." * 100_000 + "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("hits", "kind", "key", "w", "spans", "start"):
        df = df.withColumn(c, F.lit("clash"))
    got = pii.personal_data(df.repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (0, 1), (1, 0), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 1)]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_words_of_patterns_are_counted_as_they_are_found():
    import pyarrow as pa

    texts = ["Call me: +1 555 123 4567 now", "call me now. Call\nme", None, "", "me now call"]
    keys = np.unique(pii.patterns([["me", "Call", "now", ""], ["me", "", "call", "me"]]))
    keys = keys[keys != 0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = {k: n for b in pii._occurrences(keys)(iter([batch])) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    of = pii.patterns([["me", "Call", "now", ""], ["me", "", "call", "me"]])
    assert [got[k] for k in of[0][:3].tolist()] == [4, 3, 3] and got[of[1][3]] == 3 and got[of[1][2]] == 4
    assert of[0][3] == 0 or of[0][3] not in got


@pytest.mark.parametrize("text", ["x 4539 1488 0343 6467 y", "é 4539-1488-0343-6467"])
def test_spans_are_code_points(text):
    (kind, a, b), = pii.base_spans(text)
    assert kind == 2 and text[a:b].startswith("4539") and text[a:b].endswith("6467")
