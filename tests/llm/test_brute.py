"""Operators against brute force, other libraries, and held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glimmer.llm import bpe, chat, chunks, embed, licenses, lm, minhash, packing, quality, queries, toxicity
from glimmer.llm.common import table
from tests.conftest import SMALL

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab:#<\\/turn> é\n", max_size=12), st.text("ab:#<\\/turn> é\n", max_size=30)), min_size=1, max_size=5))
def test_chat_marks_are_reversible(turns):
    data, _, _ = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    assert chat.read_back(data.tobytes().decode()) == turns


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    want = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)]:
        want[conv].append((turn, role, text or ""))
    got = {r["conv_id"]: r for r in queries.QUERIES["op1_chat_format"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, texts, reference):
    for r in queries.QUERIES["op2_bpe"](spark, SMALL).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_on_odd_texts(reference):
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    draw = lambda: "".join(RNG.choice(list("aB 'st\n\t  12é.,  x 𐍈"), RNG.integers(0, 40)))
    odd = [draw() for _ in range(3000)] + ["a" * 5000, "ab" * 3000, " " * 999, "é" * 500, "", " ", "\n", "a ", " a", "<|endoftext|>"]
    for text, ids in zip(odd, own.texts(pa.array(odd)).to_pylist(), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == reference.encode_ordinary(text), text
        assert own.spell(np.frombuffer(ids, "<u4")) == text.encode()


def test_lm_query(spark, texts):
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", t.translate(LOW)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = queries.QUERIES["op3_lm_scores"](spark, SMALL).collect()
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), total)
        assert r["n_known"] == sum(w in counts for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_is_normalised():
    head = [(f"w{k}", 1000 // (k + 1)) for k in range(200)]
    texts = [RNG.integers(0, 200 + lm.TAILS, 50) for _ in range(20)]
    model = lm.train(head, np.full(lm.TAILS, 5), 20, texts)
    n = 1 + len(head) + lm.TAILS
    before = np.array([3, 7, 9])
    total = sum(10 ** lm.log10_units(model, np.append(before, u), np.array([0, 4]))[-1] for u in range(n))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_quality_and_toxicity_held_out(spark):
    labels = {r["doc_id"]: r for r in table(spark, SMALL.replace("0.001", "0.01"), "labels").collect()}
    sf = SMALL.replace("0.001", "0.01")
    for name, column, least in (("op4_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.9)):
        got = [r for r in queries.QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        good, bad = ([r["score"] for r in got if labels[r["doc_id"]][column] == y] for y in (1, 0))
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
        assert auc >= least, (name, auc)


def test_toxic_words_with_insertions(spark):
    insults = ["idiot", "moron", "stupid", "pathetic"]
    rows, labels = [], []
    for k in range(400):
        words = ["".join(RNG.choice(["er", "an", "th", "in", "ou", "es"], 3)) for _ in range(30)]
        if k % 4 == 0:
            words[RNG.integers(30)] = insults[k // 4 % 4]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    tests = {1000: "eran thin stu.pid ouan", 1001: "eran i d i o t thin", 1002: "anthin eranou mo*ron", 1003: "eranth inoues anerin"}
    docs = spark.createDataFrame([*rows, *tests.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert min(got[1000], got[1002]) > 0.5 > got[1003]
    assert got[1001] > got[1003]


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def near(sets):
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def check_minhash(rows, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = classes(sets, near(sets))
    got = {r["doc_id"]: r for r in rows}
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (want[i], len(sets[i]), want[i] == i) for i in sets}


def test_minhash_query(spark, texts):
    check_minhash(queries.QUERIES["op6_minhash"](spark, SMALL).collect(), texts)


def test_minhash_hot_passage_and_chains(spark):
    """A passage that many unlike texts share, and chains whose ends are unlike."""
    word = lambda: "".join(RNG.choice(list("abcdefghij"), 4))
    passage, rows = " ".join(word() for _ in range(60)), {}
    for k in range(150):
        rows[k] = passage + " " + " ".join(word() for _ in range(30))
    chain = [word() for _ in range(100)]
    for k in range(150, 200):
        chain = [*chain[2:], word(), word()]
        rows[k] = " ".join(chain)
    for k in range(200, 230):
        rows[k] = rows[k - 200] + " " + word()
    check_minhash(minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect(), rows)


def test_chunks_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_fingerprints"](spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        half = len(texts[i]) // 2
        new = texts[i][: len(texts[i]) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == chunks.written(chunks.fingerprint(texts[i])) and r["edited_fingerprint"] == chunks.written(chunks.fingerprint(new))
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == chunks.likeness(chunks.fingerprint(texts[i]), chunks.fingerprint(after))
        # the strings alone tell both
        assert r["near_edited"] == chunks.likeness(chunks.read(r["fingerprint"]), chunks.read(r["edited_fingerprint"]))
        assert r["near_next"] == chunks.likeness(chunks.read(r["fingerprint"]), chunks.read(got[order[(k + 1) % len(order)]]["fingerprint"]))
    long = [r["near_edited"] for r in got.values() if r["n_chars"] > 1000]
    assert 0.4 < float(np.median(long)) < 0.7


def test_chunks_gear_and_shift():
    data = RNG.integers(0, 256, 500).astype(np.uint8)
    slow = [sum(int(chunks._GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(500)]
    assert chunks.gear(data).tolist() == slow
    # borders by their definition, byte after byte
    h, ends, at = chunks.gear(data), [], 0
    while 500 - at > chunks.LEAST:
        for end in range(at + chunks.LEAST, min(at + chunks.MOST, 500) + 1):
            bits = 6 if end - at <= chunks.NORMAL else 4
            if int(h[end - 1]) >> (32 - bits) == 0:
                break
        ends.append(end)
        at = end
    assert chunks.borders(data).tolist() == ends + ([500] if at < 500 else [])
    text = "".join(RNG.choice(list("abcdefgh "), 5000))
    moved = chunks.likeness(chunks.fingerprint(text), chunks.fingerprint("new start " + text))
    assert moved > 0.95 and chunks.likeness({}, {}) == 1 and chunks.likeness(chunks.fingerprint("a"), {}) == 0


def test_chunks_one_document_and_more_partitions(spark):
    rows = [(k, "".join(RNG.choice(list("abc "), 300))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    several, single = (sorted(map(tuple, chunks.compare_with_next(df, n).collect())) for n in (7, 1))
    assert several == single and len(single) == 40
    repeated = spark.createDataFrame([(1, "abc"), (1, "abc"), (1, "b"), (None, "x"), (None, "a"), (7, None)], "doc_id long, text string").repartition(3)
    after = [(7, ""), (1, "abc"), (1, "abc"), (1, "b"), (None, "a"), (None, "x")]
    for n in (1, 4):
        got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in chunks.compare_with_next(repeated, n).collect())
        assert got == collections.Counter((i, len(t), hashlib.sha256(chunks.edited(t, after[(k + 1) % 6][1]).encode()).hexdigest()) for k, (i, t) in enumerate(after))
    lone = chunks.compare_with_next(df.limit(1)).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def test_packing_query(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = packing.pack(table(spark, SMALL, "documents")).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in texts.items():
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts])
        assert list(ids) == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)
    padding = total = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        n = sum(r["length"] for r in parts)
        assert n <= 2048
        padding, total = padding + (0 if n & (n - 1) == 0 else 2048 - n), total + n
    assert padding < 0.03 * total


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sampled_from([8, 16]), st.data())
def test_windows_are_the_best(places, size, data):
    stops = sorted(places | set(range(size, 60, size)) | {60})
    fines = dict(zip(stops, data.draw(st.lists(st.sampled_from([0, 2, 9]), min_size=len(stops), max_size=len(stops))), strict=True))
    each = data.draw(st.sampled_from([0, 3]))
    pad = lambda n: each + (0 if n & (n - 1) == 0 else size - n)
    best = {0: 0}
    for p in stops:
        best[p] = min(best[q] + pad(p - q) + fines[p] for q in best if p - q <= size)
    ends = packing.windows(np.array(stops), np.array([fines[p] for p in stops]), size, each).tolist()
    assert ends[-1] == 60 and sum(pad(b - a) + fines[b] for a, b in itertools.pairwise([0, *ends])) == best[60]


@given(st.sets(st.integers(1, 70), min_size=1), st.sampled_from([1, 8, 16, 64]))
def test_places_a_power_of_two_apart(stops, size):
    places = [0, *sorted(stops)]
    first, earlier = packing._exact(np.array(places), size)
    steps = [1 << k for k in range(7) if 1 << k < size]
    assert [earlier[a:b] for a, b in itertools.pairwise(first)] == [[places.index(p - s) for s in steps if p - s in places] for p in places]


def test_special_tokens_in_texts():
    own = packing.tokens_of(public_tokenizers.path(packing.VOCABULARY))
    odd = [None, "", "<|endoftext|> a", "x<|endoftext|>y", "a<|x b|>", "́ é \x1c y \x85 z", "it's I'M '' 's"]
    for text, ids in zip(odd, own.texts(pa.array(odd)).to_pylist(), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_embeddings_of_a_larger_table(spark):
    """Every link and component of the given vectors, against all pairs in double precision."""
    sf = SMALL.replace("0.001", "0.1")
    rows = {r["vec_id"]: r["embedding"] for r in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= embed.COSINE
    np.fill_diagonal(links, False)
    want = dict(zip(ids.tolist(), links.sum(axis=1).tolist(), strict=True))
    got = {r["vec_id"]: r for r in queries.QUERIES["op9_embedding_dedup"](spark, sf).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == want
    a, b = np.nonzero(links)
    check = classes(ids.tolist(), zip(ids[a].tolist(), ids[b].tolist(), strict=True))
    assert {i: r["component_id"] for i, r in got.items()} == check


def test_embedding_query(spark):
    rows = []
    for k in range(300):
        v = RNG.normal(size=24) if k % 6 == 0 else base + RNG.normal(size=24) * 0.05 * (k % 6)  # noqa: F821
        base = v if k % 6 == 0 else base  # noqa: F821
        rows.append((k, [float(e) for e in v]))
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = np.argwhere(np.triu(u @ u.T >= 0.95, 1)).tolist()
    want, degree = classes(range(300), linked), collections.Counter(itertools.chain(*linked))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(linked) > 50
    assert {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embed.near_vectors(df).collect()} == {k: (want[k], degree[k]) for k in range(300)}


def test_blocks_of_a_large_cell(spark):
    """A key that is cut into block pairs counts each pair once."""
    v = RNG.normal(size=8)
    rows = [(1, k, (v + RNG.normal(size=8) * 0.1).astype("<f8").tobytes(), 1) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, node long, v binary, n long")
    u = embed.units([bytes(r[2]) for r in rows])
    want = {k: int(n) for k, n in enumerate((u @ u.T >= 0.97).sum(axis=1) - 1)}
    dealt = embed.in_blocks(df, block=16).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    got = collections.Counter()
    for a, b in dealt.mapInArrow(embed._compare(embed._degrees, 0.97), "a long, b long").collect():
        got[a] += b
    assert dict(got) == want


def test_e8_neighbours():
    x = RNG.normal(size=(200, 8))
    near = embed.nearest(x)
    assert (near.sum(axis=1) % 2 == 0).all()
    others = [near + np.array(s) for s in itertools.islice((p for p in itertools.product((-1, 0, 1), repeat=8) if sum(p) % 2 == 0), 0, 3000, 7)]
    assert all((((near - x) ** 2).sum(axis=1) <= ((o - x) ** 2).sum(axis=1) + 1e-9).all() for o in others)


def test_license_places(spark):
    notice = dict(licenses.NOTICES)["MIT"].split()
    spoilt = [w if k % 40 else "changed" for k, w in enumerate(notice)]
    broken = [w if k % 3 else "changed" for k, w in enumerate(notice)]
    filler = " ".join(f"w{k}" for k in range(500))
    rows = [(1, f"{filler} {' '.join(notice)} {filler}"), (2, f"{filler} {' '.join(spoilt)}"), (3, " ".join(broken)), (4, "  licensed UNDER the\nApache License, version 2.0")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.notices(spark)).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (4, "Apache-2.0-notice")}
    assert got[1, "MIT"]["first_word"] == 500 and got[1, "MIT"]["matched"] == got[1, "MIT"]["shingles"] > got[2, "MIT"]["matched"]


def test_license_many_times_in_a_long_text(spark):
    notice = dict(licenses.NOTICES)["MIT"].split()
    many = " ".join(["w0 w1 w2 w3 w4 w5", *notice] * 150)
    df = spark.createDataFrame([(1, many), (1, "MIT alone"), (2, " ".join(notice)), (None, " ".join(notice))], "doc_id long, text string")
    plan = licenses.scan(df, licenses.notices(spark))
    got = {(r["doc_id"], r["license"]): (r["first_word"], r["matched"] == r["shingles"]) for r in plan.collect()}
    assert got == {(1, "MIT"): (6, True), (2, "MIT"): (0, True), (None, "MIT"): (0, True)}
    text = licenses.scan(df, licenses.notices(spark))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text  # only what matched is shuffled


def test_quality_statistics_of_nothing():
    from glimmer.llm.common import flat

    x = quality.statistics(*flat(pa.array(["", None, "a b c"])))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
