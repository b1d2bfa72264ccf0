"""Fingerprints, near-duplicates and vectors against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import components, embeddings, fingerprints, simhash, tiles
from textloom.llm import shingles as near

WORDS = [f"w{k}" for k in range(400)]
RNG = np.random.default_rng(3)


def prose(n):
    return " ".join(WORDS[i] for i in RNG.integers(0, len(WORDS), n))


def edited(text, k):
    words = text.split(" ")
    for i in RNG.integers(0, len(words), k):
        words[i] = WORDS[int(RNG.integers(0, len(WORDS)))]
    return " ".join(words)


def corpus():
    base = [prose(120) for _ in range(40)]
    texts = base + [edited(base[0], 1) for _ in range(30)] + [edited(b, 1) for b in base[:10]] + [base[3]] * 12
    return texts + [None, "", "  \n", "one", "One", "a b c", "A b c", "ÀB c", prose(3000)]


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(5)
    want_fp = [slow_fingerprint(t) for t in texts]
    want = reach(len(texts), lambda i, j: (want_fp[i] ^ want_fp[j]).bit_count() <= 4)
    for tile, share in ((2048, 64), (3, 1)):  # with three to a tile every large bucket is compared tile by tile
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(tiles, "SHARE", share)
        got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
        assert [got[i].fp % (1 << 64) for i in range(len(texts))] == want_fp
        assert [got[i].component_id for i in range(len(texts))] == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 6, 7, 8])
def test_links_at_every_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    halves = lambda k: sum(1 << int(i) for i in rng.permutation(32)[: k // 2]) | sum(1 << int(i) for i in 32 + rng.permutation(32)[: k - k // 2])
    fps = base + [b ^ halves(radius) for b in base[:12]] + [b ^ halves(radius + 1) for b in base[12:24]]  # the bits split evenly, the hardest case
    df = spark.createDataFrame([(fp - (1 << 64) * (fp >> 63), i) for i, fp in enumerate(fps)], "fp long, rep long")
    found = simhash.links(df, radius)
    got = {r.node: r.component for r in components.components(found).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)


def test_radius_bounds(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long, rep long"), 10)


def test_simhash_of_one_hot_block(spark, monkeypatch):
    """Every fingerprint has the same lower half, so one variant holds them all."""
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(tiles, "SHARE", 4)
    fps = [int(x) << 32 | 77 for x in np.random.default_rng(5).integers(0, 1 << 31, 700)] + [1 << 40 | 77, 3 << 40 | 77]
    df = spark.createDataFrame([(fp, i) for i, fp in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


def test_simhash_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(df).collect()) == [0, 7, 8]
    # One key with two texts, one of which is a copy of an earlier document: that one goes, and clashing columns stay.
    rows = [(1, "a b c d e", "p"), (5, "a b c d e", "q"), (5, "quite another text here", "r"), (None, "x", "s"), (None, "x", "t")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _hash string"))
    assert sorted(r._hash for r in kept.collect()) == ["p", "r", "s", "t"] and kept.columns == ["doc_id", "text", "_hash"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert {x: got.get(x, x) for x in nodes} == label


def test_vectors(spark):
    base = RNG.normal(size=(60, 16))
    vectors = [*base, *(base[:20] + RNG.normal(size=(20, 16)) * 0.05), *[base[5]] * 9, base[7] * 3]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2 if i < 40 else 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, rows[5][1], None), (906, [1.0, 2.0], 1), (907, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows if v and None not in v and np.isfinite(v).all() and any(v) and l is not None}
    label = {i: l for i, _, l in rows}
    ids = [r[0] for r in rows]
    linked = lambda a, b: a in unit and b in unit and label[a] == label[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93
    want = reach(len(ids), lambda i, j: linked(ids[i], ids[j]))
    for tile in (4096, 7):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, tile=tile).collect()}
        assert {i: got[i].n_links for i in ids} == {i: sum(linked(i, j) for j in ids if j != i) for i in ids}
        assert [got[i].component_id for i in ids] == [ids[k] for k in want]
        assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_vectors_under_one_key(spark):
    """Different vectors of one key are one node: one component, and the links of both."""
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, x, 1), (1, y, 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r)[:3] for r in embeddings.near_duplicates(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1)]


def shingles(text):
    words = (text or "").lower().split()
    return set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else {tuple(words)} if words else set()


def test_fingerprints(spark):
    texts = [prose(n) for n in (300, 900, 2000, 60)] + [None, "", "short text", "short text", "😀é" * 40, prose(5)]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.compared(df).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(got[k].near_edited - like(shingles(t), shingles(changed))) < 0.2
        assert abs(got[k].near_next - like(shingles(t), shingles(after))) < 0.2
    assert got[60].fingerprint == got[70].fingerprint and got[40].fingerprint == ""
    assert got[40].near_next == 1.0 and got[50].near_next == 0.0


def plain_minhash(text):
    """One permutation, 128 bins, empty ones filled by hashed probes, eight bits kept; straight from the definition."""
    spark_hash = lambda parts, h=42: __import__("functools").reduce(lambda h, p: xxhash.xxh64_intdigest(p, h), parts, h)
    eight, four = (lambda v, n=n: v.to_bytes(n, "little") for n in (8, 4))
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").lower().split()]
    hashes = [spark_hash(map(eight, words[i : i + 5])) for i in range(len(words) - 4)] or ([spark_hash(map(eight, words))] if words else [])
    signed = lambda h: h - (1 << 64) * (h >> 63)
    bins = {}
    for h in hashes:
        bins[h >> 57] = min(bins.get(h >> 57, signed(h)), signed(h))
    out = []
    for i in range(128) if bins else ():
        probes = [i] + [signed(spark_hash([four(i), four(k)])) % 128 for k in range(12)]
        found = next((bins[p] for p in probes if p in bins), None)
        if found is None:
            found = bins[min((signed(spark_hash([four(i), four(b), b"last"])), b) for b in bins)[1]]
        out.append(f"{found & 255:02x}")
    return "".join(out)


def test_fingerprints_equal_plain_minhash(spark):
    texts = [prose(n) for n in (1, 4, 5, 6, 9, 30, 120, 900)] + [None, "", " \n", "One two", "a b c d e a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compared(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].fingerprint == plain_minhash(t), i
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        assert got[i].edited_fingerprint == plain_minhash(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        one, two = got[i].fingerprint, plain_minhash(after)
        same = sum(one[k : k + 2] == two[k : k + 2] for k in range(0, 256, 2)) / 128
        assert got[i].near_next == pytest.approx(max(0, (same - 1 / 256) / (1 - 1 / 256)) if one and two else float(one == two))


def test_next_of_large_keys(spark):
    """Keys beyond what a double holds exactly."""
    keys = [(1 << 62) + 3 * i for i in range(400)]
    df = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "doc_id long, text string").repartition(4)
    assert all(int(r._next.text) == (int(r.text) + 1) % 400 for r in fingerprints.with_next(df, "doc_id", "text", ["text"], 16).collect())


def test_next_of_repeated_null_and_single_keys(spark):
    df = spark.createDataFrame([(None, "n"), (5, "b"), (5, "a"), (9, "z"), (9, "z")], "doc_id long, text string")
    rows = fingerprints.with_next(df, "doc_id", "text", ["text"], 8).collect()
    assert sorted((r.doc_id or 0, r.text, r._next.text) for r in rows) == [(0, "n", "a"), (5, "a", "b"), (5, "b", "z"), (9, "z", "n"), (9, "z", "z")]
    one = fingerprints.compared(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert fingerprints.compared(df.limit(0)).count() == 0
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert all(int(r._next.text) == (r.doc_id + 1) % 500 for r in fingerprints.with_next(many, "doc_id", "text", ["text"], 16).collect())


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_finds_all_near_copies(spark, monkeypatch):
    base = [prose(int(n)) for n in RNG.integers(5, 200, 30)]
    texts = [edited(b, k) for b in base for k in (0, 1, 2, 3)] + [edited(base[0] + " " + prose(300), 1) for _ in range(3)]
    big = prose(250)
    texts += [edited(big, 2) for _ in range(60)] + [big + " " + prose(120) for _ in range(20)] + [None, "", " \n", "one", "One", "a b c", "A  b c", "a b"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    sets = [shingles(t) for t in texts]
    want = sorted(set(reach(len(texts), lambda i, j: alike(sets[i], sets[j]))))
    for tile, few, often, share in ((1024, 32, 3, 64), (8, 2, 10**9, 1), (1024, 4, 10**9, 64)):  # small tiles, and an order without counts
        for name, value in (("TILE", tile), ("FEW", few), ("OFTEN", often)):
            monkeypatch.setattr(near, name, value)
        monkeypatch.setattr(tiles, "SHARE", share)
        kept = corpus_pipeline.one_of_each(spark, df, "")
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = [shingles(t) for _, t in rows]
    want = reach(len(rows), lambda i, j: 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]))
    got = corpus_pipeline.one_of_each(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted({rows[k][0] for k in want})


def test_stage_proposes_by_simhash(spark, monkeypatch):
    """Without the prefix filter's pairs, texts within four bits of each other are still linked by their fingerprints; no others are."""
    base = [prose(400) for _ in range(8)]
    texts = base + [b + " w1" for b in base] + [b.replace("w1", "W1") for b in base]
    fps = [slow_fingerprint(t) for t in texts]
    sets = [shingles(t) for t in texts]
    want = reach(len(texts), lambda i, j: sets[i] == sets[j] or (fps[i] ^ fps[j]).bit_count() <= 4 and alike(sets[i], sets[j]))
    assert len(set(want)) < len({frozenset(s) for s in sets})
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near, "_pairs", lambda tiles, find: none)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == sorted(set(want))


def test_stage_edges(spark):
    text, other = prose(40), prose(40)
    rows = [(None, text), (7, text), (7, text), (9, None), (8, ""), (3, other), (5, other), (5, prose(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.one_of_each(df).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 3, 5, 7, 8] and (5, other) not in [tuple(r) for r in got]
    assert near.one_of_each(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, text, "a"), (None, text, "b")], "doc_id long, text string, _stays string")
    assert sorted(r._stays for r in near.one_of_each(twice).collect()) == ["a", "b"]


def test_sketches_rule_no_pair_out():
    for n in (6, 300, 1020, 3000):
        text = prose(n)
        for other in (text, edited(text, n // 50), prose(n), text + " " + prose(n // 5)):
            one, two = (near.shingles(t) for t in (text, other))
            assert near._apart(near._sketch(one), near._sketch(two)) <= len(np.setxor1d(one, two))
