"""Counting, encoding and packing against the library itself."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, bpe_codec, packing, token_counts
from textloom.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

RND = random.Random(1)
ODD = ["'s", "'re", "'ve", "'ll", "'d", "'r", "'l", "  ", "\r\n", "\n", "\t", "ÅΣσ", "é", "ß", "中文", "😀", "\x85", " ", "​", "　", "\x1c", "İ", "Ᲊ", "²", "Ⅷ", "1", "23", "<|endoftext|>", "<|startoftext|>", "word", "The", " the"]


def odd_texts(n):
    return ["".join(RND.choice(ODD) for _ in range(RND.randrange(30))) for _ in range(n)] + ["", "a" * 3000 + " " * 500, "abcde" * 200, "<|endoftext|>"]


def test_counts_equal_the_library():
    texts = odd_texts(1500)
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(texts, BYTE_VOCABULARY).tolist() == want


def test_chunks_compose():
    """Cutting a text into chunks does not change its words, wherever the cuts fall."""
    text = "".join(RND.choice(ODD[:10] + [" ", "x"]) for _ in range(4 * token_counts.CHUNK))
    classes = token_counts._point_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    state, marks = token_counts._splitter()
    want, s = np.zeros(len(classes) + 1, bool), 0
    for i, c in enumerate([*classes, token_counts.STOP]):
        want[i] |= bool(marks[s, c] & token_counts.HERE) and i < len(classes)
        if marks[s, c] & token_counts.BEFORE:
            want[i - 1] = True
        s = state[s, c]
    assert (token_counts.word_starts(classes) == want[:-1]).all()


def test_counter_is_rebuilt_when_full():
    v = bpe.vocabulary(BYTE_VOCABULARY)
    small, large = token_counts.CountTransducer(v, most=5), token_counts.CountTransducer(v)
    for w in (b" the", b"thinking", b"aaaaaaa", "é中".encode()):
        assert small(w) == large(w)


def test_codes_equal_the_library():
    library = Tokenizer.from_file(WORD_VOCABULARY)
    for text in odd_texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe_codec.encode(text, WORD_VOCABULARY) == want
        assert bpe_codec.decode(want, WORD_VOCABULARY) == library.decode(want, skip_special_tokens=False)


def test_cache_keeps_within_its_bound():
    cache = bpe.BoundedCache(lambda k: k + "!", most=10, longest=5)
    keys = [str(k % 17) for k in range(200)]
    assert [cache[k] for k in keys] == [k + "!" for k in keys] and len(cache) <= 10
    assert cache["longer"] == "longer!" and "longer" not in cache
    bpe.BoundedCache.forget("another")
    assert not cache and not cache.old and cache["1"] == "1!"


ROWS = [(1, "some words"), (2, None), (3, ""), (None, "no key"), (1, "some words"), (4, "x " * 5000)]


def test_tables(spark):
    df = spark.createDataFrame([(k, t, "clash", 7) for k, t in ROWS], "doc_id long, text string, n_tokens string, piece int")
    counted = token_counts.with_token_counts(df, BYTE_VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in counted) == [(0, 2, False), (1, 2, False), (1, 2, False), (2, 0, False), (3, 0, False), (4, 5001, True)]
    coded = {r.doc_id: r for r in bpe_codec.round_trip(df, WORD_VOCABULARY).collect()}
    ids = Tokenizer.from_file(WORD_VOCABULARY).encode("some words", add_special_tokens=False).ids
    assert coded[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert coded[2].ids_sha256 == coded[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert token_counts.with_token_counts(df.limit(0), BYTE_VOCABULARY).count() == 0


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in ROWS], "doc_id long, text string, offset string").repartition(3)
    rows = packing.packed(df, WORD_VOCABULARY, capacity=64).collect()
    check_packing(rows, 64)
    library = Tokenizer.from_file(WORD_VOCABULARY)
    for k, text in {(k or 0, t or "") for k, t in ROWS}:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if (r.doc_id or 0) == k})
        assert mine == [(p, p * 64, len(ids[p * 64 : p * 64 + 64]), crc32(ids[p * 64 : p * 64 + 64].tobytes())) for p in range(-(-len(ids) // 64))]
    assert sum(r.doc_id == 1 for r in rows) == 2
    assert packing.packed(df.limit(0), WORD_VOCABULARY).count() == 0


@pytest.mark.parametrize("capacity,high", [(2048, 2048), (100, 100), (64, 33), (17, 17), (10, 4)])
def test_plans(capacity, high):
    rng = np.random.default_rng(capacity)
    lengths = rng.integers(1, high + 1, 500)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan, seen, bins = packing.Plan(counts, capacity), {}, {}
    for x in lengths.tolist():
        k = seen[x] = seen.get(x, -1) + 1
        s, o = plan.place(np.array([x]), np.array([k]))
        bins.setdefault(int(s[0]), []).append((int(o[0]), x))
    for parts in bins.values():
        at = 0
        for o, x in sorted(parts):
            assert o == at
            at += x
        assert at <= capacity
    assert len(bins) == plan.sequences and len(bins) <= 1.25 * lengths.sum() / capacity + 1


def test_reduction_is_optimal_on_small_instances():
    """Fixing what the reduction fixes never costs a sequence: against exhaustive search."""
    from functools import lru_cache

    def best(items, capacity):
        @lru_cache(None)
        def go(left):
            if not left:
                return 0
            first, rest = left[0], left[1:]
            low = 1 + go(rest)
            for mask in range(1, 1 << len(rest)):
                chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
                if first + sum(chosen) <= capacity:
                    low = min(low, 1 + go(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
            return low

        return go(tuple(sorted(items, reverse=True)))

    rng = random.Random(4)
    for _ in range(40):
        items = [rng.randint(1, 12) for _ in range(7)]
        count = np.bincount(items, minlength=13)
        fixed = packing.reduce_instance(count, 12)
        left = [x for x in range(13) for _ in range(int(count[x]))]
        assert all(sum(s) <= 12 for s, _ in fixed)
        assert sum(n for _, n in fixed) + best(left, 12) == best(items, 12)
