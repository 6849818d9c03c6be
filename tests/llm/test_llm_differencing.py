"""Packing by differencing: whole results, and the rule on its own."""

import itertools
import random
import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tracemill.llm import differencing  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


def plain_difference(lengths, windows):
    """Sums after differencing with lists: the two largest spreads merged, again and again."""
    open_parts = [[length] + [0] * (windows - 1) for length in lengths]
    while len(open_parts) > 1:
        open_parts.sort(key=lambda p: p[0] - p[-1])
        a, b = open_parts.pop(), open_parts.pop()
        open_parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return open_parts[0]


@pytest.mark.parametrize("seed", range(5))
def test_difference_is_the_method_on_distinct_spreads(seed):
    rnd = random.Random(seed)
    lengths = rnd.sample(range(1, 1 << 20), 40)
    windows = rnd.randrange(2, 7)
    found = differencing.difference(lengths, windows).tolist()
    sums = [sum(n for n, w in zip(lengths, found, strict=True) if w == i) for i in range(windows)]
    assert sorted(sums, reverse=True) == plain_difference(lengths, windows)


def test_difference_of_the_textbook():
    assert sorted([4, 5, 6, 7, 8][i] for i, w in enumerate(differencing.difference([4, 5, 6, 7, 8], 2)) if w == 0) in (
        [4, 5, 7], [6, 8],
    )


@pytest.mark.parametrize("seed", range(8))
def test_dealt_windows_hold_every_token_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([8, 100, 4096])
    pieces = [(i, rnd.randrange(50), rnd.randrange(1, capacity + 1)) for i in range(rnd.randrange(1, 80))]
    windows = differencing.dealt(pieces, capacity)
    assert all(0 < sum(p[2] for p in w) <= capacity for w in windows)
    total = sum(p[2] for p in pieces)
    assert len(windows) == -(-total // capacity)
    tokens = sorted((d, t) for w in windows for d, s, n in w for t in range(s, s + n))
    assert tokens == [(d, t) for d, s, n in pieces for t in range(s, s + n)]


def test_the_number_of_windows_rises():
    assert len(differencing.dealt([(0, 0, 7), (1, 0, 7), (2, 0, 3)], 8)) == 3
    sums = sorted(sum(p[2] for p in w) for w in differencing.dealt([(i, 0, 5) for i in range(5)], 10))
    assert sums == [5, 10, 10]


def test_powers():
    pieces = [(0, 3, 10), (1, 0, 3)]
    assert differencing.powers(pieces, 13) == [[(0, 3, 8)], [(0, 11, 2), (1, 0, 2)], [(1, 2, 1)]]
    assert differencing.powers([], 0) == []


def check(rows, texts, capacity):
    """Pieces are the documents, sequences are gapless, and only powers of two are short."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        assert sum(r.length for r in pieces) == len(ids[key])
        for r in pieces:
            own = ids[key][r.start : r.start + r.length]
            assert r.length > 0 and r.doc_tokens == len(ids[key])
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in pieces))
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] == capacity or (ends[-1] < capacity and ends[-1].bit_count() == 1)


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(differencing.packed_evenly(docs, VOCABULARY).collect(), texts, 4096)
    found = differencing.packed_evenly(docs.repartition(3), VOCABULARY, capacity=64, with_ids=True, group_windows=4).collect()
    check(found, texts, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)


def test_packed_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, other columns of the same names."""
    texts = {1: None, 2: "", 3: " \n", 4: "word " * 30_000, 5: "<|endoftext|> é ½", **{i: "a b c d e" for i in range(6, 90)}}
    schema = "doc_id long, text string, length string, Sequence int"
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], schema)
    check(differencing.packed_evenly(docs, VOCABULARY, capacity=128, group_windows=3).collect(), texts, 128)
    same = spark.createDataFrame([(None, "a b c", "x", 1), (3, "q r", "x", 1), (3, "q r", "x", 1)], schema)
    rows = differencing.packed_evenly(same.coalesce(1), VOCABULARY, capacity=4).collect()
    assert sum(r.length for r in rows) == 4 + 3 + 3 and {r.doc_id for r in rows} == {None, 3}
    assert differencing.packed_evenly(docs.limit(0), VOCABULARY).collect() == []
