"""Text operators that work row by row: token counts, licences, languages, quality."""

import collections
import random
import re
import zlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracemill.llm import common, language, licences, quality, word_bpe  # noqa: E402
from tracemill.llm.token_counts import token_counts  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "\n\t", "don't I'll 123 1a2 x", "Σας ΣΊΣΥΦΟΣ", "áb é",
    "x\x1cy", "<|startoftext|>Hello<|endoftext|> <|ENDOFTEXT|>", "İstanbul", "日本語 テスト", "a\u0085b c",
    "ﬁ ½ ² ªº", "a" * 400, "﻿abc \U0001f642\U0001f642 e‍b", "ſ K Å", "word " * 5000,
    "a |b|<|x|> '' 's 't", "ÉÈ straße naïve",
]


def docs(spark, texts, extra="n_tokens long, id string, row int, kept string"):
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(i, t, *([None] * len(names))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.load(VOCABULARY)


def test_ids_are_the_librarys(bpe):
    texts = [t for t in ODD if t is not None]
    got = list(bpe.ids(pa.array(texts)))
    for text, ids in zip(texts, got, strict=True):
        want = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, text


def test_counts_over_small_blocks_and_full_caches(bpe, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 64)
    monkeypatch.setattr(word_bpe, "BLOCK_BYTES", 64)
    monkeypatch.setattr(word_bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(word_bpe, "CACHED_WORDS", 2)
    texts = [t or "" for t in ODD] * 2
    want = [len(bpe.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe.counts(pa.array(texts)).tolist() == want


def test_every_proved_word_is_one_token(bpe):
    for word, packed in list(bpe._whole.items())[::50]:
        if "�" not in word:
            assert len(packed) == 4
            ids = [t.id for t in bpe.tokenizer.model.tokenize(bpe._spelled(word))]
            assert ids == [int.from_bytes(packed, "little")]


def test_token_counts_of_odd_rows(spark, bpe):
    rows = token_counts(docs(spark, [*ODD, "same", "same"]), VOCABULARY, limit=4).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = [*ODD, "same", "same"][r.doc_id] or ""
        n = len(bpe.tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4)
    assert token_counts(docs(spark, []), VOCABULARY).count() == 0


# -- licences ------------------------------------------------------------------------------

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENCE_TEXTS = [
    None, "", "Released under the MIT License.", "cc by nc CC-BY-NC, under the mit license under the mit license",
    "all rights are reserved", "All rights reserved.", "apache license version 2 apache LICENSE version 2.0",
    "This work is licensed under the GNU General Public License, version 3.", "under the " * 50 + "mit license",
    "École under the MIT licensé", "x" * 5000,
]


def base_places(text):
    words = _WORD.findall((text or "").encode().lower())
    starts, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        phrase = phrase.encode().split()
        found = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licence_base_places(spark):
    rows = licences.licences(docs(spark, LICENCE_TEXTS, "labels string, score int")).collect()
    for r in rows:
        want = base_places(LICENCE_TEXTS[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in rows}
    assert found[4] == "" and found[5] == "all-rights-reserved" and found[7] == "gpl-3" and found[10] == ""
    assert licences.licences(docs(spark, [])).count() == 0


def test_matching_statistics_are_the_longest_matches():
    scanner = licences.scanner()
    templates = [licences.words(t.encode()) for _, t in licences.TEMPLATES]
    templates += [licences.words(p.encode()) for p in licences.PHRASES]
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    text = licences.words(b"to use copy this software subject to the following conditions the license you may not use "
                          b"licensed under the apache license version 3 under cc by nc 4 0 all rights all rights reserved")
    state = length = 0
    for end, word in enumerate(text, 1):
        state, length = scanner.automaton.step(state, length, word)
        assert length == max((n for n in range(1, end + 1) if tuple(text[end - n : end]) in known), default=0)


def test_licence_spans():
    notice = licences.TEMPLATES[1][1].replace("any person obtaining", "every person getting")
    (span,) = licences.scanner().spans(f"some code here {notice} and more".encode())
    assert span[0] == "mit" and 0.9 < span[3] < 1 and span[1] == 3


# -- languages -----------------------------------------------------------------------------


def test_a_whole_notice_after_a_partial_copy():
    """An earlier piece of a notice directly before the notice takes nothing from it."""
    label, notice = licences.TEMPLATES[1]
    words = notice.split()
    n = len(words)
    edited = [*words[: n // 2], "zebra", *words[n // 2 + 1 :]]
    for piece in (words[: n * 7 // 12], words[n // 3 : n // 2], words[-n // 4 :], []):
        scan = licences.scanner().scan(" ".join(piece + edited).encode())
        spans = licences.scanner().spans(" ".join(piece + edited).encode())
        (share,) = [c for name, _, _, c in spans if name == label]
        assert share > 0.95 and label in scan[5] and scan[6] > 0.95
    spans = [x for x in licences.scanner().spans(" ".join(edited * 3).encode()) if x[0] == label]
    assert len(spans) == 3


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    rows = language.languages(table).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in rows) < 0.03 * len(rows)
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(table.repartition(3)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}


def test_languages_are_those_of_plain_compression(spark):
    """Every text against every dictionary, chunk by chunk, with the library alone."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    learned = language.dictionaries(table)
    kind = zstandard.DICT_TYPE_RAWCONTENT
    for r in language.languages(table).collect():
        data = texts[r.doc_id].lower().encode()
        chunks = [data[i : i + language.CHUNK_BYTES] for i in range(0, len(data), language.CHUNK_BYTES)]
        sizes = {}
        for lang, content in learned.items():
            plain = zstandard.ZstdCompressor(
                level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind),
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            sizes[lang] = sum(len(plain.compress(c)) for c in chunks)
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        second = min(n for lang, n in sizes.items() if lang != best)
        assert r.lang_pred == best and r.score == pytest.approx(1 - sizes[best] / second)
        assert r.rejected == (r.score < language.MIN_MARGIN)


@pytest.mark.parametrize("text", ["½ 2²", "①②③", "12 34 !!", "٣٤", "_", "⅓Ⅷ½", "\u0301", "😀"])
def test_texts_without_letters_have_no_language(text):
    assert language.Classifier({"en": b"the house" * 9, "fr": b"la maison" * 9}).predict(text) == ("und", 0.0)


def test_every_labelled_language_is_learned(spark):
    """More languages than 64, and one whose texts are all long."""
    rnd = random.Random(8)
    words = [["".join(chr(97 + rnd.randrange(26)) for _ in range(6)) for _ in range(30)] for _ in range(80)]

    def say(k, n):
        return " ".join(rnd.choice(words[k]) for _ in range(n))

    rows = [(f"{k}-{i}", say(k, 3000 if k == 79 else 60), f"l{k:02}") for k in range(80) for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    learned = [r[0] for r in table.where(~language.held_out(F.col("doc_id"))).select("lang").distinct().collect()]
    found = {r.doc_id: r.lang_pred for r in language.languages(table).collect()}
    assert sorted(language.dictionaries(table)) == sorted(learned) and len(learned) > 64 and "l79" in learned
    assert all(found[i] == lang for i, _, lang in rows if lang in learned)


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, is_identified int"
    en, fr = "the cat and the dog of the house " * 5, "le chat et les chiens de la maison " * 5
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", "x", 1) for i in range(40)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "12 34 !!", "fr", None, None),
             (103, en, None, None, None), (None, fr, "fr", None, None), (104, "l", None, None, None)]
    got = language.languages(spark.createDataFrame(rows, schema)).collect()
    pred = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [pred[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "fr"]
    assert pred[100].score == 0 and pred[100].rejected and not pred[103].rejected and not pred[None].held_out
    kept = language.keep_identified(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang", "score", "is_identified"]
    assert not {100, 101, 102} & {r.doc_id for r in kept.collect()} and kept.count() >= 42
    nothing = spark.createDataFrame([(1, "text", None, None, None)], schema)
    assert [r.lang_pred for r in language.languages(nothing).collect()] == ["und"]
    assert language.languages(spark.createDataFrame([], schema)).count() == 0


# -- quality -------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(inside),
    )


QUALITY_TEXTS = [
    None, "", " \n ", "a b c a b c a b c", "x y z", "x y", "été a\nb\nb\n b\nb ", "line\n" * 200,
    "one two three four " * 30, "# * | <b> $5 100%", " ".join(f"word{i} of{i}" for i in range(60)),
    "WORD" + " LOUD" * 3 + " ".join(f"SHOUT{i}" for i in range(99)), "\x85   a b",
]


def test_quality_counts_and_verdict(spark):
    rows = quality.quality(docs(spark, QUALITY_TEXTS, "n_words string, is_good int")).collect()
    for r in rows:
        text = QUALITY_TEXTS[r.doc_id]
        counts = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, text
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.base_failed == failed
        one = quality.Text(text or "")
        assert r.kept == (not failed and not any(rule(one) for rule in quality.RULES.values()))
    kept = quality.keep_good(docs(spark, QUALITY_TEXTS, "n_words string, is_good int"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept} == {10}
    assert kept.columns == ["doc_id", "text", "n_words", "is_good"]
    assert quality.quality(docs(spark, [])).count() == 0


def test_cascade_keeps_its_verdict_in_any_order():
    texts = [t or "" for t in QUALITY_TEXTS] * 9
    rules = quality.BASE_RULES | quality.RULES
    cascade = quality.Cascade(rules, sample=20)
    want = [any(rule(quality.Text(t)) for rule in rules.values()) for t in texts]
    assert [cascade.rejects(t) for t in texts] == want
    assert sorted(n for n, _ in cascade.order) == sorted(rules)


def test_repeated_windows_with_many_distinct_words():
    words = [b"%d" % (i % 1_100_000) for i in range(1_100_006)]
    assert quality.repeated_window_words(words) == 12
