"""Quality rules as a short-circuit cascade (operator 9).

Rules are tried in the order of rejections per second of work, both estimated on a sample: the first
texts of each task, on which every rule runs. The order only decides how much work a rejected text
costs; a text is kept if no rule rejects it, whatever the order. So each task may choose for its own
data, nothing is read twice, and reruns agree.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import fresh, per_text, ship_package, text_blocks

WINDOW = 3
#: Texts at the start of a task on which all rules are timed.
SAMPLE_TEXTS = 64

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SMALL = bytes(range(ord("a"), ord("z") + 1))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur at least twice, first occurrences included."""
    if len(words) <= WINDOW:
        return 0
    numbers = _Numbers()
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    distinct = len(numbers)
    heads = at[:-2] * distinct + at[1:-1]
    if distinct >= 1 << 20:  # three numbers do not fit 63 bits: number the pairs first
        heads = np.unique(heads, return_inverse=True)[1]
    keys = heads * distinct + at[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(at), bool)
    for shift in range(WINDOW):
        inside[shift : shift + len(twice)] |= twice
    return int(inside.sum())


class Text:
    """Counts of one text, each taken when first asked for."""

    def __init__(self, text: str):
        self.n_chars = len(text)
        self.data = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.n_chars - (len(self.data) - len(self.data.translate(None, _SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words)

    @cached_property
    def capitals(self) -> int:
        return len(self.data) - len(self.data.translate(None, _CAPITALS))

    @cached_property
    def small_letters(self) -> int:
        return len(self.data) - len(self.data.translate(None, _SMALL))

    @cached_property
    def words_with_letter(self) -> int:
        return sum(1 for w in self.words if _LETTER.search(w))

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)


Rule = Callable[[Text], bool]

#: True: the base rejects the text.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
#: True: the rule rejects the text.
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 5 * len(t.lines),
    "capitals": lambda t: t.capitals > t.small_letters,
    "no_letters": lambda t: 10 * t.words_with_letter < 5 * t.n_words,
    "one_word": lambda t: 10 * t.top_word > 3 * t.n_words,
}


class Cascade:
    """Rules that reorder themselves once, after the sample."""

    def __init__(self, rules: dict[str, Rule], sample: int = SAMPLE_TEXTS):
        self.order, self.left = list(rules.items()), sample
        self._seconds, self._rejected = Counter(), Counter()

    def _sampled(self, text: str) -> bool:
        """Times every rule on a fresh copy, so that shared counts weigh on each that needs them."""
        rejects = False
        for name, rule in self.order:
            fresh_text = Text(text)
            began = time.perf_counter()
            out = rule(fresh_text)
            self._seconds[name] += time.perf_counter() - began
            self._rejected[name] += out
            rejects |= out
        self.left -= 1
        if self.left == 0:
            rate = {n: self._rejected[n] / max(self._seconds[n], 1e-9) for n, _ in self.order}
            self.order.sort(key=lambda r: (-rate[r[0]], self._seconds[r[0]]))
        return rejects

    def rejects(self, text: str, counted: Text | None = None) -> bool:
        if self.left:
            return self._sampled(text)
        counted = counted or Text(text)
        return any(rule(counted) for _, rule in self.order)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, ``base_failed``, ``kept``) of every whole text.

    All base counts are wanted of every text, so the cascade saves work on the other rules only;
    :func:`keep_good` runs all rules as one cascade.

    Edge cases: a null or empty text has no words and fails the base. Null ids stay null; repeated rows
    each give a row; an empty table gives no rows; other columns are ignored.
    """

    of_task: list[Cascade] = []  # filled in a task: one sample for all its blocks

    def compute(texts: pa.Array) -> list[pa.Array]:
        if not of_task:
            of_task.append(Cascade(RULES))
        cascade = of_task[0]
        rows: list[list] = [[] for _ in range(len(_COUNTS) + 2)]
        for text in texts.to_pylist():
            counted = Text(text)
            counts = [getattr(counted, c) for c in _COUNTS]
            failed = any(rule(counted) for rule in BASE_RULES.values())
            kept = not failed and not cascade.rejects(text, counted)
            for row, value in zip(rows, [*counts, failed, kept], strict=True):
                row.append(value)
        longs = [pa.array(r, pa.int64()) for r in rows[: len(_COUNTS)]]
        return [*longs, *(pa.array(r, pa.bool_()) for r in rows[len(_COUNTS) :])]

    fields = [T.StructField(c, T.LongType()) for c in _COUNTS]
    fields += [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return per_text(docs, id_col, text_col, fields, compute)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no base rule and no other rule rejects.

    A null or empty text is rejected (too few words). One pass without a shuffle.
    """

    ship_package(docs.sparkSession)

    @F.arrow_udf(T.BooleanType())
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cascade = Cascade(BASE_RULES | RULES)
        for texts in batches:
            found = [
                t is not None and not cascade.rejects(t) for block in text_blocks(texts) for t in block.to_pylist()
            ]
            yield pa.array(found, pa.bool_())

    (flag,) = fresh(docs, "is_good")
    return docs.withColumn(flag, good(docs[text_col])).where(F.col(flag)).select(*docs.columns)


#: The same counts and verdict in SQL.
QUALITY_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM texts),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
follow AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c
    FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM follow WHERE c IS NOT NULL),
inside AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM inside GROUP BY r),
tops AS (SELECT r, max(n) AS top FROM (SELECT r, word, count(*) AS n FROM words GROUP BY ALL) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(l) AS x FROM split) GROUP BY r),
counts AS (SELECT s.r, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, coalesce(top, 0) AS top,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS small,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered
    FROM split s LEFT JOIN repeats USING (r) LEFT JOIN tops USING (r) LEFT JOIN lines USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 10 * n_dup_lines > 5 * n_lines OR capitals > small OR 10 * lettered < 5 * n_words
        OR 10 * top > 3 * n_words) AS kept
FROM base"""
