"""Packing token sequences by multiway differencing (operator 13).

Documents are cut where that saves padding. A task takes its documents in groups of as many tokens as 64 windows hold; what
is longer than a window fills windows of its own. The pieces of a group are dealt to windows by the differencing method of
Karmarkar and Karp, for many sets: every piece starts as a partial partition that has it in one window and nothing in
the others; the two partial partitions with the largest imbalance are merged, the fullest window of one with
the emptiest of the other, until one partition is left, with nearly equal windows. A window that is then over the capacity
gives up what is too much; these ends are a partial partition again, merged with the windows in the same way,
the largest end to the emptiest window. Where the ends find no room, the number of windows rises and the group is dealt out anew.

A group's total is a multiple of the capacity, as its last document is cut there and goes on in the next group. So windows are
full. What a task has left at its end, less than a window, is laid out in sequences whose lengths are powers of two.
Nothing is shuffled; a task holds the ids of one group.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import word_bpe
from tracemill.llm.common import ship_package

CAPACITY = 4096
END_ID = 2
#: Windows of a group, if it is full.
GROUP_WINDOWS = 64
#: Pieces that a task gives back at a time.
OUT_ROWS = 1 << 14
#: Sequences of a task are numbered from its partition's number times this on.
TASK_SEQUENCES = 1 << 40

#: A piece: number of its document, where it starts there, and its length.
Piece = tuple[int, int, int]


def difference(lengths: list[int], windows: int) -> np.ndarray:
    """The window of each piece: multiway differencing of ``lengths`` into ``windows`` sets."""
    n = len(lengths)
    heap = []
    for piece, length in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[0] = length
        heap.append((-length, piece, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a, fuller = heapq.heappop(heap)
        _, b, other = heapq.heappop(heap)
        sums = fuller + other[::-1]  # both fullest first, so the imbalances oppose each other
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n + len(merges) - 1, sums))
    # back from the last partition: which window each slot of a partial partition has become
    found = np.zeros(n, np.int64)
    slots = {n + len(merges) - 1: np.arange(windows)}
    for node in reversed(range(len(merges))):
        a, b, order = merges[node]
        mine = np.empty(windows, np.int64)
        mine[order] = slots.pop(n + node)
        for part, own in ((a, mine), (b, mine[::-1])):
            if part < n:
                found[part] = own[0]
            else:
                slots[part] = own
    return found


def _levelled(pieces: list[Piece], windows: list[list[Piece]], capacity: int) -> list[list[Piece]] | None:
    """``windows`` with no more than ``capacity`` each: ends of those that have more go where there is room.

    None if there is no room for all of them. With every round each end that moves finds all of its room or fills a window.
    """
    if sum(p[2] for p in pieces) > capacity * len(windows):
        return None
    sums = [sum(p[2] for p in w) for w in windows]
    while True:
        ends = []
        for i, window in enumerate(windows):
            while sums[i] > capacity:
                document, start, length = window.pop()
                off = min(length, sums[i] - capacity)
                if off < length:
                    window.append((document, start, length - off))
                ends.append((document, start + length - off, off))
                sums[i] -= off
        if not ends:
            return windows
        ends.sort(key=lambda p: -p[2])
        for end, i in zip(ends, sorted(range(len(windows)), key=sums.__getitem__), strict=False):
            windows[i].append(end)
            sums[i] += end[2]
        for end in ends[len(windows) :]:
            i = min(range(len(windows)), key=sums.__getitem__)
            windows[i].append(end)
            sums[i] += end[2]


def dealt(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Nearly equal windows of at most ``capacity`` with all of ``pieces``, which may be cut."""
    lengths = [p[2] for p in pieces]
    count = max(1, sum(lengths) // capacity)
    while True:
        windows: list[list[Piece]] = [[] for _ in range(count)]
        for piece, window in zip(pieces, difference(lengths, count).tolist(), strict=True):
            windows[window].append(piece)
        found = _levelled(pieces, windows, capacity)
        if found is not None:
            return [w for w in found if w]
        count += 1


def cut_at(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``tokens`` of ``pieces`` and the rest; one piece is cut in two where the end lies within it."""
    head: list[Piece] = []
    for i, (document, start, length) in enumerate(pieces):
        if length > tokens:
            rest = [(document, start + tokens, length - tokens), *pieces[i + 1 :]]
            return (head + [(document, start, tokens)] if tokens else head), rest
        head.append((document, start, length))
        tokens -= length
    return head, []


def powers(pieces: list[Piece], tokens: int) -> list[list[Piece]]:
    """``pieces``, which have ``tokens`` in all, in sequences whose lengths are powers of two, the longest first."""
    found = []
    for bit in reversed(range(tokens.bit_length())):
        if tokens >> bit & 1:
            own, pieces = cut_at(pieces, 1 << bit)
            found.append(own)
    return found


class _Packer:
    """The documents of a task, in groups; gives back rows (document, piece's start, length, sequence, offset)."""

    def __init__(self, capacity: int, group_windows: int):
        self.capacity, self.most = capacity, capacity * group_windows
        self.open: list[Piece] = []
        self.tokens = 0
        self.sequences = 0

    def _rows(self, windows: list[list[Piece]]) -> Iterator[tuple[int, int, int, int, int]]:
        for window in windows:
            offset = 0
            for document, start, length in sorted(window):
                yield document, start, length, self.sequences, offset
                offset += length
            self.sequences += 1

    def add(self, document: int, tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Takes in a document; full windows of its own and full groups come back."""
        alone = tokens // self.capacity * self.capacity
        for start in range(0, alone, self.capacity):
            yield from self._rows([[(document, start, self.capacity)]])
        if tokens > alone:
            self.open.append((document, alone, tokens - alone))
            self.tokens += tokens - alone
        while self.tokens >= self.most:
            group, self.open = cut_at(self.open, self.most)
            self.tokens -= self.most
            yield from self._rows(dealt(group, self.capacity))

    def end(self) -> Iterator[tuple[int, int, int, int, int]]:
        """What is left: whole windows, then sequences of powers of two."""
        group, rest = cut_at(self.open, self.tokens // self.capacity * self.capacity)
        if group:
            yield from self._rows(dealt(group, self.capacity))
        yield from self._rows(powers(rest, self.tokens % self.capacity))


def packed_evenly(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Every piece of every document with its place: (id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, [``ids``,]
    ``sequence_id``, ``offset``).

    A document is the ids of its text and an end id. Sequences are full, but for those at the end of a task whose lengths
    are powers of two; so nothing is padded where such sequences need no padding. ``ids`` are unsigned 32-bit
    little-endian numbers. Windows hold documents of one task, in the order of the table.

    Edge cases: a null or empty text is one token, its end id. Null ids and repeated rows are documents of their own. A
    document longer than a window is cut every ``capacity`` tokens, and only its rest is dealt out. An empty table gives
    no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_bpe.load(vocabulary), _Packer(capacity, group_windows)
        base = TaskContext.get().partitionId() * TASK_SEQUENCES
        held: dict[int, tuple[pa.Scalar, bytes]] = {}  # documents with tokens that are not placed yet
        left: dict[int, int] = {}
        out: list[tuple] = []

        def take(rows: Iterator[tuple[int, int, int, int, int]]) -> None:
            for document, start, length, sequence, offset in rows:
                key, data = held[document]
                own = data[4 * start : 4 * (start + length)]
                ids = [own] if with_ids else []
                out.append((key, start, length, zlib.crc32(own), len(data) // 4, *ids, base + sequence, offset))
                left[document] -= length
                if not left[document]:
                    del held[document], left[document]

        def flushed() -> pa.RecordBatch:
            names, columns = schema.names, list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.binary() if name == "ids" else pa.int64() for name in names[1:]]
            arrays = [pa.array([k.as_py() for k in columns[0]], columns[0][0].type)]
            arrays += [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        number = 0
        for batch in batches:
            for key, ids in zip(batch.column(0), encoder.ids(batch.column(1)), strict=True):
                held[number] = key, ids + end
                left[number] = len(ids) // 4 + 1
                take(packer.add(number, left[number]))
                number += 1
                if len(out) >= OUT_ROWS:
                    yield flushed()
        take(packer.end())
        if out:
            yield flushed()

    picked = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return picked.mapInArrow(run, schema)
