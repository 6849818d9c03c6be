"""Steps of traces, counted block by block before they are shuffled.

Where most pairs of a log are rare, a hash table of all the pairs of a task saves next to no rows, and one that outgrows the
task's memory is sorted and spilled again and again. A block has a bounded number of activities, whatever the size of the
task: its activities are numbered in label order, its steps are sorted as numbers, and each pair leaves it once. So time
and memory follow the rows, and a pair that is in every case is sent once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Activities of a block; one longer case is a block of its own.
BLOCK_ROWS = 1 << 21
#: Bytes of labels that leave a block at a time, and that a block of several batches has before it is closed.
OUT_BYTES = 16 << 20
BLOCK_BYTES = 128 << 20

_WAYS = "low string, high string, up bigint, down bigint"


def block_ways(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``low, high, up, down`` of the steps in ``rows`` (``trace``), as ``follows.both_ways`` counts them, a row per pair and
    block. ``low`` is null where a case starts. ``high`` is null in a row for each activity of the block: ``up`` of
    its cases end with it, and it occurs ``down`` times. An empty trace has no step."""
    return rows.select("trace").mapInArrow(_counted(block_rows), _WAYS)


def _counted(block_rows: int):
    """The function that counts the blocks of a task; made here, it needs no import elsewhere."""
    out_bytes, block_bytes = OUT_BYTES, BLOCK_BYTES

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def blocks() -> Iterator:
            held, size = [], 0
            for batch in batches:
                traces, start = batch.column(0), 0
                ends = np.cumsum(pc.fill_null(pc.list_value_length(traces), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                while start < len(traces):
                    before = ends[start - 1] if start else 0
                    stop = int(np.searchsorted(ends, before + block_rows - size, side="right"))
                    stop = max(stop, start if held else start + 1)
                    if stop > start:
                        held.append(traces.slice(start, stop - start))
                        size += int(ends[stop - 1] - before)
                    if stop < len(traces):
                        yield held
                        held, size = [], 0
                    start = stop
                if sum(t.nbytes for t in held) >= block_bytes:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        def ways(held: list) -> Iterator:
            lengths = np.concatenate([pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False) for t in held])
            labels = pa.chunked_array([t.flatten() for t in held]).combine_chunks().dictionary_encode()
            names = labels.dictionary
            by_name = pc.sort_indices(names).to_numpy()
            number = np.empty(len(names), np.int64)
            number[by_name] = np.arange(1, len(names) + 1)
            none = len(names) + 1  # 0 stands before the first activity of a case, this behind the last
            line = np.zeros(len(labels) + len(lengths) + 1, np.int64)  # all cases, with a 0 between them
            line[np.arange(1, len(labels) + 1) + np.repeat(np.arange(len(lengths)), lengths)] = number[
                labels.indices.to_numpy()
            ]
            frequency = np.bincount(line, minlength=none)[1:]
            del labels
            src, dst = line[:-1], line[1:].copy()
            dst[dst == 0] = none
            some, back = (src != 0) | (dst != none), src > dst
            steps = np.minimum(src, dst)  # the rest is done in place, as a worker has little memory of its own
            steps *= none + 1
            steps += np.maximum(src, dst, out=dst)
            steps <<= 1
            steps |= back
            del line, src, dst
            steps = steps[some]
            steps.sort()
            if not len(steps):
                return
            first = np.flatnonzero(np.diff(steps, prepend=-1))
            pair, counts = steps[first] >> 1, np.diff(first, append=len(steps))
            begins = np.diff(pair, prepend=-1) != 0
            down = (steps[first] & 1) == 1
            place = np.cumsum(begins) - 1
            up_down = np.zeros((2, place[-1] + 1), np.int64)
            up_down[down.astype(np.int64), place] = counts
            low, high = np.divmod(pair[begins], none + 1)
            last, each = high == none, np.arange(1, none)
            ending = np.zeros(none, np.int64)
            ending[low[last]] = up_down[0, last]
            totals = np.stack([ending[1:], frequency])
            low, high = np.append(low[~last], each), np.append(high[~last], np.full(len(each), none))
            up_down = np.append(up_down[:, ~last], totals, axis=1)
            size = np.zeros(none + 1, np.int64)
            size[1:none] = pc.binary_length(names).to_numpy()[by_name]
            ends = np.cumsum(size[low] + size[high])
            start = 0
            while start < len(low):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + out_bytes, side="right")))
                piece = slice(start, stop)
                columns = []
                for number_of in (low[piece], high[piece]):
                    missing = (number_of == 0) | (number_of == none)
                    at = by_name[np.where(missing, 1, number_of) - 1]
                    columns.append(names.take(pa.array(at, mask=missing)))
                columns += [pa.array(c[piece]) for c in up_down]
                yield pa.RecordBatch.from_arrays(columns, names=["low", "high", "up", "down"])
                start = stop

        for held in blocks():
            yield from ways(held)
            pa.default_memory_pool().release_unused()

    return run
