"""Packing token sequences into windows by minimum bin slack.

A document of ``n`` ids is cut into full windows and one remainder.  How often each remainder length
occurs is a histogram of at most ``capacity - 1`` entries whatever the corpus: the plan is made from
it alone, on the driver, as few patterns with their multiplicities.  To fill a window, the longest
remaining length is taken and a subset-sum dynamic programme over bitsets finds, among the remaining
lengths and counts, the multiset that comes closest to the capacity; the counts are backtracked, and
the pattern is used as often as the counts allow.  Every remainder then finds its place from its rank
among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .bpe import vocabulary
from .common import written
from .tokenfile import append_to_each

CAPACITY = 1024


def closest_fill(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to ``room`` from below."""
    reach, full, stages = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            stages.append((length, take, reach))
            reach |= reach << length * take & full
            left, part = left - take, part * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, copies a window, first window, first offset)``.

    The remainder of this length with rank ``r >= first rank``, up to the next row's, goes to window
    ``first window + (r - first rank) // copies`` at ``first offset + (r - first rank) % copies * length``.
    """
    counts = {n: c for n, c in histogram.items() if c}
    used, rows, window = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = closest_fill({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, used[n], k, window, offset))
            used[n] += k * times
            offset += k * n
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        window += times
    return sorted(rows)


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with the task that cut it and its rank there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, task = vocabulary(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in ragged.slices(batches):
            ids, off = append_to_each(*bpe.encode(*ragged.texts(batch.column("text"))), end_id)
            n = np.diff(off)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * capacity
            length = np.minimum(n[doc] - start, capacity)
            raw, at = ids.astype("<u4").tobytes(), (off[doc] + start).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at, length.tolist())]
            order = np.argsort(length, kind="stable")
            fresh = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(fresh, fresh) + seen[fresh]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc])), pa.array(np.full(len(doc), task)), pa.array(rank)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long")


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: which ids of which document, and where they lie in which sequence.

    Null and empty texts are documents of the end id alone; repeated rows and rows with a null id are packed
    each; texts of any length are encoded whole, some megabytes at a time, and cut into as many pieces as
    they need; an empty table gives no rows; other columns are ignored.  Sequences are numbered from 0 without gaps, those of remainders first.
    """
    cut = written(pieces(docs, path, end_id, capacity), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    full = histogram.pop(capacity, 0)
    rows = plan(histogram, capacity)
    first = max((w + -(-(nxt - r) // k) for (_, r, k, w, _), nxt in zip(rows, _ends(rows, histogram))), default=0)
    if full:
        rows.append((capacity, 0, 1, first, 0))
    table = np.array(rows, np.int64).reshape(-1, 5)  # bounded by the patterns of a histogram
    key = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def _ends(rows: list[tuple[int, int, int, int, int]], histogram: Mapping[int, int]) -> list[int]:
    """The rank after the last one of each row of a sorted plan."""
    return [b[1] if a[0] == b[0] else histogram[a[0]] for a, b in zip(rows, [*rows[1:], (-1, 0, 0, 0, 0)])]
