"""Removal of passages that repeat across documents, found by difference-cover anchors.

A difference cover of the residues modulo ``p`` has, for any two positions, a common shift below ``p``
that takes both into it.  So if only positions whose residue is in the cover are hashed, over
``length - p + 1`` words, any two equal windows of ``length`` words still have an anchor in common at
the same place.  Anchors that two documents share mark the windows worth a look; these are extended
to the full length and compared whole, by a 96-bit hash, for the smallest document that has them.

Documents are dealt into blocks of a few megabytes.  A block sends each of its distinct anchors or
windows once, with the smallest and largest document that has it there, so a passage in a third of all
documents is one row a block, and gets its answer back as one row a block.  All windows of a text start in
its first copy, so later exact copies need no anchors: they are found by a digest of the text beforehand.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .common import written

#: A perfect difference set: the differences of its elements meet each residue but 0 once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 4 << 20
#: Text bytes that one task of a shuffle by block or by hash stands for, at most.
TASK_BYTES = 16 << 20
BLOCK, TEXT = "_catweave_block", "_catweave_text"
SALTS = 16
LAST = np.iinfo(np.int64).max


class _Words:
    """The words of a block's documents, and the document and place of each."""

    def __init__(self, table: pa.Table):
        self.doc_id = table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        self.data, self.off = ragged.texts(table.column("text"))
        self.start, self.end, self.by_text = ragged.words(self.data, self.off)
        self.n = np.diff(self.by_text)
        self.hash = ragged.span_hash(self.data, self.start, self.end)

    def copies(self, table: pa.Table, known: pa.Table) -> np.ndarray:
        """Which documents are later copies of a text."""
        pairs = np.stack([known.column("low").to_numpy(), known.column("h").to_numpy()], 1)
        own = np.stack([self.doc_id, table.column(TEXT).to_numpy()], 1)
        kind = [("a", np.int64), ("b", np.int64)]
        return np.isin(np.ascontiguousarray(own).view(kind).ravel(), np.ascontiguousarray(pairs).view(kind).ravel())

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word index, document index and hash of every anchor."""
        doc = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(doc)) - self.by_text[doc]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        short = length - PERIOD + 1
        at = np.flatnonzero(cover[place % PERIOD] & (place + short <= self.n[doc]) & (self.n[doc] >= length))
        return at, doc[at], ragged.window_hash(self.hash, at, short)

    def candidates(self, length: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word index, document index and two hashes of the windows that hold a shared anchor."""
        at, doc, h = self.anchors(length)
        keep = np.isin(h, shared)
        at, doc = at[keep], doc[keep]
        edge = np.zeros(len(self.start) + 1, np.int32)
        low = np.maximum(at - (PERIOD - 1), self.by_text[doc])
        high = np.minimum(at, self.by_text[doc + 1] - length)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        begin = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return begin, np.searchsorted(self.by_text, begin, "right") - 1, ragged.window_hash(self.hash, begin, length), ragged.window_hash(self.hash, begin, length, 1)

    def candidates_by_hash(self, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word index, document index and hash of the windows whose hash is in ``wanted`` (sorted)."""
        count = np.maximum(self.n - (length - 1), 0)
        begin = ragged.ranges(self.by_text[:-1], count)
        h = ragged.window_hash(self.hash, begin, length)
        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        keep = wanted[place] == h
        return begin[keep], np.repeat(np.arange(len(count)), count)[keep], h[keep]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _per_block(key: np.ndarray, doc: np.ndarray, more: np.ndarray | None = None) -> list[np.ndarray]:
    """Each distinct key once, with its smallest and largest document."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    out = [key[first], doc[first], doc[last]]
    return out if more is None else [*out, more[order][first]]


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False, names: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` without the words of windows that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``length`` (at least 32) consecutive words of one
    document; windows are judged on the input.  The result has the columns of ``docs``, ``text`` being
    the kept words joined by one space where words went and as it was elsewhere, and ``n_words``,
    ``n_removed``.  With ``digest`` it has ``doc_id, n_words, n_removed, kept_sha256`` instead, the
    last over the kept words joined by one space in every document.

    A null text has no words and stays null; texts below ``length`` words lose nothing; of equal texts
    the one with the smallest id keeps its words, rows with equal ids don't count against each other;
    a null id counts as larger than all others; texts of any length are handled whole; an empty table
    stays empty; an own column named ``n_words`` or ``n_removed`` is replaced.  ``names`` are other names
    for these two.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be more than {PERIOD}")
    docs = docs.select("doc_id", "text") if digest else docs.drop(*names)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    n_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    block_of = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(n_blocks))
    dealt = docs.withColumn(BLOCK, block_of).withColumn(TEXT, F.xxhash64("text")).repartition(n_tasks, BLOCK)

    # Later copies of a text: (id, text hash); a text's copies are dealt over SALTS places.
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("low"), F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("g"), block_of.alias(BLOCK))
    firsts = named.groupBy("g").agg(F.min("low").alias("first"), F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = named.withColumn("salt", F.pmod(F.xxhash64("low"), F.lit(SALTS)).cast("int")).join(firsts, ["g", "salt"]).where("low > first")
    copies = written(again.select(F.lit(0).alias("kind"), "h", "low", BLOCK), "copies")

    def apart(block: pa.Table, told: pa.Table) -> tuple[_Words, np.ndarray, pa.Table]:
        """The block's documents that are no copies, where the copies are, and the other rows told."""
        kind = told.column("kind").to_numpy()
        every = _Words.__new__(_Words)
        every.doc_id = block.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        copy = every.copies(block, told.filter(pa.array(kind == 0)))
        return _Words(block.filter(pa.array(~copy))), copy, told.filter(pa.array(kind == 1))

    def send_anchors(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        own, _, _ = apart(block, told)
        _, doc, h = own.anchors(length)
        h, low, high = _per_block(h, own.doc_id[doc])
        return pa.table([*_longs(h, low, high), pa.array(np.full(len(h), key[0].as_py(), np.int64))], ["h", "low", "high", BLOCK])

    def send_windows(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        own, _, shared = apart(block, told)
        _, doc, h, g = own.candidates(length, shared.column("h").to_numpy().view(np.uint64))
        h, low, high, g = _per_block(h, own.doc_id[doc], g)
        return pa.table([*_longs(h, g >> np.uint64(32), low, high), pa.array(np.full(len(h), key[0].as_py(), np.int64))], ["h", "g", "low", "high", BLOCK])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else docs.withColumns({c: F.lit(0).cast("long") for c in names}).schema

    def cut(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        own, kind = _Words(block), told.column("kind").to_numpy()
        copy = own.copies(block, told.filter(pa.array(kind == 0)))
        found = told.filter(pa.array(kind == 1))
        h, low = found.column("h").to_numpy().view(np.uint64), found.column("low").to_numpy()
        order = np.argsort(h)
        h, low = h[order], low[order]
        edge = np.zeros(len(own.start) + 1, np.int32)
        if len(h):
            begin, doc, w = own.candidates_by_hash(length, h)
            earlier = low[np.searchsorted(h, w)] < own.doc_id[doc]
            np.add.at(edge, begin[earlier], 1)
            np.add.at(edge, begin[earlier] + length, -1)
        whole = np.flatnonzero(copy & (own.n >= length))
        np.add.at(edge, own.by_text[whole], 1)
        np.add.at(edge, own.by_text[whole + 1], -1)
        gone = np.cumsum(edge[:-1]) > 0
        run = np.concatenate([[0], np.cumsum(gone)])
        removed = run[own.by_text[1:]] - run[own.by_text[:-1]]
        raw, off, by, s, e = own.data.tobytes(), own.off.tolist(), own.by_text.tolist(), own.start, own.end
        out: list = []
        for i, k in enumerate(removed.tolist()):
            if k == 0 and not digest:
                out.append(None)
                continue
            if k == 0:
                kept = b" ".join(raw[off[i] : off[i + 1]].split())
            else:
                at = np.flatnonzero(~gone[by[i] : by[i + 1]]) + by[i]
                kept = b" ".join(raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist()))
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        counts = _longs(own.n, removed)
        if digest:
            return pa.table([block.column("doc_id").cast(pa.int64()), *counts, pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        block = block.drop_columns([BLOCK, TEXT])
        texts = block.column("text").to_pylist()
        text = pa.array([t if k is None else k for t, k in zip(texts, out)], block.column("text").type)
        return block.set_column(block.column_names.index("text"), "text", text).append_column(names[0], counts[0]).append_column(names[1], counts[1])

    def told(kind_one: DataFrame | None = None) -> object:
        rows = copies if kind_one is None else copies.unionByName(kind_one.select(F.lit(1).alias("kind"), "h", "low", BLOCK))
        return rows.groupBy(BLOCK)

    anchors = dealt.groupBy(BLOCK).cogroup(told()).applyInArrow(send_anchors, f"h long, low long, high long, {BLOCK} long")
    by_anchor = Window.partitionBy("h")
    shared = anchors.repartition(n_tasks, "h").withColumns({"low": F.min("low").over(by_anchor), "high": F.max("high").over(by_anchor)}).where("low < high").select("h", F.lit(0).cast("long").alias("low"), BLOCK)
    windows = dealt.groupBy(BLOCK).cogroup(told(shared)).applyInArrow(send_windows, f"h long, g long, low long, high long, {BLOCK} long")
    by_window = Window.partitionBy("h", "g")
    repeats = windows.repartition(n_tasks, "h").withColumn("low", F.min("low").over(by_window)).where("low < high").select("h", "low", BLOCK)
    return dealt.groupBy(BLOCK).cogroup(told(repeats)).applyInArrow(cut, schema)
