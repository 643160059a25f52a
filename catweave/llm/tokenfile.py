"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

A set of files is a folder of parts in ascending document order.  A part ``p`` has ``p.ids`` (its
documents' ids end to end, little-endian unsigned 16 or 32 bits, whichever the vocabulary needs),
``p.off`` (64-bit offsets of its documents into ``p.ids``, one more than documents) and ``p.doc``
(64-bit document ids; those of the first ``n_null`` documents are null).  Offsets are relative to the part; where a part begins in the whole sequence,
its base, is the prefix sum of the parts before it.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .bpe import byte_letters
from .common import scratch

#: Distinct words that a worker remembers between batches, and the bytes of the longest of them.
CACHE, SHORT = 250_000, 64
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, one distinct piece of a word at a time.

    No pre-token of such a tokenizer reaches over white space, and its normaliser (NFC, lower case) treats
    the words between it independently.  Words are cut further where an ASCII letter meets another ASCII
    character, for there a letter run begins or ends; only what follows an apostrophe stays with it.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known: dict[bytes, bytes] = {}

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lower-case bytes, start and end of the pieces, and piece offsets by text."""
        low = _LOWER[data]
        start, end, by_text = ragged.words(low, off)
        raw = low.tobytes()
        if any(word.lower() in raw for word in self.special):
            return data, start, end, by_text
        cut = np.zeros(len(low) + 1, bool)
        letter, ascii_ = _LETTER[low], low < 0x80
        cut[1:-1] = (letter[:-1] & ascii_[1:] & ~letter[1:]) | (letter[1:] & ascii_[:-1] & ~letter[:-1] & (low[:-1] != ord("'")))
        cut[off] = False
        cut[start] = True
        ink = np.zeros(len(low) + 1, bool)
        ink[:-1] = ~ragged._WHITE[low]
        start = np.flatnonzero(cut & ink)
        stop = cut.copy()
        stop[end] = True
        ends = np.flatnonzero(stop)
        end = ends[np.searchsorted(ends, start, "right")]
        return low, start, end, np.searchsorted(start, off)

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces seen for the first time; plain Latin letters need no normaliser or splitter."""
        rest, token, out = [], self.library.model.tokenize, {}
        for w in words:
            s = w.decode()
            if s.isalpha() and (s.isascii() or max(s) < "\u0250") and s == s.lower() and s.isascii() | unicodedata.is_normalized("NFC", s):
                out[w] = array("I", [t.id for t in token(s if s.isascii() else w.decode("latin-1").translate(self.letters))]).tobytes()
            else:
                rest.append((w, s))
        for (w, _), e in zip(rest, self.library.encode_batch_fast([s for _, s in rest], add_special_tokens=False) if rest else []):
            out[w] = array("I", e.ids).tobytes()
        self.known.update((w, ids) for w, ids in out.items() if len(w) <= SHORT)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and id offsets by text."""
        data, start, end, by_text = self.pieces(data, off)
        which, inverse = ragged.distinct(data, start, end)
        if len(self.known) > CACHE:
            self.known.clear()
        found = ragged.strings(data, start[which], end[which])
        known = self.known
        new = self._new([w for w in found if w not in known])
        out = [new[w] if w in new else known[w] for w in found]
        size = np.fromiter(map(len, out), np.int64, len(out)) // 4
        flat = np.frombuffer(b"".join(out), np.uint32)
        each = size[inverse]
        ids = flat[ragged.ranges((np.cumsum(size) - size)[inverse], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[by_text]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def append_to_each(ids: np.ndarray, off: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Every sequence with one more id at its end."""
    n = len(off) - 1
    to = off + np.arange(n + 1)
    out = np.full(len(ids) + n, last, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[to[1:] - 1] = False
    out[keep] = ids
    return out, to


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents, each followed by ``end_id``; one row per part with its base.

    Documents are ordered by ``doc_id`` (null first), equal ids by a hash of the text; a null or empty text
    gives the end id alone; texts of any length are encoded whole; repeated rows are written each; an empty
    table gives no part; other columns are ignored.  A part's files get their names when they are whole, and
    a task that is run again writes the same bytes.  ``folder`` is a place that all executors see.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        kind = "<u2" if max(words.size, end_id + 1) <= 1 << 16 else "<u4"
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}"
        n_docs = n_null = at = 0
        sinks = {}
        for batch in ragged.slices(batches):
            if not sinks:
                sinks = {x: store.open_output_stream(f"{name}.{x}.{task.taskAttemptId()}") for x in ("ids", "off", "doc")}
                sinks["off"].write(np.zeros(1, "<i8").tobytes())
            ids, off = append_to_each(*words.encode(*ragged.texts(batch.column("text"))), end_id)
            sinks["ids"].write(ids.astype(kind).tobytes())
            sinks["off"].write((off[1:] + at).astype("<i8").tobytes())
            sinks["doc"].write(batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            at += len(ids)
            n_docs += batch.num_rows
            n_null += batch.column("doc_id").null_count
        for x, sink in sinks.items():
            sink.close()
            store.move(f"{name}.{x}.{task.taskAttemptId()}", f"{name}.{x}")
        if sinks:
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/part-{task.partitionId():06d}"]), pa.array([kind]), pa.array([n_docs], pa.int64()), pa.array([n_null], pa.int64()), pa.array([at], pa.int64())],
                ["part", "file", "kind", "n_docs", "n_null", "n_ids"],
            )

    parts = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(run, "part long, file string, kind string, n_docs long, n_null long, n_ids long")
    )
    index = f"{scratch(spark, 'token-index')}/table"
    parts.write.parquet(index)
    parts = spark.read.schema(parts.schema).parquet(index)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def mapped(uri: str, kind: str) -> np.ndarray:
    """An array over a file: memory-mapped where it is local, else read."""
    store, where = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(where, kind, "r") if os.path.getsize(where) else np.empty(0, kind)
    with store.open_input_file(where) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(parts: DataFrame) -> DataFrame:
    """One row per document of the files that ``parts`` lists: where its ids start, how many, their CRC.

    Each part is read in a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc = mapped(f"{row['file']}.ids", row["kind"]), mapped(f"{row['file']}.off", "<i8"), mapped(f"{row['file']}.doc", "<i8")
                for a in range(0, row["n_docs"], 4096):
                    at = off[a : a + 4097].tolist()
                    chunk = ids[at[0] : at[-1]].astype("<u4").tobytes()
                    crc = [zlib.crc32(chunk[4 * (i - at[0]) : 4 * (j - at[0])]) for i, j in zip(at, at[1:])]
                    name = np.array(doc[a : a + 4096])
                    null = np.arange(a, a + len(name)) < row["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name, pa.int64(), mask=null), pa.array(np.array(at[:-1]) + row["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A number of partitions that is asked for is kept, where one left open would be made one.
    return parts.repartition(max(1, parts.count())).select("file", "kind", "n_docs", "n_null", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
