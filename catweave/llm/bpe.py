"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so every text is cut
there with certainty (and at the pre-token boundaries); the fragments are encoded independently and
their ids concatenated.  Fragments repeat a lot, so each distinct one of a batch is encoded once.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import pretoken, ragged

#: Distinct fragments that a worker remembers between batches, and the bytes of the longest of them.
CACHE, SHORT = 250_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The vocabulary of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take their surroundings are not supported")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.tokens[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.tokens[i] = word.encode()
        ranks = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special.values()}
        # The merge loop takes an id as its merge's rank, so ids must rise in merge order.
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(b <= a for a, b in zip(made, made[1:])) or made and made[0] <= max(i for t, i in ranks.items() if len(t) == 1):
            raise ValueError(f"{path}: the ids don't rise in merge order")
        self.merge = tiktoken.Encoding("fragments", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.joined = np.zeros((256, 256), bool)
        for token in self.tokens:
            for pair in zip(token, token[1:]):
                self.joined[pair] = True
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[bytes, bytes] = {}
        self.preset = {w.encode(): [i] for w, i in self.special.items()}

    def fragments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the fragments, and fragment offsets by text."""
        start, end, _ = pretoken.spans(data, off, self.preset)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]] if len(data) > 1 else False
        for i, size in pretoken.occurrences(data, off, self.preset):
            cut[i + 1 : i + size] = False
        cut[start] = True
        start = np.flatnonzero(cut[:-1])
        return start, np.append(start[1:], len(data)), np.searchsorted(start, off)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and id offsets by text."""
        start, end, by_text = self.fragments(data, off)
        which, inverse = ragged.distinct(data, start, end)
        known, preset, out = self.known, self.preset, []
        if len(known) > CACHE:
            known.clear()
        for s in ragged.strings(data, start[which], end[which]):
            ids = known.get(s)
            if ids is None:
                ids = array("I", preset.get(s) or self.merge(s)).tobytes()
                if len(s) <= SHORT:
                    known[s] = ids
            out.append(ids)
        size = np.fromiter(map(len, out), np.int64, len(out)) // 4
        flat = np.frombuffer(b"".join(out), np.uint32)
        begin = np.cumsum(size) - size
        each = size[inverse]
        ids = flat[ragged.ranges(begin[inverse], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[by_text]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id sequences end to end, and byte offsets by sequence."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[ragged.ranges(self.starts[ids], size)], ends[off]


@functools.cache
def vocabulary(path: str) -> ByteBpe:
    """A worker loads a vocabulary file once."""
    return ByteBpe(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: token count, digest of its ids and digest of the text decoded from them.

    A null text counts as empty and an empty text has no ids.  Bytes that are not UTF-8 after decoding
    (possible only for foreign ids) become replacement characters.  Repeated rows each give a row;
    other columns of ``docs`` are ignored.  Texts are handled whole, some megabytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in ragged.slices(batches):
            data, off = ragged.texts(batch.column("text"))
            ids, at = bpe.encode(data, off)
            text, to = bpe.decode(ids, at)
            raw, ids4 = text.tobytes(), ids.astype("<u4").tobytes()
            a, t = at.tolist(), to.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(ids4[4 * i : 4 * j]).hexdigest() for i, j in zip(a, a[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(t, t[1:])], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
