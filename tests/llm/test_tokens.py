"""Tokenizer operators against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catweave.llm import bpe, count, packing, pretoken, ragged, tokenfile

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "S", "t", "re", "'", "'s", "'ll", "'R", " ", "  ", "\n", "\t", "é", "É", "1", "23", "!", "?!", "　", "\xa0", "中", "😀", "<|endoftext|>", "<|startoftext|>", "The", "ß", "'re", "'Ve", "'l", "q", "́", "-", "İ", "Σ", "…", "\x1c"]


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(8000)] + ["", "a" * 3000, "ab'" * 500, " " * 1000]


def reference(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ids4(ids):
    return np.array(ids, "<u4").tobytes()


def test_strange_texts(strange):
    data, off = ragged.texts(pa.array(strange))
    ids, at = bpe.vocabulary(BYTE).encode(data, off)
    want = reference(BYTE, strange)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert count.transducer(BYTE).counts(data, off).tolist() == [len(w) for w in want]
    text, to = bpe.vocabulary(BYTE).decode(ids, at)
    assert text.tobytes() == data.tobytes() and to.tolist() == off.tolist()
    ids, at = tokenfile.encoder(WORD).encode(data, off)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(WORD, strange)


def test_scan_of_chunks_equals_one_run(strange):
    data, off = ragged.texts(pa.array(strange[:400]))
    whole = pretoken.spans(data, off)
    kept, pretoken.CHUNK = pretoken.CHUNK, 5
    try:
        pieces = pretoken.spans(data, off)
    finally:
        pretoken.CHUNK = kept
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))


@pytest.mark.parametrize("piece, pieces, most", [(1, 4, 600_000), (1, 1000, 50), (3, 7, 600_000), (64, 2, 100)])
def test_counts_of_pieces_cut_anywhere(strange, monkeypatch, piece, pieces, most):
    monkeypatch.setattr(count, "PIECE", piece)
    monkeypatch.setattr(count, "PIECES", pieces)
    monkeypatch.setattr(count, "MOST", most)
    rng = random.Random(9)
    texts = [*strange[:600], *strange[-3:], *("".join(rng.choices("abcdethrsnäé", k=rng.randint(1, 400))) for _ in range(60)), "the" * 500]
    machine = count.CountingTransducer(BYTE)
    got = machine.counts(*ragged.texts(pa.array(texts)))
    assert got.tolist() == [len(w) for w in reference(BYTE, texts)]


def twins():
    """Different texts that every polynomial hash modulo a power of two takes for equal, and near relatives."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    return [one, other, one, f"x {one} y", f"x {other} y", one[:512], other[:512], " ".join(one), " ".join(other)]


def test_texts_that_weak_hashes_confuse(spark):
    texts = twins()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    byte, word = reference(BYTE, texts), reference(WORD, texts)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {tuple(r) for r in bpe.encode_decode(df, BYTE).collect()} == {(i, len(w), sha(ids4(w)), sha(t.encode())) for i, (t, w) in enumerate(zip(texts, byte))}
    assert {(r.doc_id, r.n_tokens) for r in count.token_counts(df, BYTE).collect()} == {(i, len(w)) for i, w in enumerate(byte)}
    assert {(r.doc_id, r.ids_crc32) for r in tokenfile.read_token_files(tokenfile.write_token_files(df, WORD, 2)).collect()} == {(i, zlib.crc32(ids4([*w, 2]))) for i, w in enumerate(word)}
    assert {(r.doc_id, r.ids_crc32) for r in packing.pack(df, BYTE, end_id=0).where("doc_tokens <= 1024").collect()} == {(i, zlib.crc32(ids4([*w, 0]))) for i, w in enumerate(byte) if len(w) < 1024}


def test_least_id_is_no_null(spark):
    df = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (None, "c d"), (2**63 - 1, None)], "doc_id long, text string")
    got = sorted(tokenfile.read_token_files(tokenfile.write_token_files(df, WORD, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(2**63), 2**63 - 1]


def test_cut_pairs_never_lie_in_a_token():
    v = bpe.vocabulary(BYTE)
    assert all(v.joined[a, b] for t in v.tokens for a, b in zip(t, t[1:])) and not v.joined.all()


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_encode_decode_and_counts(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    want = reference(BYTE, [r.text for r in rows])
    got = bpe.encode_decode(df, BYTE).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, len(w), hashlib.sha256(ids4(w)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r, w in zip(rows, want))
    got = count.token_counts(df, BYTE).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, len((r.text or "").encode()), len(w), len(w) > 1024) for r, w in zip(rows, want))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_token_files(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = [w + [2] for w in reference(WORD, [r.text for r in rows])]
    got = sorted(tokenfile.read_token_files(tokenfile.write_token_files(df, WORD, 2)).collect(), key=lambda r: r.start)
    at = 0
    for r, w, g in zip(rows, want, got, strict=True):
        assert tuple(g) == (r.doc_id, at, len(w), zlib.crc32(ids4(w)))
        at += len(w)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    want = [w + [0] for w in reference(BYTE, [r.text for r in rows])]
    got = packing.pack(df, BYTE, end_id=0).collect()
    pieces = Counter()
    for r, w in zip(rows, want):
        pieces.update((r.doc_id, s, len(w[s : s + 1024]), zlib.crc32(ids4(w[s : s + 1024])), len(w)) for s in range(0, len(w), 1024))
    assert Counter(tuple(g)[:5] for g in got) == pieces
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(map(len, want))
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.1 * total / 1024 + 2


def test_fill_is_the_best_there_is():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        fill = packing.closest_fill(counts, room)
        assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= room)
        assert all(0 < k <= counts[n] for n, k in fill.items())
