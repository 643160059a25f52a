"""Near-duplicate and substring removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from catweave.llm import neardup, ragged, substring

LAST = 1 << 62


def cut_plain(rows):
    """Kept words by the definition: a window goes if it starts in a document with a smaller id."""
    first = {}
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 49):
            key = b" ".join(w[s : s + 50])
            first[key] = min(first.get(key, LAST + 1), i)
    out = Counter()
    for (i, _), (k, w) in zip(rows, words):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[b" ".join(w[s : s + 50])] < k:
                gone[s : s + 50] = [True] * 50
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_substring(request, monkeypatch, table):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 100_000)
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    if table == "odd":  # the long text would take the plain version too long
        rows = [r for r in rows if r[0] != 3]
        df = df.where("doc_id IS NULL OR doc_id != 3")
    assert Counter(map(tuple, substring.remove_repeats(df, digest=True).collect())) == cut_plain(rows)
    texts = substring.remove_repeats(df)
    assert texts.drop("n_removed").count() == len(rows) and set(df.columns) <= set(texts.columns)


def test_shared_passages_at_every_shift(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(55)]
    rows = [(i, " ".join([word() for _ in range(i % 37)] + passage[: 50 + i % 6] + [word() for _ in range(i % 5)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.remove_repeats(df, digest=True).collect())) == cut_plain(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, row[j + 1] = row[j + 1], p + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_equals_plain():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, rng.integers(3, 200), rng.integers(1, 60)).astype(np.uint64)
        b = a.tolist()
        for _ in range(rng.integers(0, 6)):
            i, k = rng.integers(0, len(b) + 1), rng.integers(3)
            b[i : i + (k != 0)] = [] if k == 1 else [int(rng.integers(0, 200))]
        n = lcs(a.tolist(), b)
        want = n / max(1, len(a) + len(b) - n)
        assert abs(neardup.aligned_similarity(a, np.array(b, np.uint64), 0.8) - (want if want >= 0.8 - 1e-12 else 0)) < 1e-9


def plain_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [(i, t or "", (t or "").encode().split()) for i, t in rows if i is not None]
    for x, (i, t, a) in enumerate(seqs):
        for j, u, b in seqs[:x]:
            need = 0.8 / 1.8 * (len(a) + len(b)) - 1e-9
            alike = a == b if min(len(a), len(b)) < 5 else sum((Counter(a) & Counter(b)).values()) >= need and lcs(a, b) >= need
            if t == u or (a and b and alike):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, docs, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 6000").select("doc_id", "text").collect()]
    base = [word() for _ in range(150)]
    for k in range(60):  # edits of one text, and of each other
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = word()
        rows.append((1_000_000 + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 15 and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == plain_classes([(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 3]) | {3: 3}
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.class_id for r in got if r.class_id is not None})
    assert neardup.near_duplicates(none).count() == 0


def edited_copies(count, words, edits, seed):
    """Copies of one text that is not among them, each with its own words at some places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, out = [word() for _ in range(words)], []
    for _ in range(count):
        w = list(base)
        for k in rng.sample(range(words), edits):
            w[k] = word()
        out.append(" ".join(w))
    return out


def sequences(texts):
    return [np.array([int(hashlib.sha256(w.encode()).hexdigest()[:15], 16) for w in t.split()], np.uint64) for t in texts]


def test_blocks_equal_alignment():
    rng = random.Random(3)
    texts = [t.split() for t in [*edited_copies(40, 120, 10, 1), *edited_copies(20, 120, 3, 2)]]
    for k, t in enumerate(texts):
        if k % 3 == 1:  # passages in another order, which only alignment decides
            cut, to = rng.randrange(20, 100), rng.randrange(3, 18)
            t[:] = t[cut : cut + to] + t[:cut] + t[cut + to :]
        if k % 7 == 2:
            t[50:50] = t[:12] * 2
    seqs, n = sequences(" ".join(t) for t in texts), len(texts)
    near = np.array([[i != j and neardup.aligned_similarity(seqs[i], seqs[j], 0.8) > 0 for j in range(n)] for i in range(n)])
    assert 0 < near.sum() < n * (n - 1)

    def plain(want, label):
        root = list(range(n))
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if label[i] == label[j] or want[i, j] and near[i, j]:
                        root[i] = root[j] = min(root[i], root[j])
        return root

    visitor = np.arange(n) % 4 == 0
    for want, label in ((np.ones((n, n), bool), np.arange(n)), (visitor[:, None] | visitor[None, :], np.arange(n) // 3 * 3), (np.ones((n, n), bool), np.zeros(n))):
        assert neardup.connected(seqs, want, label, 0.8).tolist() == plain(want, label)


@pytest.mark.parametrize("blocks", [64, 7])
def test_group_without_its_original(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", blocks)
    # Copies far enough from each other that candidates are refused and chains form.
    texts = edited_copies(120, 300, 19, 5) + edited_copies(60, 300, 4, 6)
    texts += [" ".join(t.split()[:150] + u.split()[150:]) for t, u in zip(texts[:20], texts[120:140])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = [set(r["keys"]) for r in sorted(neardup._sketches(docs, 5, neardup.TABLES, neardup.PICKS).collect(), key=lambda r: r.doc_id)]
    seqs = sequences(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and neardup.aligned_similarity(seqs[i], seqs[j], 0.8):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    assert len({root(i) for i in range(120)}) > 1
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_recall_of_near_copies(spark):
    """Pairs within the similarity by brute force, found by keys: edits from a few words to as many as are allowed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, pairs = [], []
    for k in range(400):
        w = [word() for _ in range(rng.randint(40, 300))]
        e = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 14))):
            i = rng.randrange(len(e))
            e[i : i + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(e))]
        if neardup.aligned_similarity(*sequences([" ".join(w), " ".join(e)]), 0.8):
            pairs.append(k)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c // 2 == i // 2 for i, c in got.items())
    found = sum(got[2 * k] == got[2 * k + 1] for k in pairs) / len(pairs)
    assert len(pairs) > 300 and found >= 0.95


def test_texts_that_weak_hashes_confuse(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, " ".join(one), " ".join(other), f"{' '.join(one)} {'c ' * 200}", f"{' '.join(other)} {'c ' * 200}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_copies) for r in neardup.near_duplicates(docs).collect()}
    assert {got[i] for i in (0, 1)} == {(0, 1), (1, 1)} and neardup.keep_one(docs).where("doc_id < 2").count() == 2
    assert Counter(map(tuple, substring.remove_repeats(docs, digest=True).collect())) == cut_plain(list(enumerate(texts)))


def test_rows_of_one_id_with_several_texts(spark):
    a, b, c = edited_copies(3, 60, 60, 9)
    rows = [(5, a), (5, b), (3, a), (7, b), (7, c), (7, c), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.keep_one(docs).where("doc_id IS NOT NULL").collect())) == [(3, a), (5, b), (7, c)]
    assert neardup.keep_one(docs).count() == 5


def test_hash_check_falls_back_to_bytes(monkeypatch):
    import pyarrow as pa

    data, off = ragged.texts(pa.array(["ab cd ab ef"]))
    start, end, _ = ragged.words(data, off)
    monkeypatch.setattr(ragged, "span_hash", lambda d, s, e, which=0: np.zeros(len(s), np.uint64) if which == 0 else np.arange(len(s)).astype(np.uint64))
    which, inverse = ragged.distinct(data, start, end)
    assert [ragged.strings(data, start[which], end[which])[i] for i in inverse] == [b"ab", b"cd", b"ab", b"ef"]
