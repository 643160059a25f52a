"""Near-duplicate classes by order min-hash, verified by banded alignment.

A text's shingles (``width`` consecutive words) are labelled with their occurrence number.  For each of
``tables`` hash functions the ``picks`` labelled shingles of least hash are taken and hashed in the order
in which they stand in the text (Marcais et al., Locality-sensitive hashing for the edit distance, 2019):
two texts agree in such a key about as often as they share shingles, in the same order.

Texts with an equal key are candidates.  Two of them are similar by the longest common subsequence of
their words, ``common / (len(a) + len(b) - common)``, found with bit vectors over the band of diagonals
that a pair of the wanted similarity cannot leave; a pair whose shingles are as similar always is by its
words.  Where many texts share a key, matrix products over the words they have in common rule pairs out first.

Classes are what links connect, so a pair that is connected already needs no alignment: from a text of a
group all others still unconnected are tried, then from those it was linked with, and so on.  Members of a
key that are too many for one task are dealt into blocks twice, in different ways, and what either way
links is labelled.  Then each member outside its key's largest group is held against all members in
other groups, block by block.  So a group of any number of copies costs work in proportion to it, and yet
no pair of candidates of different classes is left untried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import ragged
from .common import written

WIDTH, TABLES, PICKS, SIMILARITY = 5, 20, 3, 0.8
SALTS = 16
#: Texts and words of one block; pairs from which products rule some out; columns of one product.
BLOCK_TEXTS, BLOCK_WORDS, MANY, COLUMNS = 512, 2_000_000, 64, 4096
U64 = np.uint64


def shingles(hashes: np.ndarray, by_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their offsets by text; a text with fewer words is one shingle."""
    n = np.diff(by_text)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(off[-1], U64)
    for size in range(1, width + 1):
        own = np.flatnonzero(n == size if size < width else n >= width)
        to = ragged.ranges(off[own], count[own])
        out[to] = ragged.window_hash(hashes, ragged.ranges(by_text[own], count[own]), size)
    return out, off


def _labelled(shingle: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers in their documents (``doc`` ascends)."""
    order = np.argsort(shingle, kind="stable")
    same = (shingle[order][1:] == shingle[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    nth = np.empty(len(shingle), np.int64)
    nth[order] = np.arange(len(shingle)) - np.repeat(first, np.diff(np.append(first, len(shingle))))
    return ragged.mix(shingle + nth.astype(U64) * U64(0xA24BAED4963EE407))


def order_min_hash(shingle: np.ndarray, off: np.ndarray, tables: int, picks: int) -> np.ndarray:
    """Keys (texts x tables) of texts that each have a shingle."""
    n = np.diff(off)
    label = _labelled(shingle, np.repeat(np.arange(len(n)), n))
    bits = U64(max(20, len(shingle).bit_length()))
    index = np.arange(len(shingle), dtype=U64)
    low = (U64(1) << bits) - U64(1)
    rng = np.random.default_rng(11)
    keys = np.empty((len(n), tables), U64)
    none = U64(2**64 - 1)
    for t in range(tables):
        a, b = (U64(x) for x in rng.integers(1, 2**63, 2))
        value = ((label ^ a) * (b << U64(1) | U64(1))) >> bits << bits | index
        at = np.empty((len(n), picks), np.int64)
        for j in range(picks):
            least = np.minimum.reduceat(value, off[:-1])
            at[:, j] = np.where(least == none, -1, (least & low).astype(np.int64))
            value[at[:, j][least != none]] = none
        at.sort(axis=1)
        key = np.full(len(n), U64(t + 1))
        for j in range(picks):
            key = ragged.mix(key * U64(0x9E3779B97F4A7C15) + np.where(at[:, j] < 0, U64(0), shingle[at[:, j]]))
        keys[:, t] = key
    return keys


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """``common / (len(a) + len(b) - common)`` of two word sequences with the longest common subsequence; 0 if below ``least``."""
    na, nb = len(a), len(b)
    need = int(np.ceil(least / (1 + least) * (na + nb) - 1e-9))
    if not na or not nb or min(na, nb) < need:
        return 0.0
    if np.array_equal(a, b):
        return 1.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[i], cb[j]).sum() < need:
        return 0.0
    short = min(na, nb)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[na - rest :][::-1] != b[nb - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    common = head + tail + _banded(a[head : na - tail].tolist(), b[head : nb - tail].tolist(), na - need, nb - need)
    return common / (na + nb - common) if common >= need else 0.0


def _banded(a: list[int], b: list[int], left: int, right: int) -> int:
    """Longest common subsequence within the diagonals from ``-left`` to ``right``, with bit vectors."""
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    band = (1 << left + right + 1) - 1
    v = full
    for i, x in enumerate(a):
        m = places.get(x, 0)
        if m:
            u = v & m & (band << i - left if i >= left else band >> left - i)
            if u:
                v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _possible(texts: list[np.ndarray], want: np.ndarray, least: float) -> np.ndarray:
    """Which of the wanted pairs of word sequences have enough words in common, in whatever order."""
    n = np.array([len(t) for t in texts])
    need = np.ceil(least / (1 + least) * (n[:, None] + n[None, :]) - 1e-9)
    want = want & (np.minimum(n[:, None], n[None, :]) >= need) & (n[:, None] > 0)
    if np.count_nonzero(want) <= 2 * MANY:
        return want
    doc = np.repeat(np.arange(len(n)), n)
    _, ids, crowd = np.unique(_labelled(np.concatenate(texts), doc), return_inverse=True, return_counts=True)
    keep = crowd[ids] > 1  # the others are in no pair's common part
    doc, ids = doc[keep], np.unique(ids[keep], return_inverse=True)[1]
    size = int(ids.max()) + 1 if len(ids) else 0
    chunks = [(r, c) for at in range(0, len(n), 128) if len(r := at + np.flatnonzero(want[at : at + 128].any(1))) and len(c := np.flatnonzero(want[r].any(0)))]
    total = np.zeros(want.shape, np.float32)
    order = np.argsort(ids, kind="stable")
    cuts = np.searchsorted(ids[order], np.arange(0, size + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((len(n), min(COLUMNS, size - k * COLUMNS)), np.float32)
        x[doc[order[lo:hi]], ids[order[lo:hi]] - k * COLUMNS] = 1
        for r, c in chunks:
            total[np.ix_(r, c)] += x[r] @ x[c].T
    return want & (total >= need)


def connected(texts: list[np.ndarray], want: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """For each word sequence the first of those it is connected with.

    Links are wanted pairs (``want`` is symmetric) of the similarity; sequences of one ``label`` are connected.
    """
    can = _possible(texts, want & (label[:, None] != label[None, :]), least)
    root = np.full(len(texts), -1)
    for i in range(len(texts)):
        if root[i] >= 0:
            continue
        todo = np.flatnonzero(label == label[i]).tolist()
        root[todo] = i
        while todo:
            u = todo.pop()
            for v in np.flatnonzero(can[u] & (root < 0)).tolist():
                if root[v] < 0 and aligned_similarity(texts[u], texts[v], least) > 0:
                    new = np.flatnonzero(label == label[v])
                    root[new] = i
                    todo += new.tolist()
    return root


def _digest(column: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def _sketches(docs: DataFrame, width: int, tables: int, picks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            data, off = ragged.texts(batch.column("text"))
            start, end, by_text = ragged.words(data, off)
            shingle, at = shingles(ragged.span_hash(data, start, end), by_text, width)
            n = np.diff(at)
            keys = order_min_hash(shingle, np.concatenate([[0], at[1:][n > 0]]), tables, picks) if len(shingle) else np.empty((0, tables), U64)
            ends = np.concatenate([[0], np.cumsum((n > 0) * tables)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(by_text).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "digest", "n_words", "keys"],
            )

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest"))
    return known.mapInArrow(run, "doc_id long, digest binary, n_words long, keys array<long>")


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, words``: 64-bit hashes of the words of the wanted texts (``doc_id, digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            data, off = ragged.texts(batch.column("text"))
            start, end, by = ragged.words(data, off)
            raw, ends = ragged.span_hash(data, start, end).astype("<u8").tobytes(), (8 * by).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[i:j] for i, j in zip(ends, ends[1:])], pa.binary())], ["doc_id", "words"])

    # Always a shuffled join: the wanted ids grow with the documents, so the plan shouldn't change with size.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", _digest())
    own = own.join(wanted.hint("merge"), ["doc_id", "digest"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])
    return own.mapInArrow(run, "doc_id long, words binary")


def _links(units: DataFrame, words: DataFrame, unit: list[str], least: float) -> DataFrame:
    """``doc_id, root``: texts connected within a unit of work.

    ``units`` has ``doc_id, label, visitor`` and the columns of ``unit``; with visitors, only they are held
    against the others.
    """

    def solve(rows: pa.Table) -> pa.Table:
        visitor, label = rows.column("visitor").to_numpy(), rows.column("label").to_numpy()
        ids, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)
        texts = [np.frombuffer(w.as_py(), "<u8") for w in rows.column("words").take(pa.array(first))]
        visitor, label = visitor[first], label[first]
        # A visitor at home is a resident too.
        want = visitor[:, None] | visitor[None, :] if visitor.any() else np.ones((len(ids),) * 2, bool)
        root = connected(texts, want, label, least)
        if len(ids) > MANY or rows.nbytes > 1 << 20:
            del texts
            ragged.release()  # workers are used again, by other operators too
        some = root != np.arange(len(ids))
        return pa.table([ids[some], ids[root[some]]], ["doc_id", "root"])

    return units.join(words, "doc_id").groupBy(*unit).applyInArrow(lambda rows: solve(rows), "doc_id long, root long")


def _dealt(doc: str, key: str, salt: int, blocks: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(doc), F.col(key), F.lit(salt)), F.col(blocks))


def _classes(docs: DataFrame, similarity: float, width: int, tables: int, picks: int) -> DataFrame:
    """``doc_id, digest, class_id, n_copies`` of each text of each document with an id."""
    sketch = written(_sketches(docs, width, tables, picks), "sketches")
    texts = written(sketch.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("n_copies")), "texts")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int")
    # A text may be that of a third of all documents: its copies are dealt over SALTS places.
    member = sketch.select("doc_id", "digest", salt.alias("salt")).join(texts.withColumn("salt", salts), ["digest", "salt"]).drop("salt").distinct()
    # One text of each id stands for it.
    chosen = texts.groupBy(F.col("rep").alias("doc_id")).agg(F.min("digest").alias("digest"))
    reps = sketch.join(chosen, ["doc_id", "digest"], "left_semi").select("doc_id", "digest", "n_words", F.explode("keys").alias("key")).distinct()
    reps = written(reps, "keys")
    crowd = reps.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.expr("bit_xor(xxhash64(doc_id, 1))").alias("h1"), F.expr("bit_xor(xxhash64(doc_id, 2))").alias("h2")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("n_words") / BLOCK_WORDS)).cast("long")
    # Keys with the same members count as one; a key may be that of a third of all texts.
    kept = crowd.groupBy("n", "n_words", "h1", "h2").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks"), salts.alias("salt"))
    shared = written(reps.select("doc_id", "digest", "key", salt.alias("salt")).join(kept, ["key", "salt"]).drop("salt"), "shared")
    words = written(_sequences(docs, shared.select("doc_id", "digest").distinct()), "words")
    dealing = F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    first = shared.select("doc_id", "key", "blocks", dealing.alias("d")).select(
        "doc_id", "key", "d", F.pmod(F.xxhash64("doc_id", "key", "d"), "blocks").alias("g"), F.col("doc_id").alias("label"), F.lit(False).alias("visitor")
    )
    links = written(_links(first, words, ["key", "d", "g"], similarity), "links")
    label = written(connected_components(links, "doc_id", "root", written), "labels")
    # Keys of several blocks whose members are not all connected yet.
    large = shared.where("blocks > 1").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    large = written(large.select("doc_id", "key", "blocks", F.coalesce("component", "doc_id").alias("label")), "large")
    groups = large.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = groups.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    open_ = written(open_.select("key", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK_TEXTS).cast("long").alias("crews")), "open")
    if not open_.isEmpty():
        rest = large.withColumn("salt", salt).join(open_.withColumn("salt", salts), ["key", "salt"]).drop("salt")
        home = _dealt("doc_id", "key", 0, "blocks")
        residents = rest.select("doc_id", "key", home.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("crews") - 1)).alias("d"), "label", F.lit(False).alias("visitor"))
        outside = rest.where("label != main")
        visitors = outside.select("doc_id", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("g"), _dealt("doc_id", "key", 5, "crews").alias("d"), "label", F.lit(True).alias("visitor"))
        # Where a visitor is at home it comes once, as a visitor.
        every = residents.unionByName(visitors).groupBy("key", "g", "d", "doc_id").agg(F.max("label").alias("label"), F.max("visitor").alias("visitor"))
        more = written(_links(every, words, ["key", "g", "d"], similarity), "links")
        edges = label.select(F.col("node").alias("doc_id"), F.col("component").alias("root")).unionByName(more)
        label = written(connected_components(edges, "doc_id", "root", written), "labels")
    found = member.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", "digest", F.coalesce("component", "rep").alias("class_id"), "n_copies")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_copies``.

    ``class_id`` is the smallest id of the documents linked with it, directly or through others; a document
    without near duplicates is its own class.  Equal texts (null counts as empty) are in one class, and are
    compared with others once, by their smallest id.  ``n_copies`` counts the documents with this very text.
    Words are runs without white space; a text below ``width`` words is one shingle, so it only matches
    texts of the same words; a text without words only its equals.  Texts of any length are compared whole.
    Rows that repeat an id are one document, the class of one with several texts being the least of theirs;
    one with a null id is alone and gets a null class.  An empty table gives no rows; other columns are ignored.
    """
    found = _classes(docs, similarity, width, tables, picks).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_copies").alias("n_copies"))
    alone = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionAll(alone)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: that with the smallest id.

    Rows that repeat an id and a text leave one row; a text goes only if another document has it or one like
    it.  Rows with a null id all stay; null and empty texts are copies of each other; columns stay as they are.
    """
    kept = _classes(docs, similarity, width, tables, picks).where("doc_id = class_id").select(F.col("doc_id").alias("_catweave_id"), F.col("digest").alias("_catweave_kept"))
    own = docs.where("doc_id IS NOT NULL").withColumn("_catweave_digest", _digest())
    known = own.join(kept, (F.col("doc_id").cast("long") == F.col("_catweave_id")) & (F.col("_catweave_digest") == F.col("_catweave_kept")), "left_semi")
    return known.dropDuplicates(["doc_id", "_catweave_digest"]).drop("_catweave_digest").unionAll(docs.where("doc_id IS NULL"))
