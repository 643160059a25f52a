"""A convolutional text classifier for toxicity, trained in numpy.

Words (letter runs, lower case) are embedded by hashing: the word, its first four bytes and its first six
each pick a row of a table, and the rows are added.  Filters of several widths run over the words; each
filter's largest response over the whole text goes into a logistic layer.  Gradients flow through the
places of the largest responses only.  The language of a text is guessed from its words, and the decision
threshold is calibrated for each guessed language on rows set aside from training, so that a score of
one half is the threshold everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .common import written

#: Labelled rows, and words of theirs, that the classifier is fitted on at most, by hash order of their ids.
SAMPLE, SAMPLE_WORDS = 10_000, 8_000_000
TABLES, DIM, WIDTHS, FILTERS = (1 << 17, 1 << 15, 1 << 15), 16, (1, 2, 3), 12
#: Rows of each label that a language needs for a threshold of its own, and the share of rows set aside for it.
ENOUGH, ASIDE = 20, 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Three table rows for each word (padded by two empty words a text), and offsets by text."""

    rows: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray) -> Words:
        low = _LOWER[data]
        if len(low) > 1:  # Latin letters with marks, C3 80..9E
            up = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] < 0x9F) & (low[1:] != 0x97)) + 1
            low[up] += 0x20
        ink = np.zeros(len(data) + 2, bool)
        ink[1:-1] = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        start = np.flatnonzero(ink[1:-1] & (edge[:-1] | ~ink[:-2]))
        end = np.flatnonzero(ink[1:-1] & (edge[1:] | ~ink[2:])) + 1
        by = np.searchsorted(start, off)
        n = len(off) - 1
        to = np.arange(len(start)) + 2 * np.repeat(np.arange(n), np.diff(by))
        rows = np.full((len(start) + 2 * n, 3), -1, np.int32)
        for j, (size, stop) in enumerate(zip(TABLES, (end, np.minimum(end, start + 4), np.minimum(end, start + 6)))):
            rows[to, j] = (ragged.span_hash(low, start, stop, j % 2) % np.uint64(size - 1)).astype(np.int64)
        return cls(rows, by + 2 * np.arange(n + 1))

    def packed(self) -> np.ndarray:
        """One number for each word that is not padding."""
        rows = self.rows[self.rows[:, 0] >= 0].astype(np.int64)
        return rows[:, 0] << 32 | rows[:, 1] << 16 | rows[:, 2]

    @classmethod
    def unpacked(cls, codes: np.ndarray, size: np.ndarray) -> Words:
        n = len(size)
        rows = np.full((len(codes) + 2 * n, 3), -1, np.int32)
        to = np.arange(len(codes)) + 2 * np.repeat(np.arange(n), size)
        for j, shift in enumerate((32, 16, 0)):
            rows[to, j] = codes >> shift & 0xFFFFF >> (0 if j == 0 else 4)
        return cls(rows, np.concatenate([[0], np.cumsum(size + 2)]))


@dataclass
class Model:
    """Weights of the classifier and the language guesser; ``embed[j][-1]`` is the empty word."""

    embed: list[np.ndarray]
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out_bias: float = 0.0
    tongue: np.ndarray = field(default_factory=lambda: np.zeros((TABLES[1], 1), np.float32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def responses(self, words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedded words, and each width's filter responses at each place."""
        x = self.embed[0][words.rows[:, 0]] + self.embed[1][words.rows[:, 1]] + self.embed[2][words.rows[:, 2]]
        z = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            r = np.tile(b, (len(x), 1))
            for o in range(w):
                r[: len(x) - o] += x[o:] @ f[o]
            # A window that leaves its text never counts.
            last = words.off[1:] - 1
            for o in range(1, w):
                r[last - (o - 1)] = -1e9
            z.append(r)
        return x, z

    def pooled(self, words: Words, z: list[np.ndarray]) -> np.ndarray:
        if not len(words.off) - 1:
            return np.zeros((0, FILTERS * len(WIDTHS)), np.float32)
        return np.maximum(np.concatenate([np.maximum.reduceat(r, words.off[:-1]) for r in z], axis=1), 0)

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words, self.responses(words)[1]) @ self.out + self.out_bias

    def languages(self, words: Words) -> np.ndarray:
        """The likeliest language of each text by its words' first bytes."""
        if not len(words.off) - 1:
            return np.zeros(0, np.int64)
        return np.argmax(np.add.reduceat(self.tongue[words.rows[:, 1]], words.off[:-1]), axis=1)

    def scores(self, words: Words) -> np.ndarray:
        z = self.logits(words) - self.threshold[self.languages(words)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _subset(words: Words, which: np.ndarray) -> Words:
    n = np.diff(words.off)[which]
    return Words(words.rows[ragged.ranges(words.off[:-1][which], n)], np.concatenate([[0], np.cumsum(n)]))


def _log_odds(words: Words, which: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of each table's rows: log odds of label 1 by the chosen texts that have it, against all of them."""
    one, every = [np.zeros(size) for size in TABLES], [np.zeros(size) for size in TABLES]
    for k in range(0, len(which), 256):
        part, y = _subset(words, which[k : k + 256]), label[which[k : k + 256]]
        doc = np.repeat(np.arange(len(y), dtype=np.int64), np.diff(part.off))
        for j, size in enumerate(TABLES):
            real = part.rows[:, j] >= 0
            pair = np.unique(doc[real] * size + part.rows[real, j])
            one[j] += np.bincount(pair % size, y[pair // size], size)
            every[j] += np.bincount(pair % size, minlength=size)
    base = (label[which].sum() + 0.5) / (len(which) + 1)
    share = [(o + 2 * base) / (e + 2) for o, e in zip(one, every)]
    return [np.clip(np.log(p / (1 - p)) - np.log(base / (1 - base)), -3, 6) for p in share]


def gradients(model: Model, part: Words, label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean weighted log loss: by filters, their biases and the last layer; by the last bias; and by the
    embedded words at some places of ``part`` (a place may come several times)."""
    x, z = model.responses(part)
    h = model.pooled(part, z)
    p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
    g = ((p - label) * weight / len(label)).astype(np.float32)
    by_filter, by_bias = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.bias]
    gh = g[:, None] * model.out * (h > 0)
    places, grads = [], []
    for j, (w, f, r) in enumerate(zip(WIDTHS, model.filters, z)):
        top = np.stack([a + np.argmax(r[a:b], axis=0) for a, b in zip(part.off[:-1], part.off[1:])])  # texts x filters
        gj = gh[:, j * FILTERS : (j + 1) * FILTERS]
        by_bias[j] += gj.sum(0)
        hit = np.abs(gj) > 1e-7
        for o in range(w):
            place = np.minimum(top + o, len(x) - 1)
            by_filter[j][o] += np.einsum("nfd,nf->df", x[place], gj)
            places.append(place[hit])
            grads.append((gj[:, :, None] * f[o].T[None])[hit])
    return [*by_filter, *by_bias, (h * g[:, None]).sum(0)], float(g.sum()), np.concatenate(places), np.concatenate(grads)


def train(words: Words, label: np.ndarray, language: np.ndarray, n_languages: int, epochs: int = 5, batch: int = 48, seed: int = 3) -> Model:
    """Fit on texts with labels; ``language`` (of the same texts) only calibrates thresholds."""
    rng = np.random.default_rng(seed)
    n = len(label)
    model = Model([rng.normal(0, 0.02, (size, DIM)).astype(np.float32) for size in TABLES])
    model.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
    held = rng.permutation(n) < n // ASIDE if n >= 50 else np.zeros(n, bool)
    fit = np.flatnonzero(~held)
    if len(fit):
        for e, odds in zip(model.embed, _log_odds(words, fit, label)):
            # The first direction starts as the tables' log odds, and each width's first filter reads it.
            e[:, 0] = 0.2 * odds
        for f in model.filters:
            f[0, 0, 0] = 1.0
        model.out[:: FILTERS] = 0.5
    for e in model.embed:
        e[-1] = 0
    params = [*model.filters, *model.bias, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    scale = [np.full(len(e), 1e-3, np.float32) for e in model.embed]
    positive = max(1.0, float(label[fit].sum())) if len(fit) else 1.0
    weight = np.where(label == 1, min(5.0, 0.5 * n / positive), 1.0).astype(np.float32)
    base = np.clip(label[fit].mean(), 0.01, 0.99) if len(fit) else 0.5
    model.out_bias = float(np.log(base / (1 - base)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), batch):
            which = order[k : k + batch]
            part = _subset(words, which)
            grads, bias_grad, place, grad = gradients(model, part, label[which], weight[which])
            grads[-1] += 1e-5 * model.out
            step += 1
            for q, d, (m, v) in zip(params, grads, moments):
                m *= 0.9
                m += 0.1 * d
                v *= 0.99
                v += 0.01 * d * d
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            model.out_bias -= 0.05 * bias_grad
            for j, e in enumerate(model.embed):
                rows = part.rows[place, j]
                keep = rows >= 0
                own, back = np.unique(rows[keep], return_inverse=True)
                total = np.zeros((len(own), DIM), np.float32)
                np.add.at(total, back, grad[keep])
                scale[j][own] += (total * total).sum(1)
                e[own] -= 0.05 * total / np.sqrt(scale[j][own])[:, None]
    _fit_languages(model, words, language, n_languages)
    _calibrate(model, _subset(words, np.flatnonzero(held)), label[held], n_languages)
    return model


def _fit_languages(model: Model, words: Words, language: np.ndarray, n: int) -> None:
    count = np.zeros((TABLES[1], max(1, n)))
    for k in range(0, len(language), 256):
        part = _subset(words, np.arange(k, min(k + 256, len(language))))
        doc, real = np.repeat(language[k : k + 256], np.diff(part.off)), part.rows[:, 1] >= 0
        np.add.at(count, (part.rows[real, 1], doc[real]), 1)
    count += 0.1
    model.tongue = np.log(count / count.sum(0)).astype(np.float32)
    model.tongue[-1] = 0


def _best_cut(z: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest gap in the logits that leaves fewest weighted mistakes."""
    order = np.argsort(z)
    z, y = z[order], label[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([[0], np.cumsum(y == 0)])[-1] - np.concatenate([[0], np.cumsum(y == 0)])
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    best = np.flatnonzero(wrong == wrong.min())
    gap = edge[best + 1] - edge[best]
    k = best[np.argmax(np.minimum(gap, 6))]
    return float(np.clip((edge[k] + edge[k + 1]) / 2, -8, 8))


def _calibrate(model: Model, words: Words, label: np.ndarray, n: int) -> None:
    """A threshold for each language with enough of both labels, else that of all languages."""
    model.threshold = np.zeros(max(1, n), np.float32)
    if label.sum() < 3 or (label == 0).sum() < 3:
        return
    parts = [_subset(words, np.arange(k, min(k + 256, len(label)))) for k in range(0, len(label), 256)]
    z, tongue = np.concatenate([model.logits(p) for p in parts]), np.concatenate([model.languages(p) for p in parts])
    model.threshold[:] = _best_cut(z, label)
    for k in range(n):
        own = tongue == k
        if label[own].sum() >= ENOUGH and (label[own] == 0).sum() >= ENOUGH:
            model.threshold[k] = _best_cut(z[own], label[own])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_words: int = SAMPLE_WORDS) -> Model:
    """Train on at most ``sample`` labelled rows whose id is not held out, and on ``most_words`` words of them:
    of the rows in the order of their ids' hashes, as many as have no more words together (one at least)."""
    free = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    picked = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & free)
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches, most=1 << 20):
            words = Words.of(*ragged.texts(batch.column("text")))
            raw, ends = words.packed().tobytes(), (8 * np.cumsum(np.diff(words.off) - 2)).tolist()
            own = pa.array([raw[i:j] for i, j in zip([0, *ends], ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "lang", "toxic")), own], ["doc_id", "h", "lang", "toxic", "words"])

    # Bounded: the broadcast side has ``sample`` rows of two numbers, and each id's text is taken once.
    got = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(picked), "doc_id")
    rows = got.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "toxic")).alias("r"))
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id").alias("h"), "r.lang", F.col("r.toxic").cast("int").alias("toxic"), "r.text")
    rows = written(rows.mapInArrow(codes, "doc_id long, h long, lang string, toxic int, words binary"), "training")
    sizes = rows.select("h", "doc_id", F.octet_length("words").alias("n")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    count = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()) // 8, most_words, "right")) if sizes.num_rows else 0
    if 0 < count < sizes.num_rows or not count:
        last = sizes.slice(max(0, count - 1), 1).to_pylist()
        rows = rows.where(F.struct("h", "doc_id") <= F.struct(*(F.lit(r[c]).cast("long") for r in last for c in ("h", "doc_id")))) if last else rows
    rows = rows.drop("h").toArrow().sort_by("doc_id").combine_chunks()
    size = np.array([len(w) // 8 for w in rows.column("words").to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(w.as_py() for w in rows.column("words")), np.int64)
    words = Words.unpacked(flat, size)
    label = rows.column("toxic").to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
    names, code, seen = np.unique(np.array(rows.column("lang").to_pylist(), dtype=str), return_inverse=True, return_counts=True)
    del rows, flat
    # A language too rare for a threshold of its own shares the last place.
    often = np.flatnonzero(seen >= 2 * ENOUGH)
    place = np.full(len(names), len(often))
    place[often] = np.arange(len(often))
    model = train(words, label, place[code], max(1, len(often) + (len(often) < len(names))))
    del words
    ragged.release()
    return model


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with each text's score, from its whole text alone (a null text counts as empty)."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in ragged.slices(batches, most=1 << 20):
            score = net.scores(Words.of(*ragged.texts(batch.column("text"))))
            yield batch.append_column(name, pa.array(score, pa.float64()))

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are read only of rows whose ``crc32(doc_id as text) mod 5`` is not 0, the rest are held out.
    Rows without a label, or with a null one, teach nothing; without any label every score is that of a
    fixed prior.  Equal texts get equal scores; repeated rows each give a row; a null id is not held out.
    Null texts count as empty; texts of any length are scored whole; an empty table gives no rows; other
    columns are ignored, but for ``lang``, which (where there is one) teaches the guesser of languages.
    """
    model = fit(docs, labels, sample)
    scored = with_scores(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
