"""Toxicity, nearest neighbours, the pipeline, and the registered queries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catweave.llm import ann, queries, toxicity
from catweave.llm.common import table

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels")
    got = queries.op7_toxicity(spark, SF).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert ((held.predicted == held.toxic).mean()) > 0.97
    assert held.predicted[held.toxic == 1].mean() > 0.85 and held.predicted[held.toxic == 0].mean() < 0.02


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    net = toxicity.Model([rng.normal(0, 0.5, (size, toxicity.DIM)).astype(np.float32) for size in toxicity.TABLES])
    net.filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    net.bias = [rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    net.out, net.out_bias = rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.3
    return net


def words_of(texts):
    return toxicity.Words.of(*toxicity.ragged.texts(pa.array(texts)))


TEXTS = ["", "one", "two words", "Ärger über ÄRGER, again and again", "x " * 40, "a b c d e f g"]


def test_net_equals_plain_forward_pass():
    net, words = small_net(), words_of(TEXTS)
    for i, logit in enumerate(net.logits(words)):
        rows = words.rows[words.off[i] : words.off[i + 1]]
        x = [sum(net.embed[j][r[j]].astype(float) for j in range(3)) for r in rows]
        pooled = []
        for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias):
            for k in range(toxicity.FILTERS):
                places = [b[k] + sum(float(x[p + o] @ f[o][:, k]) for o in range(w)) for p in range(len(x) - w + 1)]
                pooled.append(max([0.0, *places]))
        assert abs(float(np.dot(pooled, net.out)) + net.out_bias - logit) < 1e-3
    again = toxicity.Words.unpacked(words.packed(), np.diff(words.off) - 2)
    assert np.array_equal(again.rows, words.rows) and np.array_equal(again.off, words.off)


def test_gradients_equal_differences():
    net, words = small_net(1), words_of(TEXTS)
    label, weight = np.array([0, 1, 0, 1, 1, 0]), np.array([1, 2, 1, 1, 0.5, 1], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(words).astype(float)))
        return float(-(weight * np.where(label == 1, np.log(p), np.log(1 - p))).mean())

    grads, bias, place, by_place = toxicity.gradients(net, words, label, weight)
    rng, step = np.random.default_rng(2), 1e-3
    for param, grad in zip([*net.filters, *net.bias, net.out], grads):
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in param.shape)
            kept, ends = param[at], []
            for d in (step, -step):
                param[at] = kept + d
                ends.append(loss())
            param[at] = kept
            assert abs((ends[0] - ends[1]) / (2 * step) - grad[at]) < 2e-2 * max(1, abs(grad[at]))
    total = np.zeros((len(words.rows), toxicity.DIM))
    np.add.at(total, place, by_place)
    for p in np.unique(place)[:8]:
        row, d = words.rows[p, 0], int(rng.integers(toxicity.DIM))
        kept, ends = net.embed[0][row, d], []
        for e in (step, -step):
            net.embed[0][row, d] = kept + e
            ends.append(loss())
        net.embed[0][row, d] = kept
        same = words.rows[:, 0] == row
        assert abs((ends[0] - ends[1]) / (2 * step) - total[same, d].sum()) < 2e-2
    assert abs(bias - float((weight * (1 / (1 + np.exp(-net.logits(words))) - label)).mean())) < 1e-4


def test_sample_is_bounded_by_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 10, "en", 5) for i in range(50)], "doc_id long, text string, lang string, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda words, label, language, n: seen.append((np.diff(words.off).tolist(), len(label), n)) or "model")
    toxicity.fit(docs, labels, most_words=75)
    toxicity.fit(docs.drop("lang"), labels, most_words=1)
    assert seen == [([12] * 7, 7, 1), ([12], 1, 1)]


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (4, 1, 0), (5, 1, 1), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    equal = {r.doc_id: r.score for r in got}
    assert equal[4] == equal[5] and equal[7] == equal[8] and equal[0] == equal[1]
    assert toxicity.classify(none, labels).count() == 0
    assert toxicity.classify(odd, labels.limit(0)).count() == odd.count()


def plain(vectors, k=20):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(ok))
    m = np.stack([ok[i] for i in ids]) if len(ids) else np.empty((0, 1))
    out = {}
    for i in ids[ids % 20 == 0]:
        s = (m * ok[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", [SMALL, SF])
def test_recall(spark, sf):
    v = table(spark, sf, "embeddings")
    want = plain([(r.vec_id, r.embedding) for r in v.collect()])
    got = {}
    for r in sorted(queries.op8_nearest_neighbours(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert all([r for r, _, _ in g] == list(range(1, 21)) for g in got.values())
    hits = [len({i for _, i, _ in g} & {i for i, _ in want[q]}) / len(want[q]) for q, g in got.items()]
    assert np.mean(hits) >= 0.9


def test_neighbours_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 1) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0], 2) for i in range(60, 400)]
    bad = [(400, None, 1), (401, [0.0] * 4, 1), (402, [1.0, None, 1.0, 1.0], 1), (403, [float("nan")] * 4, 1), (404, [float("inf")] * 4, 1), (405, [], 1), (None, [1.0] * 4, 1), (420, [1.0, 2.0], 1)]
    df = spark.createDataFrame([*rows, *bad, rows[3], rows[60]], "vec_id long, embedding array<float>, leaf int")
    got = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain([(i, v) for i, v, _ in rows])
    assert got.keys() == want.keys()
    assert np.mean([np.mean([s >= want[q][-1][1] - 1e-9 for _, s in got[q]]) for q in got]) >= 0.9
    for q in got:  # equal vectors tie, and ties go to the smaller id
        assert all(a[1] > b[1] or a[0] < b[0] for a, b in zip(got[q], got[q][1:]))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id IN (20, 21)"), F.col("vec_id") % 20 == 0).count() == 1


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += rows  # every row twice
    rows += [(7, rows[7][1])] * 200 + [(7, [9.0 + x / 100] * 8) for x in range(30)]  # one id many times, with other vectors too
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got.keys() == {0, 20, 40, 60, 80, 100}
    assert all([r for r, _ in g] == list(range(1, 21)) and len({i for _, i in g}) == 20 for g in got.values())


def test_every_dimension_is_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 150)  # not all dimensions are in the sample
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6 if i % 3 else 3).tolist()) for i in range(400)] + [(i, rng.normal(size=9).tolist()) for i in (400, 401, 402)]
    got = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, recall=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for size in (3, 6, 9):
        want |= plain([(i, v) for i, v in rows if len(v) == size])
    assert got.keys() == want.keys() and [i for i, _ in got[400]] == [i for i, _ in want[400]]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got]) >= 0.9


def test_queue_gives_leaves_best_first():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 5)) + rng.integers(0, 4, (900, 1)) * 3
    tree = ann.KMeansTree(points, branching=3, leaf=20)
    assert sorted(tree.place[tree.leaves]) == list(range(len(tree.leaves))) and len(tree.leaves) > 30
    for q in points[:20]:
        p = tree.priorities(q[None])[0]
        assert np.allclose(p, tree.matrix @ q + np.linalg.norm(q) * tree.spread)
        every = tree.visit(p.tolist(), len(tree.leaves))
        assert sorted(every) == list(range(len(tree.leaves)))
        few = tree.visit(p.tolist(), 2, [7] * len(tree.leaves), 40)
        assert few == every[:6]  # two, and on until they hold 40 rows
    # The bound on what a node's rows reach holds for nearly all of them.
    leaf = np.array(tree.leaves)[tree.assign(points)]
    reach = (points @ points[:50].T).T - (tree.matrix[leaf] @ points[:50].T).T
    assert (reach <= np.linalg.norm(points[:50], axis=1)[:, None] * tree.spread[leaf]).mean() > 0.95


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        if name != "packing":
            assert seen[-1].columns == columns
    scores = queries.op7_toxicity(spark, SMALL)
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}
    classes = corpus_pipeline.neardup.near_duplicates(seen[1])
    assert {r.doc_id for r in seen[2].collect()} == {r.class_id for r in classes.collect()}
    assert seen[3].count() == seen[2].count()
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    want = {r.doc_id: r.n_tokens + 1 for r in queries.count.token_counts(seen[3], queries.public_tokenizers.path(queries.BYTE_BPE)).collect()}
    got = {}
    for r in seen[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


@pytest.mark.parametrize("name", ["odd", "none"])
def test_pipeline_stages_on_odd_tables(spark, request, tmp_path, name):
    docs = request.getfixturevalue(name).withColumns({"n_words": F.lit("w"), "n_removed": F.lit(7), "digest": F.lit(b"d"), "class_id": F.lit("c")})
    spark.createDataFrame([(4, 0), (5, 0), (7, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema, seen = docs.schema.simpleString(), docs
    for stage, run in corpus_pipeline.STAGES[:-1]:
        seen = run(spark, seen, str(tmp_path)).cache()
        assert seen.schema.simpleString() == schema, stage
        assert seen.where("n_words != 'w' OR n_removed != 7 OR class_id != 'c'").count() == 0
        if stage == "toxicity":
            scored = toxicity.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert seen.count() == scored.where("predicted = 0").count()
        if stage == "near_dedup":
            texts = [(r.text or "") for r in seen.where("doc_id IS NOT NULL").collect()]
            assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) == seen.select("doc_id").distinct().count()


def test_near_dedup_stage_without_the_original(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(300)], []
    for i in range(500):
        w = list(base)
        for k in rng.sample(range(300), 4):
            w[k] = word()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()] == [0]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
