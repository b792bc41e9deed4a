import random

import numpy as np
import pytest
from dispatchlake.llm import quality, toxicity
from dispatchlake.llm.common import held_out
from dispatchlake.llm.labels import training_texts
from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ne", "ru", "sa") for c in ("t", "n", "x", "l")]


def tables(spark, make_docs, mark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        words, bad = rng.choices(WORDS, k=rng.randrange(5, 120)), rng.random() < 0.3
        docs.append((i, mark(rng, words) if bad else " ".join(words)))
        labels.append((i, 1 - bad, int(bad)))
    docs += [(2000, None), (2001, ""), (3, docs[3][1]), (None, "kanet"), (2002, "kanet " * 60_000)]
    labels += [(3, labels[3][1], labels[3][2]), (None, 1, 1), (5000, 0, 0), (6, None, None)]
    return make_docs(docs).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def insulted(rng, words):
    words[rng.randrange(len(words))] = rng.choice(["grobian", "grobianly"])
    return " ".join(words)


def littered(rng, words):
    return " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in words)


@pytest.mark.parametrize("module,label,mark", [(toxicity, "toxic", insulted), (quality, "quality", littered)])
def test_held_out_accuracy(spark, make_docs, module, label, mark):
    docs, labels = tables(spark, make_docs, mark)
    got = module.score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, module.score(docs, labels).collect()))
    judged = got.join(labels.where(f"{label} is not null").dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert len(judged) > 80 and sum(r.predicted == r[label] for r in judged) >= 0.97 * len(judged)


def test_labels_of_held_out_rows_are_not_read(spark, make_docs):
    docs, labels = tables(spark, make_docs, insulted)
    out = held_out(F.col("doc_id"))
    assert 100 < docs.where(out).count() < 180
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, toxicity.score(docs, x).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_few_rows(spark, make_docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(make_docs([]), none).count() == 0
    assert module.score(make_docs([(1, "a b"), (2, None)]), none).select("score").distinct().collect()[0].score == 0.5
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in module.score(make_docs([(1, "a b"), (2, None)]), one).collect())


def test_pairs_count():
    model = toxicity.FactorizationMachine(np.array([5, 6, 7]), 0.1, np.array([1.0, 2.0, 4.0]), np.array([[1.0, 0.0], [2.0, 1.0], [0.5, 3.0]]))
    got = model.logits(np.array([0, 1, 2, 1]), np.array([0, 3, 3, 4]))
    assert np.allclose(got, [0.1 + 7 + 2.0 + 0.5 + (1.0 + 3.0), 0.1, 2.1])


def test_context_vectors_count_neighbours(spark, make_docs):
    got = quality.context_vectors(make_docs([(1, "alpha beta gamma"), (2, "delta"), (3, None)]))
    places, signs = quality._index_vectors()
    a, b, c = quality.Buckets()("alpha beta gamma")
    want = np.zeros_like(got)
    for x, near in ((a, (b, c)), (b, (a, c)), (c, (a, b))):
        for y in near:
            want[x, places[y]] += signs[y]
    assert (got == want).all()


def plain_pooled(text, context):
    """Mean and spread of a text's token vectors, token by token."""
    places, signs = quality._index_vectors()
    rows = []
    for b in quality.Buckets()(text):
        own = context[b] / max(np.linalg.norm(context[b]), 1e-9)
        for p, s in zip(places[b], signs[b], strict=True):
            own[p] += s / 2
        rows.append(own)
    rows = np.array(rows)
    return np.concatenate((rows.mean(axis=0), rows.std(axis=0)))


def test_pooling_is_mean_and_spread(spark, make_docs):
    text = "alpha beta, gamma alpha! delta alpha"
    context = quality.context_vectors(make_docs([(1, text), (2, "beta gamma beta"), (3, "")]))
    got = quality.pooled(quality.Buckets()(text), quality.token_vectors(context))
    assert np.allclose(got, plain_pooled(text, context), atol=1e-5)
    assert not quality.pooled(quality.Buckets()(""), quality.token_vectors(context)).any()


def test_network_gradients_are_slopes():
    rng = np.random.default_rng(1)
    layers = [rng.normal(0, 0.5, (6, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 0.5, 4), np.array([0.2])]
    x, y = rng.normal(0, 1, (9, 6)), rng.integers(0, 2, 9).astype(float)

    def loss():
        z = np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3][0]
        return np.logaddexp(0, np.where(y > 0, -z, z)).mean() + quality.DECAY / 2 * ((layers[0] ** 2).sum() + (layers[2] ** 2).sum())

    for p, g in zip(layers, quality.gradients(layers, x, y), strict=True):
        for i in np.ndindex(p.shape):
            held = p[i]
            p[i] = held + 1e-5
            up = loss()
            p[i] = held - 1e-5
            down = loss()
            p[i] = held
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_temperature_is_the_best_of_a_fine_grid():
    rng = np.random.default_rng(2)
    for true in (0.5, 1.0, 3.0):
        z = rng.normal(0, 2, 4000)
        y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
        shown = z * true
        fine = np.arange(0.25, 8, 0.01)
        best = fine[np.argmin([-np.log(np.where(y > 0, 1 / (1 + np.exp(-shown / t)), 1 / (1 + np.exp(shown / t)))).mean() for t in fine])]
        assert abs(quality.best_temperature(shown, y) / best - 1) < 0.06 and abs(best / true - 1) < 0.25


def test_machine_slopes():
    rng = np.random.default_rng(3)
    model = toxicity.FactorizationMachine(np.arange(5), 0.3, rng.normal(0, 1, 5), rng.normal(0, 1, (5, 3)))
    ids, starts, y = np.array([0, 1, 3, 2, 3, 4, 0]), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 0.0])
    z = model.logits(ids, starts)
    by_weight, by_vector = toxicity.slopes(ids, starts, model.vectors, 1 / (1 + np.exp(-z)) - y)

    def loss():
        z = model.logits(ids, starts)
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum()

    for table, each in ((model.weights, by_weight), (model.vectors, by_vector)):
        for i in np.ndindex(table.shape):
            held = table[i]
            table[i] = held + 1e-5
            up = loss()
            table[i] = held - 1e-5
            down = loss()
            table[i] = held
            want = each[ids == i[0]].sum(axis=0)
            assert abs((up - down) / 2e-5 - (want[i[1]] if table.ndim > 1 else want)) < 1e-6


def test_labels_that_only_a_pair_tells(spark, make_docs):
    """Toxic are texts with both marks or neither: each word alone says nothing, so no sum of weights can tell."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(3000):
        words, a, b = rng.choices(WORDS, k=rng.randrange(20, 60)), rng.random() < 0.5, rng.random() < 0.5
        for there, mark in ((a, "grobian"), (b, "zelters")):
            if there:
                words.insert(rng.randrange(len(words)), mark)
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(a == b)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(make_docs(docs), table).where("held_out").collect()
    assert len(got) > 500 and sum(r.predicted == labels[r.doc_id][2] for r in got) >= 0.97 * len(got)


def test_one_text_of_a_repeated_id_is_learnt(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a c"), (1, "a b"), (2, None), (3, "x")])
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for sample, want in ((10, [(1, "a c", 1), (2, "", 1)]), (1, None)):
        got = [tuple(r) for r in training_texts(docs, labels, "toxic", sample).collect()]
        assert sorted(got) == want if want else len(got) == 1
