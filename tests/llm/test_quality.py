import zlib

import numpy as np

from lumenfield.llm import quality
from lumenfield.llm.queries import op4_quality


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = s.argsort().argsort() + 1
    p = y.sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op4_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert auc(*zip(*held)) > 0.95
    assert np.mean([int(s >= 0.5) == y for y, s in held]) > 0.93


def test_odd_rows(spark, docs):
    texts = [None, "", "!!! " * 4000, "good text here", "good text here", "junk%%% junk%%%"] * 3
    df = docs(enumerate(texts)).withColumn("score", quality.F.lit("old"))
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0), (11, 0), (2, 0), (0, None), (None, 1), (3, 1), (9, 7)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == len(texts) and got[0] == got[1] and got[3] == got[4] > 0.5 > got[5]
    again = quality.train(df.repartition(5), labels)
    assert np.allclose(again.weights, model.weights) and abs(again.bias - model.bias) < 1e-9


def test_empty_tables(spark, docs):
    df = docs([(1, "a b")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(df, none)
    assert quality.score(df, model).first().score == 0.5
    assert quality.score(df.limit(0), model).count() == 0


def test_learner_against_a_plain_loop():
    """Follow-the-regularised-leader, one coordinate at a time, from the published update."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        place = np.sort(rng.choice(50, rng.integers(1, 9), replace=False))
        rows.append((place, rng.random(len(place)), int(rng.random() < 0.5)))
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - (quality.L1 if zi > 0 else -quality.L1)) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for place, value, y in rows:
            x = {**dict(zip(place.tolist(), value.tolist())), quality.DIM: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i, v in x.items():
                g = (p - y) * v
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    w, bias = quality.learn(rows)
    assert quality.L1 > 0 and quality.L2 > 0
    assert np.allclose([w[i] for i in range(50)], [weight(i) for i in range(50)]) and abs(bias - weight(quality.DIM)) < 1e-9
    assert not w[50:].any()
