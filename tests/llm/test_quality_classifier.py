import zlib

import numpy as np

from hostlore.llm import quality_classifier as qc


def test_contexts_equal_plain_sums():
    texts = [b"a b c a ### a", b"", b"b b c", b"solo"]
    buckets, sizes = qc.token_buckets(texts)
    place, sign = qc.index_vectors()
    total = np.zeros(qc.BUCKETS * qc.DIMENSIONS, np.int64)
    qc.add_contexts(total, buckets, sizes, place, sign)
    want = np.zeros((qc.BUCKETS, qc.DIMENSIONS))
    for t in texts:
        ids = [zlib.crc32(x) % qc.BUCKETS for x in qc.TOKEN.findall(t)]
        for i, x in enumerate(ids):
            for j in range(max(0, i - qc.REACH), min(len(ids), i + qc.REACH + 1)):
                if i != j:
                    for k in range(qc.PLACES):
                        want[x, place[ids[j], k]] += sign[ids[j], k]
    assert np.array_equal(total.reshape(want.shape), want)


def test_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-x[:, 0] * 2))).astype(float)
    net = qc.Network(x, y, np.arange(4000) % 5 > 0)
    p = net.score(x)
    assert abs(p.mean() - y.mean()) < 0.03
    for lo in (0.0, 0.25, 0.5, 0.75):
        here = (p >= lo) & (p < lo + 0.25)
        assert abs(p[here].mean() - y[here].mean()) < 0.07


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in qc.classify(docs.withColumn("score", docs.doc_id), labels).collect()}
    assert len(out) == docs.count()
    pairs = [(out[r.doc_id].score, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    good, bad = ([s for s, q in pairs if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in qc.classify(docs, none).collect()] == [0.5] * 4
    some = spark.createDataFrame([(2, 1), (2, None), (None, 0), (1, 0), (3, 1)], "doc_id long, quality int")
    assert len(qc.classify(docs, some).collect()) == 4
    assert qc.classify(docs.limit(0), some).count() == 0
