import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from topspin.llm import quality


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        text = " ".join(words) if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:5] for _ in range(9))])
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_defined_results(spark):
    docs, labels = corpus()
    docs += [(1000, None, None, None), (1001, "", "x", 0.0), (None, "some text", "x", 0.0), (0, docs[0][1], "again", 0.0)]
    labels += [(1, 7, 0), (None, 1, 0), (2, labels[2][1], 1)]
    d, l = frames(spark, docs, labels)
    rows = quality.score(d, quality.train(d, l)).withColumn("held_out", quality.held_out("doc_id")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {i: q for i, q, _ in labels[:600]}
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    empty = {r.score for r in rows if r.doc_id in (1000, 1001)}
    assert len(empty) == 1


def test_held_out_labels_and_other_columns_play_no_part(spark):
    docs, labels = corpus(200)
    d, l = frames(spark, docs, labels)
    turned = l.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = d.withColumn("lang", F.lit("zz")).withColumn("score", F.lit(9.0))
    assert quality.train(d, l) == quality.train(other, turned)
    assert quality.train(d, l, fit_rows=50) != quality.train(d, l)


def test_ratios_come_from_all_labelled_rows(spark):
    docs, labels = corpus(300)
    texts = {i: t for i, t, _, _ in docs}

    def feature(trigram):
        h = sum(ord(c) * m for c, m in zip(trigram, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=True)) % (1 << 32)
        return ((h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)) >> (32 - quality.BITS)

    plain = np.zeros((2, quality.FEATURES), np.int64)
    for i, good, _ in labels:
        padded = f"\0{texts[i]}\0"
        for at in {feature(padded[k : k + 3]) for k in range(len(padded) - 2)}:
            plain[good, at] += 1
    found = quality.class_counts(spark.createDataFrame([(texts[i], good) for i, good, _ in labels] + [(None, 1)], "text string, good int").repartition(7))
    assert (found == plain).all()
    # a row that isn't fitted still counts
    d, l = frames(spark, docs, labels)
    last = spark.range(5000, 5400).where(~quality.held_out("id")).orderBy(F.xxhash64("id").desc()).first().id
    more = frames(spark, docs + [(last, "zq zq", "x", 0.0)], labels + [(last, 0, 0)])
    assert quality.train(*more, fit_rows=40) != quality.train(d, l, fit_rows=40)
    assert quality.train(d.repartition(5), l, fit_rows=40) == quality.train(d, l, fit_rows=40)


def test_without_labels_or_with_one_class(spark):
    docs, labels = corpus(30)
    d, l = frames(spark, docs, labels)
    none = quality.score(d, quality.train(d, l.limit(0))).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    one = quality.score(d, quality.train(d, l.withColumn("quality", F.lit(1)))).collect()
    assert min(r.score for r in one) > 0.5
    assert quality.score(d.limit(0), quality.train(d.limit(0), l)).count() == 0


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=60))
    rows, costs = [np.arange(5)] * 60, np.full(60, 1.0)
    w = quality.dual_coordinate_descent(rows, list(x), y, costs, 5, rounds=2000)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + 0.05 * rng.normal(size=5)) + 1e-6 for _ in range(500))


def test_very_long_texts_count_whole(spark):
    docs, labels = corpus(150)
    long = " ".join(docs[0][1] for _ in range(2000))
    junk = "zz|" * 300_000
    d, l = frames(spark, [*docs, (900, long, "x", 0.0), (901, junk, "x", 0.0), (902, docs[0][1], "x", 0.0)], [*labels, (901, 0, 0)])
    model = quality.train(d, l)
    found = {r.doc_id: r for r in quality.score(d, model).where("doc_id >= 900").collect()}
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].predicted == found[902].predicted and len(found[900].text) == len(long)
    assert model.scores([long + " " + junk])[0] != model.scores([long])[0]  # the end is seen, too
