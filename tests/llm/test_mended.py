"""Cases that went wrong once."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import langid, mixing, pii, topk


def test_top_k_takes_the_largest_doubles(spark, tmp_path):
    big = 1.7e308
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [0.5, 0.25]), (3, [-big, big]), (50, [1.0, 2.0]), (51, [0.0, 0.0])]
    spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op2_exact_top_k(spark, str(tmp_path)).collect()
    top = np.finfo(float).max
    z = {i: [int(np.floor(min(max(v * 256, -top), top))) for v in x] for i, x in rows}
    for q in (0, 50):
        cut = lambda s: max(-(2**63), min(2**63 - 1, s))
        want = sorted(((-cut(sum(a * b for a, b in zip(z[q], z[c]))), c) for c in z if c != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_personal_data_of_a_long_text_takes_time_in_proportion():
    fitted = pii.model()
    text = "a@b.co 12-34-56 write x (at) y (dot) com " * 30000
    base, spans = pii.all_spans(text, fitted)
    assert len([s for s in base if s[0] == 0]) == 30000 and len(spans) >= len(base)


def test_added_spans_are_chosen_as_by_all_comparisons():
    fitted = pii.model()
    trees, line, least = fitted
    r = random.Random(2)
    parts = ["a@b.co", "mail x (at) y (dot) com", "call (030) 555-1234", "1.2.3.4", "10[.]0[.]0[.]1", "4111.1111.1111.1111", "2020-01-02", "word", "tel 0049 30 123 4567", "at home dot com", "fe80::1:2:3:4"]
    for _ in range(60):
        text = " ".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        base = pii.base_spans(text)
        free = [c for c in pii.candidates(text) if not any(c[1] < b and a < c[2] for _, a, b in base)]
        added = []
        if free:
            p = pii.sigmoid(line[0] * trees.score(np.array([pii.describe(text, c) for c in free])) + line[1])
            for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i])):
                if p[i] >= least[free[i][0]] and not any(free[i][1] < d and c < free[i][2] for _, c, d in added):
                    added.append(free[i])
        assert pii.all_spans(text, fitted) == (base, sorted(base + added))


def test_rare_languages_are_learned(spark):
    rows = [(i, "the house and the garden are large", "en") for i in range(3000)] + [(9000 + i, "das haus und der garten sind schön", "de") for i in range(4)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert m.langs == ["de", "en"] and m.score(["der garten und das haus", "the garden"])[0] == ["de", "en"]


def test_mixing_comes_within_a_word_of_the_targets(spark, sf_dir):
    got = mixing.mix(mixing.sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.target - r.taken) <= 1 for r in got)
