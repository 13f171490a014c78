import random

import corpus_pipeline
import pytest
from weftgraph.llm import shingles, simhash

from tests.llm.test_multi_index import near, signed
from tests.llm.test_near_copies import brute


def flipped(r, x, n):
    return x ^ sum(1 << b for b in r.sample(range(64), n))


def found(spark, prints, **how):
    df = spark.createDataFrame([(signed(p),) for p in prints], "_fp long")
    return [(p.a, p.b) for p in simhash.closest(df, **how).collect()]


@pytest.mark.parametrize("segments,reach", [(4, 11), (3, 8), (4, 3), (2, 3)])
def test_all_pairs_within_reach_meet(spark, segments, reach):
    """Scattered pairs at the reach and one bit beyond it, in batches that end within a bucket."""
    r = random.Random(segments * reach)
    prints = {0, 2**64 - 1, (1 << 63) | 1}
    for i in range(200):
        x = r.getrandbits(64)
        prints |= {x, flipped(r, x, reach + i % 2)}
    want = {tuple(sorted(map(signed, p))) for p in near(sorted(prints), reach)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = found(spark, sorted(prints), segments=segments, reach=reach)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 100


def test_a_dense_group_makes_few_pairs(spark):
    """Each row of a bucket goes with the closest one before it: a group hangs together without all of its pairs."""
    r = random.Random(3)
    x = r.getrandbits(64)
    prints = sorted({flipped(r, x, r.randrange(1, 4)) for _ in range(400)})
    for rows in (4096, 5):
        got = found(spark, prints, rows=rows)
        root = {signed(p): signed(p) for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in got:
            root[find(a)] = find(b)
        assert len({find(p) for p in root}) == 1 and len(got) < 20 * len(prints)


def test_stage_joins_what_its_fingerprints_reach_by_them(spark, monkeypatch):
    """Without the exact pass the stage still joins every near copy whose fingerprint is within reach, and nothing else."""
    r = random.Random(6)
    vocab, rows = [f"w{i}" for i in range(500)], []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randrange(60, 150))]
        copy = list(base)
        copy[r.randrange(len(copy))] = "new"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
        if r.random() < 0.5:  # alike, but less than 0.8
            rows.append((len(rows), " ".join(base[: len(base) * 2 // 3])))
    want = brute(rows)
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(d.doc_id for d in corpus_pipeline.single(spark, docs, "").collect()) == want
    met = shingles._met
    monkeypatch.setattr(shingles, "_met", lambda entries: met(entries.where("false")))
    kept = {d.doc_id for d in corpus_pipeline.single(spark, docs, "").collect()}
    dropped = {i for i, _ in rows} - set(want)
    assert dropped - kept == {i for i in dropped if (prints[i] ^ prints[i - 1]).bit_count() <= 11}
    assert set(want) <= kept and len(dropped & kept) < len(dropped) / 10
