import random

import pytest

from weftgraph.llm import simhash


def prints():
    """Scattered fingerprints with neighbours, and a dense ball whose members agree in whole segments."""
    r = random.Random(4)
    out = {0, 2**64 - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(6):
            out.add(x)
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
    centre = r.getrandbits(64)
    for _ in range(60):
        out.add(centre ^ sum(1 << b for b in r.sample(range(40, 64), 3)))
    return sorted(out)


def near(found, reach):
    return {(a, b) for i, b in enumerate(found) for a in found[:i] if (a ^ b).bit_count() <= reach}


def signed(p):
    return p - 2**64 if p >> 63 else p


@pytest.mark.parametrize("segments,reach,bucket", [(2, 2, 64), (3, 2, 64), (4, 2, 3), (3, 2, 2), (2, 3, 4)])
def test_links_are_all_pairs_within_reach(spark, segments, reach, bucket):
    found = prints()
    df = spark.createDataFrame([(signed(p),) for p in found], "_fp long")
    want = {tuple(sorted(map(signed, p))) for p in near(found, reach)}
    got = [(r.a, r.b) for r in simhash.links(df, segments, reach, bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_segments_change_the_keys():
    two, three, four = (simhash.keys(m, 2) for m in (2, 3, 4))
    assert [len(bits) for bits, _ in two] == [32, 32] and all(len(ball) == 33 for _, ball in two)
    assert [len(bits) for bits, _ in three] == [21, 21, 22] and all(len(ball) == 1 for _, ball in three)
    assert [len(bits) for bits, _ in four] == [16] * 4
    assert all(sorted(b for bits, _ in k for b in bits) == list(range(64)) for k in (two, three, four))


def test_a_full_bucket_is_split(spark):
    """Fingerprints with one common segment and nothing else in common are not paired."""
    r = random.Random(8)
    df = spark.createDataFrame([(signed((r.getrandbits(43) << 21) | 5),) for _ in range(400)] + [(5,), (7,)], "_fp long").distinct()
    assert [(r.a, r.b) for r in simhash.links(df, bucket=16).collect()] == [(5, 7)]
