import random

import corpus_pipeline
from weftgraph.llm import shingles
from weftgraph.llm._base import cut, table


def brute(rows):
    """The ids to keep: the least of each group of all pairs with a Jaccard similarity of 0.8 or more on five-word shingles."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").encode().lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) * 10 >= 8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.single(spark, docs, "").collect())


def test_stage_drops_near_copies_of_the_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert kept(spark, rows) == brute(rows)


def test_stage_against_brute_force_near_the_bound(spark, monkeypatch):
    r = random.Random(5)
    vocab, rows = [f"w{i}" for i in range(400)], [(0, None), (1, ""), (2, "Two words"), (3, "two  WORDS"), (4, "two words more")]
    line = [r.choice(vocab) for _ in range(12)]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randrange(10, 120))]
        for _ in range(12):
            w = base + line if r.random() < 0.5 else list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
            base = w if r.random() < 0.3 else base
    want = brute(rows)
    assert 20 < len(want) < len(rows) - 20 and kept(spark, rows) == want
    monkeypatch.setattr(shingles, "COMMON", 0)  # the order decides the work, not the result
    assert kept(spark, rows) == want


def linked(spark, rows, similarity=0.8):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = shingles.sets(docs, ["doc_id"], 5, similarity).withColumnRenamed("doc_id", "_least")
    return shingles.links(cut(found.dropDuplicates(["_fp"])), docs, 5, similarity)


def test_links_of_a_large_group_stay_in_proportion(spark):
    """Near copies of one text meet as stars, not as all pairs."""
    base = [f"w{i}" for i in range(100)]
    assert 299 <= linked(spark, [(i, " ".join([f"x{i}", *base])) for i in range(300)]).count() <= 2 * 300


def test_keys_of_many_rows_are_split_without_loss(spark, monkeypatch):
    """Texts that share a common passage, some of them near copies: the same groups when every key may be split."""
    r = random.Random(9)
    vocab, passage = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(40)]
    rows = []
    for _ in range(40):
        own = [r.choice(vocab) for _ in range(8)]
        for _ in range(3):
            w = passage + own
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    want = brute(rows)
    assert 1 < len(want) < len(rows)
    for split, common in ((1, 0), (1, 1000), (10**6, 0)):
        monkeypatch.setattr(shingles, "SPLIT", split)
        monkeypatch.setattr(shingles, "COMMON", common)
        assert kept(spark, rows) == want


def test_hashes_follow_words_and_pieces(monkeypatch):
    texts = [None, b"", b" \t\n", b"One two", b"one  TWO", b"a b c d e f", "ä Ä é\u00a0x y z".encode(), b"x " * 500, b"a b c d e f a b c d e"]
    whole = shingles.hashes(texts, 5)
    assert [len(h) for h in whole] == [0, 0, 0, 1, 1, 2, 1, 1, 6]
    assert (whole[3] == whole[4]).all() and set(whole[5]) < set(whole[8])
    for size in (1, 7, 64):
        monkeypatch.setattr(shingles, "_PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, shingles.hashes(texts, 5)))
