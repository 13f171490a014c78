import pandas as pd

from weftgraph.llm import toxicity


def test_toxic_texts_without_a_listed_word_are_found(spark):
    """Held-out recall on toxic documents that hold no word of the fixed lexicon."""
    sf = "/root/testdata/sf0.1"
    df = toxicity.op4_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]], on="doc_id")
    held = df[df.held_out & df.toxic.notna()]
    unlisted = held[[not any(toxicity.events(t)) for t in held.text]]
    assert unlisted[unlisted.toxic == 1].predicted.mean() > 0.5 and unlisted[unlisted.toxic == 0].predicted.mean() < 0.01
    assert held[held.predicted == 1].toxic.mean() > 0.95


def test_learned_words_pass_the_same_transducers():
    learned = {"zorg": "S", "blim": "W"}
    for text, kinds in [("what a zorgling", "S"), ("you zorgling", "X"), ("not zorgling", "n"), ("he said zorg", "r"), ("a blimp", "W"), ("your blimp. zor", "V")]:
        assert toxicity.events(text, learned) == [kinds.count(k) for k in toxicity.KINDS]
    assert not any(toxicity.events("you zorgling"))


def test_many_clauses_count_for_more_than_three(spark):
    assert toxicity.events("you idiot. " * 300)[toxicity.KINDS.index("J")] == 300
    rows = [(i, "plain words here" if i % 2 else "you idiot. " * (1 + i % 5)) for i in range(200)] + [(1001, "you idiot. " * 3), (1002, "you idiot. " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2 if i % 5 else 0) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert got[1002] > got[1001] > got[1]
