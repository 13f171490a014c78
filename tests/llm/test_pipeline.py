import corpus_pipeline
from weftgraph.llm import mixing, pieces, pii, quality
from weftgraph.llm._base import cut, table

from tests.llm.test_near_copies import brute


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "pii", "mixing", "sentencepiece"]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    good, single, clean, mixed, ids = (d.toPandas() for d in kept)
    whole = table(spark, sf_dir, "documents").toPandas().set_index("doc_id")
    scores = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).toPandas()
    assert set(good.doc_id) == set(scores[scores.predicted == 1].doc_id)
    rows = [(r.doc_id, r.text) for r in kept[0].select("doc_id", "text").collect()]
    assert sorted(single.doc_id) == brute(rows) and len(single) < len(good)
    fitted = pii.model()
    assert {r.doc_id: r.text for r in clean.itertuples()} == {i: pii._redacted(whole.text[i], fitted) for i in single.doc_id}
    assert not any(pii.base_spans(t) for t in clean.text)
    times = mixing.mix(mixing.sizes(kept[2])).toPandas()
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in times.itertuples() if r.size}
    assert mixed.doc_id.value_counts().to_dict() == {i: n for i, n in want.items() if n}
    assert len(ids) == len(mixed) and ids.round_trip.all()
    with open(pieces.default_model(), "rb") as f:
        c = pieces.Codec(f.read(), 1)
    by = dict(zip(clean.doc_id, clean.text))
    assert all(list(r.ids) == c.encode([by[r.doc_id]])[0] for r in ids.head(30).itertuples())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and out.count() > 0


def stages(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_stages_on_hard_rows(spark, sf_dir):
    """Null ids and texts, repeated and long rows, extra columns with the names operators use inside: each has its result."""
    good = [r.text for r in cut(corpus_pipeline.good(spark, table(spark, sf_dir, "documents"), sf_dir)).limit(40).collect()]
    rows = [(i, t, "x") for i, t in enumerate(good)] + [(None, good[0], "x"), (None, None, None), (3, good[3], "x"), (3, good[4], None), (1000, None, "y"), (1001, "", "y"), (1002, " ".join(good) * 3, None), (1003, good[5] + " mail me a@b.co", "x")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, _fp string, _id string, size string, shard string, score string, _n string, key string"
    docs = spark.createDataFrame([(i, t, s, "en", None, *"abcdefg") for i, t, s in rows], schema)
    for d in stages(spark, docs, sf_dir)[:-1]:
        assert d.columns == docs.columns and all(tuple(r)[5:] == tuple("abcdefg") for r in d.collect())
    single = corpus_pipeline.single(spark, docs, sf_dir).toPandas()
    wanted = brute([(i, t) for i, t, _ in rows if i is not None])
    assert sorted(single.doc_id.dropna().astype(int).unique()) == sorted(set(wanted))
    private = corpus_pipeline.private(spark, docs, sf_dir)
    assert private.count() == len(rows) and not private.where("text like '%a@b.co%'").count() and private.where("text is null").count() == 2
    ids = corpus_pipeline.encoded(spark, docs, sf_dir).toPandas()
    assert len(ids) == len(rows) and (ids.n_tokens == ids.ids.map(len)).all()


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    out = stages(spark, docs, sf_dir)
    assert all(d.isEmpty() for d in out) and all(d.columns == docs.columns for d in out[:-1])
