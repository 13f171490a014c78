import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import _graph, chat, embdedup, langid, mixing, pieces, pii, quality, queries, simhash, topk, toxicity
from weftgraph.llm._base import cut, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _fp string, _x string, score string"


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "a", "b", "c", "d") for i, t, lang, src in rows], DOCS)


HARD = [(1, "", "en", "a"), (2, None, "en", None), (3, "word " * 30000, "en", "a"), (4, "Same text here now", "en", "b"), (5, "Same text here now", None, "b"), (5, "Same text here now", "en", "b"), (None, "Same text here now", "en", "b"), (6, "éà 日本 🙂 ñ", "fr", None), (7, " \t\n ", None, "c"), (8, "1234 --- !!", "de", "c")]


@pytest.fixture(scope="module")
def hard(spark):
    return cut(docs_of(spark, HARD))


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (6, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456789, -7)], "doc_id long").withColumn("h", held_out("doc_id", 5, 0))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out("doc_id", 5, 0).alias("h")).first().h is True


def test_sql_of_queries(spark, sf_dir):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist())), name


# 1
def test_chat_escape_round_trip(spark):
    texts = ["\\", "<|end|>", "\\<|end|>\\\\", "[/INST][INST]<s></s><<SYS>><</SYS>>", "<|text|>" * 3, "", "a\nb", "<|start|>assistant<|text|>x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.t == r.u and not re.search(r"<\|(start|text|end)\|>|\[/?INST\]|</?s>", r.e)


def test_chat_best_branch_of_a_tree(spark):
    nodes = spark.createDataFrame([("a", 1, None, 1.0), ("a", 2, 1, 1.0), ("a", 3, 1, 5.0), ("a", 4, 3, -9.0), ("a", 5, 2, 0.5), ("b", 1, 99, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)], "conv string, node long, parent long, score double")
    got = sorted(tuple(r) for r in chat.paths(nodes, 2).select("conv", "rank", "node", "up").collect())
    assert got == [("a", 1, 1, 2), ("a", 1, 2, 1), ("a", 1, 5, 0), ("a", 2, 1, 2), ("a", 2, 3, 1), ("a", 2, 4, 0), ("b", 1, 1, 0)]


def test_chat_long_thread(spark):
    n = 100
    nodes = spark.createDataFrame([("a", i, i - 1 if i else None, 1.0) for i in range(n)], "conv string, node long, parent long, score double")
    assert sorted(r.up for r in chat.paths(nodes).collect()) == list(range(n))


def test_chat_nulls_and_empty(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a</s>"), (1, 1, "assistant", "a</s>"), (None, 0, None, "x"), (2, None, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, None, 2, -7}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\n" + "assistant\na</s>\n" * 2), 10, sha("a</s>a</s>"))
    assert (got[None].n_turns, got[None].turns_sha256) == (1, sha("\nx\n"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, sha(""))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "e" / "conversations.parquet"))
    assert [r.conv_id for r in chat.op1_chat_formatting(spark, str(tmp_path / "e")).collect()] == [-7]


# 2
def brute_top(ids, z, k=5):
    out = set()
    for i, q in zip(ids, z):
        if i is not None and i % 50 == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in zip(ids, z) if j is not None and j != i and len(c) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e8])
def test_top_k_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    z = np.floor(rng.standard_normal((400, 6)) * scale * rng.choice([0.1, 1, 10], (400, 1)))
    z[50:120] = z[50]  # ties
    z[200] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(z)], "vec_id long, z array<double>")
    got = topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0, bucket_rows=64, query_rows=3)
    assert set(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(list(range(400)), z.tolist())


def test_top_k_hard_rows(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0]), (None, [1.0, 1.0]), (50, []), (7, [3e38, 3e38]), (100, [-1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = set(map(tuple, topk.op2_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert {g for g in got if g[0] == 0} == {(0, 1, 7, 2**63 - 1), (0, 2, 5, 256 * 128 + 512 * 128), (0, 3, 5, 256 * 128 + 512 * 128), (0, 4, 100, -65536)}
    assert not {g for g in got if g[0] == 50}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e" / "embeddings.parquet"))
    assert topk.op2_exact_top_k(spark, str(tmp_path / "e")).count() == 0


def test_coordinate_pruning_finds_what_length_pruning_finds():
    rng = np.random.default_rng(0)
    c = np.floor(rng.standard_normal((500, 8)) * 100)
    c[:40] = np.floor(c[0] + rng.standard_normal((40, 8)) * 3)
    q, ids = c[:20], np.arange(500)
    floor = np.sort(q @ c.T, axis=1)[:, -6]
    a = search_sorted(topk.search_bucket(q, ids[:20], floor, c, ids, 5))
    high, topk.HIGH = topk.HIGH, 9.0
    b = search_sorted(topk.search_bucket(q, ids[:20], floor, c, ids, 5))
    topk.HIGH = high
    assert a == b and len(a) == 100


def search_sorted(x):
    return sorted(zip(*(v.tolist() for v in x)))


# 3
@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


def test_pieces_same_ids_as_sentencepiece(model):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    c = pieces.Codec(model, 1)
    r = random.Random(1)
    texts = ["".join(r.choice("ab ▁\n\té日🙂\u0000<s>0x") for _ in range(r.randrange(200))) for _ in range(200)] + ["a" + " " * k + "b" for k in range(40)] + pieces.PROBES
    assert c.encode(texts) == whole.encode(texts, num_threads=1)
    plain = [t for t in texts if "▁" not in t]
    assert c.decode(c.encode(plain)) == plain


def test_pieces_unigram_model_built_by_hand():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.normalizer_spec.name = "identity"
    for p, s, t in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -2.0, 1), ("▁he", -3.0, 1), ("llo", -4.0, 1), ("h", -5.0, 1), ("e", -5.1, 1), ("l", -5.2, 1), ("o", -5.3, 1), ("▁hello", -9.5, 1)]:
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, t
    data = m.SerializeToString()
    texts = ["hello", "hell o", "oh hello", "", "zz hello"]
    c = pieces.Codec(data, 1)
    assert c.encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts, num_threads=1)
    assert c.decode(c.encode(texts)) == texts


def test_pieces_hard_rows(hard, none):
    got = pieces.encode(hard, ["doc_id"]).collect()
    assert len(got) == len(HARD) and all(r.round_trip for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert pieces.encode(none, ["doc_id"]).count() == 0


# 4
@pytest.mark.parametrize("text,kinds", [("you are an idiot.", "J"), ("what an idiot", "I"), ("not an idiot", "n"), ("he said idiot", "r"), ('"idiot" once', "r"), ("I will kill you", "T"), ("they kill", "U"), ("idiot. not. scum", "II"), ("Stupid$$$ thing", "I"), ("nothing here", ""), ("he said hi. idiot", "I")])
def test_toxic_clauses(text, kinds):
    got = toxicity.events(text)
    assert got == [kinds.count(k) for k in toxicity.KINDS]


def test_composed_machine_equals_its_parts():
    r = random.Random(0)
    for _ in range(200):
        s = "".join(r.choice(toxicity.SYMBOLS) for _ in range(12))
        one = s
        for f in (toxicity._negation, toxicity._report, toxicity._target):
            state, out = 0, ""
            for c in one:
                state, o = f(state, c)
                out += o
            one = out
        state, whole = 0, ""
        for c in s:
            whole += toxicity.OUT[state, c]
            state = toxicity.GO[state, c]
        assert whole == one


def test_toxicity_held_out_and_hard_rows(spark, hard, none, labels):
    df = toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = df[df.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and held[held.predicted == 1].toxic.mean() > 0.95
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3
    got = toxicity.score(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.score(none, labels).count() == 0
    assert all(r.score == 0.5 for r in toxicity.score(hard, labels.limit(0)).collect())


# 5
def brute_spans(t):
    digits = pii._digits
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]


def test_pii_base_spans_against_plain_patterns():
    r = random.Random(2)
    for alphabet in ("a@.-1+ ", "12.5 -+()", "0123456789. -", "ab1.@%é"):
        for _ in range(1500):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("x 4929348385146306 y 10.0.0.300") == [(2, 2, 18)]


def test_pii_added_spans():
    fitted = pii.model()
    found = lambda t: pii._join(pii.all_spans(t, fitted)[1])
    assert found("mail john (at) acme (dot) com now") == "email:5:29"
    assert found("call (212) 555-1234 please") == "phone:5:19"
    assert found("on 2020-01-15 we met, pages 12-34, version 1.2.3, 978-3-16-148410-0") == ""
    base, every = pii.all_spans("a@b.co and 10[.]0[.]0[.]1", fitted)
    assert base == [(0, 0, 6)] and every == [(0, 0, 6), (1, 11, 25)]


def test_pii_long_runs_stay_fast():
    import time

    began = time.time()
    pii.all_spans("a" * 10**6 + "1" * 10**5 + "@" * 10**4 + "+1" * 10**4 + "1.1." * 10**4, pii.model())
    assert time.time() - began < 20


def test_pii_rows_and_redaction(spark, hard, none):
    got = {r.doc_id: r for r in pii.find(docs_of(spark, [(1, None, None, None), (2, "a@b.co +1 (212) 555-1234 x 4929348385146306", None, None)]), ["doc_id"]).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1].base_sha256, got[1].spans, got[1].n_email) == (empty, "", 0)
    assert got[2].spans == "email:0:6,card:27:43,phone:7:24" and got[2].base_sha256 == hashlib.sha256(got[2].spans.encode()).hexdigest()
    out = pii.redact(docs_of(spark, [(2, "é a@b.co, 4929348385146306.", "en", "s")])).first()
    assert (out.text, out.n_chars, out._id) == ("é [EMAIL], [CARD].", 18, "a")
    assert pii.find(hard, ["doc_id"]).count() == len(HARD) and pii.redact(none).count() == 0


# 6
def highest_quotients(weights, seats, most):
    n = [0] * len(weights)
    for _ in range(seats):
        q = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, n)) if k < most[i]]
        if not q:
            break
        n[min(q)[1]] += 1
    return n


def test_apportionment_against_one_seat_at_a_time(spark):
    r = random.Random(5)
    cases = [[r.choice([0, 1, 3, 10, 50, 333, r.randrange(1, 2000)]) for _ in range(r.randrange(1, 12))] for _ in range(40)]
    rows, want = [], {}
    for g, w in enumerate(cases):
        if not sum(w):
            w[0] = 1
        seats = r.randrange(1, 60)
        rows += [(g, i, float(x), seats, 10**6) for i, x in enumerate(w)]
        want |= {(g, i): q for i, q in enumerate(highest_quotients(w, seats, [10**6] * len(w)))}
    df = spark.createDataFrame(rows, "g int, k int, w double, seats long, most long")
    assert {(x.g, x.k): x.quota for x in mixing.apportion(df, ["g"], "k", "w", "seats", "most").collect()} == want


def targets_by_rounds(sizes, weights, most=3):
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, f in zip(sizes, full) if f)
        w = sum(x for x, f in zip(weights, full) if not f)
        t = [most * s if f else rest * x / w for s, x, f in zip(sizes, weights, full)]
        over = [not f and a > most * s + 1e-9 for a, s, f in zip(t, sizes, full)]
        if not any(over):
            return t
        full = [f or o for f, o in zip(full, over)]


def test_mix_targets_limits_and_repeat(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 400]), "en", f"s{r.choice([0] * 8 + list(range(1, 9)))}" if i % 40 else None) for i in range(600)]
    df = docs_of(spark, rows)
    a = mixing.mix(mixing.sizes(df)).toPandas()
    b = mixing.mix(mixing.sizes(df.repartition(7))).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert a[key].sort_values("doc_id").values.tolist() == b[key].sort_values("doc_id").values.tolist()
    assert (a.taken <= 3 * a["size"]).all() and (a.taken >= 0).all() and (a["size"] == [len(rows[i][1].split()) for i in a.doc_id]).all()
    g = a.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    want = targets_by_rounds(g["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(g))])
    assert np.allclose(g.target, want) and (abs(g.taken - g.target) <= np.maximum(3, 0.02 * g.target)).all()


def test_mix_hard_rows(hard, none):
    got = mixing.mix(mixing.sizes(hard)).toPandas()
    assert len(got) == len(HARD) and (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(mixing.sizes(none)).count() == 0
    whole = mixing.mix_documents(hard)
    assert whole.columns == hard.columns and set(r.text for r in whole.collect()) <= {t for _, t, _, _ in HARD}


# 7
def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[:120] = x[0] + rng.standard_normal((120, 16)) * 0.28  # around the threshold
    x[130:140] = x[130]
    label = [i % 2 for i in range(300)]
    rows = [(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x.astype(np.float32), label))]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, rows[0][1], None), (1004, rows[0][1][:8], 0), (1005, [None] * 16, 0), (130, rows[130][1], 0)]
    got = embdedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("root", F.lit("x")), block_bytes=40 * 8 * 16).toPandas()
    ok = [i for i in range(len(rows)) if i < 300 or i == len(rows) - 1]
    u = np.array([np.array(rows[i][1], dtype=np.float32).astype(float) for i in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([rows[i][2] for i in ok])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    root = np.array([rows[i][0] for i in ok])
    while True:
        new = np.array([min([root[i], *root[link[i]]]) for i in range(len(ok))])
        if (new == root).all():
            break
        root = new
    want = sorted((rows[i][0], int(n), int(c)) for i, n, c in zip(ok, link.sum(1), root))
    alone = [(i, 0, i) for i in (1000, 1001, 1002, 1003, 1004, 1005)]
    assert sorted(map(tuple, got[["vec_id", "n_links", "component_id"]].values.tolist())) == sorted(want + alone)
    assert (got.kept == (got.vec_id == got.component_id)).all() and link.sum() > 100


def test_embedding_code_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 24))
    x[100:] = x[:100] + rng.standard_normal((100, 24)) * rng.uniform(0, 1, (100, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned, bits, factor = embdedup.codes(x)
    assert (embdedup.upper(turned @ bits.T, factor[None, :], 24) >= x @ x.T - 1e-6).all()
    # The estimate is unbiased: over many rotations its mean is the cosine.
    a, b = x[0], x[100]
    est = []
    for seed in range(400):
        p = embdedup.rotation(24, seed + 50)
        code = np.sign(p @ b) / np.sqrt(24)
        est.append((p @ a) @ code / ((p @ b) @ code))
    assert abs(np.mean(est) - a @ b) < 4 * np.std(est) / 20


def test_embedding_empty(spark):
    assert embdedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 8
def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints(spark, hard):
    got = simhash.near_groups(hard).collect()
    assert len(got) == len(HARD)
    for r in got:
        texts = {plain_fingerprint(t) for i, t, _, _ in HARD if i == r.doc_id}
        assert int(r.fingerprint, 16) in texts
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[7] == 1 and by[5] == 4 == by[None] and by[3] == 3
    one = spark.createDataFrame([("the quick brown",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert simhash.fingerprint(b"The Quick  brown") == one % 2**64


def test_simhash_links_against_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:20]:
        for _ in range(8):
            x = b
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
            b = x if r.random() < 0.5 else b
    prints = sorted(prints)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame(list(zip(range(len(prints)), signed)), "doc_id long, _fp long")
    got = {r._fp: r.component_id for r in simhash.groups(df).collect()}
    assert got == {s: find(i) for i, s in enumerate(signed)} and len(set(got.values())) < len(prints)


def test_simhash_entries_stay_small(spark):
    """A group of near copies makes 65 entries a fingerprint, not pairs."""
    df = spark.createDataFrame([((i << 40) | (1 << (i % 40)),) for i in range(500)], "_fp long").distinct()
    assert simhash.links(df).count() <= 65 * df.count()


def test_simhash_keep_one(spark, hard, none):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8]
    assert simhash.keep_one(none).count() == 0 and simhash.near_groups(none).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(7000, 7000)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


# 9
def test_quality_held_out_and_hard_rows(spark, hard, none, labels):
    df = quality.op9_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = df[df.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and df.score.between(0, 1).all()
    got = quality.classify(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(none, labels).count() == 0 and quality.classify(hard, labels.limit(0)).count() == len(HARD)
    assert quality.keep_good(hard, labels).columns == hard.columns


def test_quality_density_is_the_gaussian_one():
    rng = np.random.default_rng(0)
    x = {c: rng.standard_normal((500, quality.P)) * (1 + c) + c for c in (0, 1)}
    z = {c: np.hstack([np.ones((500, 1)), v]) for c, v in x.items()}
    m = quality.Model({c: v.T @ v for c, v in z.items()}, 0.0, 0.0)
    p = np.vstack([x[0][:5], x[1][:5]])
    dens = []
    for c in (0, 1):
        s = np.cov(x[c].T, bias=True) + 1e-4 * np.eye(quality.P)
        d = p - x[c].mean(0)
        dens.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d @ np.linalg.inv(s) * d).sum(1) + math.log(0.5))
    assert np.allclose(m.difference(p), np.clip(dens[1] - dens[0], -60, 60))


# 10
def test_language_held_out_and_hard_rows(spark, hard, none):
    df = langid.op10_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (df[df.held_out].lang_pred == df[df.held_out].lang).mean() > 0.98
    got = langid.identify(hard).collect()
    assert len(got) == len(HARD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 7, 8))
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_do_not_depend_on_pieces():
    text = "Größe, naïve 😀 ǅ words " * 50
    whole = sorted(h for _, h, _, _ in langid._buckets([text]) for h in h.tolist())
    size, langid._PIECE = langid._PIECE, 37
    parts = sorted(h for _, h, _, _ in langid._buckets([text]) for h in h.tolist())
    langid._PIECE = size
    assert whole == parts
