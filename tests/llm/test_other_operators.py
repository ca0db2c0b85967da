"""Operators on vectors and conversations, and the pipeline."""

import hashlib
import json

import numpy as np

from barloom.llm.chat import link_calls
from barloom.llm.embed_dedup import near_duplicate_vectors
from barloom.llm.topk import exact_top_k

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 6)) / 8
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    odd = [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + odd, "id long, vector array<float>")
    got = {tuple(r) for r in exact_top_k(table, table.where("id % 20 = 0"), k=7, block=16, group=3, chunk=5).collect()}
    q, want = np.floor(1024 * x).astype(int), set()
    for i in range(0, 400, 20):
        score = q @ q[i]
        best = [j for j in np.lexsort((np.arange(400), -score)) if j != i][:7]
        want |= {(i, n + 1, int(j), int(score[j])) for n, j in enumerate(best)}
    assert got == want
    assert exact_top_k(table.where("false"), table.where("false")).count() == 0
    assert exact_top_k(table.where("id < 3"), table.where("id = 0"), k=7).count() == 2
    same = spark.range(300).selectExpr("if(id % 3 = 0, 7L, id) as id", "array(1.0F, cast(id % 5 as float)) as vector")
    rows = exact_top_k(same, same.where("id in (7, 8)"), k=5, block=8, group=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.score) for r in rows] == [(q, n, (1 + 4 * w) << 20) for q, w in ((7, 0), (8, 3)) for n in range(1, 6)]
    assert [r.id for r in rows[5:]] == [4] + [7] * 4


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 10, (60, 3)) * 10.0 ** rng.integers(0, 5, (60, 3))
    x[10:20] = np.abs(rng.integers(1, 900, (10, 3))) * [0, 1, -1]
    x[6], x[7], x[8], x[9] = [0, 3.0e9 + 1, 1], [65536.0, 0, 0], [3.0e5, -(2.0**45), 1], [1e30, 0, 0]
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, vector array<double>")
    asked = range(10, 20)
    q = [[int(v) * 1024 for v in row] for row in x]
    score = {i: {j: sum(a * b for a, b in zip(q[i], q[j])) for j in range(60) if j != i} for i in asked}
    want = {(i, n + 1, j, score[i][j]) for i in asked for n, j in enumerate(sorted(score[i], key=lambda j: (-score[i][j], j))[:5])}
    got = {tuple(r) for r in exact_top_k(table, table.where(table.id.between(10, 19)), k=5, block=8, group=3, chunk=4).collect()}
    assert got == want


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows, vectors = [], {}
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * (0.02 if i >= 40 else 0)
        vectors[i] = np.float32(v).astype(float), i % 2
        rows.append((i, [float(a) for a in np.float32(v)], i % 2))
    rows += [(i + 1000, rows[i][1], rows[i][2]) for i in (0, 0, 1)][1:]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (None, rows[0][1], 0), (2004, [], 1)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows + odd, VECTORS)).collect()}
    vectors |= {1000: vectors[0], 1001: vectors[1]}
    found = total = 0
    for a, (x, label) in vectors.items():
        linked = [b for b, (y, other) in vectors.items() if a != b and label == other and x @ y / np.sqrt(x @ x * (y @ y)) >= 0.98]
        assert got[a].n_links <= len(linked) and got[a].component_id <= a and got[a].kept == (got[a].component_id == a)
        found, total = found + got[a].n_links, total + len(linked)
    assert found >= 0.97 * total > 0
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004)) and got[None].component_id is None
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "system", "be \"good\"\n", None, None, None, "x"),
        (1, 2, "tool", "early result", "k1", None, None, "x"),
        (1, 3, "assistant", None, "k1", "find", '{"q": "a", "n": 1.5, "deep": {"z": 1, "a": [true, null]}}', "x"),
        (1, 4, "assistant", "", "k1", "find", '{"n": "no"}', "x"),
        (1, 5, "assistant", "t", "k2", "other", "not json", "x"),
        (1, 6, "tool", "orphan", "k9", None, None, "x"),
        (1, 5000, "user", "late", None, None, None, "x"),
        (None, None, None, None, "k3", "find", "[1]", "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, line string")
    schemas = spark.createDataFrame([("find", "q", "string", True), ("find", "n", "number", False)], "tool string, param string, type string, required boolean")
    got = link_calls(table, schemas).orderBy("conv_id", "position").collect()
    own = [r for r in got if r.conv_id == 1]
    assert [(r.turn, r.position, r.link) for r in own] == [(0, 0, None), (3, 1, "answered"), (2, 2, "linked"), (4, 3, "repeated"), (5, 4, "open"), (6, 5, "orphan"), (5000, 6, None)]
    assert [r.errors for r in own if r.tool] == [["unknown deep"], ["type of n", "missing q"], ["unknown tool"]]
    assert [r.errors for r in got if r.conv_id is None] == [["not an object"]]
    lines = [json.loads(r.line_) for r in got]
    assert all(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.line_ for x, r in zip(lines, got))
    assert lines[2]["tool_call"]["arguments"] == {"deep": {"a": [True, None], "z": 1}, "n": 1.5, "q": "a"}
    assert link_calls(table.where("false"), schemas).count() == 0


def test_chat_with_null_turns(spark):
    rows = [
        (1, 4, "assistant", None, "k1", "find", "{}"), (1, None, "tool", "for k1", "k1", None, None), (1, -3000, "tool", "for k2", "k2", None, None),
        (1, None, "user", "calls k2", "k2", "find", "{}"), (2, None, "user", "calls k3", "k3", "find", "{}"), (2, None, "a tool", "for k3", "k3", None, None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string")
    schemas = spark.createDataFrame([("find", "q", "string", False)], "tool string, param string, type string, required boolean")
    got = [(r.conv_id, r.position, r.call_id, r.link) for r in link_calls(table, schemas).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, "k2", "answered"), (1, 1, "k2", "linked"), (1, 2, "k1", "answered"), (1, 3, "k1", "linked"), (2, 0, "k3", "answered"), (2, 1, "k3", "linked"),
    ]


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from barloom.llm.bpe import encoder
    from barloom.llm.quality import grade_texts, grades_of_labels

    from .test_text_operators import brute_components, words

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    quality, near, mixing, encoding = (stage for _, stage in corpus_pipeline.STAGES)
    graded = grade_texts(docs.select("doc_id", "text"), grades_of_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    good = quality(spark, docs.withColumn("selected", docs.doc_id.isNotNull()), sf).drop("selected").cache()
    assert ids(good) == ids(graded.where("selected")) and good.count() < docs.count()
    texts = {r.doc_id: r.text for r in good.collect()}
    kept = near(spark, good, sf).cache()
    assert ids(kept) == [i for i, (_, label) in sorted(brute_components(sorted(texts.items()), 5, 80, 100).items()) if i == label]
    rows = kept.collect()
    mixed = mixing(spark, kept, sf).cache()
    taken, size = set(ids(mixed)), {r.doc_id: len(words(r.text)) for r in rows}
    groups = {(r.lang, r.source) for r in rows}
    assert len(ids(mixed)) == len(taken) and sum(size[i] for i in taken) >= int(0.8 * sum(size.values()))
    for g in groups:  # a leaf takes a prefix of its order
        own = sorted((hashlib.md5(f"7:0:{r.doc_id}".encode()).hexdigest(), r.doc_id) for r in rows if (r.lang, r.source) == g)
        flags = [i in taken for _, i in own if size[i]]
        assert flags == sorted(flags, reverse=True)
    enc = encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)[0]
    out = {r.doc_id: r.n_tokens for r in encoding(spark, mixed, sf).collect()}
    assert out == {i: len(enc.encode_ordinary(texts[i] or "")) for i in taken}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and ids(after) <= ids(before) and after.count() > 0, name
        before = after
    out = corpus_pipeline.STAGES[3][1](spark, before, sf)
    assert ids(out) == ids(before) and out.columns[:2] == ["doc_id", "n_tokens"]
