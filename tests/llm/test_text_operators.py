"""Operators on documents against brute force, with nulls, empty and long texts, repeats and empty tables."""

import collections
import dataclasses
import hashlib
import math
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import ctw, huffman, ngram_join
from barloom.llm.bpe import bpe, encoder
from barloom.llm.mixing import mix, oracle as mixing_sql
from barloom.llm.ngram_join import Bands, ngram_jaccard_join
from barloom.llm.quality import Model, Sample, grade_texts
from barloom.llm.ring import ring_shards
from barloom.llm.shared import components, shared_dir

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join(make, odd_texts, k, num, den):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(odd_texts)
    for size in (6, 11, 30, 120, 400):
        base = list(rng.choice(vocabulary, size))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.integers(0, size, edits):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(make(texts).select("doc_id", "text"), words=k, num=num, den=den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_ngram_join_odd_tables(make):
    docs = make(["a b c d e f g", "a b c d e f g", "x y z u v w q", "a b c d e f g"], ids=[5, 3, 3, None]).withColumn("component_id", F.lit("mine"))
    got = {(r.doc_id, r.text): r.component_id_ for r in ngram_jaccard_join(docs).collect()}
    assert got[5, "a b c d e f g"] == got[3, "a b c d e f g"] == got[3, "x y z u v w q"] == 3 and got[None, "a b c d e f g"] is None
    assert ngram_jaccard_join(docs.where("false").select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("num", [80, 90, 50])
def test_segments_lose_no_link(num):
    """Any two sets within the bound share a key, whatever the allocation and whichever segments count as shared by many."""
    rng = np.random.default_rng(7)
    plain = Bands.make(num, 100, 2000)
    most = plain.most()
    for double, spare in ((0, 0), (2, 1), (1, 3), (0, 9)):
        bands = dataclasses.replace(plain, double=tuple(min(double, (h + 1 + spare) // 2) for h in most), spare=(spare,) * len(most))
        for _ in range(100):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 300)), dtype=np.uint64))
            other = set(a.tolist())
            for _ in range(int(rng.integers(0, len(a) * (100 - num) // 80 + 2))):
                if rng.random() < 0.5 and len(other) > 1:
                    other.discard(next(iter(other)))
                else:
                    other.add(int(rng.integers(0, 1 << 63)))
            b = np.array(sorted(other), np.uint64)
            edges, flat = np.array([0, len(a), len(a) + len(b)]), np.r_[a, b]
            every = np.sort(bands.keys(edges, flat, None)[1])
            often = every[rng.random(len(every)) < 0.5]
            row, keys = bands.keys(edges, flat, (often, rng.integers(0, 255, len(often))))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared) and shared != len(a) + len(b) - shared:
                assert np.intersect1d(keys[row == 0], keys[row == 1]).size, (len(a), len(b), double, spare)


def test_ngram_join_with_a_shared_passage(make, monkeypatch):
    """A passage that fills half of 2,000 different texts makes no candidates; the near copies among them are found."""
    compared = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (compared.append(pairs.count()), real(pairs, *rest))[1])
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 1 << 30, 30)), *passage, *(f"w{x}" for x in rng.integers(0, 1 << 30, 30))]) for _ in range(2000)]
    texts += [texts[i] + " end" for i in range(0, 2000, 100)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(make(texts).select("doc_id", "text")).collect()}
    assert got == {i: i if i < 2000 else (i - 2000) * 100 for i in range(len(texts))}
    assert sum(compared) < 2000


def test_pairs_that_share_many_keys_are_met_about_once(spark):
    """Of 40 near copies with most of 100 keys in common, and some that share one key only, no pair is lost and few come twice."""
    rng = np.random.default_rng(4)
    rows = [(int(k), i, i // 2) for i in range(40) for k in np.flatnonzero(rng.random(100) < 0.8)]
    rows += [(1000 + i, j, j // 2) for i in range(20) for j in (i, 100 + i)] + [(5000 + k, 200 + i, 200 + i) for i in range(2) for k in range(i, 60, 2 + i)]
    frame = spark.createDataFrame(rows, "key long, id long, comp long")
    marks = frame.select("id", F.lit(50).cast("long").alias("size"), *(F.lit(0).cast("long").alias(m) for m in ngram_join.MARKS)).distinct()
    got = [tuple(r) for r in ngram_join.met_pairs(frame, marks, 80, 100).select("a", "b").collect()]
    held = collections.defaultdict(dict)
    for k, i, comp in rows:
        held[k][i] = comp
    every = [(a, b) for ids in held.values() for a in ids for b in ids if a > b and ids[a] != ids[b]]
    assert set(got) == set(every) and len(every) > 50 * len(set(every))
    assert len(got) < 1.1 * len(set(every))


def test_ngram_join_writes_few_files(spark, make, monkeypatch):
    """Over 24 parts of documents, each table that the join writes is one small file, and the sets of shingles are in none."""
    tables = []
    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (tables.append((name, real(df, name))), tables[-1][1])[1])
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 60)) for _ in range(120)]
    docs = make(texts + [x + f" end{i}" for i, x in enumerate(texts)]).select("doc_id", "text").repartition(24)
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: i % 120 for i in range(240)}
    assert {name for name, _ in tables} >= {"signatures", "segments", "met", "links", "apart"} and "sets" not in {name for name, _ in tables}
    assert [name for name, table in tables if len(table.inputFiles()) > 1] == []


def test_verified_makes_the_sets_once(spark, make):
    """Both sides of a pair take their sets from one shuffle: each text is cut into shingles once."""
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "q r s t u v w x y z"]
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "a long, b long")
    out = ngram_join.verified(pairs, make(texts), 5, 80, 100)
    assert [tuple(r) for r in out.collect()] == [(1, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1, plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [None, ("HEAD", 3), ("HEAD_BYTES", 150), ("HEAD_BYTES", 0)])
def test_bpe(make, odd_texts, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(f"barloom.llm.bpe.{limit[0]}", limit[1])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = odd_texts + odd_texts[:6]
    ids = [*range(len(odd_texts)), None, 1, 2, 2, 3, 5]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in bpe(make(texts, ids), path, public_tokenizers.PATTERN, texts=True).collect())
    enc, want = encoder(path, public_tokenizers.PATTERN)[0], collections.Counter()
    for i, t in zip(ids, texts):
        own = enc.encode_ordinary(t or "")
        want[i, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), t or ""] += 1
    assert got == want
    assert bpe(make([]), path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, make, odd_texts, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    big = "many words in one long text, " * 14_000  # more ids than a block holds
    texts = [*odd_texts, big, "last"]
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    huffman.write_ids(make(texts), out, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.read_ids(spark, out).collect()}
    start, want = 0, {}
    for i, t in enumerate(texts):
        ids = huffman.tokenizer(path).encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    huffman.write_ids(make([]), out, path)
    assert huffman.read_ids(spark, out).count() == 0


def test_token_files_with_added_tokens(spark, make):
    path = public_tokenizers.path("word_bpe_49k.json")
    start, end = "<|startoftext|>", "<|endoftext|>"
    texts = [
        f"a {end} b", f"A{end}b", f"{start}{end}Don{start}'t", end.upper(), f"x{end.upper()}y {start.title()}", f"<{end}>", f" \t{start} \n", start,
        f"\u00e9{end}\u0301 {end}'s", "cut <|endof", "text|> short", "<|endof\ntext|>", f"<|{start}|>", "last",
    ]
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    huffman.write_ids(make(texts).coalesce(1), out, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.read_ids(spark, out).collect()}
    at, want = 0, {}
    for i, t in enumerate(texts):
        ids = huffman.tokenizer(path).encode(t, add_special_tokens=False).ids + [1]
        want[i] = at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert got == want


def test_pieces_are_encoded_many_at_a_time(odd_texts, monkeypatch):
    """Pieces go to the library joined, hundreds at a time, and each gets the ids that it has alone."""
    path, real, sent = public_tokenizers.path("word_bpe_49k.json"), huffman.tokenizer, []
    tok = real(path)

    class Counted:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **more)

    texts = [*odd_texts, "A<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> < <| |> 's x's 5's", *(f"word{i} z\u00e9{i}\u0301 <|{i}|>" for i in range(900))]
    monkeypatch.setattr(huffman, "tokenizer", lambda _: Counted())
    monkeypatch.setattr(huffman, "_known", {})
    ids, begins = huffman.encode_texts(pa.array(texts), path, 1)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == want
    assert len(sent) < len(huffman._known) / 100


def test_code_lengths_are_limited_and_optimal():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    counts = np.zeros(100, np.int64)
    counts[:30] = fibonacci
    limited, free = huffman.code_lengths(counts, 16), huffman.code_lengths(counts, 40)
    used = counts > 0
    for lengths, most in ((limited, 16), (free, 29)):
        assert lengths[used].max() <= most and math.isclose((2.0 ** -lengths[used].astype(float)).sum(), 1) and not lengths[~used].any()
    assert (limited * counts).sum() >= (free * counts).sum()
    assert huffman.code_lengths(np.array([0, 7]))[1] == 1


def test_scores(spark, make, odd_texts):
    texts = odd_texts + [f"the cat number {i} sat on the mat with the hat" for i in range(60)]
    got = {r.doc_id: r for r in ctw.score(make(texts)).collect()}
    train = collections.Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        own, r = [*words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(train[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9) and r.score < 0
    cats = [r for i, r in got.items() if i >= len(odd_texts) and r.held_out]
    assert cats and all(r.score > r.base_score for r in cats)
    grams = ctw.code_counts(make(texts)).where("kind = 0")
    most = {n: grams.groupBy(F.expr(f"(code >> 8) & {(1 << 8 * n) - 1}")).count().agg(F.max("count")).first()[0] for n in (2, 3)}
    assert most[3] < most[2]
    for split, base in ((most[2], 2), (most[2] - 1, 3), (most[3] - 1, 4)):  # groups by two bytes, by three, by four
        parts = {r.doc_id: r.score for r in ctw.score(make(texts), split=split).collect()}
        assert ctw.grouped(grams, split)[1] == base
        assert parts.keys() == got.keys() and all(abs(parts[i] - got[i].score) < 1e-8 for i in parts)
    assert ctw.score(make([])).count() == 0


def test_counts_dont_depend_on_what_tasks_keep(make, odd_texts, monkeypatch):
    texts = odd_texts + [f"the cat number {i} sat on the mat" for i in range(60)]
    count = lambda: sorted(map(tuple, ctw.code_counts(make(texts)).collect()))
    whole, real = count(), ctw.slices
    monkeypatch.setattr(ctw, "HELD", 40)
    monkeypatch.setattr(ctw, "slices", lambda batch, column, most: real(batch, column, 64))
    assert count() == whole


def test_scores_use_six_bytes_of_context(make):
    """Only the sixth byte before the digit tells which digit it is."""
    held = ctw.is_held_out(list(range(1000)))
    train, (right, wrong) = np.flatnonzero(~held)[:80].tolist(), np.flatnonzero(held)[:2].tolist()
    got = {r.doc_id: r.score for r in ctw.score(make(["a-----1", "b-----2"] * 40 + ["a-----1", "a-----2"], ids=[*train, right, wrong])).collect()}
    assert got[right] > got[wrong] + 1


def test_scores_keep_large_word_counts(make, monkeypatch):
    real, more = ctw.code_counts, 1 << 24  # a float can't hold the sum
    monkeypatch.setattr(ctw, "code_counts", lambda docs: real(docs).withColumn("n", F.when(F.col("kind") == 1, F.col("n") + more).otherwise(F.col("n"))))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:1]
    row = ctw.score(make(["word"], ids=ids)).first()
    assert math.isclose(row.base_score, math.log10(more + 2) + math.log10(2) - 2 * math.log10(more + 1 + 1 + 2 + 1), rel_tol=1e-12)


def test_trees_are_a_probability():
    """Over all 256 bytes, the probabilities in a context sum to one."""
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    codes, _ = ctw.grams(data, np.array([0, len(data)]))
    context = int(codes[9]) >> 8
    probe = np.array([context << 8 | x for x in range(256)], np.uint64)
    every, n = ctw.gathered(np.r_[codes, probe], np.r_[np.ones(len(codes), np.int64), np.zeros(256, np.int64)])
    pair = (every >> np.uint64(8)) & np.uint64(0xFFFF)
    import pandas as pd

    rows = []
    for p in np.unique(pair):
        node, zeros, ones, weighted, _ = ctw.Trees(every[pair == p], n[pair == p]).level[2]
        rows.append(pd.DataFrame({"last": (node >> np.uint64(8) & np.uint64(0xFF)).astype(int), "place": (node & np.uint64(0xFF)).astype(int), "zeros": zeros, "ones": ones, "below": weighted}))
    top = ctw.upper_nodes(pd.concat(rows).groupby(["last", "place"], as_index=False).sum())
    mine = every[pair == (context & 0xFFFF)]
    logs = ctw.Trees(mine, n[pair == (context & 0xFFFF)]).probabilities(top)
    assert math.isclose((10.0 ** logs[np.isin(mine, probe)]).sum(), 1, rel_tol=1e-9)


def test_mixing(make, odd_texts):
    texts = [f"{'word ' * (1 + i % 7)}{i}" for i in range(300)] + odd_texts
    docs = make(texts).withColumn("epoch", F.lit("mine"))
    rows = mix(docs, ["lang", "source"], part=0.5, epochs=2).collect()
    whole = sum(len(words(t)) for t in texts)
    per = collections.Counter()
    for r in rows:
        per[r.source] += r.tokens
    assert len({(r.doc_id, r.epoch_) for r in rows}) == len(rows) and abs(sum(per.values()) - whole // 2) < 3 * 5010
    everything = mix(docs, ["lang", "source"], part=2.0, epochs=2).collect()
    assert len({(r.doc_id, r.epoch_) for r in everything}) == len(everything) >= 2 * sum(bool(words(t)) for t in texts)
    assert mix(make([]), ["lang", "source"]).count() == 0


def test_mixing_redistributes_to_siblings_first(spark, make):
    rows = [(i, "w " * 10, "a", "a1" if i < 2 else "a2", 0) for i in range(42)] + [(100 + i, "w " * 10, "b", "b1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(r.source for r in mix(docs, ["lang", "source"], part=400 / 820, epochs=1).collect())
    assert got == {"a1": 2, "a2": 18, "b1": 20}
    weights = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0)], "level int, path string, weight double")
    got = collections.Counter(r.source for r in mix(docs, ["lang", "source"], part=400 / 820, epochs=1, weights=weights).collect())
    assert got == {"a1": 2, "a2": 28, "b1": 10}


def test_mixing_gives_the_share_of_shut_groups_away(spark, make):
    rows = [(i, "w " * 10, "a", "a1" if i < 5 else "a2", 0) for i in range(45)] + [(100 + i, "w " * 10, "b", "b1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([(2, "a/a2", 0.0)], "level int, path string, weight double")
    got = collections.Counter(r.source for r in mix(docs, ["lang", "source"], part=300 / 850, epochs=1, weights=weights).collect())
    assert got == {"a1": 5, "b1": 25}
    got = collections.Counter(r.source for r in mix(docs, ["lang", "source"], part=1.0, epochs=1, weights=weights).collect())
    assert got == {"a1": 5, "b1": 40}


def test_mixing_with_weights_against_sql(spark):
    """Shortages, shut nodes and weights on all levels; ties of capacity to weight; empty texts."""
    import duckdb

    rows = [(i, "w " * (i % 5), "abc"[i % 3], f"s{i % 7}", f"t{i % 2}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    db = duckdb.connect()
    db.execute("create table docs(doc_id bigint, text varchar, lang varchar, source varchar, kind varchar)")
    db.executemany("insert into docs values (?, ?, ?, ?, ?)", rows)
    levels = ["lang", "source", "kind"]
    for weights, part in (
        ([(1, "a", 9.0), (1, "b", 0.25), (2, "a/s0", 0.0), (2, "b/s1", 5.0), (3, "c/s2/t1", 0.0), (3, "c/s3/t0", 7.0)], 0.6),
        ([(1, "a", 0.0), (2, "b/s1", 0.0)], 2.0),
        ([(1, "a", 0.0), (1, "b", 0.0), (1, "c", 0.0)], 0.5),
    ):
        got = mix(frame, levels, part=part, epochs=2, weights=spark.createDataFrame(weights, "level int, path string, weight double"))
        want = db.execute(mixing_sql(levels, "docs", part, 2, "7", "select doc_id, epoch, tokens from s", weights)).fetchall()
        assert sorted(map(tuple, got.select("doc_id", "epoch", "tokens").collect())) == sorted(want)


def test_ring(make, odd_texts):
    docs = make(odd_texts * 30, ids=[None, *range(1, len(odd_texts) * 30)]).withColumn("shard", F.lit("mine"))
    rows = ring_shards(docs, shards=7).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard_].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert len(rows) == len(odd_texts) * 30 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    loose = {r.doc_id: r.shard_ for r in ring_shards(docs, shards=7, slack=0.5).collect()}
    more = {r.doc_id: r.shard_ for r in ring_shards(docs, shards=8, slack=0.5).collect()}
    assert sum(loose[i] != more[i] for i in loose) < len(loose) / 3
    assert ring_shards(docs.where("false")).count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_against_a_walk_of_each_row(spark, make, odd_texts, slack):
    docs = make(odd_texts * 20, ids=[None, None, *range(2, len(odd_texts) * 20)])
    docs = docs.union(docs.where("doc_id < 200")).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))  # repeated rows, a column without hash
    rows = ring_shards(docs, shards=6, virtual_nodes=9, slack=slack).collect()
    key = F.xxhash64(F.lit(9), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"))
    cells = {(r.doc_id, r.text_crc32): r.cell for r in spark.createDataFrame({(r.doc_id, r.text_crc32) for r in rows}, "doc_id long, text_crc32 long").select("*", F.shiftrightunsigned(key, 48).alias("cell")).collect()}
    spot = lambda name: int(hashlib.sha256(name.encode()).hexdigest(), 16) % 65536
    ring = sorted((spot(f"{s}/{v}"), s) for s in range(6) for v in range(9))
    room = [-(-int(len(rows) * (1 + slack)) // 6) if slack else len(rows) // 6 + (s < len(rows) % 6) for s in range(6)]
    taken, want = [0] * 6, []
    order = lambda r: (cells[r.doc_id, r.text_crc32], r.doc_id is not None, r.doc_id or 0, r.text_crc32)
    for r in sorted(rows, key=order):
        behind = [s for c, s in ring if c >= order(r)[0]] + [s for _, s in ring]
        shard = next(s for s in behind if taken[s] < room[s])
        want.append((str(r.doc_id), r.text_crc32, shard, taken[shard]))
        taken[shard] += 1
    assert sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rows) == sorted(want)


def test_quality(spark, make, odd_texts):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["river", "stone", "light", "green", "house", "walks"], 30)) for _ in range(120)]
    poor = [" ".join(f"{w}!!" for w in rng.choice(["BUY", "NOW", "FREE"], 30)) for _ in range(60)]
    texts = good + poor + odd_texts
    docs = make(texts).withColumn("selected", F.lit("mine"))
    ratings = spark.createDataFrame([(i, 2 if i < 120 else 0) for i in range(0, 180, 2)] + [(1, None), (None, 1)], "doc_id long, grade int")
    rows = {r.doc_id: r for r in grade_texts(docs, ratings).collect()}
    assert len(rows) == len(texts) and all(rows[i].selected_ for i in range(1, 120, 2)) and not any(rows[i].selected_ for i in range(121, 180, 2))
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows.values())
    assert all(r.selected for r in grade_texts(make(good), ratings.where("grade = 2")).collect())
    tails = Model(np.zeros(1), np.array([-1.0, 1.0])).tails(np.array([0.0]))
    assert tails[0, 0] > 0.5 > tails[0, 1]


def test_ordinal_loss_and_gradients():
    """The likelihood equals its definition, and its gradients equal differences of it, also for texts seen in part."""
    rng = np.random.default_rng(5)
    seen = rng.integers(1, 6, 700)
    rows = Sample(rng.integers(0, 3, 700), seen + rng.integers(0, 3, 700).astype(float), seen, rng.integers(0, 9, seen.sum()))
    weights, cuts = rng.normal(size=9), np.array([-0.4, 0.7])
    loss, by_weight, by_cut = rows.loss(weights, cuts)
    want, at = 0.0, 0
    for grade, n, s in zip(rows.grade, rows.features, rows.seen):
        score = weights[rows.at[at : at + s]].sum() / s * math.sqrt(n)
        above = [1.0, *(1 / (1 + math.exp(c - score)) for c in cuts), 0.0]
        want, at = want + math.log(above[grade] - above[grade + 1]), at + s
    assert math.isclose(loss, want / 700, rel_tol=1e-9)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert math.isclose(by_weight[i], (rows.loss(weights + step, cuts)[0] - rows.loss(weights - step, cuts)[0]) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)
    for j in range(2):
        step = np.eye(2)[j] * 1e-6
        assert math.isclose(by_cut[j], (rows.loss(weights, cuts + step)[0] - rows.loss(weights, cuts - step)[0]) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)
