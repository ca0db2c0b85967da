"""op11, op12 and op13 against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from barloom.llm.centroids import cluster_vectors, nearest, vantage_tree
from barloom.llm.collocations import collocations
from barloom.llm.rankbpe import merges, rank_bpe

VECTORS = "vec_id long, vector array<double>, cluster string"


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            groups[j].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = assign()
    own = collections.Counter()
    for d, j in found:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=repr)


def test_clusters(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.0, 0.25, 1.5]) + r.choice([0, 0, 1e-3]) for _ in range(3)]) for i in range(150)]
    rows += [(7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (500, None), (501, [1.0, None, 2.0]), (502, [1.0, math.nan, 2.0]), (503, [math.inf, 0.0, 0.0]), (504, [1.0]), (505, [])]
    rows += [(600, [1e6, -1e6, 0.0]), (601, [3e7, 1.0, 0.0])]  # large ones take the exact way beyond 64 bits
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(3)
    for k, rounds in ((5, 3), (1, 1), (200, 2), (16, 0)):
        got = cluster_vectors(df, k=k, rounds=rounds, dims=3).collect()
        assert sorted((tuple(x) for x in got), key=repr) == plain_clusters(rows, k, rounds, 3, 64), k
    assert cluster_vectors(df, k=2, dims=9).collect() == []
    assert cluster_vectors(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="fit a long"):
        cluster_vectors(spark.createDataFrame([(1, [1e300, 0.0, 0.0], "x"), (2, [0.0, 0.0, 0.0], "x")], VECTORS), k=1, dims=3).collect()


def test_tree_meets_ties():
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 40):
        c = rng.integers(-3, 3, (k, 2))  # many equal centroids and equal distances
        x = rng.integers(-4, 4, (400, 2))
        who, best = nearest(x, c, vantage_tree(c.tolist()))
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        assert (best == d.min(1)).all() and (who == d.argmin(1)).all()


def plain_collocations(rows, longest, support, cover, top):
    count, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {p: n for p, n in count.items() if n >= support}
    out = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        longer = [f for (other, q), f in frequent.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if len(p) == 1 or any(100 * f >= cover * a for f in longer):
            continue
        n = total[lang]
        s, k = min((1000 * a * n // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), a, count[lang, p[:k]], count[lang, p[k:]], n))
    rows = []
    for lang, found in out.items():
        for rank, (s, _, p, a, left, right, n) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), a, left, right, n, -s))
    return sorted(rows)


@pytest.mark.parametrize("shard_bytes, support, cover", [(1 << 20, 4, 100), (1500, 4, 100), (100, 3, 90), (2000, 40, 100)])
def test_collocations(spark, shard_bytes, support, cover):
    r = random.Random(support)
    pool = "New york city of the The a A rock and roll é ÉTÉ x\x0bz".split(" ")
    rows = [("".join(r.choice(pool) + r.choice([" ", "  ", "\t", ", ", "\n", " ", " "]) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "en", "de", None])) for _ in range(300)]
    rows += [("the the the the the the", "en")] * 5 + [(None, "en"), ("", None), (" \t.,", "fr"), ("only once", "it"), ("word " * 4000, "de")]
    df = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(3)
    for top in (7, None):
        got = collocations(df, longest=5, support=support, cover=cover, top=top, shard_bytes=shard_bytes)
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5, support, cover, top)
    assert collocations(df.limit(0)).collect() == []


def test_rank_bpe(spark, make, odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    r = random.Random(9)
    letters = "abcXYZ éßñ'.,!-_09\n\t　你\U0001f600́\x1f"
    texts = [*odd_texts, "a <|endoftext|> b", "A<|ENDOFTEXT|>b<|startoftext|>c", "x" * 3000, "ab" * 1500 + "ö" * 700, "don't they'LL we've I'M", "İK"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300)]
    docs = make(texts, [*range(len(texts) - 2), None, 3]).withColumn("ids", texts_column())
    rows = rank_bpe(docs, path, texts=True).collect()
    want = []
    for doc_id, text in zip([*range(len(texts) - 2), None, 3], texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        want.append((doc_id, len(ids), *sha, ids, decoded))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert rank_bpe(docs.limit(0), path).collect() == []
    assert rank_bpe(docs, path).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def texts_column():
    from pyspark.sql import functions as F

    return F.lit("clashes")


def test_rank_array_equals_heap():
    import public_tokenizers

    m = merges(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 60))).encode() for _ in range(300)]
    assert m.encode_words(words) == [m.merge_long(w) for w in words]
