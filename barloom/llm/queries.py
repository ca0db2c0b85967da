"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe
from .centroids import cluster_vectors
from .chat import calls_of_turns, link_calls
from .collocations import collocations
from .ctw import score
from .embed_dedup import near_duplicate_vectors
from .huffman import read_ids, write_ids
from .mixing import mix, oracle as mixing_sql
from .ngram_join import ngram_jaccard_join
from .quality import grade_texts, grades_of_labels
from .rankbpe import rank_bpe
from .ring import ring_shards
from .shared import read, shared_dir
from .topk import exact_top_k


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)


def fixed(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows as a local table of the plan."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in rows)
    names, kinds = zip(*(column.split() for column in ddl.split(", ")))
    return spark.sql(f"select {', '.join(f'cast({n} as {k}) as {n}' for n, k in zip(names, kinds))} from values {values} as v({', '.join(names)})")


SCHEMAS = [
    ("reply", "length", "number", False), ("reply", "start", "string", True), ("reply", "turn", "number", True),
    ("summarise", "focus", "string", True), ("summarise", "start", "string", True), ("summarise", "turn", "number", True),
]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = fixed(spark, SCHEMAS, "tool string, param string, type string, required boolean")
    done = link_calls(calls_of_turns(read(spark, sf_dir, "conversations")), schemas)
    return done.select("conv_id", "turn", "position", "link", F.array_join("errors", "; ").alias("errors"), "line")


# In conversations of odd number results stand a turn before their calls.
OP2_SQL = """
with m as (
  select conv_id, turn, role, text, case role when 'user' then turn when 'assistant' then if(conv_id % 2 = 0, turn - 1, turn + 1) end as num,
         case when role = 'user' then case when turn % 3 = 0 then 'summarise' else 'reply' end end as tool from conversations
), k as (
  select *, 'c' || conv_id || '-' || num as call_id,
         if(turn % 7 = 0, '[' || turn || ']', '{"length":' || length(text) || ',"start":' || to_json(substr(text, 1, 40)) || ',"turn":'
           || if(turn % 5 = 0, '"' || turn || '"', turn::varchar) || '}') as args from m
), l as (
  select *, exists (select 1 from k c where c.conv_id = k.conv_id and c.call_id = k.call_id and c.tool is not null) as has_call,
         exists (select 1 from k c where c.conv_id = k.conv_id and c.call_id = k.call_id and c.tool is null) as has_result from k
)
select conv_id, turn, row_number() over (partition by conv_id order by case when tool is null and has_call then greatest(turn, num) else turn end,
                                                        tool is null and has_call and turn <= num, turn) - 1 as position,
       case when tool is not null then case when has_result then 'answered' else 'open' end
            when call_id is not null then case when has_call then 'linked' else 'orphan' end end as link,
       case when tool is null then '' when turn % 7 = 0 then 'not an object'
            else concat_ws('; ', if(tool = 'summarise', 'missing focus', null), if(turn % 5 = 0, 'type of turn', null), if(tool = 'summarise', 'unknown length', null)) end as errors,
       '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || to_json(role) ||
       case when tool is not null then ',"tool_call":{"arguments":' || args || ',"id":"' || call_id || '","name":"' || tool || '"}'
            when call_id is not null then ',"tool_call_id":"' || call_id || '"' else '' end || '}' as line
from l
"""


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return exact_top_k(vectors, vectors.where("id % 100 = 0"), k=10, scale=1024).withColumnRenamed("id", "vec_id")


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return near_duplicate_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


DOMAIN = "pmod(cast(substr(source, 4) as int), 4)"
# d0 asks for more than its two epochs hold, so its brothers share the rest; English in d1 and one leaf of d3 give nothing.
WEIGHTS = [(1, "d0", 8.0), (1, "d3", 0.5), (2, "d1/en", 0.0), (2, "d2/fr", 4.0), (3, "d0/en/src0", 3.0), (3, "d3/de/src3", 0.0)]


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("domain", F.concat(F.lit("d"), F.expr(DOMAIN).cast("string")))
    weights = fixed(spark, WEIGHTS, "level int, path string, weight double")
    return mix(docs, ["domain", "lang", "source"], part=0.7, epochs=2, weights=weights).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


OP7_SQL = mixing_sql(
    ["domain", "lang", "source"],
    "(select *, 'd' || (cast(substr(source, 4) as int) % 4) as domain from documents)",
    0.7, 2, "7", "select doc_id, domain, lang, source, tokens, epoch from s", WEIGHTS,
)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = grade_texts(docs, grades_of_labels(read(spark, sf_dir, "labels")))
    return rated.drop("text")


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ring_shards(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_ids(spark, out)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return cluster_vectors(vectors, k=16, rounds=3, dims=64, scale=64, seed=1)


def clusters_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """The rounds as a chain of relations: centroids c0, c1, ... and assignments a0, a1, ..."""
    steps = [f"""v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as hugeint)) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), e as (select row, unnest(x) as x, unnest(range({dims})) as pos from v),
d as (select row, row_number() over (order by sha256('{seed}:' || coalesce(cast(vec_id as varchar), 'null')), x) - 1 as c from v),
c0 as (select d.c, e.pos, e.x from d join e using (row) where d.c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as (
  select row, min_by(c, (s, c)) as c, min(s) as s from (select e.row, c.c, sum((e.x - c.x) * (e.x - c.x)) as s from e join c{i} c using (pos) group by all) group by row
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as (
  select c, pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) as x from c{i} c
  left join (select a.c, e.pos, cast(sum(e.x) as hugeint) as s, cast(count(*) as hugeint) as n from e join a{i} a using (row) group by all) m using (c, pos)
)""")
    return "with " + ", ".join(steps) + f""", h as (select c, sha256(string_agg(cast(x as varchar), ',' order by pos)) as centroid_sha256 from c{rounds} group by c)
select vec_id, cast(c as integer) as cluster, cast(s as bigint) as distance, cast(sum(s) over (partition by c) as bigint) as cluster_inertia,
       cast(sum(s) over () as bigint) as inertia, centroid_sha256 from a{rounds} join h using (c) join v using (row)"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), longest=5, support=100, scale=1000, cover=100, top=2000)


OP12_SQL = """
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from p
), g as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) s)
), t as (select lang, cast(sum(len(w)) as hugeint) as n from w group by lang),
f as (select lang, k, phrase, cast(count(*) as hugeint) as a from g group by all having count(*) >= 100),
cut as (
  select f.*, unnest(range(1, f.k)) as cut, string_split(phrase, ' ') as words from f where k > 1
), s as (
  select c.lang, c.phrase, c.k, c.a, l.a as l, r.a as r, t.n, c.cut, (1000 * c.a * t.n) // (l.a * r.a) as score
  from cut c join t using (lang)
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[: c.cut], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[c.cut + 1 :], ' ')
), weakest as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_of as (
  select lang, unnest([array_to_string(words[: k - 1], ' '), array_to_string(words[2 :], ' ')]) as phrase, a from (select distinct lang, k, a, words from cut where k > 2)
), covered as (select lang, phrase, max(a) as a from inner_of group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l,
       cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from weakest w where not exists (select 1 from covered c where c.lang = w.lang and c.phrase = w.phrase and c.a >= w.a)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rank_bpe(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_format": op2_chat_format,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_ctw_score": op6_ctw_score,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ring_shards": op9_ring_shards,
    "op10_token_output": op10_token_output,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_collocations": op12_collocations,
    "op13_rank_bpe": op13_rank_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op3_exact_top_k": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op11_centroid_clusters": clusters_sql(16, 3, 64, 64, 1),
    "op12_collocations": OP12_SQL,
}
