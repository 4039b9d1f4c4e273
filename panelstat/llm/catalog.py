"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.llm import alignment, bpe, imatch, mixing, negatives, packing, ppm, sharding, simhash, substring, toxicity, vptree, warc
from panelstat.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@_query()
def op9_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


OP10_LIMIT = 64 << 10  # bytes of a shard: several splits on every table
OP10_SQL = f"""
with recursive r as (
  select doc_id, coalesce(strlen(text), 0) n_bytes, lpad(bin(('0x' || substr(sha256(cast(doc_id as varchar)), 1, 15))::bigint), 60, '0') b
  from documents
), t as (
  select '' shard, 0 depth
  union all
  select t.shard || x.bit, t.depth + 1
  from t, (values ('0'), ('1')) x(bit)
  where t.depth < 60 and (select sum(n_bytes) > {OP10_LIMIT} and count(*) > 1 from r where starts_with(r.b, t.shard))
), s as (
  select t.shard, t.depth, sum(n_bytes) shard_bytes, count(*) shard_rows
  from t join r on starts_with(r.b, t.shard) group by all
)
select r.doc_id, r.n_bytes::bigint n_bytes, s.shard, s.depth::int depth, s.shard_rows::bigint shard_rows, s.shard_bytes::bigint shard_bytes, s.shard_bytes <= {OP10_LIMIT} fits
from r join s on starts_with(r.b, s.shard) where s.shard_bytes <= {OP10_LIMIT} or s.shard_rows = 1
  and not exists (select 1 from s up where up.depth < s.depth and starts_with(s.shard, up.shard) and (up.shard_bytes <= {OP10_LIMIT} or up.shard_rows = 1))
"""


@_query(OP10_SQL)
def op10_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"), limit=OP10_LIMIT)


@_query()
def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP8_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
r as (select doc_id, len(w) n, s, list_aggregate(w[s:s + 12], 'string_agg', ' ') k from w, unnest(range(1, len(w) - 11)) u(s)),
f as (select k, min(doc_id) first from r group by k),
c as (select distinct doc_id, p from r join f using (k), unnest(range(s, s + 13)) u(p) where f.first < r.doc_id),
g as (select doc_id, list(p) gone from c group by doc_id)
select w.doc_id, len(w.w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(array_to_string([x for x, i in w.w if not coalesce(list_contains(gone, i), false)], ' ')) kept_sha256
from w left join g using (doc_id)
"""


@_query(OP8_SQL)
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= {warc.MIN_REVISIT} group by d)
select page_id, n::bigint payload_bytes, d payload_digest, case when page_id > first then 'revisit' else 'response' end record_type,
  case when page_id > first then first end refers_to
from p left join f using (d)
"""


@_query(OP5_SQL)
def op5_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


OP1_SQL = f"""
with v as (select row_number() over () place, vec_id, embedding::double[] v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.place, q.vec_id query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) score
  from v q join v c on q.vec_id % 100 = 0 and q.place <> c.place and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by place order by score, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= {vptree.K}
"""


@_query(OP1_SQL)
def op1_vp_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@_query()
def op2_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.with_edits(table(spark, folder, "documents"))


@_query()
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def _held_out(parts: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 1, F.lit(False))


@_query()
def op6_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.scores(table(spark, folder, "documents"), ~_held_out(5))


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, ~_held_out(3))


@_query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = toxicity.score(docs, learn_toxicity(docs, table(spark, folder, "labels")))
    return out.select("doc_id", _held_out(3).alias("held_out"), "score", "predicted")


@_query()
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.round_trip(table(spark, folder, "documents"))
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


OP12_SQL = f"""
with e as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)) q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r ar, a.vec_id anchor_id, c.r, c.vec_id, a.l = c.l same, case when len(a.q) > 0 then list_inner_product(a.q, c.q)::bigint else 0 end score
  from e a join e c on a.vec_id % 100 = 0 and a.r <> c.r and len(a.q) = len(c.q)),
p as (select ar, anchor_id, r, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by ar order by score desc, vec_id) <= {negatives.N_POSITIVES}),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id negative_id, s.score negative_score,
    row_number() over (partition by p.ar, p.r order by s.score desc, s.vec_id)::int as rank
  from p join s on p.ar = s.ar and not s.same and {negatives.LOW} * positive_score <= 100 * s.score and 100 * s.score <= {negatives.HIGH} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {negatives.N_NEGATIVES}
"""


@_query(OP12_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    relabel = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, folder, "embeddings"), relabel=relabel)


@_query()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.align(table(spark, folder, "documents"), {"groups_sha256": digest})[0]
