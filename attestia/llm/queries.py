"""The registered queries over the training-data operators, with oracle text where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.llm import bpe, hardneg, langid, linededup, media, mixing, ngramjoin, sharding, suffixdedup, tokencount, vafile, wavelet, wordruns
from attestia.llm.common import WORD, durable
from attestia.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), digest=True)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = mixing.mix(table(spark, sf_dir, "documents"), mixing.cyclic_weights((3, 1, 2)), ratio=1.5, cap=2.0)
    return mixing.taken_words(manifest)


ORACLES["op2_mixing"] = r"""
with sized as (
  select doc_id, coalesce('s' || source, 't') as skey,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents
), sources as (
  select skey, cast(sum(size) as bigint) as source_size from sized group by skey
), weighted as (
  select *, [3.0::double, 1.0::double, 2.0::double][1 + cast((row_number() over (order by skey) - 1) % 3 as int)] as weight from sources
), levels as (
  select *, 2.0::double * source_size as most, 2.0::double * source_size / weight as full_at,
         1.5::double * cast(sum(source_size) over () as double) as budget
  from weighted
), filling as (
  select *, row_number() over (order by full_at, skey) as turn,
         (budget - coalesce(sum(most) over (order by full_at, skey rows between unbounded preceding and 1 preceding), 0.0::double))
         / sum(weight) over (order by full_at, skey rows between current row and unbounded following) as level
  from levels
), reached as (
  select coalesce((select level from filling where level <= full_at order by turn limit 1), 'infinity'::double) as t
), targets as (
  select skey, source_size, weight, budget, least(most, weight * t) as target from filling, reached
), queued as (
  select s.doc_id, s.size, g.skey, g.source_size, g.target, g.budget, g.weight, e.epoch,
         md5('mix:' || e.epoch || ':' || coalesce(cast(s.doc_id as varchar), '')) as h
  from sized s join targets g on s.skey = g.skey cross join (select unnest([0, 1]) as epoch) e
), served as (
  select *, (epoch * source_size + sum(size) over (partition by skey, epoch order by h, doc_id rows unbounded preceding)) as done
  from queued
), finished as (
  select *, cast(done as double) / weight as finish from served
), spent as (
  select *, sum(size) over (order by finish, skey, epoch, h, doc_id rows unbounded preceding) as used from finished
)
select doc_id, size, source_size, target,
       cast(sum(case when used <= budget and done <= 2.0::double * source_size then size else 0 end) as bigint) as taken
from spent group by doc_id, size, source_size, target
"""


@query
def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return linededup.dedup(docs, count=True).select(
        "doc_id", "n_lines", "n_removed", F.octet_length(left).cast("long").alias("kept_bytes"), F.sha2(left, 256).alias("kept_sha256")
    )


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs, langid.model_of(docs))
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = durable(media.store(table(spark, sf_dir, "documents")), "media")
    return media.digests(stored)


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op6_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(list_transform(q.e, lambda x: cast(x as double)), list_transform(c.e, lambda x: cast(x as double))) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 100 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return wavelet.documents(wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """Documents in which h, the crc32 of the decimal doc_id, is a multiple of 10 repeat their words from word a on.

    A document without doc_id stays as it is.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    g, n = F.floor(h / 10), F.size("_w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("_w", place(i) + 1)), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.select("doc_id", "text", F.when(chosen, words).alias("_w"))
    return split.select("doc_id", F.when(F.coalesce(F.size("_w") > 0, F.lit(False)), again).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordruns.runs(periodic(table(spark, sf_dir, "documents")), digest=True)


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op13_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.e) = len(c.e)
  where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same) where n <= 5
), ranked as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank
  from positives p join scored s on p.anchor_id = s.anchor_id
  where not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
