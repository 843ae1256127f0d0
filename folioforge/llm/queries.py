"""The registered queries of this subpackage: operators on whole tables, as digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, convrepair, embeddings, hardneg, imatch, langid, linededup, minhash, packing, sharding, suffixdedup, tokens, urlfilter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out_rule(F.col("doc_id"))
    model = langid.train(docs, held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"), 0.98)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.fingerprints_with_edits(docs, imatch.lexicon(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


#: (host, path, verdict) of the rules of op11.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repair of conversations whose rows are damaged by a hash of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(F.col("damage") == 4, "user").otherwise(space("role"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", damage.alias("damage"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "damage")
    return convrepair.repair_conversations(rows, F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row, where every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_id": op5_language_id,
    "op6_embedding_links": op6_embedding_links,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op11_url_filter": """
        with parts as (select page_id, coalesce(url, '') as url from pages),
             split as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                              regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from parts),
             rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             fits as (select s.page_id, s.host, s.path, r.host || r.path as rule, r.verdict, length(r.host || r.path) as n
                      from split s left join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits
        qualify row_number() over (partition by page_id order by n desc nulls last) = 1""",
    "op13_hard_negatives": """
        with usable as (select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
                               [floor(256 * x::double) for x in embedding] as v from embeddings
                        where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
             score as (select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
                       from usable a, usable r where a.vec_id % 100 = 0 and len(a.v) = len(r.v)),
             positive as (select anchor_id, id as positive_id, score as positive_score from score where same and id <> anchor_id
                          qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
        select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
               row_number() over (partition by anchor_id, positive_id order by score desc, id)::integer as rank
        from positive join score using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        qualify rank <= 10""",
}
