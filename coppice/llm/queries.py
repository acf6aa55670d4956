"""The operators of this package as queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import (
    alignment,
    decontaminate,
    langid,
    packing,
    pii,
    prefix_tree,
    quality,
    shards,
    simhash,
    substrings,
    toxicity,
    warc,
    wordgrams,
)
from coppice.llm.common import doc_remainder, documents, table

SHARDS = 24
MAX_TOKENS = 4096
END_ID = 1


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return shards.shard_by_bytes(documents(spark, sf_dir), SHARDS).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with a tenth of its characters edited at most."""
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed formats and what learnt contexts add."""
    return pii.find_personal_data(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32 of the id is not 2 modulo 4."""
    docs = documents(spark, sf_dir)
    held_out = doc_remainder("doc_id", 4) == 2
    filters = langid.learn(docs, ~held_out)
    return langid.identify(docs.withColumn("held_out", held_out), filters, ["doc_id", "held_out"])


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, normalised, and read back by its offset."""
    pages = table(spark, sf_dir, "pages")
    records, _, _ = warc.archive_pages(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    return records.select(
        warc.page_number("record_id", kind).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_number("refers_to", kind).alias("refers_to"),
    )


def op7_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and line labels of every document."""
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words that occur again."""
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from those whose crc32 of the id is not 0 modulo 5.

    Without labelled examples of both classes no document is predicted to be toxic.
    """
    docs = documents(spark, sf_dir)
    held_out = doc_remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.toxic_scores(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", ((F.col("score") >= 0.5) & F.lit(model.trained)).cast("int"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), MAX_TOKENS, END_ID)


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct row of first turns of the rebuilt conversations, with its members, children, leaves and savings."""
    return prefix_tree.prefix_tree(table(spark, sf_dir, "conversations"))


def op12_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from those whose crc32 of the id is not 1 modulo 3."""
    docs = documents(spark, sf_dir)
    held_out = doc_remainder("doc_id", 3) == 1
    model = wordgrams.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = wordgrams.quality_scores(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers on every document."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(documents(spark, sf_dir), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_histogram_sort, op2_decontamination, op3_bootstrapped_pii, op4_simhash, op5_language_filters,
        op6_warc_normaliser, op7_line_field, op8_recompression, op9_subword_toxicity, op10_best_fit,
        op11_prefix_tree, op12_ftrl_quality, op13_token_alignment,
    )
}

#: crc32 by shifts: each character of the decimal id is taken in, then eight steps of the division follow.
_PREFIX_TREE_SQL = """
with turns as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), keyed as (
  select c, turn, sha256(strlen(role) || ':' || role || text) as k,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w from turns
), own as (
  select c, list({'k': k, 'w': w} order by turn nulls first, k) as p,
    xor(list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''),
        lambda x: list_prepend(ascii(x)::bigint, list_value(-1, -1, -1, -1, -1, -1, -1, -1)::bigint[])))),
      lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end
    ), 4294967295::bigint) % 4 as h
  from keyed group by c
), rebuilt as (
  select o.c, list_concat(coalesce(list_slice(b.p, 1, o.h), []), list_slice(o.p, o.h + 1, len(o.p))) as p
  from own o left join own b on b.c = o.c - o.c % 20
), prefixes as (
  select c, len(p) as size, d, array_to_string(list_transform(list_slice(p, 1, d), lambda x: x.k), '') as pre,
    array_to_string(list_transform(list_slice(p, 1, d - 1), lambda x: x.k), '') as up,
    case when d = 0 then 0 else p[d].w end as w
  from (select c, p, unnest(range(len(p) + 1)) as d from rebuilt)
), nodes as (
  select d, pre, min(up) as up, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * min(w) as saved,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (size = d), '')) as ends_sha256
  from prefixes group by d, pre
), children as (
  select d - 1 as d, up as pre, count(*) as n from nodes where d > 0 group by all
), known as (
  select n.*, coalesce(k.n, 0) as n_children from nodes n left join children k on k.d = n.d and k.pre = n.pre
), sums as (
  select a.d, a.pre, sum((k.n_children = 0)::bigint) as n_leaves, sum(k.saved) as saved_tokens
  from known k join prefixes a on a.c = k.conv_id and a.d <= k.d group by all
)
select k.conv_id, k.d as depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves::bigint as n_leaves,
  s.saved_tokens::bigint as saved_tokens, k.ends_sha256
from known k join sums s on s.d = k.d and s.pre = k.pre left join known p on k.d > 0 and p.d = k.d - 1 and p.pre = k.up
"""

#: Other models, hashes and tokenizers are beyond SQL here; tests hold each query against brute force instead.
ORACLES: dict[str, str] = {"op11_prefix_tree": _PREFIX_TREE_SQL}
