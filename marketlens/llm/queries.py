"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, class_lm, langid, licenses, mixing, near_dups, packing, prefix_trie, quality_model, quality_rules, token_counts, vantage, vector_dups
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary file of the packing query.
TOKENIZER = "word_bpe_49k.json"
#: Piece file of the token counts.
PIECES = "piece_bpe_32k.model"
#: The two vocabulary files of the alignment.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model).withColumn("held_out", held_out)


MIXING_SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
per as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
         row_number() over (order by source nulls last) as ix from per),
levels as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, ix rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (order by source_size * 2.0::double / weight, ix rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed),
targets as (
  select source, source_size, least(source_size * 2.0::double, max(level) over () * weight) as target from levels),
placed as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::bigint as quota,
         (sum(s.size) over (partition by s.source order by s.h, s.size rows between unbounded preceding and current row) - s.size)::bigint as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)))::bigint as taken
from placed
"""


@query("op1_mixing", MIXING_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_class_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 1
    return class_lm.score(docs, class_lm.fit(docs, ~held_out)).withColumn("held_out", held_out)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_model.score(docs, model).withColumn("held_out", held_out)


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.Vocabulary.of(token_counts.zipf_scores(tokenizer_path(PIECES)))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summed(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


TRIE_SQL = r"""
with turns as (
  select conv_id as c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t,
         row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
  from conversations where conv_id is not null),
stored as (
  select c, list(t order by pos) as ts from turns group by c),
heads as (
  select c, ts, c - c % 20 as base,
         xor(list_reduce(list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint),
             lambda crc, x: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, xor(crc, x)),
             4294967295::bigint), 4294967295::bigint) % 4 as h
  from stored),
built as (
  select a.c, list_concat(coalesce(b.ts, [])[:a.h], a.ts[a.h + 1:]) as ts
  from heads a left join stored b on b.c = a.base),
members as (
  select c, d, ts[:d] as node, len(ts) = d as ends from (select c, ts, unnest(range(len(ts) + 1)) as d from built)),
nodes as (
  select node, d, min(c) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(case when ends then c::varchar end, ',' order by c), '')) as ends_sha256,
         case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) end as saves
  from members group by node, d),
children as (
  select node[:d - 1] as node, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
below as (
  select n.node[:k] as node, k as d, sum(n.saves) as saved_tokens, count(*) filter (where ch.node is null) as n_leaves
  from (select node, d, saves, unnest(range(d + 1)) as k from nodes) n left join children ch on ch.node = n.node and ch.d = n.d
  group by 1, 2)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(ch.n_children, 0)::bigint as n_children,
       b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join below b on b.node = n.node and b.d = n.d left join children ch on ch.node = n.node and ch.d = n.d
left join nodes p on p.d = n.d - 1 and p.node = n.node[:n.d - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op11_vantage_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
