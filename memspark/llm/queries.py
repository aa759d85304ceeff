"""The registered queries of this subpackage: thin views of its operators, and DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, exact_dedup, jaccard_join, language_id, lm_score, mixing, pii, prefix_trie, quality_rules, suffix_dedup, token_blocks, toxicity
from .common import documents, labels, split_remainder


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir).select("doc_id", "text"))


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_filter(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(documents(spark, sf_dir), labels(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language_id.learn(docs.filter(split_remainder("doc_id", 3) != 1))
    return language_id.identify(docs, models).withColumn("held_out", split_remainder("doc_id", 3) == 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, labels(spark, sf_dir).filter(split_remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", split_remainder("doc_id", 5) == 0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), width=4, percent=85)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    "op12_prefix_trie": r"""
        with recursive ids as (select distinct conv_id as c, conv_id::varchar as s from conversations where conv_id is not null),
        crc as (
            select c, s, 0 as i, 4294967295::bigint as v from ids
            union all
            select c, s, i + 1, case when w & 1 = 1 then xor(w >> 1, 3988292384::bigint) else w >> 1 end
            from (select c, s, i, case when i % 8 = 0 then xor(v, ascii(substr(s, i // 8 + 1, 1))::bigint) else v end as w from crc where i < 8 * length(s))
        ),
        heads as (select c, xor(v, 4294967295::bigint) % 9 as h, c - c % 5 as b from crc where i = 8 * length(s)),
        t as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as r, coalesce(text, '') as x
            from conversations where conv_id is not null
        ),
        moved as (
            select h.c, t.p, t.r, t.x, 0 as own from heads h join t on t.c = h.b and t.p <= h.h
            union all
            select h.c, t.p, t.r, t.x, 1 from heads h join t on t.c = h.c and t.p > h.h
        ),
        built as (select c, row_number() over (partition by c order by own, p) as d, sha256(strlen(r) || ':' || r || x) as g, strlen(x) as n from moved),
        paths as (select c, d, string_agg(g, ',') over (partition by c order by d) as k, n from built union all select c, 0, '', 0 from heads),
        longest as (select c, max(d) as l from paths group by c),
        nodes as (
            select p.d as depth, p.k, min(p.c) as conv_id, count(*) as n_convs, any_value(p.n) as n,
                   sha256(coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (l.l = p.d), '')) as ends_sha256
            from paths p join longest l using (c) group by p.d, p.k
        ),
        ups as (
            select a.depth, a.k, b.depth as d2, b.k as k2, b.conv_id as c2, b.n_convs as m2, b.n as n2
            from nodes a join paths p on p.d = a.depth and p.k = a.k join nodes b on b.depth >= a.depth join paths q on q.c = p.c and q.d = b.depth and q.k = b.k
            where p.c = b.conv_id
        ),
        kids as (select p.d as depth, p.k, count(*) as n_children from nodes n join paths p on p.c = n.conv_id and p.d = n.depth - 1 where n.depth > 0 group by all),
        sums as (
            select u.depth, u.k, sum(case when u.d2 > 0 then (u.m2 - 1) * u.n2 else 0 end)::bigint as saved_tokens, count(*) filter (k.k is null) as n_leaves
            from ups u left join kids k on k.depth = u.d2 and k.k = u.k2 group by u.depth, u.k
        ),
        parents as (select n.depth, n.k, m.conv_id as parent_conv_id from nodes n join paths p on p.c = n.conv_id and p.d = n.depth - 1 join nodes m on m.depth = p.d and m.k = p.k)
        select n.conv_id, n.depth::bigint as depth, parents.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) as n_children, sums.n_leaves, sums.saved_tokens, n.ends_sha256
        from nodes n join sums on sums.depth = n.depth and sums.k = n.k left join kids on kids.depth = n.depth and kids.k = n.k left join parents on parents.depth = n.depth and parents.k = n.k""",
}
