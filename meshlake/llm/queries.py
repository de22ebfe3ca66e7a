"""Queries of the training-data operators and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, fingerprint, jaccard_join, language_id, license_scan, packing, periodic_runs, quality, secret_scan, sharding, span_dedup
from .common import read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.pair_neighbours(read_table(spark, sf_dir, "conversations"))
    out = chat_format.preference_format(pairs)
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return out.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion",
        as_text("chosen_mask").alias("chosen_mask"), as_text("rejected_mask").alias("rejected_mask"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public vocabularies has the file; executors have the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), every_item=True)


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"), periodic_runs.looped)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_best_fit_packing, op3_quality_rules, op4_jaccard_join, op5_secret_scan, op6_decontaminate, op7_span_dedup,
        op8_license_scan, op9_fingerprint, op10_language_id, op11_collocations, op12_sharding, op13_periodic_runs,
    )
}

_CHAT = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), p as (
  select conv_id - (conv_id % 2 + 2) % 2 as even, conv_id % 2 = 0 as first, i, role, text, conv_id from t
), m as (
  select coalesce(a.even, b.even) as even, coalesce(a.i, b.i) as i,
         coalesce(a.role = b.role and a.text = b.text, false) as same
  from (select * from p where first) a full outer join (select * from p where not first) b on a.even = b.even and a.i = b.i
), n as (
  select even, coalesce(min(i) filter (where not same) - 1, max(i)) as n from m group by even
), r as (
  select p.even,
    max(conv_id) filter (where first) as chosen_id, max(conv_id) filter (where not first) as rejected_id, any_value(n.n) as n_prompt_turns,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by i) filter (where i <= n.n and first), '') as prompt,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by i) filter (where i > n.n and first), '') as chosen_completion,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by i) filter (where i > n.n and not first), '') as rejected_completion,
    coalesce(string_agg(case when role = 'assistant' then '1' else '0' end, '' order by i) filter (where i > n.n and first), '') as chosen_mask,
    coalesce(string_agg(case when role = 'assistant' then '1' else '0' end, '' order by i) filter (where i > n.n and not first), '') as rejected_mask
  from p join n using (even) group by p.even
)
select even // 2 as pair_id, chosen_id, rejected_id, cast(n_prompt_turns as integer) as n_prompt_turns, prompt,
       chosen_completion, rejected_completion, chosen_mask, rejected_mask
from r
"""

#: Phrases of one to four words within pieces, their counts, all cuts of each candidate and the longer ones around it.
_COLLOCATIONS = """
with p as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p
), total as (
  select lang, cast(sum(len(ws)) as bigint) as n from w group by lang having n > 0
), g as (
  select lang, len, array_to_string(ws[i:i + len - 1], ' ') as phrase
  from (select lang, ws, len, unnest(range(1, len(ws) - len + 2)) as i from w, (values (1), (2), (3), (4)) as sizes(len))
), f as materialized (
  select lang, phrase, len, count(*) as a from g group by lang, phrase, len having a >= 30
), c as materialized (
  select *, string_split(phrase, ' ') as ws from f where len >= 2
), ck as materialized (
  select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail from c, (values (1), (2), (3)) as ks(k) where k < len
), cut as (
  select ck.lang, ck.phrase, ck.a, k, x.a as l, y.a as r, cast(2000000::hugeint * ck.a // (x.a + y.a) as bigint) as score
  from ck join f x on x.lang = ck.lang and x.phrase = head join f y on y.lang = ck.lang and y.phrase = tail
), best as (
  select lang, phrase, a, arg_min(l, score * 4 + k) as l, arg_min(r, score * 4 + k) as r, min(score) as score from cut group by lang, phrase, a
), inner_parts as materialized (
  select lang, a, array_to_string(ws[i:i + m - 1], ' ') as phrase from c, (values (2), (3)) as sizes(m), (values (1), (2), (3)) as starts(i) where m < len and i + m - 1 <= len
), covered as (
  select distinct c.lang, c.phrase from inner_parts x join c on c.lang = x.lang and c.phrase = x.phrase where 100::hugeint * x.a >= 80::hugeint * c.a
)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score
  from best anti join covered using (lang, phrase)
) join total using (lang) where rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": _CHAT, "op11_collocations": _COLLOCATIONS}
