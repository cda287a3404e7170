"""Queries ``opN_<name>`` over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, decontaminate, hmm_lm, knn_quality, langid, ngram_join, piece_codec, quality_rules, token_store, url_reputation
from .workspace import shared_dir

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(divisor: int) -> Column:
    """crc32 of the document id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(table(spark, sf_dir, "documents"), fold(7) != 2).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four arrivals, compacted after each, read back from the committed manifest."""
    store = compaction.ingest(table(spark, sf_dir, "documents"), shared_dir(spark), fold(4), 4)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold(4) != 2).select("doc_id", (~F.col("train")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    return knn_quality.score_quality(table(spark, sf_dir, "documents"), labels).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


ORACLE = {
    "op2_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select a, b from e union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as least from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) as component_id from w left join n using (doc_id) left join c using (doc_id)""",
    "op4_quality_rules": r"""
with w as (
  select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select doc_id, i, ws[i : i + 4] as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 6)),
d as (select doc_id, unnest(places) as i from (select doc_id, win, list(i) as places from g group by 1, 2 having count(*) > 1)),
r as (select doc_id, count(distinct i + j) as n_repeat_words from d, range(5) t(j) group by 1),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(regexp_extract_all(text, '[|!]')) as signs, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters, len(list_distinct(ws)) as kinds
  from w left join r using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 18 * n_words or n_symbols * 5 > n_words or signs * 4 > n_words
    or (n_lines >= 4 and n_dup_lines * 2 > n_lines) or letters * 2 < word_chars or (n_words >= 50 and kinds * 10 < n_words)) as kept
from f""",
    "op3_compaction": "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents",
    "op10_url_reputation": rf"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest,
    regexp_replace(regexp_replace(regexp_replace(html, '{url_reputation.MARKUP}', ' ', 'g'), '{url_reputation.SIGN_ENTITIES}', '&', 'g'), '{url_reputation.ENTITIES}', ' ', 'g') as text from pages),
named as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         len(regexp_extract_all(text, '{url_reputation.WORDS}')) as words, len(regexp_extract_all(text, '{url_reputation.SIGNS}')) as signs from parts),
ruled as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
    case when words > 0 then case when signs * 5 > words then 1.0 else 0.0 end end as bad
  from named),
hosts as (
  select host, case when regexp_matches(host, '{url_reputation.LONG_SUFFIX}') then regexp_extract(host, '([^.]*[.])?[^.]*[.][^.]*$') else regexp_extract(host, '([^.]*[.])?[^.]*$') end as domain,
    case when regexp_matches(host, '{url_reputation.LONG_SUFFIX}') then regexp_extract(host, '[^.]*[.][^.]*$') else regexp_extract(host, '[^.]*$') end as suffix,
    count(bad)::double as n, coalesce(sum(bad), 0)::double as b
  from ruled group by 1),
total as (select (coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as rate from hosts),
s0 as (select suffix, sum(n) as n, sum(b) as b, any_value(rate) as prior from hosts, total group by 1),
sk as (select sum(n * pow(b / n - m, 2)) as between_, sum(m * (1 - m)) as noise, sum(n * m * (1 - m)) as spread
       from (select *, least(greatest(prior, 1e-6), 1 - 1e-6) as m from s0 where n > 0)),
sv as (select case when spread is null or spread <= noise then 2.0 when between_ <= noise then 1e4
       else least(1e4, greatest(0.5, (spread - noise) / (between_ - noise) - 1)) end as k from sk),
s1 as (select suffix, (prior * k + b) / (n + k) as mean from s0, sv),
d0 as (select domain, d.n, d.b, s1.mean as prior from (select domain, suffix, sum(n) as n, sum(b) as b from hosts group by 1, 2) d join s1 using (suffix)),
dk as (select sum(n * pow(b / n - m, 2)) as between_, sum(m * (1 - m)) as noise, sum(n * m * (1 - m)) as spread
       from (select *, least(greatest(prior, 1e-6), 1 - 1e-6) as m from d0 where n > 0)),
dv as (select case when spread is null or spread <= noise then 2.0 when between_ <= noise then 1e4
       else least(1e4, greatest(0.5, (spread - noise) / (between_ - noise) - 1)) end as k from dk),
d1 as (select domain, (prior * k + b) / (n + k) as mean from d0, dv),
h0 as (select host, hosts.n, hosts.b, d1.mean as prior from hosts join d1 using (domain)),
hk as (select sum(n * pow(b / n - m, 2)) as between_, sum(m * (1 - m)) as noise, sum(n * m * (1 - m)) as spread
       from (select *, least(greatest(prior, 1e-6), 1 - 1e-6) as m from h0 where n > 0)),
hv as (select case when spread is null or spread <= noise then 2.0 when between_ <= noise then 1e4
       else least(1e4, greatest(0.5, (spread - noise) / (between_ - noise) - 1)) end as k from hk),
h1 as (select host, (prior * k + b) / (n + k) as mean, n + k as w from h0, hv)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when greatest(0.0, mean - 1.64 * sqrt(mean * (1 - mean) / (w + 1))) >= 0.2 then 'block' else 'allow' end as verdict
from ruled join h1 using (host)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
