"""Registered queries over the test tables, one per operator, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable
from . import (
    bpe, conversation_repair, damage, decontamination, hnsw, line_crf, mixing, periodic_runs, quality_rules, secret_scan, sharding,
    simhash, token_counts, url_filter)

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    return quality_rules.quality_report(docs, durable).drop("n_lines")


def op2_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return line_crf.classify(docs, _table(spark, folder, "labels", "doc_id", "quality"))


URL_RULES = (
    url_filter.Rule("net", "/", url_filter.BLOCK),
    url_filter.Rule("example.net", "/en/", url_filter.ALLOW),
    url_filter.Rule("example.com", "/de/", url_filter.BLOCK),
    url_filter.Rule("org", "/fr/", url_filter.ALLOW),
)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, folder, "pages", "page_id", "url"), URL_RULES).drop("url")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, durable).select("doc_id", "size", "source_size", "target", "taken")


def op5_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings", "vec_id", "embedding")
    return hnsw.nearest(vectors, F.col("vec_id") % 20 == 0, durable)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents", "doc_id", "text"), durable)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents", "doc_id", "text"), durable)


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    coded = bpe.round_trip(docs, RANKS, PATTERN, keep=["doc_id"])
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(secret_scan.secret_spans(_table(spark, folder, "documents", "doc_id", "text"), durable))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Fields ``lang`` and ``source``, then the first line of the text as ``title`` and the rest as ``body``."""
    docs = _table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    body = F.substr(F.coalesce("text", F.lit("")), F.length(title) + 2)
    whole, sections = token_counts.joined_fields(
        {"lang": F.col("lang"), "source": F.col("source"), "title": title, "body": body})
    ready = docs.select("doc_id", whole.alias("text"), sections.alias("sections"))
    return token_counts.token_counts(ready, RANKS, PATTERN)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = damage.with_repeats(_table(spark, folder, "documents", "doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["shorter"]).alias("length"),
        best["period"].alias("period"), F.floor(F.lit(-1000) * best["shorter"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "benchmark", "item_id", "text")
    return decontamination.contamination(docs, items, durable)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = damage.damaged_turns(_table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_repair.report(conversation_repair.repair(turns, durable, copies="copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_crf": op2_line_crf,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_hnsw": op5_hnsw,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    # Base counts, then the sketches by their definition: values cut to six leading bits, quartiles of their counts.
    "op1_quality_rules": r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
grams as (
  select doc_id, unnest(range(1, len(w) - 3)) as place, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as gram
  from w where len(w) >= 5),
twice as (select doc_id, place from grams qualify count(*) over (partition by doc_id, gram) > 1),
spans as (select doc_id, place, lead(place) over (partition by doc_id order by place) as nxt from twice),
rep as (select doc_id, sum(least(5, coalesce(nxt - place, 5)))::bigint as n from spans group by 1),
c as (
  select doc_id, lang, source, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from w left join rep using (doc_id)),
r as (
  select doc_id, lang, source, unnest(['word_length', 'symbol_share', 'duplicate_line_share']) as ratio,
    unnest([word_chars * 100 // n_words, n_symbols * 10000 // word_chars, n_dup_lines * 10000 // n_lines]) as v,
    unnest([n_words >= 20, word_chars >= 1, n_lines >= 1]) as judged,
    unnest([40, 50, 1500]) as spread, unnest([true, false, false]) as has_low
  from c where n_words > 0),
b as (select *, v - v % (1::bigint << greatest(length(bin(v)) - 6, 0)) as bucket from r),
scoped as (
  select 'own' as scope, lang, source, ratio, bucket from b
  union all select 'lang', lang, null, ratio, bucket from b
  union all select 'all', null, null, ratio, bucket from b),
ranked as (
  select scope, lang, source, ratio, bucket, count(*) over p as total,
    row_number() over (partition by scope, lang, source, ratio order by bucket) as pos
  from scoped window p as (partition by scope, lang, source, ratio)),
q as (
  select scope, lang, source, ratio, any_value(total) as total,
    min(case when pos * 4 >= total then bucket end) as q1, min(case when pos * 4 >= total * 3 then bucket end) as q3
  from ranked group by 1, 2, 3, 4),
judged as (
  select b.doc_id, not b.judged or (
    b.v <= coalesce(o.q3, g.q3, a.q3) + 3 * greatest(coalesce(o.q3 - o.q1, g.q3 - g.q1, a.q3 - a.q1), b.spread)
    and (not b.has_low
      or b.v >= coalesce(o.q1, g.q1, a.q1) - 3 * greatest(coalesce(o.q3 - o.q1, g.q3 - g.q1, a.q3 - a.q1), b.spread))) as fits
  from b
  left join q o on o.scope = 'own' and o.total >= 200 and o.ratio = b.ratio
    and o.lang is not distinct from b.lang and o.source is not distinct from b.source
  left join q g on g.scope = 'lang' and g.total >= 200 and g.ratio = b.ratio and g.lang is not distinct from b.lang
  left join q a on a.scope = 'all' and a.ratio = b.ratio),
inside as (select doc_id, bool_and(fits) as fits from judged group by 1),
f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c left join inside using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(fits, true) as kept
from f
""",
    # Every rule that fits, longest first.
    "op3_url_filter": r"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
p as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) as path from rest),
rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) as verdict
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (page_id)
""",
    # Sources in the order in which they reach their cap; the first so many are clamped.
    "op4_mixing": r"""
with d as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/17'), 1, 8))::bigint as ord
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight from s),
o as (
  select *, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over p, 0) as clamped, sum(weight) over () - coalesce(sum(weight) over p, 0) as loose
  from w window p as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select (total - clamped)::bigint as left_over, loose::bigint as loose from o
  where weight * (total - clamped) <= 3 * source_size * loose order by clamped limit 1),
t as (
  select source, source_size, least(3.0::double * source_size, (weight * left_over)::double / loose) as target
  from w, level),
f as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from t),
c as (
  select d.doc_id, d.size, f.source_size, f.target, f.whole, round(f.target - f.whole * f.source_size)::bigint as rest,
    coalesce(sum(d.size) over (partition by d.source order by ord, doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from c
""",
    # All windows of the documents against all windows of the items; near matches around a window's rarest term.
    "op12_decontamination": r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
i as (
  select item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
win as (
  select distinct item_id, w[k:k + 9] as words
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0)),
grams as (
  select r, k, n, w[k + 1:k + n] as words
  from (select r, w, n, unnest(range(len(w) - n + 1)) as k from d, (select distinct len(words) as n from win) where len(w) >= n)),
occ as (select r, k, n, item_id from grams join win using (words)),
hit as (
  select r, count(distinct pos)::bigint as n_hit
  from (select r, unnest(range(k, k + n)) as pos from (select distinct r, k, n from occ)) group by 1),
ids as (
  select r, count(*)::bigint as n_items, sha256(array_to_string(list_sort(list(item)), ',')) as items_sha256
  from (select distinct r, item_id::varchar as item from occ) group by 1),
t as (select r, unnest(w) as term, unnest(range(len(w))) as pos from d),
c as (select term, count(*) as n from t group by 1),
dw as (select row_number() over () as wid, words from (select distinct words from win)),
wt as (select wid, unnest(words) as term, unnest(range(len(words))) as off from dw),
rare as (
  select wid, arg_min(term, coalesce(n, 0) * 1000 + off) as rarest, count(distinct term) as terms
  from wt left join c using (term) group by 1 having min(coalesce(n, 0)) > 0),
places as (select t.r, t.pos, wid, terms from t join rare on t.term = rarest),
near as (
  select places.r, places.pos, wid from places join (select distinct wid, term from wt) x using (wid)
  join t on t.r = places.r and t.term = x.term and abs(t.pos - places.pos) <= 20
  group by places.r, places.pos, wid, terms having count(distinct x.term) = terms),
n as (select r, count(distinct item_id)::bigint as n_near_items from near join dw using (wid) join win using (words) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated,
  coalesce(n_near_items, 0)::bigint as n_near_items
from d left join hit using (r) left join ids using (r) left join n using (r)
""",
}
