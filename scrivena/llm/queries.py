"""Queries of the training-data operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivena.llm import chat_format, decontaminate, exact_dedup, filter_audit, html_extract, jaccard_join, language_id, license_scan, merkle, packing, quality, url_filter, warc
from scrivena.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op3_exact_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, data_dir, "documents")).drop("raw")


QUERIES["op3_exact_dedup"] = op3_exact_dedup
ORACLE_SQL["op3_exact_dedup"] = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""


def op4_decontaminate(spark: SparkSession, data_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark"))
    return found.drop("spans")


QUERIES["op4_decontaminate"] = op4_decontaminate
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE_SQL["op4_decontaminate"] = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
b as materialized (select item_id, w, least(len(w), 13) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
bw as materialized (
  select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as g
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from b)
),
sizes as (select distinct n from bw),
dw as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)
),
hits as materialized (select dw.doc_id, dw.s, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
  from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


def op7_jaccard_join(spark: SparkSession, data_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, data_dir, "documents")).drop("raw")


QUERIES["op7_jaccard_join"] = op7_jaccard_join
ORACLE_SQL["op7_jaccard_join"] = f"""
with recursive d as materialized (select doc_id, {_WORDS} as w from documents),
t as materialized (select row_number() over (order by w) as node, w, min(doc_id) as least, count(*) as n_copies from d where len(w) > 0 group by w),
g as materialized (
  select distinct node, array_to_string(w[s:s + 4], ' ') as gram from (select node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from t)
),
n as materialized (select node, count(*) as size from g group by node),
links as materialized (
  select x.a, x.b from (select p.node as a, q.node as b, count(*) as common from g p join g q on p.gram = q.gram and p.node <> q.node group by all) x
  join n na on na.node = a join n nb on nb.node = b where 10 * common >= 8 * (na.size + nb.size - common)
),
reach(a, b) as (select node, node from t union select r.a, l.b from reach r join links l on l.a = r.b),
classes as (select r.a as node, min(t.least) as class_id from reach r join t on t.node = r.b group by r.a),
degrees as (select a as node, count(*) as n_links from links group by a)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_copies, 1)::bigint as n_copies
from d left join t on t.w = d.w and len(d.w) > 0 left join classes using (node) left join degrees using (node)
"""


def op1_html_extract(spark: SparkSession, data_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, data_dir, "pages"))


QUERIES["op1_html_extract"] = op1_html_extract


def op2_language_id(spark: SparkSession, data_dir: str) -> DataFrame:
    return language_id.identified(table(spark, data_dir, "documents"))


QUERIES["op2_language_id"] = op2_language_id


def op5_chat_format(spark: SparkSession, data_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, data_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.formatted(rows))


QUERIES["op5_chat_format"] = op5_chat_format
ORACLE_SQL["op5_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 9 + 7 + 7)::bigint as formatted_chars
from c group by conv_id
"""


def op6_packing(spark: SparkSession, data_dir: str) -> DataFrame:
    return packing.packed(table(spark, data_dir, "documents")).withColumn("input_ids", F.xxhash64("input_ids")).withColumnRenamed("input_ids", "ids_hash")


QUERIES["op6_packing"] = op6_packing


def op10_url_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, data_dir, "pages"), url_filter.rule_table(spark))


QUERIES["op10_url_filter"] = op10_url_filter
ORACLE_SQL["op10_url_filter"] = """
with p as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
),
h as (
  select page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from p
),
r(verdict, rh, rp) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
best as (
  select url, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict
  from (select distinct url, host, path from h), r
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by url
)
select page_id, host, path, rule,
       coalesce(verdict, case when regexp_matches(host || path, '^([^/]*[.-])?(spam[.-]|(cheap-)?pills[.-]|casino[.-]|porn[.-]|malware-|phishing-)') then 'block' else 'allow' end) as verdict
from h left join best using (url)
"""


def op8_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    return quality.scored(table(spark, data_dir, "documents"), table(spark, data_dir, "labels"))


QUERIES["op8_quality"] = op8_quality


def op9_license_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, data_dir, "documents"))


QUERIES["op9_license_scan"] = op9_license_scan
ORACLE_SQL["op9_license_scan"] = license_scan.oracle_sql()


def op13_filter_audit(spark: SparkSession, data_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, data_dir, "documents"), table(spark, data_dir, "labels"))


QUERIES["op13_filter_audit"] = op13_filter_audit
ORACLE_SQL["op13_filter_audit"] = filter_audit.ORACLE_SQL


def op12_merkle_manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    return merkle.audited(table(spark, data_dir, "documents"))


QUERIES["op12_merkle_manifest"] = op12_merkle_manifest
ORACLE_SQL["op12_merkle_manifest"] = merkle.ORACLE_SQL


def op11_warc(spark: SparkSession, data_dir: str) -> DataFrame:
    return warc.archived(table(spark, data_dir, "pages"))


QUERIES["op11_warc"] = op11_warc
ORACLE_SQL["op11_warc"] = warc.ORACLE_SQL
