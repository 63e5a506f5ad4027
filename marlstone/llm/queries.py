"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, learned_partitions, licenses, mixing, segmentation, simhash, substring_dedup, toxicity, warc, wrapper


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(_read(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_sentencepiece_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.sample_segmentations(_read(spark, sf_dir, "documents"), with_sha256=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_longest(_read(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures in the order of their ids: a URL in its canonical spelling was fetched in
    full, any other spelling was asked for with validators and answered 304."""
    is_full = F.coalesce(warc.canonical_url(F.col("url")) == F.regexp_replace(F.col("url"), "^https?://", ""), F.lit(False))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        "url",
        F.col("page_id").cast("long").alias("time"),
        is_full.alias("is_full"),
        F.concat(F.lit('W/"'), F.substring(digest, 1, 16), F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("modified"),
        digest.alias("digest"),
        F.when(
            is_full,
            F.create_map(F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")),
        )
        .otherwise(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), F.col("page_id").cast("string")))
        .alias("headers"),
    )


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(page_captures(_read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.select(F.col("id").alias("page_id"), "url_key", "status", "refers_to", "digest", F.array_join(lines, "\n").alias("headers"))


def op6_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(_read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_learned_partitions": op1_learned_partitions,
        "op2_mix_sources": op2_mix_sources,
        "op3_sentencepiece_topk": op3_sentencepiece_topk,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_wrapper": op6_wrapper,
        "op7_toxicity": op7_toxicity,
        "op8_simhash_golay": op8_simhash_golay,
        "op9_license_scan": op9_license_scan,
        "op10_substring_dedup": op10_substring_dedup,
    }


OP4_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
), g as (
  select *, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by points desc, doc_id asc nulls last) as keep_id,
         first_value(points) over (partition by norm order by points desc, doc_id asc nulls last) as keep_points
  from t
)
select doc_id, keep_id, cast(group_size as bigint) as group_size,
       (points = keep_points and doc_id is not distinct from keep_id) as kept, sha256(norm) as text_sha256
from g
"""

OP2_SQL = r"""
with d as (
  select *, md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || size) as key
  from (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents) q
), s as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source asc nulls last) as k
  from d group by source
), w as (
  select source, source_size, 3 * source_size as cap,
         case (k - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from s
), f as (
  select *, cap / weight as fill, sum(source_size) over () as total,
         coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as caps,
         sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as rest
  from w
), l as (
  select *, cast(total - caps as double) / rest as level from f
), m as (
  select *, (select level from l where fill > level order by fill, source asc nulls last limit 1) as lvl from l
), t as (
  select source, source_size,
         case when lvl is null or fill <= lvl then cast(cap as double) else weight * lvl end as target
  from m
), p as (
  select d.doc_id, d.size, d.source, t.source_size, t.target,
         cast(floor(t.target + 0.5) as bigint) as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) end as bigint) as taken,
       source
from p
"""


OP5_SQL = r"""
with a as (
  select page_id, url, html, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
  from pages
), b as (
  select page_id, url, html,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') as host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
           lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid|phpsessid)(=.*)?$'))) as params
  from a
), c as (
  select page_id, html, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as url_key, url from b
), d as (
  select page_id, url_key, coalesce(url_key = regexp_replace(url, '^https?://', ''), false) as is_full,
         sha256(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as octets
  from c
), e as (
  select *, last_value(case when is_full then page_id end ignore nulls) over (partition by url_key order by page_id rows between unbounded preceding and 1 preceding) as o
  from d
), f as (
  select e.*, case when e.is_full then 'full' when o is null then 'no_response' when substr(e.digest, 1, 16) = substr(r.digest, 1, 16) then 'resolved' else 'mismatch' end as status,
         r.digest as o_digest, r.octets as o_octets
  from e left join d r on r.page_id = e.o
)
select page_id, url_key, status, case when status = 'resolved' then o end as refers_to,
       case status when 'full' then digest when 'resolved' then o_digest end as digest,
       case status when 'full' then 'content-length: ' || octets || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id
                   when 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || o_octets || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id end as headers
from f
"""


OP10_SQL = r"""
with t as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), p as (
  select r, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as win
  from (select r, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from t where len(ws) >= 50) q
), f as (
  select win, min(doc_id) as m from p group by win
), b as (
  select r, i from p join f using (win) where m < doc_id
), w as (
  select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from t
), g as (
  select w.r, w.word, w.j, count(b.i) over (partition by w.r order by w.j rows between 49 preceding and current row) > 0 as gone
  from w left join b on b.r = w.r and b.i = w.j
), k as (
  select r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by j) filter (where not gone) as kept from g group by r
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join k using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_warc_revisits": OP5_SQL, "op10_substring_dedup": OP10_SQL}
