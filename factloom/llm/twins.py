"""The parts of the operators that SQL can say, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, pii, urls
from .common import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where base phrases stand: op5_licenses without the method's own labels."""
    base, starts = F.col("base"), F.transform("base", lambda p: p["start"])
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), licenses.label_list(base).alias("base_labels"))


LICENSES_SQL = f"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
ends as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'license' and i > 1 and (w[i - 1] in ('mit', 'apache') or (i > 2 and w[i - 1] = 'public' and w[i - 2] = 'general'))) as ends_at from words),
starts as (select doc_id, len(w) as n_words, list_transform(ends_at, lambda i: case when w[i - 1] = 'public' then i - 3 else i - 2 end) as s, list_transform(ends_at, lambda i: case when w[i - 1] = 'public' then 'gpl' else w[i - 1] end) as labels from ends)
select doc_id, n_words, len(s) as n_base, list_min(s) as first_word, list_max(s) as last_word, array_to_string(list_sort(list_distinct(labels)), ',') as base_labels from starts
"""


def pii_base_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base matches by kind and a digest of their texts: op8_pii without places and added kinds."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    texts = lambda kind: F.transform(own(kind), lambda s: F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    kinds = [k.name for k in pii.KINDS if k.base]
    return found.select("doc_id", *[F.size(own(k)).cast("bigint").alias(f"n_{k}") for k in kinds], F.sha2(F.array_join(F.concat(*[texts(k) for k in kinds]), "|"), 256).alias("texts_sha256"))


PII_SQL = r"""
with proposed as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email,
    regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ips,
    regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+') as cards, regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') as phones
  from documents),
digits as (select *, list_transform(cards, lambda c: regexp_replace(c, '[^0-9]', '', 'g')) as plain from proposed),
checked as (
  select doc_id, email, list_filter(ips, lambda m: list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(try_cast(p as hugeint) <= 255, false)))) as ip,
    list_filter(cards, lambda m, i: len(plain[i]) between 13 and 19 and
      list_sum(list_transform(range(1, len(plain[i]) + 1), lambda k: case when k % 2 = 1 then cast(substr(plain[i], len(plain[i]) + 1 - k, 1) as int)
        when cast(substr(plain[i], len(plain[i]) + 1 - k, 1) as int) > 4 then 2 * cast(substr(plain[i], len(plain[i]) + 1 - k, 1) as int) - 9
        else 2 * cast(substr(plain[i], len(plain[i]) + 1 - k, 1) as int) end)) % 10 = 0) as card,
    list_filter(phones, lambda m: len(regexp_replace(m, '[^0-9]', '', 'g')) between 9 and 15) as phone
  from digits)
select doc_id, len(email) as n_email, len(ip) as n_ip, len(card) as n_card, len(phone) as n_phone,
  sha256(array_to_string(list_concat(list_concat(email, ip), list_concat(card, phone)), '|')) as texts_sha256
from checked
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9_mixing, without the drawn copies."""
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


# the level at which limited shares add up is found among the points where a source reaches its limit
MIXING_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select *, (row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 as weight from per),
points as (select 0.0 as pt union select 3.0 * source_size / weight from weighed),
reached as (select pt, sum(least(3.0 * source_size, pt * weight)) as taken, sum(case when 3.0 * source_size / weight > pt then weight else 0 end) as rest from points, weighed group by pt),
below as (select * from reached where taken <= (select sum(source_size) from weighed) order by pt desc limit 1),
level as (select pt + case when rest > 0 then ((select sum(source_size) from weighed) - taken) / rest else 0 end as level from below)
select doc_id, size, source_size, round(least(3.0 * source_size, level * weight), 3) as target
from sized join weighed on sized.source is not distinct from weighed.source, level
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op10_urls, and the rule's verdict; null where only reputation decides."""
    found = urls.judge_urls(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


URLS_SQL = rf"""
with parts as (select page_id,
    case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
rules(of, start, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (select page_id, arg_max(of || start, length(of || start)) as rule, arg_max(verdict, length(of || start)) as rule_verdict
  from parts, rules where (host = of or ends_with(host, '.' || of)) and starts_with(path, start) group by page_id)
select page_id, host, path, rule, rule_verdict from parts left join fits using (page_id)
"""

TWINS = {license_base_places: LICENSES_SQL, pii_base_matches: PII_SQL, mixing_targets: MIXING_SQL, url_rules: URLS_SQL}
