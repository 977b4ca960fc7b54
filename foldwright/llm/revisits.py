"""Operator 2: not-modified revisits resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table, text_of

#: Headers that a 304 answer may carry and that then replace the stored ones (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
#: Time is cut into so many ranges of about equal rows, so that one URL's captures spread over as many tasks.
RANGES = 256


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., no scheme, fragment, tracking parameters, default page or trailing slash."""
    url = F.regexp_replace(F.trim(text_of(url)), r"#.*$", "")
    url = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^/?]*([^?]*)", 1), r"(\.html?|/)+$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lowered_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that then clash, the first in order of the names stays."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.expr("CAST(map() AS map<string,string>)"))))
    pairs = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, 1, i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(first)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row a revisit: response_id, status and merged headers.

    ``captures`` has id, url, time (long), kind ('response' or 'revisit') and headers (map). A revisit is joined with
    the latest response of its canonical URL that is strictly earlier in (time, id). Status: 'no_response' if there is
    none; 'mismatch' if both have an etag, else both a last-modified, and they differ (weak tags compare without W/);
    'unverified' if they share no validator; else 'resolved'. Merged headers are those of the response, with the
    permitted ones of the revisit in their place; null unless resolved or unverified. Null times are earliest; a null
    url is the empty one; a null id is smallest; other kinds are ignored; other columns do not matter. No captures, no
    rows. Each (URL, time range) is one window, and only the last response of each goes on to the next range.
    """
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "id", canonical_url(F.col("url")).alias("url"), F.coalesce(F.col("time").cast("long"), F.lit(-(2**63))).alias("time"), F.col("kind"), lowered_names(F.col("headers")).alias("headers")
    )
    rows = materialize(rows, "captures")
    cuts = rows.approxQuantile("time", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
    cuts = F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))) if cuts else F.expr("CAST(array() AS array<bigint>)")
    rows = rows.withColumn("span", F.size(F.filter(cuts, lambda c: c <= F.col("time"))))
    response = F.when(F.col("kind") == "response", F.struct("time", "id", "headers"))
    last = F.when(F.col("kind") == "response", F.struct("time", "id"))
    ends = rows.groupBy("url", "span").agg(F.max_by("headers", last).alias("h"), F.max(last).alias("at"))
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("at").isNotNull(), F.struct(F.col("at.time").alias("time"), F.col("at.id").alias("id"), F.col("h").alias("headers"))), ignorenulls=True)
    ends = ends.select(F.col("url").alias("u"), F.col("span").alias("s"), carried.over(before).alias("carried")).where("carried IS NOT NULL")
    order = Window.partitionBy("url", "span").orderBy(F.col("time"), F.col("id").asc_nulls_first(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(response, ignorenulls=True).over(order)).where("kind = 'revisit'")
    rows = rows.join(ends, (F.col("url") == F.col("u")) & (F.col("span") == F.col("s")), "left").withColumn("source", F.coalesce("near", "carried"))

    def tag(h: str, name: str) -> Column:
        return F.regexp_replace(F.element_at(F.col(h), name), r"^W/", "")

    old, new = tag("source.headers", "etag"), tag("headers", "etag")
    old_date, new_date = tag("source.headers", "last-modified"), tag("headers", "last-modified")
    status = (
        F.when(F.col("source").isNull(), "no_response")
        .when(old.isNotNull() & new.isNotNull(), F.when(old == new, "resolved").otherwise("mismatch"))
        .when(old_date.isNotNull() & new_date.isNotNull(), F.when(old_date == new_date, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    rows = rows.withColumn("status", status)
    allowed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("source.headers", lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.when(F.col("status").isin("resolved", "unverified"), F.map_concat(kept, allowed))
    return rows.select("id", "url", "time", F.col("source.id").alias("response_id"), "status", merged.alias("merged_headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as a crawl in order of page_id: two captures a page, a full one and a conditional one.

    A page whose URL has a query or fragment answers its first request not modified, with the tag of its own content,
    and is fetched in full right after; any other page is fetched in full first.
    """
    digest = F.md5(text_of("html"))
    lang = F.regexp_extract(text_of("html"), r'<html lang="([a-z]+)"', 1)
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Language"), lang, F.lit("ETag"), digest, F.lit("Content-Length"), F.octet_length(text_of("html")).cast("string"), F.lit("Date"), F.col("page_id").cast("string"))
    brief = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), digest), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.lit("0"))
    variant = F.col("url").rlike(r"[?#]")
    base = pages.select("page_id", "url", full.alias("full"), brief.alias("brief"), F.coalesce(variant, F.lit(False)).alias("variant"))
    one = F.struct(F.lit("response").alias("kind"), F.col("full").alias("headers"), (F.col("page_id") * 2 + F.col("variant").cast("int")).alias("time"))
    two = F.struct(F.lit("revisit").alias("kind"), F.col("brief").alias("headers"), (F.col("page_id") * 2 + 1 - F.col("variant").cast("int")).alias("time"))
    return base.select(F.col("page_id").alias("id"), "url", F.explode(F.array(one, two)).alias("c")).select("id", "url", "c.kind", "c.headers", "c.time")


def op2_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pairs = F.array_sort(F.map_entries("merged_headers"))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.col("id").alias("page_id"), "url", F.col("response_id").alias("response_page_id"), "status", flat.alias("merged_headers"))


_CLEAN = r"regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
OP2_SQL = rf"""
WITH p AS (
  SELECT page_id, {_CLEAN} AS u, md5(coalesce(html, '')) AS tag, regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) AS lang,
    strlen(coalesce(html, '')) AS bytes, CASE WHEN regexp_matches(coalesce(url, ''), '[?#]') THEN 1 ELSE 0 END AS variant FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '(\.html?|/)+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(u, '\?(.*)$', 1), '(^|&){TRACKING}=[^&]*', '', 'g'), '^&', '') AS query FROM p
), k AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM c
), found AS (
  SELECT r.page_id, r.url, r.tag, f.page_id AS response_page_id, f.tag AS old_tag, f.lang, f.bytes
  FROM k r LEFT JOIN k f ON f.url = r.url AND f.page_id * 2 + f.variant < r.page_id * 2 + 1 - r.variant
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) = 1
)
SELECT page_id, url, response_page_id,
  CASE WHEN response_page_id IS NULL THEN 'no_response' WHEN tag = old_tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN tag = old_tag THEN 'content-language=' || lang || ';content-length=' || bytes || ';content-type=text/html;date=' || page_id || ';etag=W/' || tag END AS merged_headers
FROM found
"""
