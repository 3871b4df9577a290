"""Not-modified revisit resolution for crawl archives, in DataFrame functions.

A revisit record of the profile "server not modified" has headers but no
payload.  It is resolved by an as-of join to the latest earlier full response
of the same canonical URL; its validators must agree with that response's, and
the headers that a 304 answer may renew replace the response's.

The as-of join works in two steps, so that one URL with very many records is
not sorted in one task: within time buckets by a window, and across buckets by
carrying each bucket's last full response forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The headers that a 304 answer may renew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not name content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def _decoded(text: Column) -> Column:
    """Percent-escapes of letters, digits and ``-._~`` become these; the others get upper-case digits."""
    code = lambda p: F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
    plain = lambda p: F.chr(code(p)).rlike("^[A-Za-z0-9._~-]$")
    rest = lambda p: F.substring(p, F.lit(3), F.length(p))
    part = lambda p, i: F.when(i == 0, p).when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).when(plain(p), F.concat(F.chr(code(p)), rest(p))).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest(p)))
    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%", -1), part), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    walked = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(walked, "/")).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or its scheme's default port, no scheme or fragment, unescaped path without dot segments and last slash, no tracking parameters, sorted query."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = _without_dots(_decoded(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.transform(F.split(query, "&"), _decoded), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), tail)


def _validator(headers: str, name: str) -> Column:
    return F.regexp_replace(F.col(headers)[name], "^W/", "")


def resolve_revisits(records: DataFrame, *, bucket: int = 3600) -> DataFrame:
    """One row for each revisit record.

    ``records``: record_id, url, ts (long), kind (response or revisit), status,
    headers (map, names in lower case), has_payload.  A full response is a
    response of status 200 with a payload; of several at one time the one with
    the largest record_id is the latest, of several rows of one record the one
    whose sorted headers come last.  Strictly earlier ones count.

    Returns record_id, canonical, source_id, outcome (resolved,
    validator_mismatch, or no_response) and headers (merged if resolved, else
    the revisit's own).  Validators agree if no etag (weak comparison) or
    last-modified that both have differs, and at least one is shared.  Null
    urls or times resolve to nothing; null headers are null or none.  A revisit
    row that stands twice gives two equal rows, a response that does changes
    nothing.  ``bucket`` is the width of a time bucket; results do not depend on
    it.  URLs of any length are taken whole.  Other columns are ignored; no
    records give no rows.
    """
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("has_payload"), F.lit(False))
    headers = F.array_sort(F.map_entries("headers"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", F.coalesce(F.col("kind") == "revisit", F.lit(False)).alias("revisit"), full.alias("full"), headers.alias("h")).where("revisit OR full")
    known = rows.where("canonical IS NOT NULL AND ts IS NOT NULL").withColumn("tb", F.floor(F.col("ts") / bucket))
    mark = F.when(F.col("full"), F.struct("ts", "record_id", "h"))
    earlier = Window.partitionBy("canonical", "tb").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("found", F.max(mark).over(earlier)).where("revisit")
    buckets = known.groupBy("canonical", "tb").agg(F.max(mark).alias("last"))
    before = Window.partitionBy("canonical").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("canonical", "tb", F.max("last").over(before).alias("carried"))
    placed = inside.join(carried, ["canonical", "tb"], "left").select("record_id", "canonical", "h", F.coalesce("found", "carried").alias("source"))
    lost = rows.where("revisit AND (canonical IS NULL OR ts IS NULL)").select("record_id", "canonical", "h", F.lit(None).cast(placed.schema["source"].dataType).alias("source"))
    joined = placed.unionByName(lost).select("record_id", "canonical", F.col("source.record_id").alias("source_id"), F.col("source").isNotNull().alias("any"), F.map_from_entries("h").alias("new"), F.map_from_entries("source.h").alias("old"))
    agree, shared = F.lit(True), F.lit(False)
    for name in ("etag", "last-modified"):
        a, b = _validator("new", name), _validator("old", name)
        agree = agree & F.coalesce(a == b, F.lit(True))
        shared = shared | (a.isNotNull() & b.isNotNull())
    fine = F.coalesce(agree & shared, F.lit(False))
    renewed = F.map_filter("new", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("old", lambda k, v: ~F.coalesce(F.map_contains_key(renewed, k), F.lit(False)))
    outcome = F.when(~F.col("any"), "no_response").when(fine, "resolved").otherwise("validator_mismatch")
    return joined.select("record_id", "canonical", "source_id", outcome.alias("outcome"), F.when(F.col("any") & fine, F.map_concat(kept, renewed)).otherwise(F.col("new")).alias("headers"))


#: Fixed values of the log that ``crawl_log`` makes: when a page is asked for again, by its id, after its first fetch (negative: before).
GAPS = (-3, 1, 29, 41, 20_001)


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl's records from page rows, with other spellings of each URL.

    A page is fetched at time ``2 * page_id`` (every eleventh fetch fails) and,
    changed, 31 later, and asked for again, if modified, after one of ``GAPS``.
    Revisits send the etag of the first or the second version, the first
    version's last-modified, an outdated etag or no validator.  Pages without
    html are responses without a payload.
    """
    page = F.col("page_id").cast("long")
    etag = lambda text: F.concat(F.lit('"'), F.substring(F.md5(text), 1, 16), F.lit('"'))
    day = lambda t: F.concat(F.lit("day "), t.cast("string"))
    first, second = 2 * page, 2 * page + 31
    again = first + F.element_at(F.array(*map(F.lit, GAPS)), (F.pmod(page, F.lit(len(GAPS))) + 1).cast("int"))
    tags = etag(F.col("html")), etag(F.concat("html", F.lit("changed")))

    def response(n: int, at: Column, tag: Column, status: Column) -> Column:
        headers = F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("last-modified"), day(at), F.lit("date"), day(at),
            F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.length("html").cast("string"),
        )
        return F.struct((3 * page + n).alias("record_id"), F.col("url"), at.alias("ts"), F.lit("response").alias("kind"), status.alias("status"), headers.alias("headers"), (F.col("html").isNotNull() & (status == 200)).alias("has_payload"))

    ok, failed = F.lit(200), F.when(F.pmod(page, F.lit(11)) == 5, 503).otherwise(200)
    sent = F.pmod(page, F.lit(7))
    weak = F.concat(F.lit("W/"), F.when(sent < 3, tags[0]).otherwise(tags[1]))
    validator = F.when(sent < 5, F.create_map(F.lit("etag"), weak)).when(sent == 5, F.create_map(F.lit("last-modified"), day(first))).otherwise(F.create_map(F.lit("etag"), F.lit('"outdated"')))
    validator = F.when(F.pmod(page, F.lit(13)) == 0, F.create_map().cast("map<string,string>")).otherwise(validator)
    own = F.map_concat(validator, F.create_map(F.lit("date"), day(again), F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit")))
    # the same address otherwise written: a fragment, a dot segment, escaped letters, capitals in the host
    path = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^([a-z]+://[^/?]+)/", "$1/./x/../")
    spelt = F.when(F.pmod(page, F.lit(2)) == 0, F.regexp_replace(path, "^(.*/)e", "$1%65")).otherwise(F.regexp_replace(path, "^http", "HTTP"))
    revisit = F.struct((3 * page + 2).alias("record_id"), F.concat(spelt, F.lit("#again")).alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), own.alias("headers"), F.lit(False).alias("has_payload"))
    kinds = F.explode(F.array(response(0, first, tags[0], failed), response(1, second, tags[1], ok), revisit))
    return pages.where("page_id IS NOT NULL").select(kinds.alias("r")).select("r.*")


def sql() -> str:
    """DuckDB SQL of ``resolve_revisits(crawl_log(pages))`` with headers as a sorted list of name=value."""
    bare = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    tag = lambda t: f"""'"' || substr(md5({t}), 1, 16) || '"'"""
    gaps = ", ".join(map(str, GAPS))
    return rf"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {bare} AS bare, html FROM pages WHERE page_id IS NOT NULL),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^({TRACKING})(=|$)'))) AS q FROM p),
u AS (SELECT page_id, html, {tag('html')} AS tag1, {tag("html || 'changed'")} AS tag2,
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE ' ' END, '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
full_responses AS (
  SELECT 3 * page_id AS id, canonical, 2 * page_id AS ts, tag1 AS tag, length(html) AS size FROM u WHERE html IS NOT NULL AND page_id % 11 <> 5
  UNION ALL SELECT 3 * page_id + 1, canonical, 2 * page_id + 31, tag2, length(html) FROM u WHERE html IS NOT NULL),
revisits AS (SELECT 3 * page_id + 2 AS id, canonical, 2 * page_id + ([{gaps}])[page_id % {len(GAPS)} + 1] AS ts,
  CASE WHEN page_id % 13 = 0 OR page_id % 7 = 5 THEN NULL WHEN page_id % 7 < 3 THEN 'W/' || tag1 WHEN page_id % 7 < 5 THEN 'W/' || tag2 ELSE '"outdated"' END AS sent,
  CASE WHEN page_id % 13 <> 0 AND page_id % 7 = 5 THEN 'day ' || (2 * page_id) END AS since FROM u),
j AS (SELECT r.*, s.id AS source, s.ts AS source_ts, s.tag, s.size, coalesce(replace(r.sent, 'W/', '') = s.tag, r.since = 'day ' || s.ts, false) AS fine
  FROM revisits r ASOF LEFT JOIN full_responses s ON r.canonical = s.canonical AND r.ts > s.ts)
SELECT id AS record_id, canonical, source AS source_id, CASE WHEN source IS NULL THEN 'no_response' WHEN fine THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
  CASE WHEN fine THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=day ' || ts || ';etag=' || coalesce(sent, tag) || ';last-modified=day ' || source_ts
       ELSE 'content-length=0;date=day ' || ts || coalesce(';etag=' || sent, '') || coalesce(';last-modified=' || since, '') || ';x-cache=hit' END AS headers
FROM j"""
