"""Not-modified revisits of web captures, resolved by an as-of join to the latest earlier full response.

Only what the join needs travels (ids, validators, headers, digests; no payloads). A canonical URL's timeline is cut
into time slices; within a slice a window finds the latest response, and each slice is handed the last response of the
slices before it, so a URL with a third of all captures is still dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the time range that hold about as many captures each, and slices of equal width in each part.
PARTS, INNER = 64, 8
#: Header fields that a 304 response may update (RFC 9110, section 15.4.5); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and a closing slash; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)), r"&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, r"^&+", ""), r"^(.)", "?$1")
    return F.concat(host, F.regexp_replace(path, r"/$", ""), query)


def _slice_of(rows: DataFrame, parts: int) -> Column:
    """Number of a row's time slice, ascending with ``ts``: parts are cut at quantiles, so that no stray time stamp
    stretches more than its own part."""
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.percentile_approx("ts", [k / parts for k in range(1, parts)], 10_000).alias("cuts")).first()
    if span.lo is None:
        return F.lit(0)
    cuts = [span.lo, *span.cuts, span.hi + 1]
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    part = F.least(F.size(F.filter(edges, lambda c: c <= F.col("ts"))), F.lit(len(cuts) - 1))
    begin, end = F.get(edges, part - 1), F.get(edges, part)
    return part * INNER + F.least(F.floor((F.col("ts") - begin) * INNER / F.greatest(end - begin, F.lit(1))), F.lit(INNER - 1))


def resolve_revisits(records: DataFrame, slices: int = PARTS) -> DataFrame:
    """One row per revisit record: ``record_id``, ``canonical``, ``response_id``, ``status``, ``headers``, ``payload_digest``.

    ``records`` has ``record_id``, ``kind`` (response or revisit), ``uri``, ``ts`` (long), ``etag``, ``last_modified``,
    ``headers`` (map of lower-case names) and ``payload_digest``. A revisit is joined to the response with the greatest
    (``ts``, ``record_id``) among those of the same canonical URL with a strictly smaller ``ts``. ``status`` is
    ``resolved`` if the validators agree (etags under weak comparison where both have one, else last_modified where
    both have one), ``mismatch`` if they differ, ``unverified`` if none can be compared and ``no_response`` without an
    earlier response. Resolved revisits have the response's headers, overlaid with the revisit's permitted ones, and
    its payload digest; others have nulls. Rows with a null uri, ts or kind find nothing (``no_response``); other kinds
    are left out. Repeated revisits are each resolved; no rows give no rows.
    """
    columns = ["record_id", "kind", "ts", "etag", "last_modified", "headers", "payload_digest"]
    rows = records.select(canonical_url(F.col("uri")).alias("canonical"), *columns).where(F.col("kind").isin("response", "revisit"))
    rows = rows.where("kind = 'revisit' or (canonical is not null and ts is not null)")
    rows = rows.withColumn("slice", _slice_of(rows, slices))
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "payload_digest"))
    rows = rows.withColumn("r", response)
    last = rows.where("kind = 'response'").groupBy("canonical", "slice").agg(F.max("r").alias("r"))
    # each slice with revisits learns the last response of the slices before it
    wanted = rows.where("kind = 'revisit'").select("canonical", "slice").distinct().withColumn("r", F.lit(None).cast(last.schema["r"].dataType))
    before = Window.partitionBy("canonical").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("has", F.lit(True)).unionByName(wanted.withColumn("has", F.lit(False)))
    carried = carried.withColumn("carry", F.max("r").over(before)).groupBy("canonical", "slice").agg(F.max("carry").alias("carry"))
    within = Window.partitionBy("canonical", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max("r").over(within)).where("kind = 'revisit'").join(carried, ["canonical", "slice"], "left")
    found = found.withColumn("r", F.coalesce("near", "carry"))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    same_tag, same_date = weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified")
    status = F.when(F.col("r").isNull(), "no_response").when(same_tag.isNotNull(), F.when(same_tag, "resolved").otherwise("mismatch"))
    status = status.when(same_date.isNotNull(), F.when(same_date, "resolved").otherwise("mismatch")).otherwise("unverified")
    found = found.withColumn("status", status)
    ours = F.filter(F.map_entries(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: e["key"].isin(list(PERMITTED)))
    theirs = F.filter(F.coalesce(F.col("r.headers"), F.array()), lambda e: ~F.exists(ours, lambda o: o["key"] == e["key"]))
    merged = F.map_from_entries(F.array_sort(F.concat(theirs, ours)))
    ok = F.col("status") == "resolved"
    return found.select(
        "record_id", "canonical", F.col("r.record_id").alias("response_id"), "status",
        F.when(ok, merged).alias("headers"), F.when(ok, F.col("r.payload_digest")).alias("payload_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records derived from pages: each page is a full response, and is revisited once at a later time.

    Revisits carry the page's etag (every fifth a changed one, every seventh none but a date) and fresh header fields.
    """
    digest = F.md5("html")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), digest.alias("payload_digest"), F.concat(F.lit("day-"), (F.col("page_id") % 28).cast("string")).alias("last_modified"))
    full = base.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("kind"), "uri", (F.col("page_id") * 10).alias("ts"),
        F.concat(F.lit('"'), "payload_digest", F.lit('"')).alias("etag"), "last_modified",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), F.col("last_modified")).alias("headers"), "payload_digest",
    )
    tag = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), "payload_digest", F.lit('"')))
    again = base.select(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("kind"), "uri", (F.col("page_id") * 10 + F.col("page_id") % 100 * 1000 + 5).alias("ts"),
        tag.alias("etag"), "last_modified",
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("expires"), F.lit("never")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)
