"""Not-modified revisits of a web archive, resolved to the responses that they stand for.

A revisit (304) is joined as of its time to the latest earlier full response of its canonical URL. It stands for that response only if the validators agree. The
result has the stored headers with those replaced that a 304 may carry. Bodies do not travel: resolved_id says where the body is.

Records of one URL are cut into chunks by time. Inside a chunk a sorted window finds the latest response; for the rest each chunk's last response is carried
forward over the chunks, a short list for each URL. So a URL that holds a third of all records is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.store import shuffle_partitions

# fixed values: headers of a 304 that update a stored response, and query parameters that only track
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, `www.`, tracking parameters and closing slashes; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.sort_array(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, resolved_id, status and headers of every revisit.

    records: record_id, url, fetched (long), kind (response or revisit; others are passed over), headers (map with lower-case names). status: resolved,
    validator mismatch, no validator, no earlier response, no url; resolved_id and merged headers only where resolved, else NULL and the revisit's own. Entity
    tags are compared weakly; modification times only where either side has no tag. Earlier means a lesser `fetched`; of equal ones the greater
    record_id counts; a NULL time comes before all. Repeated revisits each get their result. An empty table gives an empty table; other columns are not read.
    """
    rows = records.where("kind in ('response', 'revisit')").select("record_id", "fetched", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), canonical_url(F.col("url")).alias("canonical_url"))
    lost = rows.where("canonical_url is null and kind = 'revisit'").select("record_id", "canonical_url", F.lit(None).cast("long").alias("resolved_id"), F.lit("no url").alias("status"), "headers")
    # by where most times lie, so a few far ones do not widen the chunks; those go to the first or the last chunk, NULL before them
    low, high = rows.agg(F.percentile_approx("fetched", [0.01, 0.99], 1000).alias("at")).first()["at"] or (0, 0)
    chunks = 4 * shuffle_partitions(records.sparkSession)
    width = (high - low) // chunks + 1
    chunk = F.when(F.col("fetched").isNull(), -2).otherwise(F.greatest(F.lit(-1), F.least(F.lit(chunks), F.floor((F.col("fetched") - low) / width))))
    stored = F.when(F.col("kind") == "response", F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers")))
    rows = rows.where("canonical_url is not null").withColumns({"chunk": chunk, "stored": stored})
    inside = Window.partitionBy("canonical_url", "chunk").orderBy(F.col("fetched").asc_nulls_first(), F.desc("kind"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("found", F.last("stored", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    ends = rows.groupBy("canonical_url", "chunk").agg(F.max_by("stored", F.when(F.col("stored").isNotNull(), F.struct("fetched", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("canonical_url", "chunk", F.last("last", ignorenulls=True).over(before).alias("carried"))
    both = near.join(ends.hint("merge"), ["canonical_url", "chunk"]).withColumn("found", F.coalesce("found", "carried"))
    mine, theirs = F.col("headers"), F.col("found.headers")
    tags, times = (mine["etag"], theirs["etag"]), (mine["last-modified"], theirs["last-modified"])
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), _weak(tags[0]) == _weak(tags[1])).when(times[0].isNotNull() & times[1].isNotNull(), times[0] == times[1]).otherwise(False)
    status = F.when(F.col("found").isNull(), "no earlier response").when(tags[0].isNull() & times[0].isNull(), "no validator").when(agree, "resolved").otherwise("validator mismatch")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    out = both.withColumn("status", status)
    done = F.col("status") == "resolved"
    found = out.select("record_id", "canonical_url", F.when(done, F.col("found.id")).alias("resolved_id"), "status", F.when(done, merged).otherwise(F.col("headers")).alias("headers"))
    return found.unionByName(lost)
