"""Not-modified revisits of web captures, resolved against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.common import cut

#: Fixed names: parameters that do not tell pages apart, and headers that a not-modified answer must not change.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sid)(=|$)"
NOT_MERGED = ("content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade")
VALIDATORS = ("etag", "last-modified", "payload-digest")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www``, default ports, fragment and closing slashes; the host in lower case,
    query parameters sorted and without tracking ones."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(plain, r"^[^/?]*", 0)
    rest = F.substr(plain, F.length(host) + 1)
    name = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    parts = F.filter(F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(parts), "&")
    return F.concat(name, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """For every revisit the response it stands for: (record_id, url_key, time, state, response_id, headers, payload).

    ``records`` has ``record_id`` long, ``url`` string, ``time`` long, ``kind`` (``response`` or ``revisit``),
    ``headers`` map with lower-case names, ``payload`` string. A revisit belongs to the full response of the same
    canonical URL with the latest time strictly before its own (of equal times that with the largest id). It is
    ``resolved`` if at least one validator is in both and all that are in both agree (weak and strong etags
    alike), ``changed`` if one differs, ``no_validator`` if none is in both, ``no_response`` without an earlier
    response. If resolved, it gets the response's payload and headers, with its own headers over them except
    those that describe the body or the connection; otherwise its own headers and a null payload.

    Records are dealt by ranges of (URL, time), so the captures of one URL may lie in many tasks; the latest response of each
    task and URL is handed on to the later tasks. Records without a URL or time are ``no_response`` if revisits, and answer
    nothing. Repeated revisits each get a row; of responses with one id any is taken. Extra columns are not read.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "time", "kind", "headers", "payload")
    narrow = named.select("record_id", "url_key", "time", (F.col("kind") == "response").alias("full")).where("kind in ('response', 'revisit')")
    known = narrow.where("url_key is not null and time is not null")
    dealt = cut(known.repartitionByRange("url_key", "time").withColumn("task", F.spark_partition_id()))
    capture = F.when(F.col("full"), F.struct("time", "record_id"))
    inside = Window.partitionBy("task", "url_key").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.max(capture).over(inside)).where("not full")
    latest = dealt.groupBy("url_key", "task").agg(F.max(capture).alias("latest"))
    earlier = Window.partitionBy("url_key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    handed = latest.select("url_key", "task", F.max("latest").over(earlier).alias("handed")).where("handed is not null")
    found = near.join(handed, ["url_key", "task"], "left").select(
        "record_id", "url_key", "time", F.coalesce("near", "handed")["record_id"].alias("response_id")
    )
    lost = narrow.where("not full and (url_key is null or time is null)").select("record_id", "url_key", "time", F.lit(None).cast("long").alias("response_id"))
    own = named.where("kind = 'revisit'").groupBy("record_id").agg(F.first("headers").alias("own"))
    full = named.where("kind = 'response'").groupBy("record_id").agg(F.first(F.struct("headers", "payload")).alias("r"))
    joined = (
        found.unionByName(lost)
        .join(own, "record_id")
        .join(full.select(F.col("record_id").alias("response_id"), "r"), "response_id", "left")
    )
    mine, its = F.coalesce("own", F.create_map().cast("map<string,string>")), F.coalesce("r.headers", F.create_map().cast("map<string,string>"))
    pairs = [(_validator(mine, v), _validator(its, v)) for v in VALIDATORS]
    both = F.array(*[a.isNotNull() & b.isNotNull() for a, b in pairs])
    differ = F.array(*[F.coalesce(a != b, F.lit(False)) for a, b in pairs])
    state = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(F.exists(differ, lambda x: x), "changed")
        .when(F.exists(both, lambda x: x), "resolved")
        .otherwise("no_validator")
    )
    allowed = F.map_filter(mine, lambda k, _: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(its, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    right = F.col("state") == "resolved"
    return joined.withColumn("state", state).select(
        "record_id",
        "url_key",
        "time",
        "state",
        "response_id",
        F.when(right, F.map_concat(kept, allowed)).otherwise(mine).alias("headers"),
        F.when(right, F.col("r.payload")).alias("payload"),
    )


def _validator(headers: Column, name: str) -> Column:
    value = F.try_element_at(headers, F.lit(name))
    return F.regexp_replace(value, "^W/", "") if name == "etag" else value
