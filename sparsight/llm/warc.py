"""WARC records, and the resolution of revisits that say "not modified".

A revisit holds no content. Its content is that of the latest earlier full
response for the same canonical URL, if the validators agree; headers that a
304 answer may renew are taken from the revisit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparsight.session import materialize, shuffle_partitions

VERSION = "WARC/1.1\r\n"
BATCH_BYTES = 16 << 20
#: fixed values: headers that a 304 answer may renew in a stored response
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
FIELDS = "record_id string, kind string, url string, at timestamp, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path; null stays null."""
    part = lambda i: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    host = F.regexp_replace(F.lower(part(2)), r"^(.*?)(:80|:443|:)?$", "$1")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(part(1) == "", url).otherwise(F.concat(F.lower(part(1)), F.lit("://"), host, path, part(4)))


def block(record: dict[str, Column]) -> Column:
    """A record as WARC text, of ``record_id, kind, url, at, status, headers, body`` (a string)."""
    lines = F.array_join(F.transform(F.map_entries(record["headers"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    http = F.concat(F.lit("HTTP/1.1 "), record["status"].cast("string"), F.lit("\r\n"), lines, F.lit("\r\n"), record["body"])
    return F.concat(
        F.lit(VERSION), F.lit("WARC-Type: "), record["kind"], F.lit("\r\nWARC-Record-ID: <"), record["record_id"],
        F.lit(">\r\nWARC-Target-URI: "), record["url"], F.lit("\r\nWARC-Date: "),
        F.date_format(record["at"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("\r\nContent-Length: "),
        F.octet_length(http).cast("string"), F.lit("\r\n\r\n"), http,
    )


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one per task, of a table with the columns of ``block``; ``gzip`` makes each one a compressed stream."""
    named = {c: F.col(c) for c in ("record_id", "kind", "url", "at", "status", "headers", "body")}
    named["body"] = F.coalesce(named["body"].cast("string"), F.lit(""))
    records.select(block(named)).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_HEAD = re.compile(rb"[0-9.]+\r\n.*?\r\n\r\n", re.DOTALL)
_TYPE = re.compile(rb"(?im)^WARC-Type:")
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]+)")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``head, content, damaged`` from the pieces between version lines, in the order of each split of a file.

    A piece begins a record unless the one before still lacks content. One
    without a record's head, as the rest of content cut by a split, is none.
    """
    head, size, parts, held, split, rows, full = None, 0, [], 0, None, [], 0

    def done():
        if head is not None:
            content = b"WARC/".join(parts)
            rows.append((head, content[:size], len(content) < size))

    def batch_of(rows):
        head, content, damaged = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(head, pa.binary()), pa.array(content, pa.binary()), pa.array(damaged, pa.bool_())], ["head", "content", "damaged"]
        )

    for batch in batches:
        for piece, where in zip(batch.column("b").to_pylist(), batch.column("split").to_pylist()):
            if where == split and head is not None and held < size:
                parts.append(piece)
                held += len(b"WARC/") + len(piece)
                continue
            found = _HEAD.match(piece)
            done()
            head, split = None, where
            if found and _TYPE.search(found.group()):
                length = _LENGTH.search(found.group())
                head, size = found.group()[:-4], int(length.group(1)) if length else 0
                parts = [piece[found.end():]]
                held = len(parts[0])
                full += held
            if full > BATCH_BYTES:
                yield batch_of(rows) if rows else batch_of([(b"", b"", False)]).slice(1)
                rows, full = [], 0
    done()
    if rows:
        yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files of any version, compressed or not, with the columns of ``FIELDS``, and ``damaged``.

    Files are read as a stream and cut at version lines; the length that a
    record states says whether such a line is its own content. Uncompressed
    large files are split, compressed ones are not. Damaged is a record shorter
    than it says, also one whose content holds a version line at the very place
    where a large file is split. Header names are in lower case; of a repeated
    header the last counts. Empty files hold nothing.
    """
    raw = spark.read.option("lineSep", "WARC/").text(path).select(
        F.col("value").cast("binary").alias("b"), F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start").alias("split")
    )
    records = raw.mapInArrow(_records, "head binary, content binary, damaged boolean")
    head = F.col("head").cast("string")
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    http = F.substring_index(F.col("content").cast("string"), "\r\n\r\n", 1)
    lines = F.filter(F.split(http, "\r\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")
    ))
    # the last of each name
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return records.select(
        F.regexp_replace(field("WARC-Record-ID"), "^<|>$", "").alias("record_id"), field("WARC-Type").alias("kind"),
        field("WARC-Target-URI").alias("url"), F.try_to_timestamp(field("WARC-Date")).alias("at"),
        F.regexp_extract(http, r"^HTTP/[0-9.]+ ([0-9]+)", 1).try_cast("int").alias("status"),
        F.map_from_entries(last).alias("headers"),
        F.substring(F.col("content"), F.octet_length(http) + 5, F.octet_length("content")).alias("body"), "damaged",
    )


def _plain(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\s*W/", "")


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per revisit: ``record_id, url, at, target_id, target_at, outcome, headers``.

    ``records`` has ``record_id, kind, url, at, status, headers``. The target
    is the response with status 200 of the same canonical URL with the latest
    time before the revisit's, of equal times the largest id. ``outcome``:
    ``resolved`` where the validators agree (the entity tag, compared weakly,
    or without one the time of last modification), ``mismatch`` where they
    differ, ``unverified`` where the revisit has none, ``unmatched`` without a
    target. ``headers`` are the target's, renewed, where resolved. Null urls
    or times match nothing; repeated rows stay repeated.

    Contents are not moved. A URL with very many records is cut into slices of
    time, so that no task holds all of it; one row per slice carries over.
    """
    n = slices or shuffle_partitions(records.sparkSession)
    key = canonical(F.col("url"))
    time = F.unix_micros("at")
    light = materialize(records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "url", "at", "headers", key.alias("k"), time.alias("t"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
    ), "records")
    bounds = light.approxQuantile("t", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    cuts = F.array(*(F.lit(int(x)) for x in sorted(set(bounds)))).cast("array<bigint>")
    timed = light.withColumn("s", F.size(F.filter(cuts, lambda c: c <= F.col("t"))))
    offer = F.when(F.col("full") & F.col("t").isNotNull() & F.col("k").isNotNull(), F.struct("t", "record_id"))
    inside = Window.partitionBy("k", "s").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    events = timed.select("record_id", "kind", "url", "at", "headers", "k", "s", "t", offer.alias("offer"))
    carried = events.groupBy("k", "s").agg(F.max("offer").alias("top")).withColumn(
        "carry", F.max("top").over(Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    ).select("k", "s", "carry")
    found = events.withColumn("near", F.when(F.col("t").isNotNull(), F.max("offer").over(inside))).where("kind = 'revisit'")
    found = found.join(carried, ["k", "s"], "left").withColumn("target", F.coalesce("near", "carry"))
    kept = light.where("full").select(
        F.col("record_id").alias("target_id"), F.col("t").alias("target_t"), F.col("k").alias("target_k"),
        F.col("at").alias("target_at"), F.col("headers").alias("old"),
    ).dropDuplicates(["target_id", "target_t", "target_k"])
    joined = found.select("record_id", "url", "at", "headers", "k", "target.*").toDF(
        "record_id", "url", "at", "headers", "target_k", "target_t", "target_id"
    ).join(kept, ["target_id", "target_t", "target_k"], "left")
    new = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    old = F.coalesce("old", F.create_map().cast("map<string,string>"))
    tag, since = new["etag"], new["last-modified"]
    outcome = (
        F.when(F.col("target_id").isNull(), "unmatched")
        .when(tag.isNotNull(), F.when(_plain(tag).eqNullSafe(_plain(old["etag"])), "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(since.eqNullSafe(old["last-modified"]), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    renewed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "at", "target_id", "target_at", "outcome",
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
    )
