"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsight.llm import (
    hilbert_clusters, lempel_ziv_dedup, licence_scan, link_rank, merkle_manifest, packing, personal_data, phrase_index,
    projected_neighbours, secret_scan, simhash_dedup, toxicity, warc,
)
from sparsight.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        def call(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = call
        if sql:
            SQL[function.__name__] = sql
        return call

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op2_simhash_near_dedup(spark, folder):
    found = simhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_ASCII_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(coalesce({_ASCII_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(_OP9_SQL)
def op9_benchmark_decontamination(spark, folder):
    found = phrase_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.withColumn("n_hit", phrase_index.covered(F.col("starts"), F.col("ends"))).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), first AS (SELECT t, min(doc_id) AS f FROM win GROUP BY t
), gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (t) WHERE f < doc_id)
), cut AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n_removed
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) k
  LEFT JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query(_OP10_SQL)
def op10_substring_dedup(spark, folder):
    parsed = lempel_ziv_dedup.factors(table(spark, folder, "documents"))
    return lempel_ziv_dedup.without_factors(parsed).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op5_packing(spark, folder):
    pieces = packing.packed(table(spark, folder, "documents"), public_tokenizers.path(packing.TOKENIZER))
    return packing.digests(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query()
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity.trained(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, net).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op4_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.secret_spans(docs)
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    count = [F.size(of(k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.PATTERNS))
    return found.select(
        "doc_id", *count, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


_RANKS = "\n".join(
    f""", {k}{i} AS (SELECT host, sum(r) AS r FROM (
  SELECT {e}b AS host, r * share * 0.85 AS r FROM {k}{i - 1} JOIN {e} ON {e}a = host
  UNION ALL SELECT host, seed * (1 - 0.85) FROM {k}s) GROUP BY host)"""
    for k, e in (("t", "f"), ("d", "g")) for i in range(1, link_rank.ROUNDS + 1)
)
_OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, html, {_ASCII_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, host, path, html,
    (SELECT max_by({{'rule': h || r.p, 'verdict': verdict}}, length(h || r.p)) FROM rules r
     WHERE (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, r.p)) AS x FROM p
), links AS (
  SELECT host AS a, {_ASCII_LOWER.format("b")} AS b, count(*) AS w FROM (
    SELECT host, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)) AS b
    FROM fit) GROUP BY 1, 2
), family AS (
  SELECT host AS a, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS b
  FROM (SELECT host FROM fit UNION SELECT b FROM links)
), e AS (
  SELECT a, b, CAST(sum(w) AS DOUBLE) AS w FROM (
    SELECT a, b, w FROM links UNION ALL SELECT a, b, 1 FROM family WHERE b <> ''
    UNION ALL SELECT b, a, 1 FROM family WHERE b <> '') WHERE a <> b AND a <> '' AND b <> '' GROUP BY a, b
), f AS (SELECT a AS fa, b AS fb, w / sum(w) OVER (PARTITION BY a) AS share FROM e
), g AS (SELECT b AS ga, a AS gb, w / sum(w) OVER (PARTITION BY b) AS share FROM e
), ts AS (SELECT host, count(*) / (SELECT count(*) FROM fit WHERE x.verdict = 'allow')::DOUBLE AS seed
  FROM fit WHERE x.verdict = 'allow' AND host <> '' GROUP BY host
), ds AS (SELECT host, count(*) / (SELECT count(*) FROM fit WHERE x.verdict = 'block')::DOUBLE AS seed
  FROM fit WHERE x.verdict = 'block' AND host <> '' GROUP BY host
), t0 AS (SELECT host, seed AS r FROM ts), d0 AS (SELECT host, seed AS r FROM ds)
{_RANKS}
SELECT page_id, fit.host, path, x.rule AS rule,
  coalesce(x.verdict, CASE WHEN coalesce(d.r, 0) > 0.5 * (coalesce(t.r, 0) + coalesce(d.r, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit LEFT JOIN t{link_rank.ROUNDS} t ON t.host = fit.host LEFT JOIN d{link_rank.ROUNDS} d ON d.host = fit.host
"""


@query(_OP6_SQL)
def op6_url_filter(spark, folder):
    return link_rank.verdicts(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op1_projected_neighbours(spark, folder):
    return projected_neighbours.nearest(table(spark, folder, "embeddings"))


# Captures derived from pages, written as WARC files and read back: each page is
# answered in full once, and asked for again later, with another spelling of its URL, by a request that finds it unchanged
# or, for one page in seven, that has another entity tag.
_OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS tag, page_id * 60 AS t, (page_id * 7919) % 2000 * 60 AS gap FROM pages
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]*://[^/?#]*')), '(:80|:443)$', ''), '$', '')
    || CASE WHEN regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) END
    || regexp_extract(url, '^[^:]*://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS key FROM p
), v AS (SELECT page_id, key, t + gap AS t, CASE WHEN page_id % 7 = 0 THEN 'other' ELSE tag END AS tag FROM k
), j AS (
  SELECT v.page_id, v.t, v.tag, max_by(k.page_id, k.t) AS target, max_by(k.tag, k.t) AS target_tag
  FROM v LEFT JOIN k ON k.key = v.key AND k.t < v.t GROUP BY v.page_id, v.t, v.tag
)
SELECT page_id, target AS target_page,
  CASE WHEN target IS NULL THEN 'unmatched' WHEN tag = target_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN target IS NOT NULL AND tag = target_tag THEN
    'content-type=text/html,date=' || CAST(t AS VARCHAR) || ',etag="' || tag || '"' END AS headers
FROM j
"""


@query(_OP3_SQL)
def op3_warc_revisits(spark, folder):
    pages = table(spark, folder, "pages")
    tag = F.md5("html")
    seconds = F.col("page_id") * 60
    later = seconds + F.col("page_id") * 7919 % 2000 * 60
    headers = lambda *x: F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in x))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    responses = pages.select(
        F.col("page_id").cast("string").alias("record_id"), F.lit("response").alias("kind"), "url",
        F.timestamp_seconds(seconds).alias("at"), F.lit(200).alias("status"),
        headers("content-type", "text/html", "date", seconds.cast("string"), "etag", quoted(tag)).alias("headers"),
        F.col("html").alias("body"),
    )
    revisits = pages.select(
        F.concat(F.lit("again-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.col("url"), F.lit("#again")).alias("url"), F.timestamp_seconds(later).alias("at"), F.lit(304).alias("status"),
        headers(
            "content-length", "0", "date", later.cast("string"),
            "etag", F.concat(F.lit("W/"), quoted(F.when(F.col("page_id") % 7 == 0, "other").otherwise(tag))),
        ).alias("headers"), F.lit("").alias("body"),
    )
    path = scratch_path(spark, "captures")
    warc.write_warc(responses.unionByName(revisits), path, "gzip")
    captures = warc.read_warc(spark, path).where("not damaged")
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return warc.resolve(captures).select(
        F.regexp_replace("record_id", "again-", "").cast("bigint").alias("page_id"),
        F.col("target_id").cast("bigint").alias("target_page"), "outcome",
        F.when(F.col("headers").isNotNull(), F.regexp_replace(F.concat_ws(",", entries), "W/", "")).alias("headers"),
    )


@query()
def op7_licence_scan(spark, folder):
    return licence_scan.notices(table(spark, folder, "documents"))


_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "text")
) + ")"
_COLUMNS = {c: c for c in ("doc_id", "source", "lang", "n_chars", "text")}


def _levels_sql(name: str, group: str, levels: int) -> str:
    """Levels of a binary tree above ``{name}0`` (group, i, h); a group of one node stays as it is."""
    return "\n".join(
        f""", {name}{n + 1} AS MATERIALIZED (
  SELECT {group}, CASE WHEN m = 1 THEN i ELSE i // 2 END AS i, CASE WHEN min(m) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {name}{n}) GROUP BY {group}, m, CASE WHEN m = 1 THEN i ELSE i // 2 END)"""
        for n in range(levels)
    )


def _fold_sql(name: str, tree: str, group: str, levels: int) -> str:
    """Folds of ``{name}0`` (doc_id, g, place, i, own, new, proof) up the levels of a tree."""
    return "\n".join(
        f""", {name}{n + 1} AS MATERIALIZED (
  SELECT f.* EXCLUDE (i, new, proof), f.i // 2 AS i, f.proof || coalesce(s.h, '') AS proof,
    CASE WHEN k.m = 1 THEN new WHEN s.h IS NULL THEN sha256(new) WHEN f.i % 2 = 0 THEN sha256(new || s.h) ELSE sha256(s.h || new) END AS new
  FROM {name}{n} f JOIN (SELECT {group} AS kg, count(*) AS m FROM {tree}{n} GROUP BY 1) k ON kg = f.{group}
  LEFT JOIN {tree}{n} s ON s.{group} = f.{group} AND s.i = xor(f.i, 1))"""
        for n in range(levels)
    )


#: levels that the SQL follows: tables of up to a million rows and 64 groups
_DEEP, _WIDE = 20, 6
_OP11_SQL = f"""
WITH RECURSIVE crcs(b, k, c) AS (
  SELECT CAST(b AS BIGINT), 0, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crcs WHERE k < 8
), crc AS MATERIALIZED (SELECT b, c FROM crcs WHERE k = 8), crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc
), d AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '') AS g, {_LEAF.format(**_COLUMNS)} AS leaf,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda acc, x: xor(acc >> 8, t[xor(acc % 256, x) + 1])), 4294967295) AS crc
  FROM documents, crc_table
), n AS MATERIALIZED (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS own,
    CASE WHEN crc % 7 = 0 THEN {_LEAF.format(**_COLUMNS | {"n_chars": "n_chars + 1"})} ELSE leaf END AS new
  FROM d
), l0 AS MATERIALIZED (SELECT g, i, own AS h FROM n)
{_levels_sql("l", "g", _DEEP)}
, subroots AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS place, h AS subroot FROM l{_DEEP}
), u0 AS MATERIALIZED (SELECT 0 AS z, place AS i, subroot AS h FROM subroots)
{_levels_sql("u", "z", _WIDE)}
, f0 AS MATERIALIZED (SELECT *, '' AS proof FROM n)
{_fold_sql("f", "l", "g", _DEEP)}
, v0 AS MATERIALIZED (SELECT f.doc_id, f.own, f.new, f.proof, s.subroot, s.place AS i, 0 AS z FROM f{_DEEP} f JOIN subroots s USING (g))
{_fold_sql("v", "u", "z", _WIDE)}
SELECT doc_id, own AS leaf, subroot, u{_WIDE}.h AS root, sha256(proof) AS proof_sha256, new AS folded_root, new = u{_WIDE}.h AS verified
FROM v{_WIDE}, u{_WIDE}
"""


@query(_OP11_SQL)
def op11_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [(F.col("n_chars").cast("decimal(20,0)") + 1) if i == 3 else f for i, f in enumerate(fields)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        "doc_id", merkle_manifest.group_key(F.col("lang")).alias("g"), merkle_manifest.leaf(fields).alias("leaf"),
        F.when(tampered, merkle_manifest.leaf(more)).alias("changed"),
    )
    tree = merkle_manifest.manifest(rows, [F.col("doc_id").asc_nulls_first()])
    changes = tree.leaves.withColumn("new", F.coalesce("changed", "leaf")).drop("changed")
    text = lambda c: F.lower(F.hex(c))
    return merkle_manifest.folded(tree, changes).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def _round_sql(n: int) -> str:
    return f""", n{n} AS MATERIALIZED (
  SELECT key, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT key, c, list_sum(list_transform(list_zip(v, y), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d FROM p, c{n}) GROUP BY key
)"""


_OP12_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {hilbert_clusters.DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {hilbert_clusters.DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS y FROM p ORDER BY sha256('3:' || vec_id) LIMIT {hilbert_clusters.CLUSTERS}
)
""" + "\n".join(
    _round_sql(n) + f""", c{n + 1} AS MATERIALIZED (
  SELECT c, list(coalesce(m, y) ORDER BY i) AS y FROM (
    SELECT c, i, y[i] AS y FROM (SELECT c, y, unnest(range(1, {hilbert_clusters.DIMENSIONS + 1})) AS i FROM c{n}))
  LEFT JOIN (
    SELECT c, i, CAST((s - (((s % k) + k) % k)) // k AS BIGINT) AS m FROM (
      SELECT c, i, sum(x) AS s, count(*) AS k FROM (
        SELECT n{n}.c, unnest(range(1, {hilbert_clusters.DIMENSIONS + 1})) AS i, unnest(v) AS x FROM p JOIN n{n} USING (key)
      ) GROUP BY c, i)
  ) USING (c, i) GROUP BY c
)"""
    for n in range(hilbert_clusters.ROUNDS)
) + _round_sql(hilbert_clusters.ROUNDS) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM p JOIN n{hilbert_clusters.ROUNDS} USING (key) JOIN c{hilbert_clusters.ROUNDS} USING (c)
"""


@query(_OP12_SQL)
def op12_hilbert_clusters(spark, folder):
    found, centroids = hilbert_clusters.clusters(table(spark, folder, "embeddings"))
    names = F.array(*(F.lit(",".join(map(str, c))) for c in centroids.tolist())).cast("array<string>")
    return found.withColumn("centroid_sha256", F.sha2(F.get(names, F.col("cluster")), 256))


@query()
def op13_personal_data(spark, folder):
    found = personal_data.personal_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}")
        for k, name in enumerate(personal_data.KINDS)
    ]
    return found.select(
        "doc_id", *count, F.sha2(personal_data.joined(base), 256).alias("base_sha256"),
        personal_data.joined(F.col("spans")).alias("spans"),
    )
