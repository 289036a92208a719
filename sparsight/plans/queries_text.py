"""Registered queries over the corpus: reading, filtering, tokens, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparsight.functions import text as tx
from sparsight.operators import filters, ordering, packing, tokens
from sparsight.plans import flows
from sparsight.plans.catalogue import (
    BODY, BOUNDED, DOCS, GOOD, LENGTHS, PLACED, TOKENS, VOCAB, WORDS, ids_text, query,
)
from sparsight.session import scratch_path
from sparsight.sources import corpus as sources, shards

# --- reading -----------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, length(text) AS n_read FROM documents")
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    return flows.documents(spark, folder).select(
        "doc_id", "lang", "source", "n_chars", F.length("text").alias("n_read")
    )


@query(f"""WITH {GOOD}
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN 'no text' ELSE 'kept' END AS status,
       CASE WHEN g.doc_id IS NULL THEN NULL ELSE md5(d.text) END AS digest
FROM docs d LEFT JOIN good g USING (doc_id)""")
def jsonl_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that fail the filter are written without their text."""
    path = scratch_path(spark, "jsonl")
    text = F.when(tx.is_strict(F.col("text")), F.col("text")).alias("text")
    shards.write_jsonl(flows.corpus(spark, folder).select("doc_id", text), path, ["doc_id", "text"])
    good, bad = sources.read_jsonl(spark, path)
    return good.select(
        "doc_id", F.lit("kept").alias("status"), F.md5("text").alias("digest")
    ).unionByName(
        bad.select("doc_id", F.col("reason").alias("status"), F.lit(None).cast("string").alias("digest"))
    )


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM documents)
WHERE i <= round((SELECT count(*) FROM documents) * 10 / 100.0)""")
def first_percent(spark: SparkSession, folder: str) -> DataFrame:
    docs = flows.corpus(spark, folder)
    splits = flows.document_splits(spark, folder)
    return sources.head_percent(docs, "doc_id", 10, splits).select("doc_id", "lang")


@query("SELECT doc_id, source, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = flows.documents(spark, folder)
    return sources.take_docs(docs, "doc_id", 100).select(
        "doc_id", "source", F.md5("text").alias("digest")
    )


@query("SELECT md5(text) AS digest, length(text) AS n FROM documents")
def jsonl_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export")
    shards.write_jsonl(flows.corpus(spark, folder), path)
    back = spark.read.schema("text string").json(path)
    return back.select(F.md5("text").alias("digest"), F.length("text").alias("n"))


# --- filters -----------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE t <> ''")
def nonblank_documents(spark: SparkSession, folder: str) -> DataFrame:
    return filters.nonblank(flows.corpus(spark, folder)).select("doc_id")


@query(f"WITH {BOUNDED} SELECT doc_id, source FROM good")
def good_documents(spark: SparkSession, folder: str) -> DataFrame:
    return filters.quality_good(flows.corpus(spark, folder)).select("doc_id", "source")


@query(rf"""WITH {DOCS} SELECT doc_id, source FROM docs
WHERE length(t) > 20 AND regexp_matches(t, '{tx.TWO_LETTERS}')
  AND upper(t) <> t AND NOT regexp_matches(t, '^\p{{N}}+$')""")
def strict_documents(spark: SparkSession, folder: str) -> DataFrame:
    return filters.quality_strict(flows.corpus(spark, folder)).select("doc_id", "source")


_RULES = rf"""rules AS (SELECT source, lang, t = '' AS r_blank, length(t) <= 20 AS r_short,
  length(t) >= 30000 AS r_long, NOT regexp_matches(t, '{tx.TWO_LETTERS}') AS r_letters,
  upper(t) = t AS r_upper, regexp_matches(t, '^\p{{N}}+$') AS r_num FROM docs)"""


_COUNTS = """count(*) AS n_docs, count(*) FILTER (r_blank) AS blank,
  count(*) FILTER (r_short) AS too_short, count(*) FILTER (r_long) AS too_long,
  count(*) FILTER (r_letters) AS few_letters, count(*) FILTER (r_upper) AS all_upper,
  count(*) FILTER (r_num) AS numeric,
  count(*) FILTER (NOT (r_short OR r_long OR r_upper OR r_num)) AS kept_good,
  count(*) FILTER (NOT (r_short OR r_letters OR r_upper OR r_num)) AS kept_strict"""


@query(f"WITH {DOCS}, {_RULES} SELECT source, {_COUNTS} FROM rules GROUP BY source")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return filters.quality_report(flows.corpus(spark, folder))


@query(f"""WITH {DOCS}, {_RULES}
SELECT source, lang, GROUPING(source, lang)::BIGINT AS grouping_id, {_COUNTS}
FROM rules GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def quality_cube(spark: SparkSession, folder: str) -> DataFrame:
    return filters.quality_cube(flows.corpus(spark, folder))


@query(f"""WITH {DOCS}
SELECT min(doc_id) AS doc_id FROM docs GROUP BY t""")
def exact_duplicates_removed(spark: SparkSession, folder: str) -> DataFrame:
    return filters.dedup_exact(flows.corpus(spark, folder)).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'es'")
def language_subset(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_language(flows.documents(spark, folder), "es").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7', 'src13')")
def source_subset(spark: SparkSession, folder: str) -> DataFrame:
    names = ["src1", "src7", "src13"]
    return filters.by_source(flows.documents(spark, folder), names).select("doc_id", "source")


@query(f"""WITH {TOKENS}
SELECT doc_id, tok_pos, token_id FROM toks WHERE token_id NOT IN (0, 1)""")
def special_tokens_dropped(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.token_rows(flows.sequences(spark, folder))
    return filters.drop_special(rows, flows.SPECIAL)


@query(f"""WITH {TOKENS}
SELECT doc_id, CASE WHEN tok_pos < 64 THEN tok_pos - 1 ELSE tok_pos END AS tok_pos, token_id
FROM toks WHERE token_id NOT IN (0, 1)""")
def kept_rank_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.token_rows(flows.sequences(spark, folder))
    return tokens.kept_rank(rows, flows.SPECIAL, flows.CHUNK)


# --- order, tokens -----------------------------------------------------------


@query(f"""WITH {GOOD}
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM good""")
def document_index(spark: SparkSession, folder: str) -> DataFrame:
    splits = flows.document_splits(spark, folder)
    docs = flows.good(spark, folder).select("doc_id")
    return ordering.index_documents(docs, splits=splits)


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1
  AS shuffled_idx FROM documents""")
def shuffled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.shuffle_index(flows.corpus(spark, folder).select("doc_id"))


def _epoch_sql(epoch: int) -> str:
    """Places by cubes modulo the next prime that leaves 2 when divided by 3, less the images of what lies above the table."""
    draw = lambda at: f"(('0x' || substr(sha256('42:{epoch}'), {2 * at + 1}, 16))::UBIGINT % p)::BIGINT"
    image = "((f * (((i + a) % p) * ((i + a) % p) % p * ((i + a) % p) % p) % p + b) % p)"
    return f"""(WITH size AS (SELECT count(*) AS n FROM documents),
  prime AS (SELECT n, (SELECT min(p) FROM (SELECT unnest(range(n + 1, n + 1000)) AS p) WHERE p % 3 = 2
    AND NOT EXISTS (SELECT 1 FROM range(2, CAST(sqrt(p) AS BIGINT) + 1) r(d) WHERE p % d = 0)) AS p FROM size),
  key AS (SELECT n, p, CASE WHEN {draw(0)} = 0 THEN 1 ELSE {draw(0)} END AS f, {draw(8)} AS a, {draw(16)} AS b FROM prime),
  holes AS (SELECT {image} AS h FROM key, (SELECT unnest(range(n, p)) AS i FROM key)),
  idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
  SELECT doc_id, {epoch}::BIGINT AS epoch, {image} - (SELECT count(*) FROM holes WHERE h < {image}) AS epoch_idx FROM idx, key)"""


@query(f"SELECT * FROM {_epoch_sql(0)} UNION ALL SELECT * FROM {_epoch_sql(1)}")
def epoch_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The places of all documents in two epochs; no sort, no list of places."""
    docs = flows.documents(spark, folder).select("doc_id")
    indexed = ordering.index_documents(docs, splits=flows.document_splits(spark, folder))
    n = docs.count()
    orders = [ordering.epoch_order(indexed, n, e).select("doc_id", F.lit(e).alias("epoch"), "epoch_idx") for e in (0, 1)]
    return orders[0].unionByName(orders[1])


_BUFFER = 100


@query("SELECT doc_id, true AS within_buffer FROM documents")
def buffer_shuffled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document once, none ahead of its place by the buffer or more."""
    mixed = ordering.buffer_shuffle(flows.documents(spark, folder).select("doc_id"), size=_BUFFER)
    place = F.row_number().over(Window.partitionBy("range").orderBy("doc_id")) - 1
    return mixed.select("doc_id", (place - F.col("shuffled_idx") < _BUFFER).alias("within_buffer"))


@query(f"WITH {VOCAB} SELECT token, n, token_id FROM vocab")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return flows.vocab(spark, folder).select("token", "n", "token_id")


@query(f"""WITH {BODY}
SELECT doc_id, count(*) AS n, string_agg(token_id::VARCHAR, ' ' ORDER BY tok_pos) AS ids
FROM body GROUP BY doc_id""")
def tokenized_documents(spark: SparkSession, folder: str) -> DataFrame:
    tokenized = tokens.tokenize(flows.good(spark, folder), flows.vocab(spark, folder))
    return tokenized.select("doc_id", F.size("ids").alias("n"), ids_text("ids").alias("ids"))


@query(f"""WITH {TOKENS}
SELECT doc_id, count(*) AS n, arg_min(token_id, tok_pos) AS first_id,
       arg_max(token_id, tok_pos) AS last_id, sum(token_id)::BIGINT AS id_sum
FROM toks GROUP BY doc_id""")
def bos_eos_sequences(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.col("seq")
    return flows.sequences(spark, folder).select(
        "doc_id", F.size(seq).alias("n"), F.element_at(seq, 1).alias("first_id"),
        F.element_at(seq, -1).alias("last_id"),
        F.aggregate(seq, F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"),
    )


@query(f"WITH {TOKENS} SELECT doc_id, tok_pos, token_id FROM toks")
def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_rows(flows.sequences(spark, folder))


_CUT = BODY + """,
cut AS (SELECT doc_id, least(len(w), 256) AS k FROM words),
seqs AS (SELECT doc_id, 0 AS pos, 0 AS id FROM cut
         UNION ALL SELECT doc_id, k + 1, 1 FROM cut
         UNION ALL SELECT doc_id, tok_pos, token_id FROM body WHERE tok_pos <= 256)"""


@query(f"""WITH {_CUT}
SELECT doc_id, count(*) AS n, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
FROM seqs GROUP BY doc_id""")
def truncated_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return flows.sequences(spark, folder, flows.TRUNCATE).select(
        "doc_id", F.size("seq").alias("n"), ids_text("seq").alias("ids")
    )


_WHOLE = BODY + """,
seqs AS (SELECT doc_id, 0 AS pos, 0 AS id FROM words
         UNION ALL SELECT doc_id, len(w) + 1, 1 FROM words
         UNION ALL SELECT doc_id, tok_pos, token_id FROM body)"""
_CHUNKS = _WHOLE + """,
chunks AS (SELECT doc_id, (pos // 64) * 64 AS start, count(*) AS n,
                  string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids,
                  string_agg(id::VARCHAR, ' ' ORDER BY pos) FILTER (pos % 64 < 16) AS head
           FROM seqs GROUP BY ALL)"""


@query(f"""WITH {_CHUNKS}
SELECT doc_id, start, ids || repeat(' 1', (64 - n)::INT) AS input_ids, n AS n_real, 64 - n AS n_pad FROM chunks""")
def padded_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents in rows of one length, the last of each padded."""
    length = flows.CHUNK
    mask = tokens.attention_mask(F.size("ids"), length)
    return tokens.chunk(flows.sequences(spark, folder), length, keep_tail=True).select(
        "doc_id", "start",
        ids_text(tokens.pad_to(F.col("ids"), length)).alias("input_ids"),
        F.size(F.filter(mask, lambda x: x == 1)).alias("n_real"),
        F.size(F.filter(mask, lambda x: x == 0)).alias("n_pad"),
    )


@query(f"""WITH {_WHOLE},
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
            FROM seqs GROUP BY doc_id),
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM per_doc)
SELECT batch_id, doc_id,
       ids || repeat(' 1', (max(n) OVER (PARTITION BY batch_id) - n)::INT) AS input_ids,
       rtrim(repeat('1 ', n::INT) || repeat('0 ', (max(n) OVER (PARTITION BY batch_id) - n)::INT))
         AS attention_mask
FROM numbered""")
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    seqs = flows.sequences(spark, folder)
    padded = tokens.pad_batch(seqs, 32, splits=flows.document_splits(spark, folder))
    return padded.select(
        "batch_id", "doc_id", ids_text("input_ids").alias("input_ids"),
        ids_text("attention_mask").alias("attention_mask"),
    )


@query(f"WITH {_CHUNKS} SELECT doc_id, start, ids FROM chunks WHERE n = 64")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    cut = tokens.chunk(flows.sequences(spark, folder), flows.CHUNK)
    return cut.select("doc_id", "start", ids_text("ids").alias("ids"))


@query(f"WITH {_CHUNKS} SELECT doc_id, start, n, ids FROM chunks")
def chunks_with_tails(spark: SparkSession, folder: str) -> DataFrame:
    seqs = flows.sequences(spark, folder)
    return tokens.chunk(seqs, flows.CHUNK, keep_tail=True).select(
        "doc_id", "start", F.size("ids").alias("n"), ids_text("ids").alias("ids")
    )


@query(f"WITH {_CHUNKS} SELECT doc_id, start, head AS ids FROM chunks WHERE n = 64")
def context_cut(spark: SparkSession, folder: str) -> DataFrame:
    cut = tokens.chunk(flows.sequences(spark, folder), flows.CHUNK)
    return cut.select("doc_id", "start", ids_text(tokens.context_cut(F.col("ids"), 16)).alias("ids"))


@query(f"""WITH {WORDS}
SELECT source, sum((len(w) + 2) // 64)::BIGINT AS n_chunks,
       count(*) FILTER (len(w) + 2 >= 64) AS n_docs
FROM words GROUP BY source HAVING sum((len(w) + 2) // 64) > 0""")
def chunk_counts_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Counts need lengths alone: no vocabulary, one exchange of partial sums."""
    docs = flows.good(spark, folder)
    n = F.floor((F.size(tx.words(F.col("text"))) + 2) / flows.CHUNK)
    return (
        docs.select("source", n.alias("n"))
        .groupBy("source")
        .agg(F.sum("n").alias("n_chunks"), F.count_if(F.col("n") > 0).alias("n_docs"))
        .where("n_chunks > 0")
    )


@query(f"""WITH {PLACED}
SELECT g // 128 AS block_id, count(DISTINCT doc_id) AS n_docs,
       string_agg(doc_id || ':' || tok_pos || ':' || token_id, ' ' ORDER BY g) AS tokens
FROM placed GROUP BY g // 128 HAVING count(*) = 128""")
def packed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    def cells(s):
        return F.transform(
            s["ids"],
            lambda t, j: F.concat_ws(
                ":", s["doc_id"].cast("string"), (s["start"] + j).cast("string"), t.cast("string")
            ),
        )

    return flows.blocks(spark, folder).select(
        "block_id",
        F.size(F.array_distinct(F.col("segments.doc_id"))).alias("n_docs"),
        F.array_join(F.flatten(F.transform("segments", cells)), " ").alias("tokens"),
    )


@query(f"""WITH {PLACED}
SELECT g // 128 AS block_id, doc_id, tok_pos, token_id FROM placed
WHERE g // 128 < (SELECT count(*) FROM placed) // 128""")
def unpacked_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return packing.unpack(flows.blocks(spark, folder))


@query(f"""WITH {LENGTHS},
spread AS (SELECT *, unnest(range((off // 4096)::BIGINT, ((off + n - 1) // 4096)::BIGINT + 1))
             AS batch_id FROM lengths)
SELECT batch_id, doc_id, greatest(batch_id * 4096 - off, 0)::BIGINT AS lo,
       least((batch_id + 1) * 4096 - off, n)::BIGINT AS hi FROM spread""")
def segment_batches(spark: SparkSession, folder: str) -> DataFrame:
    lengths = tokens.sequence_lengths(flows.good(spark, folder))
    cut = packing.segment_batches(lengths, 4096, splits=flows.document_splits(spark, folder))
    return cut.select("batch_id", "doc_id", "lo", "hi")


@query(f"""WITH {GOOD}
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM good""")
def mini_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = flows.good(spark, folder).select("doc_id")
    return tokens.assign_batches(docs, 16, splits=flows.document_splits(spark, folder))


@query(f"""WITH {WORDS}
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM words""")
def rebuilt_text(spark: SparkSession, folder: str) -> DataFrame:
    table = flows.vocab(spark, folder)
    seqs = tokens.sequences(tokens.tokenize(flows.good(spark, folder), table))
    rows = filters.drop_special(tokens.token_rows(seqs), flows.SPECIAL)
    return tokens.rebuild_text(rows, table).select(
        "doc_id", F.size(F.split("text", " ")).alias("n_words"), F.md5("text").alias("digest")
    )


@query(f"WITH {TOKENS} SELECT token_id, count(*) AS n FROM toks GROUP BY token_id")
def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    from sparsight.operators.statistics import token_histogram

    return token_histogram(tokens.token_rows(flows.sequences(spark, folder)))


@query(f"WITH {TOKENS} SELECT tok_pos, count(*) AS n FROM toks GROUP BY tok_pos")
def position_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Positions follow from the lengths, so the words need no ids."""
    from sparsight.operators.statistics import position_distribution as distribution

    lengths = tokens.sequence_lengths(flows.good(spark, folder))
    rows = lengths.select(F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("tok_pos"))
    return distribution(rows)


# --- shards and recovery over documents --------------------------------------


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled documents count as done."""
    done = spark.read.parquet(f"{folder}/labels.parquet")
    return shards.pending(flows.documents(spark, folder), done).select("doc_id")


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang""")
def appended_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One part per language, and one for any other, appended to one dataset again."""
    docs = flows.documents(spark, folder).select("doc_id", "lang", "n_chars")
    known = ("en", "es", "fr", "de")
    parts = [filters.by_language(docs, x) for x in known]
    parts.append(docs.where(~F.coalesce(F.col("lang").isin(*known), F.lit(False))))
    return (
        shards.union_shards(*parts)
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    )
