"""Registry of the queries and of the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsight.functions.text import SPACE_RUN, TWO_LETTERS, WHITESPACE
from sparsight.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DECIMALS = 6


def query(sql: str | None = None, exact: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name.

    Results leave with 64-bit integers and doubles rounded to six decimals,
    so that both engines print alike; columns in ``exact`` are not rounded.
    """

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return _plain(fn(spark, folder), exact)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _plain(df: DataFrame, exact: tuple[str, ...]) -> DataFrame:
    def column(name: str, kind: str):
        c = F.col(name)
        if kind in ("tinyint", "smallint", "int"):
            return c.cast("long").alias(name)
        if kind in ("float", "double") and name not in exact:
            return (F.round(c.cast("double"), DECIMALS) + F.lit(0.0)).alias(name)
        return c

    return df.select(*(column(n, k) for n, k in df.dtypes))


def ids_text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


def r(expression: str, name: str) -> str:
    """A rounded column of the SQL side."""
    return f"round({expression}, {DECIMALS}) + 0.0 AS {name}"


# Building blocks of the SQL side, each adding to the ones before it.
_TRIM = f"trim(text, '{WHITESPACE}')"
DOCS = f"""docs AS (SELECT doc_id, lang, source, text, {_TRIM} AS t FROM documents)"""
_RULES = r"length(t) > 20 AND upper(t) <> t AND NOT regexp_matches(t, '^\p{N}+$')"
GOOD = DOCS + f""",
good AS (SELECT * FROM docs WHERE {_RULES} AND regexp_matches(t, '{TWO_LETTERS}'))"""
BOUNDED = DOCS + f""",
good AS (SELECT * FROM docs WHERE {_RULES} AND length(t) < 30000)"""
WORDS = GOOD + f""",
words AS (SELECT doc_id, source, lang, string_split_regex(t, '{SPACE_RUN}') AS w FROM good)"""
VOCAB = WORDS + """,
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM words) GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM counts)"""
BODY = VOCAB + """,
body AS (SELECT doc_id, source, tok_pos, token_id, token
         FROM (SELECT doc_id, source, unnest(w) AS token,
                      unnest(range(1, len(w) + 1)) AS tok_pos FROM words)
         JOIN vocab USING (token))"""
TOKENS = BODY + """,
toks AS (SELECT doc_id, tok_pos, token_id FROM body
         UNION ALL SELECT doc_id, 0, 0 FROM words
         UNION ALL SELECT doc_id, len(w) + 1, 1 FROM words)"""
PLACED = TOKENS + """,
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, tok_pos) - 1 AS g FROM toks)"""
LENGTHS = WORDS + """,
lengths AS (SELECT doc_id, source, len(w) + 2 AS n,
                   sum(len(w) + 2) OVER (ORDER BY doc_id) - len(w) - 2 AS off FROM words)"""

EMB = """emb AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS x FROM embeddings)"""
CELLS = EMB + """,
cells AS (SELECT vec_id, label, unnest(range(len(x))) AS dim, unnest(x) AS x FROM emb)"""
DICT = CELLS + """,
means AS (SELECT label * 8 + vec_id % 8 AS latent, dim, round(avg(x), 6) AS m
          FROM cells GROUP BY ALL),
dict AS (SELECT latent, list(m / norm ORDER BY dim) AS w
         FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY latent)) AS norm FROM means)
         GROUP BY latent)"""
CODES = DICT + """,
pre AS (SELECT vec_id, label, latent, list_inner_product(x, w) AS z FROM emb, dict),
codes AS (SELECT * FROM pre WHERE z > 0.25)"""
TOKEN_CODES = f"""{BODY}, {CODES},
tz AS (SELECT doc_id, tok_pos, token_id, token, latent, z FROM body
       JOIN codes ON codes.vec_id = body.token_id % (SELECT count(*) FROM embeddings))"""
TOP = TOKEN_CODES + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER
          (PARTITION BY latent ORDER BY round(z, 9) DESC, doc_id, tok_pos) AS rank FROM tz)
        WHERE rank <= 5)"""
EXAMPLES = TOP + """,
examples AS (SELECT latent, rank, doc_id, tok_pos, token, z,
    array_to_string(list_concat(list_concat(w[greatest(tok_pos - 4, 1) : tok_pos - 1],
        ['<<' || token || '>>']), w[tok_pos + 1 : tok_pos + 4]), ' ') AS sentence
    FROM top JOIN words USING (doc_id))"""
