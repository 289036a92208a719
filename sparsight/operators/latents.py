"""What makes a latent fire: examples, prompts, explanations, keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsight.functions import text as tx
from sparsight.operators.autoencoder import TIE_DECIMALS
from sparsight.operators.joins import lookup_join
from sparsight.session import materialize

# The texts of the explanation prompt.
SYSTEM_PROMPT = (
    "You are analyzing a latent neuron in a transformer-based language model. "
    "Each sentence below contains one token that strongly activates this latent neuron, highlighted using << >>. "
    "Your task is to interpret what concept, theme, or category this neuron responds to. "
    "Be precise but not overly narrow. Use fewer than 20 words. "
    "Avoid punctuation, lists, formatting, or generic labels like 'words' or 'nouns'. "
    "Focus on shared semantic meaning across the highlighted tokens."
)
USER_PREFIX = "The activating examples are:\n\n"
ASSISTANT_PROMPT = (
    "Start by mentally grouping the highlighted tokens into a conceptual category. "
    "Then, write a final interpretation in fewer than 20 words. "
    "This neuron activates on"
)
MAX_EXPLANATION_WORDS = 20
COMPLETIONS = 3
# What a marked sentence may start with, and the marks.
LINE_NUMBERING = "0123456789. "
OPEN, CLOSE = "<<", ">>"

FORMATTING = r"[*_#`\[\]{}|]|^\s*[-•]|^\s*[0-9]+[.)]|\n"

# Below this k Spark cuts each task's rows to k per latent before the shuffle.
_LIMIT_PUSHED_BELOW = 1_000
_SALTS = 64
_HIT_BYTES = 96


def top_activations(z: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest rows per latent; ties by document and position.

    ``rank <= k`` over row_number lets every task drop all but ``k`` rows per
    latent before the exchange, so a hot latent does not reach one task whole.
    For a large ``k``, where that does not apply, a salted round comes first.
    """
    order = [F.desc(F.round("z", TIE_DECIMALS)), F.asc("doc_id"), F.asc("tok_pos")]
    rows = z
    if k >= _LIMIT_PUSHED_BELOW:
        salt = F.pmod(F.xxhash64("doc_id", "tok_pos"), F.lit(_SALTS))
        first = Window.partitionBy("latent", "_salt").orderBy(*order)
        rows = (
            z.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(first))
            .where(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    final = Window.partitionBy("latent").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def with_context(
    top: DataFrame, documents: DataFrame, width: int, text: str = "text"
) -> DataFrame:
    """Add the words around each hit: ``before``, ``token``, ``after``.

    Position 0 is BOS, so word ``tok_pos`` counts from 1. The hits are few, k
    per latent: they are written and, where their number allows, broadcast, so
    that the documents stay where they are and only those hit are split.
    """
    hits = materialize(top, "hits")
    joined = lookup_join(
        documents.select("doc_id", text), hits, ["doc_id"], row_bytes=_HIT_BYTES
    ).withColumn("_w", tx.words(F.col(text)))
    first = F.greatest(F.col("tok_pos") - width, F.lit(1))
    return (
        joined.withColumn("before", F.slice("_w", first, F.col("tok_pos") - first))
        .withColumn("token", F.element_at("_w", F.col("tok_pos")))
        .withColumn("after", F.slice("_w", F.col("tok_pos") + 1, F.lit(width)))
        .drop("_w", text)
    )


def highlight(examples: DataFrame) -> DataFrame:
    """``tokens`` with the hit in double angle brackets."""
    marked = F.concat(F.lit(OPEN), F.col("token"), F.lit(CLOSE))
    return examples.withColumn(
        "tokens", F.concat(F.col("before"), F.array(marked), F.col("after"))
    ).drop("before", "after")


def is_marked(token: Column) -> Column:
    return token.startswith(OPEN) & token.endswith(CLOSE)


def import_marked(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, rank, tokens): one row per non-blank line of generated sentences.

    Numbering in front is stripped. The first token that is marked keeps its
    mark, freed from any further brackets.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n"), tx.strip), lambda line: line != ""
    )
    cells = F.transform(lines, lambda line: tx.words(F.ltrim(line, F.lit(LINE_NUMBERING))))
    rows = df.select(*key, F.posexplode(cells).alias("rank", "_tokens"))
    at = F.array_position(F.transform("_tokens", is_marked), True)

    def clean(token: Column, i: Column) -> Column:
        freed = F.concat(F.lit(OPEN), F.btrim(token, F.lit("<>")), F.lit(CLOSE))
        return F.when(i + 1 == F.col("_at"), freed).otherwise(token)

    return rows.withColumn("_at", at).select(
        *key, "rank", F.transform("_tokens", clean).alias("tokens")
    )


def marked_counts(examples: DataFrame) -> DataFrame:
    return (
        examples.select(F.explode("tokens").alias("token"))
        .where(is_marked(F.col("token")))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def build_prompts(examples: DataFrame, by: str = "latent") -> DataFrame:
    """One prompt per latent from its numbered examples: ``rank`` starts at 1.

    A group is the top k of one latent.
    """
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.array_join("tokens", " "))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return examples.groupBy(by).agg(
        F.lit(SYSTEM_PROMPT).alias("system"),
        F.concat(F.lit(USER_PREFIX), body).alias("user"),
        F.lit(ASSISTANT_PROMPT).alias("assistant"),
    )


Client = Callable[[dict[str, str], int], list[str]]


def named_tokens(examples: DataFrame, n: int = COMPLETIONS, most: int = 8, by: str = "latent") -> DataFrame:
    """(by, completions): the distinct marked tokens of each latent, the strongest first, as ``n`` equal explanations.

    What can be said without a model, in the shape that ``explain`` gives.
    Marks and punctuation go; a group is the top k of one latent.
    """
    marked = F.filter("tokens", is_marked)
    plain = F.transform(marked, lambda w: F.lower(F.btrim(F.substring(w, 3, F.length(w) - 4), F.lit(".,;:!?"))))
    ordered = F.sort_array(F.collect_list(F.struct("rank", plain.alias("names"))))
    names = F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["names"])))
    said = F.concat(F.lit("tokens like "), F.array_join(F.slice(names, 1, most), " "))
    return examples.groupBy(by).agg(F.array_repeat(said, n).alias("completions"))


def explain(prompts: DataFrame, client: Client, n: int = COMPLETIONS) -> DataFrame:
    """Ask ``client`` for ``n`` completions of every prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[["system", "user", "assistant"]].to_dict("records")
            yield pd.DataFrame(
                {
                    "latent": batch["latent"],
                    "completions": [[c.strip() for c in client(p, n)] for p in asked],
                }
            )

    return prompts.select("latent", "system", "user", "assistant").mapInPandas(
        run, "latent int, completions array<string>"
    )


def explanations(completed: DataFrame) -> DataFrame:
    """One row per completion, numbered from 1."""
    return completed.select(
        "latent", F.posexplode("completions").alias("n", "explanation")
    ).withColumn("n", F.col("n") + 1)


def valid_explanation(explanation: Column) -> Column:
    """Under 20 words, and free of lists and markup."""
    n = F.size(tx.words(explanation))
    return (n > 0) & (n < MAX_EXPLANATION_WORDS) & ~explanation.rlike(FORMATTING)


def latent_keywords(z: DataFrame, m: int, token: str = "token_id", weight: str | None = None) -> DataFrame:
    """The ``m`` tokens that activate each latent most often; ``weight`` tells how often a row occurs."""
    times = F.sum(weight) if weight else F.count("*")
    counts = z.groupBy("latent", token).agg(times.alias("n"), F.max("z").alias("max_z"))
    order = Window.partitionBy("latent").orderBy(F.desc("n"), F.asc(token))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)
