"""Data and compute budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class ComputeConfig:
    # Fixed values of the published plan: half a model's parameters, the
    # autoencoder's two widths, and the rate of one accelerator.
    parameters: float = 1.2e9
    d_in: int = 2_048
    d_sae: int = 16_384
    flops_per_second: float = 165e12


def compute_budget(
    counts: DataFrame, cfg: ComputeConfig = ComputeConfig(), by: str = "source",
    tokens: str = "n_tokens",
) -> DataFrame:
    """Operations and hours for a forward pass of half the model and for training."""
    d = F.sum(tokens).cast("double")
    forward = d * cfg.parameters
    training = d * (6.0 * 2.0 * cfg.d_in * cfg.d_sae)
    rate = cfg.flops_per_second * 3600.0
    return counts.groupBy(by).agg(
        F.sum(tokens).alias("n_tokens"),
        forward.alias("forward_flops"),
        training.alias("training_flops"),
        (forward / rate).alias("forward_hours"),
        (training / rate).alias("training_hours"),
    )


def token_entropy(counts: DataFrame, other_vocab: int = 256_000) -> DataFrame:
    """From (token, n): bits per token, the uniform bound, and how many tokens
    of a vocabulary of ``other_vocab`` carry the same uniform bits.
    """
    n = F.sum("n").cast("double")
    # sum p log p = (sum n log n) / N - log N: one pass, no total needed first
    spread = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    bound = F.log2(F.count("*").cast("double"))
    return counts.agg(
        F.sum("n").alias("n_tokens"),
        F.count("*").alias("vocab"),
        bound.alias("uniform_bits"),
        (F.log2(n) - spread / n).alias("entropy_bits"),
        (n * bound / F.log2(F.lit(float(other_vocab)))).alias("equivalent_tokens"),
    )


def powerlaw_fit(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``y = a * x ** b`` by least squares on the logarithms."""
    ln_x, ln_y = F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double"))
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.exp(F.regr_intercept(ln_y, ln_x)).alias("a"),
        F.regr_slope(ln_y, ln_x).alias("b"),
        F.regr_r2(ln_y, ln_x).alias("r2"),
    )
