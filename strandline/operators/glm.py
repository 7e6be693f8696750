"""Negative-binomial models of any design, and what follows their tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.stats import chi_square_tail, normal_two_sided
from strandline.operators.testing import adjust_p_values, ranked_all
from strandline.session import checkpointed

#: Steps of the filter on base means (fixed value): 0, 5, ... 80 per cent of the genes.
FILTER_STEPS = 17


def design(treated: Column, *, batch: Column | None = None, batches: list | None = None, interaction: bool = False) -> Column:
    """A sample's row of the design matrix: intercept, treatment, a dummy for every batch
    but the first of ``batches``, and with ``interaction`` their products with the treatment."""
    x = treated.cast("double")
    dummies = [F.when(batch == b, 1.0).otherwise(0.0) for b in (batches or [])[1:]]
    return F.array(F.lit(1.0), x, *dummies, *([d * x for d in dummies] if interaction else []))


def _fit(x: np.ndarray, y: np.ndarray, size: np.ndarray, alpha: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Coefficients, inverse information and means, by iterated weighted least squares."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max(float((y / size).mean()), 1e-8))
    info = np.eye(x.shape[1])
    for _ in range(rounds):
        mu = size * np.exp(np.clip(x @ beta, -30, 30))
        w = mu / (1 + alpha * mu)
        info = x.T @ (w[:, None] * x) + 1e-10 * np.eye(x.shape[1])
        try:
            new = np.linalg.solve(info, x.T @ (w * (x @ beta + (y - mu) / mu)))
        except np.linalg.LinAlgError:
            return None
        done = np.abs(new - beta).max() < 1e-10
        beta = np.clip(new, -30, 30)
        if done:
            break
    return beta, np.linalg.inv(info), size * np.exp(np.clip(x @ beta, -30, 30))


def _likelihood(y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    r = 1 / alpha
    gamma = np.vectorize(math.lgamma)
    return float(np.sum(gamma(y + r) - math.lgamma(r) - gamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))))


def wald_tests(df: DataFrame, *, gene: list[str], value: str, size: str, dispersion: str, design: str, contrast: list[float]) -> DataFrame:
    """A contrast of the model's coefficients for each gene: ``log2fc``, ``se``, ``wald``, ``p``.

    ``design`` holds each sample's row of the design matrix. A gene's samples are one
    group of as many rows as there are samples. Genes without counts, or whose
    design is singular, come out with nulls.
    """
    c = np.asarray(contrast, float)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, s, x = rows[value].to_numpy(float), rows[size].to_numpy(float), np.stack(rows[design].to_list()).astype(float)
        found = _fit(x, y, s, max(float(rows[dispersion].iloc[0]), 1e-8)) if y.sum() > 0 and np.linalg.matrix_rank(x) == x.shape[1] else None
        if found is None:
            return pd.DataFrame([[*key, None, None, None]], columns=[*gene, "log2fc", "se", "wald"])
        effect, se = float(c @ found[0]), math.sqrt(float(c @ found[1] @ c))
        return pd.DataFrame([[*key, effect / math.log(2), se / math.log(2), effect / se]], columns=[*gene, "log2fc", "se", "wald"])

    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in gene)
    fitted = df.groupBy(*gene).applyInPandas(fit, f"{kinds}, log2fc double, se double, wald double")
    return fitted.withColumn("p", F.when(F.col("wald").isNotNull(), normal_two_sided(F.col("wald"))))


def likelihood_ratio_tests(df: DataFrame, *, gene: list[str], value: str, size: str, dispersion: str, full: str, reduced: str, freedom: int) -> DataFrame:
    """Twice the gain in log likelihood of the full over the reduced design, and its p-value: ``stat``, ``p``."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, s, alpha = rows[value].to_numpy(float), rows[size].to_numpy(float), max(float(rows[dispersion].iloc[0]), 1e-8)
        likelihoods = []
        for name in (full, reduced):
            x = np.stack(rows[name].to_list()).astype(float)
            found = _fit(x, y, s, alpha) if y.sum() > 0 and np.linalg.matrix_rank(x) == x.shape[1] else None
            likelihoods.append(None if found is None else _likelihood(y, found[2], alpha))
        stat = None if None in likelihoods else max(0.0, 2 * (likelihoods[0] - likelihoods[1]))
        return pd.DataFrame([[*key, stat]], columns=[*gene, "stat"])

    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in gene)
    fitted = df.groupBy(*gene).applyInPandas(fit, f"{kinds}, stat double")
    return fitted.withColumn("p", F.when(F.col("stat").isNotNull(), chi_square_tail(F.col("stat"), freedom)))


def outlying_genes(df: DataFrame, effects: DataFrame, *, gene: list[str], value: str, size: str, dispersion: str, treated: str, effect: str, most: float = 5.0) -> DataFrame:
    """Largest Cook's distance of each gene's samples and whether it is above ``most``.

    Of a two-sided factor (``treated`` 0 or 1) with the gene's ``effect`` in log2.
    Means start from the untreated samples' mean; leverage is a sample's weight over
    its side's. Sides are sums within the gene, so nothing is collected.
    """
    rows = df.join(effects.select(*gene, F.col(effect).alias("_effect")), gene).withColumn("_x", F.col(treated).cast("double"))
    of = W.partitionBy(*gene)
    mean = F.avg(F.when(F.col("_x") == 0, F.col(value) / F.col(size))).over(of)
    base = F.when(mean > 0, F.log(mean)).otherwise(0.0)
    alpha = F.greatest(F.col(dispersion), F.lit(1e-8))
    rows = rows.withColumn("_mu", F.greatest(F.col(size) * F.exp(base + F.col("_effect") * math.log(2) * F.col("_x")), F.lit(1e-8))).withColumn("_w", 1 / (1 / F.col("_mu") + alpha))
    side = lambda b: F.sum(F.when(F.col("_x") == b, F.col("_w")).otherwise(0.0)).over(of)
    rows = rows.withColumn("_w0", side(0.0)).withColumn("_w1", side(1.0)).filter((F.col("_w0") > 0) & (F.col("_w1") > 0))
    inverse = F.when(F.col("_x") == 0, 1 / F.col("_w0")).otherwise((F.col("_w0") + F.col("_w1")) / (F.col("_w0") * F.col("_w1")))
    leverage = F.least(F.col("_w") * inverse, F.lit(0.9999))
    distance = (F.col(value) - F.col("_mu")) ** 2 * leverage / (2 * F.col("_mu") ** 2 * (1 - leverage) ** 2)
    return rows.withColumn("_c", distance).groupBy(*gene).agg(F.max("_c").alias("cooks")).withColumn("outlier", F.col("cooks") > most)


def filtered_by_mean(tests: DataFrame, *, key: str, mean: str, p: str, least: float = 0.1) -> DataFrame:
    """Adjusted p-values after a filter on the base mean, chosen so that most genes pass.

    Of the means at 0, 5, ... 80 per cent of the tested genes, the one above which
    most adjusted p-values are below ``least`` (of equal ones the highest) is the
    bound; genes at or below it get 1. ``tests`` has one row a ``key``; rows without
    a p-value, or flagged ``outlier``, take no part and get 1. Adds ``padj``, ``filtered``.
    """
    rows = tests if "outlier" in tests.columns else tests.withColumn("outlier", F.lit(False))
    able = checkpointed(rows.filter(F.col(p).isNotNull() & ~F.isnan(p) & ~F.col("outlier")).select(F.col(key).alias("_key"), F.col(mean).cast("double").alias("_mean"), F.col(p).alias("_p")))
    n = able.count()
    places = {step: min(int(n * step * 0.05 + 1e-9), n - 1) + 1 for step in range(FILTER_STEPS)} if n else {}
    ranked = ranked_all(able.withColumn("_low", -F.col("_mean")), score="_low", key="_key")
    bound = None
    if places:
        means = {r["rank"]: r["_mean"] for r in ranked.filter(F.col("rank").isin(sorted(set(places.values())))).select("rank", "_mean").collect()}
        bounds = {step: means[place] for step, place in places.items()}
        steps = F.array(*[F.struct(F.lit(step).alias("_step"), F.lit(float(b)).alias("_bound")) for step, b in bounds.items()])
        tried = able.select("_mean", "_p", F.explode(steps).alias("_x")).select("_mean", "_p", "_x.*").filter(F.col("_mean") > F.col("_bound"))
        counted = adjust_p_values(tried.select("_step", "_p"), p="_p", family=["_step"], out="_q").groupBy("_step").agg(F.count(F.when(F.col("_q") < least, 1)).alias("_n"))
        passing = {r["_step"]: r["_n"] for r in counted.collect()}
        bound = bounds[max(bounds, key=lambda step: (passing.get(step, 0), step))]
    kept = adjust_p_values(able.filter(F.col("_mean") > F.lit(bound).cast("double")), p="_p", family=[], out="padj").select("_key", "padj")
    joined = rows.join(kept.withColumnRenamed("_key", key), key, "left")
    tested = F.col(p).isNotNull() & ~F.isnan(p) & ~F.col("outlier")
    return joined.withColumn("filtered", tested & F.col("padj").isNull()).withColumn("padj", F.coalesce("padj", F.lit(1.0)))


def shrunken_effects(tests: DataFrame, *, effect: str, se: str) -> DataFrame:
    """Adds ``shrunk``: the effect times se² over se² and the median squared effect of all genes."""
    prior = tests.filter(F.col(effect).isNotNull() & ~F.isnan(effect)).agg(F.expr(f"percentile({effect} * {effect}, 0.5)").alias("_prior"))
    variance = F.col(se) * F.col(se)
    return tests.crossJoin(prior).withColumn("shrunk", F.col(effect) * F.coalesce(F.try_divide(variance, variance + F.col("_prior")), F.lit(1.0))).drop("_prior")
