"""Models fitted group by group or from one small aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpointed


def nonnegative_weights(matrix: np.ndarray, target: np.ndarray, *, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Least squares without negative weights, by active sets."""
    n = matrix.shape[1]
    weights, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ weights)
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance:
            break
        active[j] = True
        while active.any():
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(matrix[:, active], target, rcond=None)[0]
            if trial[active].min() > 0:
                weights = trial
                break
            falling = active & (trial <= 0)
            step = np.min(weights[falling] / np.maximum(weights[falling] - trial[falling], 1e-300))
            weights = weights + step * (trial - weights)
            active &= weights > tolerance
            weights[~active] = 0.0
    return weights


def exposures(spectra: DataFrame, signatures: DataFrame, *, sample: str, signature: str, channel: str = "channel", value: str = "fraction", least: float = 0.05) -> DataFrame:
    """Weights of the signatures in each sample's spectrum, those below ``least`` of the
    sum dropped and the rest fitted again, and the cosine of fit and spectrum.

    The signatures meet each sample by channel in a join; a sample's group has one
    row per channel and signature.
    """
    sides = spectra.select(F.col(sample).alias("_sample"), F.col(channel).alias("_channel"), F.col(value).alias("_y"))
    shapes = signatures.select(F.col(signature).alias("_sig"), F.col(channel).alias("_channel"), F.col(value).alias("_x"))
    rows = sides.join(shapes, "_channel")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot_table(index="_channel", columns="_sig", values="_x", fill_value=0.0).sort_index()
        target = rows.groupby("_channel")["_y"].first().sort_index().to_numpy()
        m = matrix.to_numpy()
        weights = nonnegative_weights(m, target)
        keep = weights >= least * max(weights.sum(), 1e-300)
        if keep.any() and not keep.all():
            weights = np.zeros(len(weights))
            weights[keep] = nonnegative_weights(m[:, keep], target)
        fitted = m @ weights
        norm = np.linalg.norm(fitted) * np.linalg.norm(target)
        cosine = float(fitted @ target / norm) if norm > 1e-12 else 0.0
        found = weights > 0
        return pd.DataFrame({"sample": key[0], "signature": matrix.columns[found], "weight": weights[found] / max(weights.sum(), 1e-300), "cosine": cosine})

    kinds = sides.schema["_sample"].dataType.simpleString(), shapes.schema["_sig"].dataType.simpleString()
    fitted = rows.groupBy("_sample").applyInPandas(fit, f"sample {kinds[0]}, signature {kinds[1]}, weight double, cosine double")
    return fitted.withColumnRenamed("sample", sample) if sample != "sample" else fitted


def principal_components(df: DataFrame, *, vector: str, k: int, keep: list[str]) -> DataFrame:
    """The first k principal components of array vectors, standardised over all rows.

    The rows meet only in one d x d matrix; each component points to where its
    largest loading is positive. A place that does not vary counts as zero.
    """
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    if rows.isEmpty():
        return rows.select(*keep, *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(scaled)
    signs = [float(np.sign(c[np.argmax(np.abs(c))])) or 1.0 for c in model.pc.toArray().T]
    scores = vector_to_array("_pc")
    return model.transform(scaled).select(*keep, *[(scores[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def dispersion_trend(df: DataFrame, *, gene: list[str], value: str) -> DataFrame:
    """Mean, variance and moment estimate of the dispersion of counts, shrunk in the log
    towards the trend a0 + a1 / mean fitted on all genes by their quantiles."""
    moments = df.groupBy(*gene).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")).filter((F.col("n") > 1) & (F.col("mean") > 0))
    raw = moments.withColumn("dispersion", F.greatest((F.col("variance") - F.col("mean")) / (F.col("mean") * F.col("mean")), F.lit(1e-8)))
    floor = raw.agg(F.percentile_approx("dispersion", 0.05, 10_000).alias("_a0"))
    slope = raw.crossJoin(floor).agg(F.first("_a0").alias("_a0"), F.percentile_approx(F.greatest(F.col("dispersion") - F.col("_a0"), F.lit(0.0)) * F.col("mean"), 0.5, 10_000).alias("_a1"))
    return raw.crossJoin(slope).withColumn("trend", F.col("_a0") + F.col("_a1") / F.col("mean")).withColumn("shrunk", F.exp((F.log("dispersion") + F.log(F.greatest("trend", F.lit(1e-8)))) / 2)).drop("_a0", "_a1")


def count_models(df: DataFrame, *, gene: list[str], sample: str, value: str, treated: str, size: str, dispersion: str, rounds: int = 50) -> DataFrame:
    """Negative-binomial regression of counts on one two-sided factor, gene by gene.

    Each gene's samples are one group (as many rows as there are samples). Iterated
    weighted least squares with the gene's dispersion and the samples' size factors;
    Wald statistic of the factor in units of log2. Genes without both sides or
    without counts come out with nulls.
    """

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, s, x1 = rows[value].to_numpy(float), rows[size].to_numpy(float), rows[treated].to_numpy(float)
        empty = pd.DataFrame([[*key, None, None, None]], columns=[*gene, "log2fc", "se", "wald"])
        if y.sum() <= 0 or len(set(x1)) < 2:
            return empty
        x, alpha = np.column_stack([np.ones(len(y)), x1]), float(rows[dispersion].iloc[0])
        beta = np.array([np.log(max((y / s).mean(), 1e-8)), 0.0])
        for _ in range(rounds):
            mu = s * np.exp(np.clip(x @ beta, -30, 30))
            w = mu / (1 + alpha * mu)
            z = x @ beta + (y - mu) / mu
            info = x.T @ (w[:, None] * x) + 1e-8 * np.eye(2)
            new = np.linalg.solve(info, x.T @ (w * z))
            done = np.abs(new - beta).max() < 1e-8
            beta = np.clip(new, -30, 30)
            if done:
                break
        se = float(np.sqrt(np.linalg.inv(info)[1, 1]))
        return pd.DataFrame([[*key, beta[1] / np.log(2), se / np.log(2), beta[1] / se]], columns=empty.columns)

    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in gene)
    return df.groupBy(*gene).applyInPandas(fit, f"{kinds}, log2fc double, se double, wald double")


def permutation_p_values(scores: DataFrame, *, set_key: str, size: str, score: str, n_ranked: int, permutations: int = 128, most: int = 2048, least_hits: int = 10, seed: int = 1) -> DataFrame:
    """p-values of enrichment scores from random sets of the same size, over the whole ranking.

    Random sets are drawn per set size, in blocks spread over the tasks; their scores
    are counted, not kept. Sizes with a set that fewer than ``least_hits`` of them
    reach are drawn as often again, until that holds or ``most`` were drawn: so small
    p-values rest on many. Two-sided on the size of the score, (hits + 1) / (draws + 1);
    a p-value's standard error is about its root over the root of the draws. Adds
    ``p``, ``draws`` and ``nes``, the score over the mean random one.
    """
    spark = scores.sparkSession
    block = 64

    def draw(batches):
        for batch in batches:
            for n, number in zip(batch["_size"], batch["_block"]):
                rng = np.random.default_rng([seed, int(n), int(number)])
                i = np.arange(1, n + 1)
                up, down = np.sqrt((n_ranked - n) / n), np.sqrt(n / (n_ranked - n))
                null = np.empty(block)
                for j in range(block):
                    ranks = np.sort(rng.choice(n_ranked, int(n), replace=False, shuffle=False)) + 1
                    at = i * up - (ranks - i) * down
                    null[j] = max(abs(at.max()), abs((at - up).min()))
                yield pd.DataFrame({"_size": np.int64(n), "_null": null})

    known = checkpointed(scores.filter(F.col(size).between(1, n_ranked - 1)).select(set_key, F.col(size).cast("long").alias("_size"), F.abs(score).alias("_x")))
    open_, first, more, counts = known, 0, -(-permutations // block), None
    while True:
        work = open_.select("_size").distinct().crossJoin(spark.range(first, first + more).withColumnRenamed("id", "_block"))
        null = checkpointed(work.repartition("_size", "_block").mapInPandas(draw, "_size long, _null double"))
        met = open_.join(null, "_size").groupBy(set_key).agg(F.count(F.when(F.col("_null") >= F.col("_x"), 1)).alias("_hits"), F.count("*").alias("draws"), F.sum("_null").alias("_sum"))
        counts = met if counts is None else counts.unionByName(met).groupBy(set_key).agg(*[F.sum(c).alias(c) for c in ("_hits", "draws", "_sum")])
        counts = checkpointed(counts)
        first += more
        undecided = counts.filter((F.col("_hits") < least_hits) & (F.col("draws") == first * block))
        if first * block >= most or undecided.isEmpty():
            break
        # All sets of a size share its draws.
        sizes = known.join(undecided.select(set_key), set_key, "left_semi").select("_size").distinct()
        open_, more = known.join(sizes, "_size", "left_semi"), min(first, most // block - first)
    mean = F.col("_sum") / F.col("draws")
    return scores.join(counts, set_key, "left").withColumn("p", (F.col("_hits") + 1) / (F.col("draws") + 1.0)).withColumn("nes", F.col(score) / mean).drop("_hits", "_sum")
