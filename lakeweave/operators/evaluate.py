"""Does the enriched data predict the target better, and which features matter."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.ranges import running_totals
from lakeweave.plans.scratch import written


def _pipeline(df: DataFrame, features: Sequence[str], target: str, seed: int) -> Pipeline:
    kinds = dict(df.dtypes)
    text = [c for c in features if kinds[c] == "string"]
    numbers = [c for c in features if kinds[c] != "string"]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in text]
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{c}__n" for c in numbers]))
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in text] + [f"{c}__n" for c in numbers], outputCol="__features", handleInvalid="keep"))
    stages.append(GBTRegressor(featuresCol="__features", labelCol=target, predictionCol="prediction", maxIter=10, maxBins=1024, seed=seed))
    return Pipeline(stages=stages)


def split(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """70 % to train on and 30 % to test, by a hash of the whole row, so that partitioning doesn't matter."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(10))
    return df.where(bucket < 7), df.where(bucket >= 7)


def fit_model(df: DataFrame, features: Sequence[str], target: str, seed: int = 42):
    """(model, held-out rows, their mean squared error)."""
    known = df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
    numeric = known.withColumns({c: F.col(c).cast("double") for c, t in known.dtypes if c in features and t != "string"})
    train, test = split(numeric, seed)
    model = _pipeline(numeric, features, target, seed).fit(train)
    return model, test, mse(model.transform(test), target)


def mse(predicted: DataFrame, target: str) -> float:
    """Mean squared error of the column ``prediction``."""
    return RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse").evaluate(predicted)


def shuffles(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of ``count`` permutations p -> (a * p + b) mod n of the places 0 to n - 1."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        a = rng.randrange(1, min(max(n, 2), 1 << 20))
        if math.gcd(a, max(n, 1)) == 1:
            out.append((a, rng.randrange(max(n, 1))))
    return out


def dealt(df: DataFrame, features: Sequence[str], rounds: int, seed: int = 0) -> DataFrame:
    """``df`` once for every feature and round, with ``feature`` and ``round``, the values of that feature dealt out anew among the rows.

    Rows are numbered once in the order of their hashes, by ranges; a round is
    a permutation of the numbers, so all rounds are one join and no task holds
    all rows.
    """
    keys = [F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in df.columns)), *(F.col(f"`{c}`") for c in df.columns)]
    numbered = written(running_totals(df.withColumn("__one", F.lit(1)), [], keys, "__one").withColumnRenamed("__before", "__p").drop("__one", "__total"), "numbered")
    n = numbered.count()
    turns = [(f, r, *ab) for f, of in zip(features, range(len(features)), strict=True) for r, ab in enumerate(shuffles(n, rounds, seed * 1009 + of))]
    turn = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("round"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for f, r, a, b in turns)))
    spread = numbered.withColumn("__t", turn).withColumn("__q", (F.col("__t.a") * F.col("__p") + F.col("__t.b")) % F.lit(max(n, 1)))
    given = numbered.select(F.col("__p").alias("__q"), *(F.col(f"`{f}`").alias(f"__v{i}") for i, f in enumerate(features)))
    met = spread.join(given, "__q")
    met = met.withColumns({f: F.when(F.col("__t.feature") == f, F.col(f"__v{i}")).otherwise(F.col(f"`{f}`")) for i, f in enumerate(features)})
    return met.select(*(F.col(f"`{c}`") for c in df.columns), "__t.feature", "__t.round")


def permutation_importance(model, test: DataFrame, features: Sequence[str], target: str, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(feature, round, increase): how much the mean squared error grows when the feature's values are dealt out anew; one job for all rounds."""
    base = mse(model.transform(test), target)
    predicted = model.transform(dealt(test, features, rounds, seed))
    error = F.avg((F.col("prediction") - F.col(target)) ** 2)
    return predicted.groupBy("feature", "round").agg((error - F.lit(base)).alias("increase"))


def compare(df: DataFrame, base: Sequence[str], added: Sequence[str], target: str, seed: int = 42) -> tuple[float, float, float]:
    """(error with the dataset's own features, with the added ones, reduction in per cent)."""
    a = fit_model(df, base, target, seed)[2]
    b = fit_model(df, [*base, *added], target, seed)[2]
    return a, b, 100 * (a - b) / a if a else 0.0
