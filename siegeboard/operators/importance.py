"""Feature preparation and importance of settings for difficulty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from ..functions.numeric import f_score
from ..session import materialize
from .ranking import with_row_index


class SettingFeatures:
    """Numbers: mean fill, standard scale, rotation to all principal components.
    Texts: most frequent fill, one-hot with unknown values ignored.

    All fitted values are one number or label per column.
    """

    def __init__(self, numbers: Sequence[str], texts: Sequence[str], rotate: bool = True):
        self.numbers, self.texts, self.rotate = list(numbers), list(texts), rotate
        self.centers: dict[str, tuple[float, float]] = {}
        self.modes: dict[str, str] = {}
        self.model: PipelineModel | None = None

    def _filled(self, df: DataFrame) -> DataFrame:
        changes = {}
        for i, name in enumerate(self.numbers):
            mean, spread = self.centers[name]
            value = F.coalesce(col(name).cast("double"), F.lit(mean))
            changes[f"_n{i}"] = (value - F.lit(mean)) / F.lit(spread or 1.0)
        for i, name in enumerate(self.texts):
            # The mark keeps an empty text usable as a category name.
            text = F.coalesce(col(name).cast("string"), F.lit(self.modes[name]))
            changes[f"_t{i}"] = F.concat(F.lit("="), text)
        return df.withColumns(changes)

    def fit(self, df: DataFrame) -> "SettingFeatures":
        if self.numbers:
            stats = df.agg(
                *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(self.numbers)],
            ).first()
            means = {c: stats[f"m{i}"] or 0.0 for i, c in enumerate(self.numbers)}
            spreads = df.agg(
                *[
                    F.stddev_pop(F.coalesce(col(c).cast("double"), F.lit(means[c]))).alias(f"s{i}")
                    for i, c in enumerate(self.numbers)
                ]
            ).first()
            self.centers = {c: (means[c], spreads[f"s{i}"] or 0.0) for i, c in enumerate(self.numbers)}
        if self.texts:
            # Most frequent text per column, the smallest among equals.
            pairs = df.select(
                F.inline(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(self.texts)]))
            ).where(F.col("v").isNotNull())
            counted = pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
            best = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()
            found = {r["i"]: r["v"] for r in best}
            self.modes = {c: found.get(i, "") for i, c in enumerate(self.texts)}
        stages, parts = [], []
        if self.numbers:
            inputs = [f"_n{i}" for i in range(len(self.numbers))]
            stages.append(VectorAssembler(inputCols=inputs, outputCol="_numbers"))
            if self.rotate:
                stages.append(PCA(k=len(inputs), inputCol="_numbers", outputCol="_rotated"))
            parts.append("_rotated" if self.rotate else "_numbers")
        if self.texts:
            inputs = [f"_t{i}" for i in range(len(self.texts))]
            places = [f"_p{i}" for i in range(len(self.texts))]
            hots = [f"_h{i}" for i in range(len(self.texts))]
            # An unknown text gets the last place, which dropLast turns into all zeros.
            stages.append(
                StringIndexer(inputCols=inputs, outputCols=places, handleInvalid="keep", stringOrderType="alphabetAsc")
            )
            stages.append(OneHotEncoder(inputCols=places, outputCols=hots, dropLast=True))
            parts += hots
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
        self.model = Pipeline(stages=stages).fit(self._filled(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._filled(df))
        return out.select(*[col(c) for c in df.columns], "features")

    def names(self) -> list[str]:
        """One name per feature."""
        labels = []
        for stage in self.model.stages:
            if hasattr(stage, "labelsArray"):
                labels = [f"{c}_{v[1:]}" for c, values in zip(self.texts, stage.labelsArray) for v in values]
        return [*self.numbers, *labels]


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, in one aggregate."""
    y = col(target).cast("double")
    wide = df.agg(*[F.corr(col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("Feature"), F.col(f"r{i}").alias("correlation")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Univariate regression F statistic of each column."""
    y = col(target).cast("double")
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(columns)]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("Feature"), f_score(F.col(f"r{i}"), F.col("n")).alias("f_score")) for i, c in enumerate(columns)]
    )
    return wide.select(F.inline(rows))


def category_f_scores(df: DataFrame, texts: Sequence[str], target: str) -> DataFrame:
    """F statistic of every one-hot column, from counts and sums per text value.

    No encoded column is built: a 0/1 column's correlation with the target only needs
    the count and the target sum of its value.
    """
    y = col(target).cast("double")
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")).first()
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in texts])), y.alias("y")
    )
    per_value = pairs.groupBy("c", "v").agg(F.count(F.lit(1)).alias("m"), F.avg("y").alias("own"))
    n = float(whole["n"])
    share = F.col("m") / n
    cov = share * (F.col("own") - F.lit(whole["mean"]))
    r = F.try_divide(cov, F.sqrt(share * (1 - share) * F.lit(whole["var"])))
    return per_value.select(
        F.concat("c", F.lit("_"), F.coalesce("v", F.lit("null"))).alias("Feature"), f_score(r, F.lit(n)).alias("f_score")
    )


def forest(seed: int, trees: int = 100, leaf: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="label",
        numTrees=trees,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="all",
        maxDepth=10,
        seed=seed,
    )


def forest_importance(
    df: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, seed: int = 7, trees: int = 100
) -> DataFrame:
    """Forest importance per feature beside its correlation or F statistic; numbers are not rotated, so each weight is its column's."""
    features = SettingFeatures(numbers, texts, rotate=False).fit(df)
    ready = features.transform(df).select("features", col(target).cast("double").alias("label"))
    model = forest(seed, trees).fit(ready)
    weights = model.featureImportances.toArray().tolist()
    rows = list(zip(features.names(), weights))
    found = df.sparkSession.createDataFrame(rows, "Feature string, importance double")
    related = correlations(df, numbers, target).withColumnRenamed("correlation", "Difficulty Correlation") if numbers else None
    if texts:
        scores = category_f_scores(df, texts, target).withColumnRenamed("f_score", "Difficulty Correlation")
        related = scores if related is None else related.unionByName(scores)
    related = related.withColumn("Difficulty Correlation", F.coalesce(F.nanvl("Difficulty Correlation", F.lit(0.0)), F.lit(0.0)))
    return found.join(related, "Feature", "left").orderBy(F.desc("importance"), "Feature")


def hash_split(df: DataFrame, key: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and about ``share`` of the rows held out; the key decides, so equal keys stay together.

    Unlike a random split, neither partitioning nor row order moves a row to the other side. A null key is an empty text.
    """
    cut = f"{min(int(share * 16**8), 16**8 - 1):08x}"
    held = F.substring(F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), 1, 8) < cut
    return df.where(~held), df.where(held)


def fixed_layout(df: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """Rows in partitions and order of their key alone, so that a seeded forest draws the same rows in every run."""
    return df.repartition(parts, col(key)).sortWithinPartitions(col(key))


def holdout_report(
    df: DataFrame, key: str, numbers: Sequence[str], texts: Sequence[str], target: str, share: float = 0.2, seed: int = 7, trees: int = 100
) -> DataFrame:
    """Held-out error of a forest beside that of the learned rows' mean: ``n_train, n_test, baseline_mse, mse``."""
    train, test = hash_split(df, key, share)
    model, features = _fitted(train, key, numbers, texts, target, seed, trees)
    y = col(target).cast("double")
    known = train.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean")).first()
    off = y - F.lit(known["mean"])
    told = model.transform(features.transform(test))
    miss = y - F.col("prediction")
    return told.agg(
        F.lit(known["n"]).cast("bigint").alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
        F.avg(off * off).alias("baseline_mse"),
        F.avg(miss * miss).alias("mse"),
    )


def _fitted(train: DataFrame, key: str, numbers: Sequence[str], texts: Sequence[str], target: str, seed: int, trees: int):
    features = SettingFeatures(numbers, texts, rotate=False).fit(train)
    ready = features.transform(train).select(col(key).alias("key"), "features", col(target).cast("double").alias("label"))
    return forest(seed, trees).fit(fixed_layout(ready, "key").drop("key")), features


def permutation_importance(
    df: DataFrame, key: str, numbers: Sequence[str], texts: Sequence[str], target: str, share: float = 0.2, seed: int = 7, trees: int = 100
) -> DataFrame:
    """How much the held-out squared error grows when one column is taken from another row: ``Feature, increase``.

    Rows are lined up by the hash of their key and each takes the column from the row half a round
    further on, so every value is used once and the result is the same in every run. ``key`` must be unique.
    All columns are tried in one pass.
    """
    train, test = hash_split(df, key, share)
    model, features = _fitted(train, key, numbers, texts, target, seed, trees)
    names = [*numbers, *texts]
    slim = test.select(col(key).alias("_key"), col(target).cast("double").alias("_y"), *[col(c) for c in names])
    placed = materialize(with_row_index(slim, [F.md5(F.col("_key").cast("string").cast("binary")), F.col("_key").asc()], name="_at"))
    n = placed.count()
    if not n:
        return df.sparkSession.createDataFrame([], "Feature string, increase double")
    other = placed.select(F.pmod(F.col("_at") + F.lit(n // 2), F.lit(n)).alias("_at"), *[col(c).alias(f"_other{i}") for i, c in enumerate(names)])
    tried = placed.join(other, "_at").withColumn("Feature", F.explode(F.array(F.lit(""), *[F.lit(c) for c in names])))
    tried = tried.withColumns({c: F.when(F.col("Feature") == c, F.col(f"_other{i}")).otherwise(col(c)) for i, c in enumerate(names)})
    miss = F.col("_y") - F.col("prediction")
    errors = model.transform(features.transform(tried)).groupBy("Feature").agg(F.avg(miss * miss).alias("mse"))
    plain = errors.where("Feature = ''").select(F.col("mse").alias("_plain"))  # one row
    return errors.where("Feature <> ''").join(F.broadcast(plain)).select("Feature", (F.col("mse") - F.col("_plain")).alias("increase"))


def holdout_error(
    df: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, share: float = 0.2, seed: int = 7, trees: int = 100
) -> DataFrame:
    """Mean squared error of a forest on held-out rows."""
    ready = SettingFeatures(numbers, texts).fit(df).transform(df)
    ready = ready.select("features", col(target).cast("double").alias("label"))
    train, test = ready.randomSplit([1 - share, share], seed=seed)
    predicted = forest(seed, trees).fit(train).transform(test)
    error = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mse").evaluate(predicted)
    return df.sparkSession.createDataFrame([(float(error),)], "mse double")
