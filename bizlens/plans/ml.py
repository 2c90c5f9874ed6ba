"""Propensity model: features, split, boosted trees, and metrics that never collect the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.functions.bands import classify
from bizlens.functions.metrics import ratio
from bizlens.operators.aggregate import histogram
from bizlens.operators.ordering import at_or_above_fraction, running_total, same

BASE_YEAR = 2025


def featurise(df: DataFrame, ids: Sequence[str] = ("cvr", "company_name"), flags: Sequence[str] = ("has_subsidiaries",),
              label: str = "uses_target_software", founded: str | None = "founded_year") -> DataFrame:
    """Row-wise part of the features: names dropped, booleans to 0/1, company age.

    The first of ``ids`` stays as the row key for splitting and scoring; it is no feature.
    """
    out = df.withColumns({c: F.col(c).cast("int") for c in flags}).withColumn("label", F.col(label).cast("double"))
    if founded:
        out = out.withColumn("company_age", F.lit(BASE_YEAR) - F.col(founded))
    return out.drop(*[c for c in ids[1:] if c in out.columns], label)


def pipeline(categorical: Sequence[str], numeric: Sequence[str], trees: int = 300, depth: int = 4, rate: float = 0.08,
             subsample: float = 0.9, features_per_tree: float = 0.9, seed: int = 42) -> Pipeline:
    """Index, one-hot (all levels kept) and assemble the columns, then boosted trees."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical], dropLast=False)
    assemble = VectorAssembler(inputCols=[f"{c}_oh" for c in categorical] + list(numeric), outputCol="features")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate,
                        subsamplingRate=subsample, featureSubsetStrategy=str(features_per_tree), seed=seed)
    return Pipeline(stages=[index, hot, assemble, gbt])


def train(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], **params) -> PipelineModel:
    return pipeline(categorical, numeric, **params).fit(df)


def score(model: PipelineModel, df: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of the positive class for every row."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def attach_scores(companies: DataFrame, scores: DataFrame, key: str = "cvr", out: str = "prob") -> DataFrame:
    """Companies with their score; one that was not scored keeps NULL."""
    return companies.join(scores.select(key, out), key, "left")


def top_features(model: PipelineModel, df: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most important features by name."""
    width = model.stages[-1].featureImportances.toArray()
    meta = model.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    best = sorted(((names.get(i, str(i)), float(v)) for i, v in enumerate(width)), key=lambda r: (-r[1], r[0]))[:k]
    return df.sparkSession.createDataFrame(best, "feature string, importance double")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """Mark an exact, repeatable ``test`` share of each label (column ``is_test``).

    Rows are ordered by a hash of the id, whose first digits cut them into even ranges. Whole ranges are in or out by
    their counts; only the rows of the one range per label at the edge are ranked. Rows without a label form a stratum of their
    own; rows without an id share one hash and come in the order of the whole row.
    """
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    marked = df.withColumns({"_h": h, "_b": F.substring(h, 1, 4)})
    counts = marked.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_label = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(in_label), F.lit(0)),
        "_want": F.round(F.sum("_n").over(Window.partitionBy(label)) * F.lit(test), 0).cast("bigint")})
    counts = counts.select(F.col(label).alias("_label"), F.col("_b").alias("_range"), "_n", "_before", "_want")
    joined = marked.join(counts, same([F.col(label), F.col("_b")], [F.col("_label"), F.col("_range")]))
    edge = (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") > F.col("_want"))
    pos = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key, F.xxhash64(*df.columns)))
    whole = joined.filter(~edge).withColumn("is_test", F.col("_before") + F.col("_n") <= F.col("_want"))
    ranked = joined.filter(edge).withColumn("is_test", F.col("_before") + pos <= F.col("_want"))
    return whole.unionByName(ranked).drop("_h", "_b", "_label", "_range", "_n", "_before", "_want")


def _curve(df: DataFrame, score_col: str, label: str) -> DataFrame:
    """Per distinct score: positives, negatives and their counts at or above it."""
    g = df.groupBy(score_col).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("_n")).withColumn("neg", F.col("_n") - F.col("pos")).drop("_n")
    return running_total(g, [(score_col, True)], {"tp": "pos", "fp": "neg"})


def _outranked() -> Column:
    """Positives above each negative's score, plus half of those that tie with it."""
    return F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos").cast("double") / 2.0)


def auc(df: DataFrame, score_col: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve from per-score counts: exact, ties count half."""
    c = _curve(df, score_col, label)
    g = c.agg(F.sum(_outranked()).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return g.select("p", "n", F.round(F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n").cast("double")), 8).alias("auc")).withColumnsRenamed(
        {"p": "positives", "n": "negatives"})


def roc(df: DataFrame, score_col: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score: rates of all rows scored at or above it."""
    c = _curve(df, score_col, label)
    pos, neg = c.agg(F.sum("pos")).scalar(), c.agg(F.sum("neg")).scalar()
    return c.select(F.col(score_col).alias("threshold"), F.round(ratio(F.col("fp"), neg), 8).alias("fpr"), F.round(ratio(F.col("tp"), pos), 8).alias("tpr"))


def confusion(df: DataFrame, threshold: float = 0.5, score_col: str = "score", label: str = "label", inclusive: bool = True) -> DataFrame:
    pred = classify(score_col, threshold, inclusive).alias("predicted")
    return df.groupBy(F.col(label).cast("int").alias("actual"), pred).agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, bins: int = 10, score_col: str = "score", label: str = "label") -> DataFrame:
    """Mean score against the positive rate in equal-width bins."""
    b = F.least(F.floor(F.col(score_col) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    s = F.col(score_col).cast("decimal(20,12)")
    return df.groupBy(b).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(s).cast("double") / F.count(F.lit(1)).cast("double"), 8).alias("mean_score"),
        F.round(F.avg(F.col(label).cast("double")), 8).alias("positive_rate"))


def score_hist(df: DataFrame, bins: int = 30, score_col: str = "score", label: str = "label") -> DataFrame:
    return histogram(df, score_col, 0, 1, bins, by=[label])


def segment_scores(df: DataFrame, dim: str, threshold: float = 0.5, score_col: str = "score") -> DataFrame:
    """Average score and count of high scores per segment."""
    s = F.col(score_col).cast("decimal(20,12)")
    return df.groupBy(dim).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(s).cast("double") / F.count(F.lit(1)).cast("double"), 8).alias("avg_score"),
        F.count_if(F.col(score_col) >= threshold).alias("high_scores"))


def precision_at(df: DataFrame, threshold: float = 0.5, score_col: str = "score", label: str = "label") -> DataFrame:
    hit = F.col(score_col) >= threshold
    g = df.agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"))
    return g.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 8))


def top_decile_lift(df: DataFrame, score_col: str = "score", frac: float = 0.1) -> DataFrame:
    """Mean score of the top fraction (ties at the edge included) over the mean of all."""
    edge = at_or_above_fraction(df, score_col, frac)
    s = F.col(score_col).cast("decimal(20,12)")
    flagged = df.select(s.alias("_s"), (F.col(score_col) >= edge).alias("_top"))
    g = flagged.agg(
        F.count_if("_top").alias("n_top"), (F.sum(F.when(F.col("_top"), F.col("_s"))).cast("double") / F.count_if("_top").cast("double")).alias("top"),
        (F.sum("_s").cast("double") / F.count("_s").cast("double")).alias("base"))
    return g.select("n_top", F.round("top", 8).alias("top_mean"), F.round("base", 8).alias("base_mean"), F.round(F.try_divide("top", "base"), 6).alias("lift"))


def lift_curve(df: DataFrame, bins: int = 10, score_col: str = "score", label: str = "label") -> DataFrame:
    """Cumulative positive rate of the best ``i / bins`` of rows over the overall rate.

    Rows with one score stay together: a step ends at the first score that reaches it.
    """
    c = _curve(df, score_col, label).withColumn("seen", F.col("tp") + F.col("fp"))
    n, pos = c.agg(F.sum(F.col("pos") + F.col("neg"))).scalar(), c.agg(F.sum("pos")).scalar()
    # A score closes every step that its rows cross.
    steps = c.withColumn("_all", n).withColumn("step", F.explode(F.filter(
        F.sequence(F.lit(1), F.lit(bins)),
        lambda i: (F.col("seen") * bins >= i * F.col("_all")) & ((F.col("seen") - F.col("pos") - F.col("neg")) * bins < i * F.col("_all")))))
    base = ratio(pos, n)
    return steps.select("step", "seen", F.col("tp").alias("positives"), F.round(F.try_divide(ratio("tp", "seen"), base), 6).alias("lift"))


def drift(history: DataFrame, drop: float = 0.02) -> DataFrame:
    """Weeks whose AUC fell by more than ``drop`` against the week before: ``(week, auc)`` rows, one per week."""
    w = Window.partitionBy("model").orderBy("week")
    moved = history.withColumn("change", F.round(F.col("auc") - F.lag("auc").over(w), 8))
    return moved.withColumn("alert", F.coalesce(F.col("change") < -F.lit(drop), F.lit(False)))


def auc_by(df: DataFrame, by: str, score_col: str = "score", label: str = "label") -> DataFrame:
    """AUC per slice, for example per week."""
    g = df.groupBy(by, score_col).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("_n"))
    c = running_total(g.withColumn("neg", F.col("_n") - F.col("pos")), [(score_col, True)], {"tp": "pos"}, by=[by])
    out = c.groupBy(by).agg(F.sum(_outranked()).alias("w"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return out.select(by, F.round(F.try_divide(F.col("w"), F.col("p") * F.col("n")), 8).alias("auc"))
