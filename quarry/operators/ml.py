"""Model training, scoring, metrics, clustering and splits on Spark ML."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import as_list, is_numeric, name, present, require, require_numeric
from quarry.operators import ordered
from quarry.operators.rows import mark_by_hash
from quarry.session import scratch_path, write_out

MAX_TREE_DEPTH = 30  # the deepest Spark ML grows
FEATURES = "_features"


@dataclass
class Model:
    """A fitted pipeline with what is needed to use and explain it."""

    pipeline: PipelineModel
    kind: str
    target: str | None
    features: list[str]
    inputs: list[str] = field(default_factory=list)


def feature_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """Pipeline stages that build the feature vector, and the names of its entries.

    Text columns become 0/1 columns without their alphabetically first level; a level not seen in
    training counts as that first one, so scoring data never shifts the columns.
    """
    stages, parts, names = [], [], []
    for i, c in enumerate(features):
        if is_numeric(df, c):
            parts.append(c)
            names.append(c)
            continue
        indexer = StringIndexer(inputCol=c, outputCol=f"_i{i}", stringOrderType="alphabetDesc", handleInvalid="keep").fit(df)
        levels = list(indexer.labelsArray[0])
        if len(levels) < 2:
            continue
        encoder = OneHotEncoder(inputCol=f"_i{i}", outputCol=f"_o{i}", dropLast=False, handleInvalid="error")
        # the last two entries are the first level and the unseen one
        slicer = VectorSlicer(inputCol=f"_o{i}", outputCol=f"_s{i}", indices=list(range(len(levels) - 1)))
        stages += [indexer, encoder, slicer]
        parts.append(f"_s{i}")
        names += [f"{c}_{v}" for v in levels[:-1]]
    return [*stages, VectorAssembler(inputCols=parts, outputCol=FEATURES)], names


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_i") or c.startswith("_o") or c.startswith("_s") or c.startswith("_label")
                     or c in (FEATURES, "_raw", "_probability", "_index", "_predicted")])


def train_test_split(df: DataFrame, key: str | Sequence[str], train_size: float = 0.75, seed: int = 0,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts of exact size, floor(train_size · n) rows in the first.

    With ``stratify`` every stratum gets its share, rounded by largest remainder so that the sizes add up.
    """
    keys = as_list(key)
    require(df, *keys, stratify)
    if not 0 < train_size < 1:
        raise ValueError("train_size must be between 0 and 1")
    if stratify is None:
        marked = mark_by_hash(df, keys, seed, math.floor(train_size * df.count()), out="_train")
    else:
        shares = df.groupBy(name(stratify)).agg(F.count(F.lit(1)).alias("n")).select(
            name(stratify), "n", F.floor(F.col("n") * train_size).alias("base"),
            (-(F.col("n") * train_size - F.floor(F.col("n") * train_size))).alias("rest"))
        total, base = shares.agg(F.sum("n"), F.sum("base")).first()
        extra = math.floor(train_size * total) - base
        numbered = ordered.number_rows(write_out(shares), ["rest", stratify], out="place")
        quota = numbered.select(name(stratify), (F.col("base") + (F.col("place") < extra).cast("long")).alias("quota"))
        marked = mark_by_hash(df, keys, seed, quota, by=stratify, out="_train")
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train")


def _held_out(df: DataFrame, key: Sequence[str], used: Sequence[str], test_size: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Training rows, test rows and the number of the former; written once, as fitting reads them many times."""
    usable = present(df, *used).select(*[name(c) for c in dict.fromkeys([*key, *used])])
    n = usable.count()
    n_train = n - math.ceil(test_size * n)
    marked = write_out(mark_by_hash(usable, key, seed, n_train, out="_train")) if test_size > 0 else write_out(usable.withColumn("_train", F.lit(True)))
    return marked.filter("_train").drop("_train"), marked.filter("NOT _train").drop("_train"), n_train


def _reloaded(fitted: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as it is read back: without the training summary, whose session tasks cannot take along once a table was observed."""
    path = scratch_path(spark)
    fitted.write().save(path)
    return PipelineModel.load(path)


def train_classifier(df: DataFrame, target: str, features: str | Sequence[str], key: str | Sequence[str],
                     model: str = "random_forest", test_size: float = 0.2, seed: int = 0, n_estimators: int = 100,
                     max_depth: int | None = None, max_iter: int = 100) -> tuple[Model, float]:
    """Random forest or logistic regression on a 80/20 split; returns the model and its test accuracy."""
    cols = as_list(features)
    require(df, target, *cols, *as_list(key))
    train, test, n_train = _held_out(df, as_list(key), [target, *cols], test_size, seed)
    stages, names = feature_stages(df, cols)
    labelled = train.withColumn("_label_text", name(target).cast("string"))
    index = StringIndexer(inputCol="_label_text", outputCol="_label", stringOrderType="alphabetAsc").fit(labelled)
    common = {"featuresCol": FEATURES, "labelCol": "_label", "predictionCol": "_index", "probabilityCol": "_probability", "rawPredictionCol": "_raw"}
    if model == "random_forest":
        learner = RandomForestClassifier(numTrees=n_estimators, maxDepth=MAX_TREE_DEPTH if max_depth is None else max_depth, seed=seed, **common)
    elif model == "logistic_regression":
        # squared penalty of weight 1 over the sum of the losses
        learner = LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n_train, 1), standardization=False, **common)
    else:
        raise ValueError("model must be random_forest or logistic_regression")
    fitted = _reloaded(Pipeline(stages=[*stages, learner]).fit(index.transform(labelled)), df.sparkSession)
    back = IndexToString(inputCol="_index", outputCol="_predicted", labels=list(index.labelsArray[0]))
    trained = Model(PipelineModel([*fitted.stages, back]), f"classifier:{df.schema[target].dataType.simpleString()}", target, cols, names)
    scored = predict(test, trained, "_guess")
    accuracy = scored.agg(F.avg((F.col("_guess") == name(target)).cast("int"))).first()[0]  # None without test rows
    return trained, accuracy


def train_regressor(df: DataFrame, target: str, features: str | Sequence[str], key: str | Sequence[str],
                    model: str = "linear_regression", alpha: float = 1.0, test_size: float = 0.2, seed: int = 0,
                    n_estimators: int = 100, max_depth: int | None = None) -> tuple[Model, float]:
    """Linear, ridge or random forest regression; returns the model and R² on the held-out part (None without one)."""
    cols = as_list(features)
    require(df, *cols, *as_list(key))
    require_numeric(df, target)
    train, test, n_train = _held_out(df, as_list(key), [target, *cols], test_size, seed)
    stages, names = feature_stages(df, cols)
    labelled = train.withColumn("_label", name(target).cast("double"))
    common = {"featuresCol": FEATURES, "labelCol": "_label", "predictionCol": "_index"}
    if model == "random_forest":
        learner = RandomForestRegressor(numTrees=n_estimators, maxDepth=MAX_TREE_DEPTH if max_depth is None else max_depth, seed=seed, **common)
    elif model == "linear_regression":
        learner = LinearRegression(solver="normal", regParam=0.0, **common)
    elif model == "ridge":
        # the normal solver scales the penalty by the label's spread and the row count
        spread = labelled.agg(F.stddev_pop("_label")).first()[0] or 1.0
        learner = LinearRegression(solver="normal", regParam=alpha * spread / max(n_train, 1), elasticNetParam=0.0, standardization=False, **common)
    else:
        raise ValueError("model must be linear_regression, ridge or random_forest")
    fitted = _reloaded(Pipeline(stages=[*stages, learner]).fit(labelled), df.sparkSession)
    trained = Model(fitted, "regressor", target, cols, names)
    scored = score(predict(test, trained, "_guess"), target, "_guess", "r2")
    return trained, scored.first()["value"]


def predict(df: DataFrame, model: Model, out: str, threshold: float | None = None) -> DataFrame:
    """Add predictions; with ``threshold`` 0/1 by the probability of the second class."""
    require(df, *model.features)
    scored = model.pipeline.transform(df)
    if model.kind == "regressor":
        value = F.col("_index")
    elif threshold is not None:
        value = (vector_to_array("_probability")[1] >= threshold).cast("int")
    else:
        value = F.col("_predicted").cast(model.kind.split(":", 1)[1])
    return _plain(scored.withColumn(out, value))


def score(df: DataFrame, target: str, prediction: str, metrics: str | Sequence[str] = "accuracy") -> DataFrame:
    """(metric, value) from a table with actual and predicted values; unknown metrics get null.

    Class metrics are weighted by class size; a class never predicted has precision 0.
    """
    require(df, target, prediction)
    wanted = as_list(metrics)
    pairs = present(df, target, prediction)
    y, p = name(target), name(prediction)
    rows = []
    if {"accuracy", "mae", "mse", "r2"} & set(wanted):
        aggs = [F.avg((y == p).cast("int")).alias("accuracy")]
        if is_numeric(df, target) and is_numeric(df, prediction):
            aggs += [F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var")]
        one = pairs.agg(*aggs).first().asDict()
        one["r2"] = 1 - one["mse"] / one["var"] if one.get("var") else None
        rows += [(m, one.get(m)) for m in wanted if m in ("accuracy", "mae", "mse", "r2")]
    if {"precision", "recall", "f1"} & set(wanted):
        confusion = pairs.groupBy(y.alias("y"), p.cast(df.schema[target].dataType).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        actual = confusion.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
        guessed = confusion.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("guessed"))
        per = actual.join(guessed, "y", "left").select(
            "support", F.coalesce(F.col("hit") / F.col("guessed"), F.lit(0.0)).alias("precision"), (F.col("hit") / F.col("support")).alias("recall"))
        per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
        weighted = per.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")]).first()
        rows += [(m, weighted[m]) for m in wanted if m in ("precision", "recall", "f1")]
    known = {m for m, _ in rows}
    rows += [(m, None) for m in wanted if m not in known]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importance(spark: SparkSession, model: Model, top_n: int = 10) -> DataFrame:
    """(feature, importance), largest first: impurity importances, or mean absolute coefficients."""
    learner = next((s for s in model.pipeline.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix")), None)
    if learner is None:
        raise ValueError("the model has neither importances nor coefficients")
    if hasattr(learner, "featureImportances"):
        weights = learner.featureImportances.toArray()
    elif hasattr(learner, "coefficientMatrix"):
        weights = abs(learner.coefficientMatrix.toArray()).mean(axis=0)
    else:
        weights = abs(learner.coefficients.toArray())
    ranked = sorted(zip(model.inputs, map(float, weights)), key=lambda x: (-x[1], x[0]))[:top_n]
    return spark.createDataFrame(ranked, "feature string, importance double")


def save_model(model: Model, path: str) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    about = json.dumps({"kind": model.kind, "target": model.target, "features": model.features, "inputs": model.inputs})
    spark = SparkSession.active()
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Model:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Model(PipelineModel.load(f"{path}/pipeline"), **about)


def kmeans(df: DataFrame, features: str | Sequence[str], k: int = 3, init: str = "k-means++", n_init: int = 10,
           max_iter: int = 300, seed: int = 0, out: str = "cluster_id") -> DataFrame:
    """K-Means labels from the best of ``n_init`` starts, numbered by the order of the centres."""
    cols = as_list(features)
    require(df, *cols)
    if init not in ("k-means++", "random"):
        raise ValueError("init must be k-means++ or random")
    stages, _ = feature_stages(df, cols)
    usable = present(df, *cols)
    prepared = Pipeline(stages=stages).fit(usable)
    vectors = write_out(prepared.transform(usable).select(FEATURES))  # read once per iteration
    runs = [KMeans(k=k, initMode="k-means||" if init == "k-means++" else "random", maxIter=max_iter, seed=seed + i,
                   featuresCol=FEATURES, predictionCol="_index").fit(vectors) for i in range(n_init)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    centres = [tuple(c) for c in best.clusterCenters()]
    place = {i: n for n, i in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    label = F.get(F.lit([place[i] for i in range(len(centres))]), F.col("_index"))
    return _plain(best.transform(prepared.transform(usable)).withColumn(out, label))
