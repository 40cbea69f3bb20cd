"""Phase classification: split, weights, boosted trees, MLlib forest, report."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions import fixed_values as fv
from ..windows import fill
from . import boosting

CLASSES = [fv.DEGRADING, fv.TURNING, fv.RECOVERING]


def temporal_split(df: DataFrame, year: str, test_years: int = 2) -> DataFrame:
    """``is_train``: all but the last ``test_years`` years of the table."""
    newest = df.agg(F.max(year).alias("m")).scalar()
    return df.withColumn("is_train", F.col(year) <= newest - test_years)


def class_counts(df: DataFrame, label: str, classes: list[str]) -> Column:
    """Scalar struct of the row count of each class, so weighting rows needs no shuffle."""
    return df.agg(F.struct(*[F.count_if(F.col(label) == c).alias(c) for c in classes]).alias("n")).scalar()


def class_weights(df: DataFrame, label: str, classes: list[str] = CLASSES, out: str = "weight") -> DataFrame:
    """Balanced weight n / (k n_c), with k the number of stated classes."""
    n = class_counts(df, label, classes)
    total = sum((n[c] for c in classes[1:]), n[classes[0]])
    weight = None
    for c in classes:
        value = total / (F.lit(float(len(classes))) * F.greatest(n[c], F.lit(1)))
        weight = F.when(F.col(label) == c, value) if weight is None else weight.when(F.col(label) == c, value)
    return df.withColumn(out, weight)


def _usable(train: DataFrame, features: list[str], optional: list[str]) -> list[str]:
    """Features at hand; one that is missing is an error unless declared optional."""
    absent = set(features) - set(train.columns) - set(optional)
    if absent:
        raise ValueError(f"missing features: {sorted(absent)}")
    return [f for f in features if f in train.columns]


def _class_number(label: str, classes: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1


def _phases(scored: DataFrame, probabilities: str, classes: list[str]) -> DataFrame:
    """Probability per class, the likeliest phase (the first of equals) and its probability."""
    p, names = F.col(probabilities), F.array(*[F.lit(c) for c in classes])
    return scored.withColumns({
        **{f"prob_{c.lower()}": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, c in enumerate(classes)},
        "predicted_phase": F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1), "confidence": F.array_max(p),
    }).drop(probabilities)


def phase_classifier(train: DataFrame, valid: DataFrame | None, full: DataFrame, features: list[str], label: str, weight: str | None = "weight",
                     optional: list[str] = (), classes: list[str] = CLASSES, carry: tuple[str, str, str] | None = None, **options):
    """Boosted trees fitted on ``train``, ended by ``valid``, applied to ``full``: probabilities, predicted phase, confidence, rounds used.

    NULL features count as 0; rows of other labels are left out of the fit. ``carry`` = (entity, year, column) fills a column
    forward per entity before prediction; ``options`` go to ``boosting.boost``. Returns (predictions, {feature: importance}).
    """
    used = _usable(train, features, optional)
    columns = [*[F.col(f) for f in used], _class_number(label, classes).alias("_y")]
    rows = train.select(*columns, (F.col(weight) if weight else F.lit(1.0)).alias("_w"), F.lit(False).alias("_v"))
    if valid is not None:
        rows = rows.unionByName(valid.select(*columns, F.lit(1.0).alias("_w"), F.lit(True).alias("_v")))
    model = boosting.boost(rows.filter("_y >= 0"), used, "_y", len(classes), "_w", "_v", **options)
    if carry:
        full = fill(full, [carry[0]], [carry[1]], carry[2])
    out = _phases(full.withColumn("_p", model.probabilities(full)), "_p", classes)
    return out.withColumn("n_rounds", F.lit(model.best)), model.importances()


def forest_classifier(train: DataFrame, full: DataFrame, features: list[str], label: str, weight: str | None = "weight",
                      optional: list[str] = (), classes: list[str] = CLASSES, seed: int = 42, trees: int = 60, depth: int = 5):
    """As ``phase_classifier``, by a random forest without validation rows."""
    used = _usable(train, features, optional)

    def vectors(df):
        inputs = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used})
        out = VectorAssembler(inputCols=[f"_f_{c}" for c in used], outputCol="_x").transform(inputs)
        return out.drop(*[f"_f_{c}" for c in used])

    # MLlib reads the class count from the highest label, so every class must occur or probabilities are padded.
    labelled = vectors(train.withColumn("_y", _class_number(label, classes).cast("double")).filter("_y >= 0"))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                   weightCol=weight, probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_raw").fit(labelled)
    scored = model.transform(vectors(full)).withColumn("_p", vector_to_array("_p")).drop("_x", "_raw", "_pred")
    return _phases(scored, "_p", classes), dict(zip(used, [float(v) for v in model.featureImportances.toArray()]))


def top_importance(df: DataFrame, name: str, value: str, keys: list[str] = (), k: int = 5, out: str = "top_json",
                   salts: int = 64) -> DataFrame:
    """The k largest entries as a JSON object, largest first; equal values by name.

    Each hashed slice of a group keeps its k best, so at most ``salts * k`` entries of a group meet.
    """
    slice_ = F.pmod(F.xxhash64(name), F.lit(salts))
    best = Window.partitionBy(*keys, slice_).orderBy(F.col(value).desc(), F.col(name))
    kept = df.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))))
    entries = F.transform(F.slice(pairs, 1, k), lambda e: F.struct(e["n"].alias("key"), (-e["v"]).alias("value")))
    return kept.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias(out))


def importance_frame(spark, importances: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(importances.items()), "feature string, importance double")


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted F1 on each row."""
    cell = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cell.select(F.col("t").alias("class"), "n", F.lit("t").alias("s"), (F.col("t") == F.col("p")).alias("hit"))
    sides = sides.unionByName(cell.select(F.col("p").alias("class"), "n", F.lit("p").alias("s"), F.lit(False).alias("hit")))
    per = sides.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("s") == "t", F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("s") == "p", F.col("n"))), F.lit(0)).alias("predicted"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")),
        "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    })
    both = per.agg(F.struct(
        F.avg("f1").alias("macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted")).alias("s")).scalar()
    return per.select("class", "precision", "recall", "f1", "support", both["macro"].alias("f1_macro"), both["weighted"].alias("f1_weighted"))
