"""Chart-type model on image embeddings."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L
from ..session import saved

#: Chart types that train as another class, and training classes of other categories.
ALIAS = {"violin": "box", "mixed": "other"}
NON_CHART = {"method": "x:method", "background": "x:background", "example": "x:example", "table": "x:table", "prompt": "x:prompt"}
PENALTY = 20.0
MAX_ITER, TOLERANCE = 200, 1e-9


def _alias(c: Column) -> Column:
    return C.mapped(c, ALIAS, c)


def training_label(figures: DataFrame) -> DataFrame:
    """Add `label`: from the figure's label, a chart named in its text, or null. Panels get no text guess."""
    named = F.when(F.col("parent").isNull(), C.chart_of_texts())
    step = figures.withColumns(C.chart_texts(F.col("v_tags"), F.col("caption"))).withColumns({"_named": named, "_kind": C.blank_to_null(_alias(F.coalesce("v_chart_type", F.lit(""))))})
    guess = _alias(F.col("_named"))
    data = F.when(F.col("_kind") != "other", F.col("_kind")).otherwise(F.coalesce(guess, F.lit("other")))
    label = F.when(F.col("v_category") == "data", data).when(F.col("v_category").isNull(), guess).otherwise(C.mapped(F.col("v_category"), NON_CHART, F.lit(None)))
    return step.withColumn("label", label).drop("_named", "_kind", "low_tags", "low_caption")


def chart_candidates(figures: DataFrame) -> DataFrame:
    """Data figures without a clear chart type, unlabelled results and unlabelled panels."""
    kind = F.coalesce(C.blank_to_null(_alias(F.col("v_chart_type"))), F.lit("other"))
    open_ = F.col("v_category").isNull()
    return figures.filter((F.col("v_category").eqNullSafe("data") & (kind == "other")) | (open_ & ((F.col("kind") == "result") | F.col("parent").isNotNull())))


def embedding_delta(figures: DataFrame, thumbs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys to embed, cache rows still live); thumbs has (fig_id, mtime), cache has fig_key."""
    keys = figures.join(thumbs, "fig_id").select("fig_id", F.concat("fig_id", F.lit("|"), F.floor("mtime").cast("string")).alias("fig_key"))
    return keys.join(cache.select("fig_key"), "fig_key", "left_anti"), cache.join(keys.select("fig_key"), "fig_key", "left_semi")


def norm2(embedding: Column) -> Column:
    return F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows at unit length; a zero vector stays."""
    n = norm2(F.col(column))
    return df.withColumn("_n", n).withColumn(column, F.transform(column, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x.cast("double")))).drop("_n")


def frequent_classes(labelled: DataFrame, least: int = L.MIN_PER_CLASS) -> DataFrame:
    """Class counts of the classes with at least `least` rows."""
    return labelled.groupBy("label").agg(F.count("label").alias("n")).filter(F.col("n") >= least)


def class_weights(labelled: DataFrame) -> DataFrame:
    """Rows of frequent classes with weight rows / (classes x class rows); at most one row for each class is broadcast."""
    counts = frequent_classes(labelled)
    every = Window.partitionBy(F.lit(0))  # a row for each class, no more
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return labelled.join(F.broadcast(counts.select("label", weight.alias("weight"))), "label")


def fit_chart_model(rows: DataFrame) -> tuple[LogisticRegressionModel, list[str]]:
    """Class-balanced multinomial logistic regression on (embedding, label, weight); classes in order."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()  # a row for each class
    classes = sorted(r["label"] for r in counts)
    n = sum(r["n"] for r in counts)
    index = C.mapped(F.col("label"), {c: float(i) for i, c in enumerate(classes)}, F.lit(0.0))
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), index.cast("double").alias("y"), "weight")
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (PENALTY * n), elasticNetParam=0.0, standardization=False, maxIter=MAX_ITER, tol=TOLERANCE)
    return model.fit(data), classes


def probabilities(model: LogisticRegressionModel, classes: list[str], rows: DataFrame, all_classes: bool = False) -> DataFrame:
    """rows with the most likely class and its probability; `all_classes` keeps the probabilities of all in `_p`."""
    data = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    p = model.transform(data).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max("_p")
    return p.withColumns({"pred_label": F.get(names, (F.array_position("_p", best) - 1).cast("int")), "pred_p": best}).drop("features", "rawPrediction", "probability", "prediction", *([] if all_classes else ["_p"]))


def optimality(model: LogisticRegressionModel, classes: list[str], rows: DataFrame) -> DataFrame:
    """(label, gradient): for each class the largest component of the gradient of the penalised, weighted mean likelihood at the model, zero at its optimum.

    Rows are summed per embedding dimension as columns; what comes out has a row for each class.
    """
    n = rows.count()
    p = probabilities(model, classes, rows, all_classes=True)
    ones = F.array([(F.col("label") == c).cast("double") for c in classes])
    residual = F.zip_with("_p", ones, lambda x, y: F.col("weight") * (x - y))
    terms = p.select("weight", residual.alias("r"), F.posexplode(F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0)))).alias("dim", "x"))
    sums = terms.groupBy("dim").agg(F.array([F.sum(F.get("r", F.lit(i)) * F.col("x")) / F.sum("weight") for i in range(len(classes))]).alias("g"))
    matrix = model.coefficientMatrix.toArray()
    penalty = F.array([F.array([F.lit(float(x) / (PENALTY * n)) for x in row] + [F.lit(0.0)]) for row in matrix])  # the intercept bears none
    each = sums.select("dim", F.posexplode("g").alias("k", "g"))
    names = F.array([F.lit(c) for c in classes])
    return each.groupBy(F.get(names, F.col("k")).alias("label")).agg(F.max(F.abs(F.col("g") + F.get(F.get(penalty, F.col("k")), F.col("dim")))).alias("gradient"))


def class_means(rows: DataFrame) -> tuple[list[list[float]], list[float], list[str]]:
    """A linear model by class means: coefficients, intercepts and classes in order; the nearest mean scores highest. One small row for each class comes to the driver."""
    dims = rows.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    means = dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean")).orderBy("label").collect()
    return [list(r["mean"]) for r in means], [-sum(x * x for x in r["mean"]) / 2 for r in means], [r["label"] for r in means]


def linear_model(model: LogisticRegressionModel, classes: list[str]) -> tuple[list[list[float]], list[float], list[str]]:
    """Coefficients, intercepts and classes of a fitted model."""
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), classes


def score_columns(rows: DataFrame, coefficients: list[list[float]], intercepts: list[float], classes: list[str]) -> DataFrame:
    """rows with the most likely class of a linear model and its probability, by dot products and softmax as columns; of equal scores the first class counts."""
    x = F.col("embedding").cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(x, F.array([F.lit(float(c)) for c in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = rows.withColumn("_s", F.array([dot(w) + F.lit(float(b)) for w, b in zip(coefficients, intercepts)])).withColumn("_m", F.array_max("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_m")))
    names = F.array([F.lit(c) for c in classes])
    return scored.withColumns({"pred_label": F.get(names, (F.array_position("_s", F.col("_m")) - 1).cast("int")), "pred_p": 1 / total}).drop("_s", "_m")


def with_folds(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Stratified folds: inside each class by the hash order of the key, dealt round.

    Rows are range-partitioned by class and hash and numbered inside their partitions; a class's rows in earlier partitions (a count for
    each class and partition) give the offset, so no task sees a whole class.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "_h", key]
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string")))
    # range bounds come from a sample, so the ranged rows are written once: counts and rows must agree
    ranged = saved(hashed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "fold-ranges")
    sizes = ranged.groupBy("label", "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    before = sizes.select(F.col("label").alias("_label"), F.col("_part").alias("_in"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "label").orderBy("_h", key)))
    placed = numbered.join(F.broadcast(before), (F.col("_part") == F.col("_in")) & F.col("label").eqNullSafe(F.col("_label")))
    return placed.withColumn("fold", ((F.col("_before") + F.col("_n") - 1) % k).cast("int")).drop("_h", "_part", "_n", "_before", "_in", "_label")


def cross_validate(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Out-of-fold class and probability of every row."""
    folded = saved(with_folds(rows, key, k), "folds")
    out = None
    for i in range(k):
        model, classes = fit_chart_model(folded.filter(F.col("fold") != i))
        part = probabilities(model, classes, folded.filter(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def cv_report(oof: DataFrame, min_p: float) -> DataFrame:
    """Accuracy, and accuracy and share of rows at min_p or more; zero where there are none."""
    hit, sure = (F.col("label") == F.col("pred_label")).cast("double"), F.col("pred_p") >= min_p
    return oof.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.when(sure, hit)), F.lit(0.0)).alias("accuracy_sure"), F.coalesce(F.avg(sure.cast("double")), F.lit(0.0)).alias("share_sure"))


def predict_charts(model: LogisticRegressionModel, classes: list[str], candidates: DataFrame, min_p: float = 0.8) -> DataFrame:
    """Candidates with pred_label and pred_p (three digits) where sure, null otherwise."""
    p = probabilities(model, classes, candidates)
    sure = F.col("pred_p") >= min_p
    return p.withColumns({"pred_label": F.when(sure, F.col("pred_label")), "pred_p": F.when(sure, F.bround("pred_p", 3))})


def prediction_counts(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.coalesce("pred_label", F.lit("(unsure)")).alias("pred_label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pred_label")
