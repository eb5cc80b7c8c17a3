"""Nearest-neighbour consistency, confusion and F1, random-forest utility, rank correlation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.forests import RandomForestClassifier
from sensorloom.operators.neighbours import neighbours


def standardize(df: DataFrame, train: DataFrame, columns: list[str] | str) -> DataFrame:
    """x, the columns, or the entries of one array column, in units of the training rows' population deviation (zero counts as one)."""
    vector = F.col(columns) if isinstance(columns, str) else F.array(*columns)
    cells = train.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = cells.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("__z"))
    # one row with an entry for each component
    return df.join(F.broadcast(stats)).withColumn("x", F.zip_with(vector, "__z", lambda v, z: (v - z["m"]) / z["s"])).drop("__z")


def knn(train: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Predicted label of each query (query_id, label, x) by its k nearest training rows (train_id, label, x) with weights 1 / distance; exact hits alone count when there are any.

    Ties go to the smaller training id, then the smaller label. See `neighbours` for the search and its defined cases.
    """
    near = neighbours(train, queries, k)
    exact = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("query_id")) == 1
    weight = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    votes = near.withColumn("weight", weight).groupBy("query_id", "label", "train_label").agg(F.sum("weight").alias("weight"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "train_label"))
    return votes.withColumn("r", r).where("r = 1").select("query_id", "label", F.col("train_label").alias("prediction"))


def confusion(predictions: DataFrame, labels: list, true: str = "label", predicted: str = "prediction") -> DataFrame:
    return predictions.groupBy(true).pivot(predicted, labels).count().fillna(0)


def f1_by_label(predictions: DataFrame) -> DataFrame:
    """label, support, tp, predicted, f1 over the labels of either side; undefined ratios are 0."""
    long = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("true"), F.lit(0).alias("pred")), F.struct(F.col("prediction").alias("l"), F.lit(0).alias("true"), F.lit(1).alias("pred")))).alias("x"), (F.col("label") == F.col("prediction")).cast("int").alias("hit"))
    per = long.groupBy(F.col("x.l").alias("label")).agg(F.sum("x.true").alias("support"), F.sum("x.pred").alias("predicted"), F.sum(F.col("hit") * F.col("x.true")).alias("tp"))
    return per.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0)))


def scores(predictions: DataFrame) -> DataFrame:
    per = f1_by_label(predictions)
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("num_samples"))


def per_label_accuracy(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """accuracy for each label of the spine; null without samples."""
    per = predictions.groupBy("label").agg(F.count("*").alias("num_samples"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    return labels.select("label").distinct().join(per, "label", "left").fillna(0, ["num_samples"])


def forest_utility(real_train: DataFrame, synthetic: DataFrame, real_test: DataFrame, columns: list[str], trees: int = 300, depth: int = 10, seed: int = 42) -> DataFrame:
    """setting, accuracy, macro_f1, weighted_f1 of forests trained on real, synthetic and both, tested on real.

    Without synthetic rows only real_only is there. label is a number.

    The forests are prepared at the same time; what they predict is one job of all of them, unless
    their rows need several (see `forests`).
    """
    array = lambda df: df.select(F.col("label").cast("double").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    real, made, test = array(real_train), array(synthetic), array(real_test)
    settings = {"real_only": real}
    if not synthetic.isEmpty():
        settings |= {"synthetic_only": made, "real_plus_synthetic": real.unionByName(made)}

    def trained(rows: DataFrame):
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

    with ThreadPool(len(settings)) as pool:
        models = pool.map(inheritable_thread_target(real_train.sparkSession)(trained), settings.values(), 1)
    out = None
    for name, model in zip(settings, models, strict=True):
        row = scores(model.transform(test).select("label", "prediction")).withColumn("setting", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("setting", "accuracy", "macro_f1", "weighted_f1")


def spearman(df: DataFrame, a: str, b: str, buckets: int = 200) -> DataFrame:
    """Rank correlation with average ranks of ties.

    Distinct values with their counts fall into buckets between approximate quantiles, which
    are ranked apart; the rows before a bucket come from the buckets' totals (at most
    buckets + 1 rows).
    """
    ranks = []
    for c in (a, b):
        counts = df.groupBy(c).agg(F.count("*").alias("n"))
        edges = counts.agg(F.percentile_approx(c, [i / buckets for i in range(1, buckets)]).alias("edges"))
        # edges is one row
        placed = counts.join(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(F.coalesce("edges", F.array()), lambda e: e < F.col(c)))).drop("edges")
        totals = placed.groupBy("bucket").agg(F.sum("n").alias("n"))
        offsets = totals.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks.append(placed.withColumn("inside", inside).join(F.broadcast(offsets), "bucket").select(c, (F.col("offset") + F.col("inside") + (F.col("n") + 1) / 2).alias(f"rank_{c}")))
    return df.join(ranks[0], a).join(ranks[1], b).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))
