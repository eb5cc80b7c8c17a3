"""Splits and samples; random ones order rows by a hash of seed and key, which any engine run repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.windows import number_rows
from sensorloom.tables import kept


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def subject_split(df: DataFrame, train: list[int] | None = None, val: list[int] | None = None, test: list[int] | None = None) -> DataFrame:
    """split by subject: given lists, or all but the last two subjects, the second-last, the last (an empty list counts as none).

    Of the subjects only the last two reach the driver. Where they are asked for, the rows are
    written once, as they are read twice.
    """
    subject = F.col("subject_id")
    if not (train and val and test):
        df = kept(df)
        last = [r[0] for r in df.select("subject_id").where(subject.isNotNull()).distinct().orderBy(F.desc("subject_id")).limit(2).collect()]
        early = subject < last[1] if len(last) == 2 else F.lit(False)
        rules = {"train": subject.isin(train) if train else early, "val": subject.isin(val or last[1:]), "test": subject.isin(test or last[:1])}
    else:
        rules = {"train": subject.isin(train), "val": subject.isin(val), "test": subject.isin(test)}
    split = F.coalesce(*[F.when(rule, name) for name, rule in rules.items()])
    return df.withColumn("split", split).where("split is not null")


def random_split(df: DataFrame, key: str = "window_id", train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact-size split in hash order: int(n * train), then int(n * val), then the rest."""
    hashed = df.withColumn("__h", hash_order(key, seed)).withColumn("__b", F.shiftright("__h", 48))
    ranked = number_rows(hashed, ["__b"], "__r", ["__h", key])
    total = df.count()
    a, b = int(total * train), int(total * train) + int(total * val)
    return ranked.withColumn("split", F.when(F.col("__r") < a, "train").when(F.col("__r") < b, "val").otherwise("test")).drop("__h", "__b", "__r")


def split_windows(df: DataFrame, strategy: str = "subject", **options) -> DataFrame:
    if strategy not in ("subject", "random"):
        raise ValueError(f"unknown split strategy: {strategy}")
    return (subject_split if strategy == "subject" else random_split)(df, **options)


def split_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("subject_id")).alias("subjects"), F.array_sort(F.collect_set("activity_name")).alias("activities"))


def alternating_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Even rows of each activity left, odd rows right."""
    n = F.row_number().over(Window.partitionBy("activity_name").orderBy(*order)) - 1
    return df.withColumn("side", F.when(n % 2 == 0, "left").otherwise("right"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in hash order, or all."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_activity(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("activity_name").orderBy(hash_order(key, seed), key))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def first_per_activity(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("activity_name").orderBy(*order))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def prefix(df: DataFrame, n: int | None, key: str = "window_id") -> DataFrame:
    return df if n is None else df.orderBy(key).limit(n)


def pair_windows(real: DataFrame, synthetic: DataFrame, cap: int | None = 128, seed: int | None = 42) -> DataFrame:
    """Per activity, the first min(n real, n synthetic, cap) of each side, met by rank: activity_name, rn, r, s; all without a cap.

    Sides are in hash order of the seed, or by window_id without one.
    """
    first = [] if seed is None else [hash_order("window_id", seed)]
    w = Window.partitionBy("activity_name").orderBy(*first, "window_id")
    rank = lambda df, name: df.withColumn("rn", F.row_number().over(w)).where(F.lit(True) if cap is None else F.col("rn") <= cap).select("activity_name", "rn", F.col("w").alias(name), F.col("window_id").alias(f"{name}_id"))
    return rank(real, "r").join(rank(synthetic, "s"), ["activity_name", "rn"])
