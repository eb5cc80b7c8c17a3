"""Intermediate tables and lookups that stay bounded."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df's rows in the shared checkpoint folder of the session, without their lineage.

    The folder is what spark.checkpoint.dir names; where it is unset, a temporary one will do on a single machine only.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def looked_up(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", limit: int = 4096) -> DataFrame:
    """df joined with the table, which is broadcast while it has at most `limit` rows, counted first."""
    return df.join(F.broadcast(table) if table.limit(limit + 1).count() <= limit else table, on, how)


def as_key(columns: list[str]) -> Column:
    """The columns as one value that equals itself where some are null."""
    return F.struct(*columns) if columns else F.struct(F.lit(0))
