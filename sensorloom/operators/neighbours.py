"""Exact nearest neighbours by pivots and the triangle inequality.

Training rows belong to the nearest of at most PIVOTS pivots, rows of the table taken by a hash.
Cells lie along a tour from pivot to nearest pivot and are packed into blocks of about BLOCK
rows in that order; a cell of more rows is several blocks. Queries are packed in the same way, by
their nearest pivot, so that queries of one lot are near each other.

A query first meets a few cells near it, which bounds its k-th distance. It then meets only cells
that may hold a nearer row: with p the cell's pivot, o the query's nearest pivot and [low, high]
the distances of the cell's rows to p, no row of the cell is nearer than d(q, p) - high,
low - d(q, p) or (d(q, p) - d(q, o)) / 2, and rows whose own distance to p differs from the query's by
more than the bound are passed over as well. A block travels to a lot if any of the lot's
queries needs one of its cells; a lot meets up to TOGETHER blocks in a row, each with the bounds that those
before it have left. Distances are estimated by one matrix product; what lies within the
bound is measured exactly. On data without clusters the bounds exclude little and all
blocks are met; the result is the same.

The driver holds the pivots and one row of counts for each; a task holds one block and one lot
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorloom.tables import kept

PIVOTS = 512
BLOCK = 2048
TOGETHER = 16  # blocks that a lot meets one after the other
SLACK = 1e-9  # of the distances, for rounding


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has no null, NaN or infinite component."""
    return df.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of a and b, from differences, so that equal rows have distance 0."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(b):
        out[:, i] = np.sqrt(((a - row) ** 2).sum(axis=1))
    return out


def _tour(pivots: np.ndarray) -> list[int]:
    """The pivots in an order that goes to the nearest one not yet met."""
    d = distances(pivots, pivots)
    order, left = [0], set(range(1, len(pivots)))
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[d[order[-1], rest].argmin()]))
        left.remove(order[-1])
    return order


class Packing:
    """For each cell its first bin and its number of bins; small cells that follow each other on the tour share one."""

    def __init__(self, sizes: np.ndarray, tour: list[int]) -> None:
        self.first, self.count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        at, held = 0, 0
        for c in tour:
            if held and held + sizes[c] > BLOCK:
                at, held = at + 1, 0
            self.first[c], self.count[c] = at, max(1, -(-int(sizes[c]) // BLOCK))
            if self.count[c] > 1:
                at, held = at + int(self.count[c]), 0
            else:
                held += int(sizes[c])

    def bin(self, *keys: str) -> Column:
        """The bin of a row with a cell, dealt by a hash of the keys where the cell has several."""
        of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
        return of(self.first) + F.pmod(F.xxhash64(*keys), of(self.count))


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df with the nearest pivot's number as cell and the distance to it as away."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                d = distances(np.stack(part["x"].to_list()), pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), away=d[np.arange(len(d)), cell])

    return kept(df.mapInPandas(nearest, df.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema))


class Cells:
    """The training rows by pivot: their number, the least and greatest distance, and the bins they are packed in."""

    def __init__(self, train: DataFrame) -> None:
        n = train.count()
        first = train.orderBy(F.xxhash64("train_id"), "train_id").limit(min(PIVOTS, max(1, int(n**0.5)))).select("x").collect()
        self.pivots = np.array([r.x for r in first], np.float64).reshape(len(first), -1)
        self.tour = _tour(self.pivots)
        self.rows = _placed(train, self.pivots)
        self.size, self.low, self.high = np.zeros(len(first), np.int64), np.zeros(len(first)), np.zeros(len(first))
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():
            self.size[r.cell], self.low[r.cell], self.high[r.cell] = r.n, r.low, r.high
        self.packing = Packing(self.size, self.tour)

    def blocks(self) -> DataFrame:
        """A row for each bin: its rows' cells, distances to the pivot, ids, labels and vectors, by cell and distance."""
        lists = self.rows.groupBy(self.packing.bin("train_id", "x").alias("bin")).agg(F.sort_array(F.collect_list(F.struct("cell", "away", "train_id", "label", "x"))).alias("r"))
        return lists.select("bin", F.col("r.cell").alias("cells"), F.col("r.away").alias("aways"), F.col("r.train_id").alias("train_ids"), F.col("r.label").alias("train_labels"), F.flatten("r.x").alias("txs"))

    def needed(self, d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each query, a row of distances to the pivots, the cells that may hold a row within its bound."""
        nearest = np.maximum(np.maximum(d - self.high, self.low - d), (d - d.min(axis=1, keepdims=True)) / 2)
        room = bounds[:, None] + SLACK * (np.where(np.isfinite(bounds), bounds, 0)[:, None] + d)
        return (nearest <= room) & (self.size > 0)

    def close(self, d: np.ndarray, k: int) -> np.ndarray:
        """For each query the nearest cells that hold 2 k rows in one of their bins each."""
        out = np.zeros(d.shape, bool)
        held = self.size // self.packing.count
        for i, order in enumerate(np.argsort(d, axis=1, kind="stable")):
            out[i, order[: int(np.searchsorted(np.cumsum(held[order]), 2 * k)) + 1]] = True
        return out & (self.size > 0)


class _Lot:
    """Queries of a lot with the nearest rows met so far, which tighten their bounds."""

    def __init__(self, batch: pa.RecordBatch, i: int, plan: Cells, k: int, first: bool) -> None:
        cell = {c: batch[c][i].values for c in ("query_ids", "labels", "xs", "bounds")}
        self.ids, self.labels, self.k, self.held = cell["query_ids"], cell["labels"], k, None
        self.q = cell["xs"].to_numpy().reshape(-1, plan.pivots.shape[1])
        self.bounds = np.full(len(self.q), np.inf) if first else cell["bounds"].to_numpy().copy()
        self.d = distances(self.q, plan.pivots)
        self.need = plan.close(self.d, k) if first else plan.needed(self.d, self.bounds)
        self.square, self.seen = (self.q**2).sum(axis=1), np.zeros(len(self.q), np.int64)

    def meet(self, batch: pa.RecordBatch, i: int) -> None:
        cell = {c: batch[c][i].values for c in ("cells", "aways", "train_ids", "train_labels", "txs")}
        t, aways, of = cell["txs"].to_numpy().reshape(len(cell["cells"]), -1), cell["aways"].to_numpy(), cell["cells"].to_numpy()
        square = (t**2).sum(axis=1)
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in np.unique(of).tolist():
            a, b = np.searchsorted(of, [c, c + 1])
            asks = np.flatnonzero(self.need[:, c])
            limit = self.bounds[asks]
            room = limit + SLACK * (np.where(np.isfinite(limit), limit, 0) + self.d[asks, c])
            low, high = np.searchsorted(aways[a:b], self.d[asks, c] - room), np.searchsorted(aways[a:b], self.d[asks, c] + room, side="right")
            some = high > low
            asks, room, low, high = asks[some], room[some], low[some], high[some]
            if not len(asks):
                continue
            self.seen[asks] += high - low
            sums = self.square[asks, None] + square[None, a:b]
            place = np.arange(b - a)
            near = (sums - 2 * (self.q[asks] @ t[a:b].T) <= room[:, None] ** 2 + SLACK * sums) & (place >= low[:, None]) & (place < high[:, None])
            x, y = np.nonzero(near)
            at.append(asks[x])
            to.append(y + a)
        at, to = np.concatenate(at), np.concatenate(to)
        exact = np.empty(len(at))
        for s in range(0, len(at), 1 << 16):
            exact[s : s + (1 << 16)] = np.sqrt(((self.q[at[s : s + (1 << 16)]] - t[to[s : s + (1 << 16)]]) ** 2).sum(axis=1))
        new = pa.table({"at": at, "d": exact, "train_id": cell["train_ids"].take(pa.array(to)), "train_label": cell["train_labels"].take(pa.array(to))})
        both = new if self.held is None else pa.concat_tables([self.held, new])
        at, d = both["at"].to_numpy(), both["d"].to_numpy()
        order = np.lexsort((pc.rank(both["train_id"], tiebreaker="dense").to_numpy(), d, at))
        nth = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        kept_rows = order[nth < self.k]
        last = order[nth == self.k - 1]  # the k-th of those queries that have k
        self.bounds[at[last]] = np.minimum(self.bounds[at[last]], d[last])
        self.held = both.take(pa.array(kept_rows))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None and self.held.num_rows:
            at = pa.array(self.held["at"].to_numpy())
            columns = [self.ids.take(at), self.labels.take(at), self.held["train_id"], self.held["train_label"], self.held["d"], pa.array(self.seen[at.to_numpy()])]
            yield from pa.table(columns, names=["query_id", "label", "train_id", "train_label", "d", "compared"]).to_batches()


def _met(lots: DataFrame, cells: Cells, blocks: DataFrame, k: int, first: bool) -> DataFrame:
    """query_id, label, train_id, train_label, d: of each lot and TOGETHER blocks that it meets the k nearest rows of each query; and the pairs compared for the query there."""
    plan = Cells.__new__(Cells)  # what tasks need of the cells, without the frame
    plan.pivots, plan.size, plan.low, plan.high, plan.packing = cells.pivots, cells.size, cells.low, cells.high, cells.packing

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lot = batch["lot"][i].as_py()
                bins = set()
                for c in np.flatnonzero(_Lot(batch, i, plan, k, first).need.any(axis=0)).tolist():
                    start, n = int(plan.packing.first[c]), int(plan.packing.count[c])
                    bins |= {start + lot % n} if first else set(range(start, start + n))
                part = np.arange(len(bins)) // TOGETHER
                yield pa.RecordBatch.from_arrays([pa.array([lot] * len(bins), pa.int64()), pa.array(part), pa.array(sorted(bins), pa.int64())], names=["lot", "part", "bin"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["bin"][i].as_py() is None:  # the lot itself comes before its blocks
                    if now is not None:
                        yield from now.rows()
                    now, key = _Lot(batch, i, plan, k, first), (batch["lot"][i].as_py(), batch["part"][i].as_py())
                else:
                    assert key == (batch["lot"][i].as_py(), batch["part"][i].as_py())
                    now.meet(batch, i)
        if now is not None:
            yield from now.rows()

    pairs = kept(lots.mapInArrow(meetings, "lot long, part long, bin long"))
    own = pairs.select("lot", "part").distinct().join(lots, "lot")
    met = pairs.join(blocks, "bin")
    dealt = own.unionByName(met, allowMissingColumns=True).repartition("lot", "part").sortWithinPartitions("lot", "part", F.asc_nulls_first("bin"))
    one = lambda c: F.get(c, F.lit(0)).alias(c[:-1])
    schema = dealt.select(*[one(c) for c in ("query_ids", "labels", "train_ids", "train_labels")], F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("compared")).schema
    return dealt.mapInArrow(compare, schema)


def _lots(queries: DataFrame, packing: Packing) -> DataFrame:
    lists = queries.groupBy(packing.bin("query_id", "x").cast("long").alias("lot")).agg(F.collect_list(F.struct("query_id", "label", "x", "bound")).alias("q"))
    return lists.select("lot", F.col("q.query_id").alias("query_ids"), F.col("q.label").alias("labels"), F.flatten("q.x").alias("xs"), F.col("q.bound").alias("bounds"))


def _nearest(met: DataFrame, k: int) -> DataFrame:
    # the rank limit prunes each task's rows before they are shuffled
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "train_id"))
    return met.withColumn("r", rank).where(F.col("r") <= k)


def neighbours(train: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, label, train_id, train_label, d: each query's k nearest training rows, ties to the smaller id.

    Ids are distinct on either side. Rows of either side whose vector is null or has null, NaN or
    infinite components take no part; no training rows give no rows.
    """
    train, queries = kept(_usable(train).select("train_id", "label", "x")), _usable(queries).select("query_id", "label", "x")
    if train.isEmpty():
        return train.sparkSession.createDataFrame([], T.StructType([*queries.select("query_id", "label").schema, train.schema["train_id"], T.StructField("train_label", train.schema["label"].dataType), T.StructField("d", T.DoubleType())]))
    cells = Cells(train)
    blocks = cells.blocks()
    asked = _placed(queries, cells.pivots)
    sizes = np.zeros(len(cells.pivots), np.int64)
    for r in asked.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    packing = Packing(sizes, cells.tour)
    met = _nearest(_met(_lots(asked.withColumn("bound", F.lit(float("inf"))), packing), cells, blocks, k, True), k).groupBy("query_id").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    # fewer than k rows bound nothing
    bounds = kept(met.select("query_id", F.when(F.col("n") >= k, F.col("d")).otherwise(float("inf")).alias("bound")))
    bounded = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return _nearest(_met(_lots(bounded, packing), cells, blocks, k, False), k).drop("r", "compared")
