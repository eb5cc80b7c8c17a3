"""Random forests of deep trees: nodes with many rows are split by summed histograms, smaller ones are grown to their leaves in one task.

A deep tree has about a node for every row, so no tree is kept: test rows move down with the training
rows, and a task returns only what its trees say about them. Equal training rows are one row with a
count; how often a tree takes a row is a Poisson number, so what a tree does depends on the seed, its
number and the rows, not on where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.tables import kept

#: Numbers (rows by features) and rows that a task holds of the training rows of one node.
NODE_CELLS, NODE_ROWS = 1 << 22, 1 << 20
#: Rows of a block.
BLOCK_ROWS = 1 << 14
#: Blocks of test rows that meet a node's training rows at a time.
TEST_BLOCKS = 16
#: Most tasks over which a forest is dealt while its trees' roots fit into a task.
GROUPS = 32
#: Rows, counted for each tree, that are grown in step; they fit into a core's cache.
STEP_ROWS = 1 << 15
#: Rows, counted for each tree, that are dealt to their nodes in one wave, and the fewest trees of a wave; a wave's rows lie on disk.
WAVE_ROWS, WAVE_TREES = 1 << 21, 8
#: Nodes whose histograms one pass gathers, and the quantiles that bound a histogram's bins.
PASS_NODES, QUANTILES = 256, 255
#: A whole vote. Votes are whole numbers, so that their sum does not depend on its order.
VOTE = 1 << 40


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _roots(seed: int, trees: np.ndarray) -> np.ndarray:
    return _mix(_mix(np.full(len(trees), seed % 2**64, np.uint64)) + trees.astype(np.uint64) + np.uint64(1))


def _children(nodes: np.ndarray) -> np.ndarray:
    """Left and right child of each node, side by side."""
    return _mix(np.repeat(nodes, 2) + np.tile(np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B], np.uint64), len(nodes)))


def _draw(nodes: np.ndarray, order: np.ndarray, j: int) -> None:
    """Swaps the feature that each node draws in place j into column j of its order."""
    r, left = np.arange(len(nodes)), order.shape[1] - j
    k = j + (_mix(nodes ^ np.uint64(j + 1)) % np.uint64(left)).astype(np.intp)
    order[r, j], order[r, k] = order[r, k], order[r, j]


def _taken(seed: int, tree: int, bucket: int, counts: np.ndarray) -> np.ndarray:
    """How often a tree takes each row of a block."""
    return np.random.default_rng([seed % 2**64, tree, bucket]).poisson(counts)


class _Level:
    """The rows of a level's nodes, ordered by node, and what every feature's search for a cut needs of them."""

    def __init__(self, node: np.ndarray, c: np.ndarray, w: np.ndarray, counts: np.ndarray, codes: int):
        size, classes = len(node), counts.shape[1]
        self.w, self.place, self.group = w, np.arange(size), node * classes + c
        self.bits = max(size, codes).bit_length()
        self.mask, self.key = (1 << self.bits) - 1, (node << 2 * self.bits) | self.place
        self.length = np.bincount(node, minlength=len(counts))
        self.start = self.length.cumsum() - self.length
        self.last = self.start + self.length - 1
        weight, squares, each = counts.sum(axis=1), np.square(counts).sum(axis=1), counts.ravel()
        over = lambda v: np.repeat(v, self.length)
        self.weight, self.squares, self.weighted = over(weight), over(squares), w * each[self.group]
        # running sums go over all nodes; these are what they hold before a node, or a node's class
        self.weight_before, self.squares_before = over(weight.cumsum() - weight), over(squares.cumsum() - squares)
        self.class_before = np.repeat(each.cumsum() - each, np.bincount(self.group, minlength=len(each)))

    def best(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node, over its rows ordered by code: the best cut's sum of squared class weights over weight on both sides (-1 without a cut), and the codes beside it."""
        key = self.key | (code.astype(np.int64) << self.bits)
        key.sort()
        pos = key & self.mask
        key >>= self.bits
        w, own = self.w[pos], (self.group[pos] << self.bits) | self.place
        own.sort()
        own &= self.mask
        # weight of the row's own class before it in its node
        some, before = w[own], np.empty_like(w)
        before[own] = some.cumsum() - some - self.class_before
        squares = (w * (2 * before + w)).cumsum() - self.squares_before
        left = w.cumsum() - self.weight_before
        other = self.squares + squares - 2 * (self.weighted[pos].cumsum() - self.squares_before)
        right = self.weight - left
        right[self.last] = 1
        score = squares / left + other / right
        score[:-1][key[1:] == key[:-1]] = -1
        score[self.last] = -1
        best = np.maximum.reduceat(score, self.start)
        at = np.flatnonzero(score == np.repeat(best, self.length))
        at = at[np.searchsorted(at, self.start)]
        return best, key[at] & self.mask, key[np.minimum(at + 1, len(key) - 1)] & self.mask


def _votes(x: np.ndarray, c: np.ndarray, classes: int, taken: np.ndarray, nodes: np.ndarray, depth: int, asked: np.ndarray) -> np.ndarray:
    """Votes for each class on each asked row, summed over one tree for each of `nodes`, whose rows x are taken as often as its row of `taken` says, and which may be `depth` deep."""
    width = x.shape[1]
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(width)), strict=True)
    offset = np.cumsum([0, *map(len, values)])[:-1]
    values, codes = np.concatenate(values).astype(np.float64), np.stack(codes, axis=1).astype(np.int32).ravel()
    out, step = np.zeros((len(asked), classes), np.int64), max(1, STEP_ROWS // max(1, len(x)))
    for i in range(0, len(nodes), step):
        part = nodes[i : i + step]
        node, row = np.nonzero(taken[i : i + step])
        out += _grown(width, values, offset, codes, row, c[row], taken[i + node, row], node, classes, part, depth, asked)
    return out


def _grown(width: int, values: np.ndarray, offset: np.ndarray, codes: np.ndarray, row: np.ndarray, c: np.ndarray, w: np.ndarray, node: np.ndarray, classes: int, nodes: np.ndarray, depth: int, asked: np.ndarray) -> np.ndarray:
    """Votes of trees that are split level by level, all nodes of a level at once, with the asked rows beside them."""
    trees, drawn = len(nodes), math.ceil(math.sqrt(width))
    one = np.arange(trees * len(asked))
    at, which = np.divmod(one, max(1, len(asked)))
    leaf, shares, leaves = np.zeros(len(one), np.intp), [], 0
    most = int(np.diff(offset, append=len(values)).max())
    at_row = row * width

    def closed(stay: np.ndarray) -> None:
        """Makes leaves of the other nodes."""
        nonlocal one, at, which, at_row, c, w, node, nodes, counts, leaves
        if stay.all():
            return
        total = counts[~stay].sum(axis=1, keepdims=True)
        shares.append(np.rint(counts[~stay] / np.maximum(total, 1) * VOTE).astype(np.int64))
        number, ends, goes = np.where(stay, np.cumsum(stay), np.cumsum(~stay) + leaves) - 1, ~stay[at], stay[node]
        leaf[one[ends]] = number[at[ends]]
        leaves += len(total)
        one, at, which = one[~ends], number[at[~ends]], which[~ends]
        node, at_row, c, w = number[node[goes]], at_row[goes], c[goes], w[goes]
        nodes, counts = nodes[stay], counts[stay]

    for level in range(depth + 1):
        counts = np.bincount(node * classes + c, w, len(nodes) * classes).astype(np.int64).reshape(-1, classes)
        closed((np.count_nonzero(counts, axis=1) > 1) & (level < depth))
        if not len(nodes):
            break
        here, score = _Level(node, c, w, counts, most), np.full(len(nodes), -1.0)
        feature, low, high = np.zeros((3, len(nodes)), np.intp)
        order = np.tile(np.arange(width), (len(nodes), 1))
        for j in range(width):
            if j >= drawn:
                # as many features as asked for, and more where none of them can cut
                todo = score < 0
                if not todo.any():
                    break
                near = todo[node]
                here = _Level((np.cumsum(todo) - 1)[node[near]], c[near], w[near], counts[todo], most)
            else:
                todo, near = np.ones(len(nodes), bool), slice(None)
            _draw(nodes, order, j)
            got, a, b = here.best(codes[at_row[near] + np.repeat(order[todo, j], here.length)])
            better = got > score[todo]
            k = np.flatnonzero(todo)[better]
            score[k], feature[k], low[k], high[k] = got[better], order[k, j], a[better], b[better]
        split = score >= 0
        feature, low, high = feature[split], low[split], high[split]
        closed(split)
        if not len(nodes):
            break
        # halfway between the two values, where that lies below the upper one
        a, b = values[offset[feature] + low], values[offset[feature] + high]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = a / 2 + b / 2
            middle = np.where((middle >= a) & (middle < b), middle, a)
        at = 2 * at + ~(asked[which, feature[at]] <= middle[at])
        node = 2 * node + (codes[at_row + feature[node]] > low[node])
        by = np.argsort(node, kind="stable")
        node, at_row, c, w = node[by], at_row[by], c[by], w[by]
        nodes = _children(nodes)
    out, shares = np.zeros((len(asked), classes), np.int64), np.concatenate(shares)
    for tree in leaf.reshape(trees, -1):
        out += shares[tree]
    return out


def _by_node(at: np.ndarray, taken: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node with the rows that are taken there."""
    rows = np.flatnonzero(taken)
    rows = rows[np.argsort(at[rows], kind="stable")]
    for part in np.split(rows, np.flatnonzero(np.diff(at[rows])) + 1):
        if len(part):
            yield int(at[part[0]]), part


def _rows(blocks: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, classes and counts of blocks, or rows, keys and nothing."""
    join = lambda name, kind: np.frombuffer(b"".join(blocks[name]), kind)
    return join("x", np.float32).reshape(-1, width), join("c", np.int64), join("w", np.int64)


def _said(asked: pd.DataFrame, votes: np.ndarray) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(asked["c"]), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": keys[:, 0], "b": keys[:, 1], "votes": list(votes)})


BLOCK = "bucket long, x binary, c binary, w binary"
VOTES = "a long, b long, votes array<long>"


class RandomForestClassifier:
    """numTrees trees of at most maxDepth splits by Gini impurity, each on a Poisson sample of the rows.

    A node draws the square root of the number of features, rounded up, and goes on where none of
    them differs between its rows. Nodes whose rows fit into NODE_CELLS are cut between any two
    values, larger ones at one of QUANTILES quantiles. Numbers are taken as 32-bit floats; null and
    NaN count as larger than all numbers.
    """

    def __init__(self, numTrees: int, maxDepth: int, seed: int = 42):  # noqa: N803
        self.trees, self.depth, self.seed = numTrees, maxDepth, seed

    def fit(self, rows: DataFrame) -> Forest:
        """rows: label, a number, and features, an array of numbers."""
        rows = rows.select(F.col("label").cast("double").alias("label"), _numbers())
        distinct = rows.groupBy("label", "x").agg(F.count("*").alias("w"))
        known = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.sort_array(F.collect_set("label")).alias("classes"), F.count_if(F.col("label").isNull() | F.isnan("label")).alias("unknown")).first()
        if not known.n or known.unknown:
            raise ValueError(f"{known.n} different training rows, {known.unknown} of them without a label")
        return Forest(self, distinct, known.n, known.width, np.array(known.classes))


def _numbers():
    return F.transform(F.col("features").cast("array<float>"), lambda v: F.coalesce(v, F.lit(float("nan")).cast("float"))).alias("x")


class Forest:
    """A forest and its training rows; its trees are grown when rows are asked for."""

    def __init__(self, plan: RandomForestClassifier, distinct: DataFrame, n: int, width: int, classes: np.ndarray):
        self.trees, self.depth, self.seed = plan.trees, plan.depth, plan.seed
        self.distinct, self.n, self.width, self.classes = distinct, n, width, classes
        buckets = -(-n // BLOCK_ROWS)

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "label"], kind="stable")
            c = np.searchsorted(classes, pdf["label"].to_numpy())
            return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "x": [np.stack(pdf["x"]).astype(np.float32).tobytes()], "c": [c.astype(np.int64).tobytes()], "w": [pdf["w"].to_numpy(np.int64).tobytes()]})

        h = distinct.withColumn("h", F.xxhash64("label", "x")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        self.blocks = h.groupBy("bucket").applyInPandas(packed, BLOCK)

    def transform(self, test: DataFrame) -> DataFrame:
        """test with a prediction: the class with the largest sum of the trees' shares, the smallest of equals."""
        keyed = test.withColumn("__x", _numbers()).withColumn("__a", F.xxhash64(F.lit(1), "__x")).withColumn("__b", F.xxhash64(F.lit(2), "__x"))
        # two hashes are the row's key; equal rows are asked for once
        points = keyed.groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(F.first("__x").alias("x"))
        buckets = max(1, -(-points.count() // BLOCK_ROWS))

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "x": [np.stack(pdf["x"]).astype(np.float32).tobytes()], "c": [pdf[["a", "b"]].to_numpy(np.int64).tobytes()], "w": [b""]})

        asked = points.withColumn("bucket", F.pmod("a", F.lit(buckets))).groupBy("bucket").applyInPandas(packed, BLOCK)
        most = min(NODE_ROWS, max(1, NODE_CELLS // self.width))
        votes = self._whole(asked, buckets) if self.n <= most else self._dealt(asked, most)
        totals = self._summed(votes)
        classes = F.array(*[F.lit(float(c)) for c in self.classes])
        first = totals.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.element_at(classes, F.array_position("votes", F.array_max("votes")).cast("int")).alias("prediction"))
        return keyed.join(first, ["__a", "__b"]).drop("__a", "__b", "__x")

    def _summed(self, votes: DataFrame) -> DataFrame:
        return votes.groupBy("a", "b").agg(F.array(*[F.sum(F.col("votes")[i]) for i in range(len(self.classes))]).alias("votes"))

    def _whole(self, asked: DataFrame, buckets: int) -> DataFrame:
        """Votes of trees whose roots fit into a task: each task takes all rows, a share of the trees and a chunk of the asked rows."""
        spark, trees, seed, depth, width, classes = asked.sparkSession, self.trees, self.seed, self.depth, self.width, len(self.classes)
        groups, chunks = min(trees, GROUPS, spark.sparkContext.defaultParallelism), -(-buckets // TEST_BLOCKS)
        tasks = groups * chunks
        # one number for each task, none two of which fall into the same partition
        ids = spark.range(64 * tasks + 64).groupBy(F.pmod(F.hash("id"), F.lit(tasks))).agg(F.min("id").alias("id")).select("id").collect()
        parts = sorted(r.id for r in ids)
        parts += [64 * tasks + 64 + i for i in range(tasks - len(parts))]

        def grown(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return _said(asked, np.zeros((0, classes), np.int64))
            blocks, mine = blocks.sort_values("bucket"), np.arange(parts.index(blocks["part"].iloc[0]) % groups, trees, groups)
            (x, c, w), points = _rows(blocks, width), _rows(asked, width)[0]
            ends, votes, step = np.cumsum([len(b) // 8 for b in blocks["w"]])[:-1], 0, max(1, STEP_ROWS // len(x))
            for some in np.array_split(mine, -(-len(mine) // (8 * step))):
                taken = np.stack([np.concatenate([_taken(seed, int(t), int(b), n) for b, n in zip(blocks["bucket"], np.split(w, ends), strict=True)]) for t in some])
                votes = votes + _votes(x, c, classes, taken, _roots(seed, some), depth, points)
            return _said(asked, votes)

        ids = F.array(*[F.lit(p).cast("long") for p in parts])
        left = self.blocks.withColumn("part", F.explode(ids))
        chunk = (F.col("bucket") / TEST_BLOCKS).cast("int")
        right = asked.withColumn("part", F.explode(F.slice(ids, chunk * groups + 1, groups)))
        left, right = (side.repartition(tasks, "part").groupBy("part") for side in (left, right))
        return left.cogroup(right).applyInPandas(grown, VOTES)

    def _dealt(self, asked: DataFrame, most: int) -> DataFrame:
        """Votes of trees whose upper nodes do not fit into a task: these are split first, then rows are dealt to the nodes below, some trees at a time."""
        blocks, asked = kept(self.blocks), kept(asked)
        edges = self.distinct.select(F.posexplode("x").alias("f", "v")).where("NOT isnan(v)").groupBy("f").agg(F.percentile_approx("v", [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)]).alias("e")).collect()
        edges = {r.f: np.unique(r.e) for r in edges}
        edges, total = [edges.get(f, np.array([0.0])) for f in range(self.width)], None
        wave = max(WAVE_TREES, WAVE_ROWS // self.n)
        for i in range(0, self.trees, wave):
            tops = self._tops(blocks, edges, range(i, min(self.trees, i + wave)), most)
            votes = self._below(blocks, asked, tops)
            # beside the executors, as a wave's total replaces the last
            total = self._summed(votes if total is None else total.unionByName(votes)).localCheckpoint()
            # nothing refers to the wave's plans any more, so Spark deletes its shuffle files
            del votes
            total.sparkSession._jvm.System.gc()
        return total

    def _tops(self, blocks: DataFrame, edges: list[np.ndarray], trees: range, most: int) -> dict[int, Top]:
        """The upper nodes of some trees, down to nodes that take at most `most` rows."""
        tops = {t: Top(int(n)) for t, n in zip(trees, _roots(self.seed, np.array(trees)), strict=True)}
        work = [(t, 0) for t in trees] if self.depth else []
        while work:
            now, work = work[:PASS_NODES], work[PASS_NODES:]
            for tree, node, feature, threshold, sides in self._cuts(blocks, edges, tops, now):
                top = tops[tree]
                for child, (size, mixed) in zip(top.cut(node, feature, threshold), sides, strict=True):
                    if size > most and mixed and top.depth[child] < self.depth:
                        work.append((tree, child))
        return tops

    def _cuts(self, blocks: DataFrame, edges: list[np.ndarray], tops: dict[int, Top], now: list[tuple[int, int]]) -> list[tuple]:
        """tree, node, feature, threshold and the two sides' weight and whether they hold more than one class, for those of the nodes that a quantile cuts."""
        seed, width, classes, bins = self.seed, self.width, len(self.classes), QUANTILES + 1
        drawn = math.ceil(math.sqrt(width))
        order, names = np.tile(np.arange(width), (len(now), 1)), np.array([tops[t].name[n] for t, n in now], np.uint64)
        for j in range(drawn):
            _draw(names, order, j)
        # a number for each node of now, -1 for the others
        places = {t: np.full(len(tops[t].name), -1) for t, _ in now}
        for k, (t, n) in enumerate(now):
            places[t][n] = k
        some = {t: tops[t] for t in places}

        def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for bucket, i in zip(batch["bucket"], range(len(batch)), strict=True):
                    x, c, w = _rows(batch.iloc[i : i + 1], width)
                    place = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
                    for t, top in some.items():
                        taken = _taken(seed, t, int(bucket), w)
                        at = places[t][top.end(x)]
                        for k, r in _by_node(at, taken * (at >= 0)):
                            slot = (np.arange(drawn) * bins + place[r][:, order[k, :drawn]]) * classes + c[r][:, None]
                            got = np.bincount(slot.ravel(), np.repeat(taken[r], drawn), drawn * bins * classes)
                            sums[k] = sums[k] + got if k in sums else got
            if sums:
                yield pd.DataFrame({"k": list(sums), "h": [v.tobytes() for v in sums.values()]})

        def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            left = sum(np.frombuffer(h, np.float64) for h in pdf["h"]).reshape(drawn, bins, classes).cumsum(axis=1)
            right = left[:, -1:] - left
            n, m = left.sum(axis=2), right.sum(axis=2)
            cut = (n > 0) & (m > 0)
            score = np.where(cut, (left**2).sum(axis=2) / np.where(cut, n, 1) + (right**2).sum(axis=2) / np.where(cut, m, 1), -1)
            j, b = np.unravel_index(score.argmax(), score.shape)
            sides = [float(n[j, b]), float(m[j, b])], [bool(np.count_nonzero(s[j, b]) > 1) for s in (left, right)]
            return pd.DataFrame({"k": [k], "f": [int(order[k, j])], "b": [int(b)], "sizes": [sides[0]], "mixed": [sides[1]]})[[bool(cut.any())]]

        found = blocks.mapInPandas(gathered, "k int, h binary").groupBy("k").applyInPandas(chosen, "k int, f int, b int, sizes array<double>, mixed array<boolean>").collect()
        return [(*now[r.k], r.f, float(edges[r.f][r.b]), list(zip(r.sizes, r.mixed, strict=True))) for r in found]

    def _below(self, blocks: DataFrame, asked: DataFrame, tops: dict[int, Top]) -> DataFrame:
        seed, depth, width, classes = self.seed, self.depth, self.width, len(self.classes)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(len(batch)):
                    x = _rows(batch.iloc[i : i + 1], width)[0]
                    for t, top in tops.items():
                        n = np.bincount(top.end(x))
                        yield pd.DataFrame({"tree": t, "node": np.flatnonzero(n), "n": n[n > 0]})

        counts = asked.mapInPandas(counted, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()
        chunks = {(r.tree, r.node): -(-r.n // (TEST_BLOCKS * BLOCK_ROWS)) for r in counts}

        def dealt(batches: Iterator[pd.DataFrame], training: bool) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for bucket, i in zip(batch["bucket"], range(len(batch)), strict=True):
                    x, c, w = _rows(batch.iloc[i : i + 1], width)
                    c = c.reshape(len(x), -1)
                    for t, top in tops.items():
                        taken = _taken(seed, t, int(bucket), w) if training else np.ones(len(x), np.int64)
                        out = []
                        for node, r in _by_node(top.end(x), taken):
                            many = chunks.get((t, node), 0)
                            out += [(t, node, k, int(bucket), x[r].tobytes(), c[r].tobytes(), taken[r].tobytes() if training else b"") for k in (range(many) if training else [int(bucket) % many])]
                        yield pd.DataFrame(out, columns=["tree", "node", "chunk", "bucket", "x", "c", "w"])

        def grown(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks) or not len(asked):
                return _said(asked, np.zeros((sum(map(len, asked["c"])) // 16, classes), np.int64))
            (x, c, w), top, node = _rows(blocks.sort_values("bucket"), width), tops[int(blocks["tree"].iloc[0])], int(blocks["node"].iloc[0])
            return _said(asked, _votes(x, c, classes, w[None], np.array([top.name[node]], np.uint64), depth - top.depth[node], _rows(asked, width)[0]))

        sides = (side.mapInPandas(lambda b, training=side is blocks: dealt(b, training), f"tree int, node int, chunk long, {BLOCK}").groupBy("tree", "node", "chunk") for side in (blocks, asked))
        return next(sides).cogroup(next(sides)).applyInPandas(grown, VOTES)


class Top:
    """A tree's upper nodes: the left child of each (0: an end; the right one follows it), what cuts it, its depth and its name."""

    def __init__(self, name: int):
        self.child, self.feature, self.threshold, self.depth, self.name = [0], [0], [0.0], [0], [name]

    def cut(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        first = len(self.child)
        self.child[node], self.feature[node], self.threshold[node] = first, feature, threshold
        self.child += [0, 0]
        self.feature += [0, 0]
        self.threshold += [0.0, 0.0]
        self.depth += [self.depth[node] + 1] * 2
        self.name += [int(n) for n in _children(np.array([self.name[node]], np.uint64))]
        return first, first + 1

    def end(self, x: np.ndarray) -> np.ndarray:
        """The end that each row comes to."""
        child, feature, threshold = (np.array(v) for v in (self.child, self.feature, self.threshold))
        at = np.zeros(len(x), np.intp)
        go = np.flatnonzero(child[at])
        while len(go):
            a = at[go]
            at[go] = child[a] + ~(x[go, feature[a]] <= threshold[a])
            go = go[child[at[go]] > 0]
        return at
