"""Ranked lexical search: sharded inverted lists, variable blocks with maxima, exact skipping.

`index` reads every row of a table once, where it lies, and makes shards of bounded size: the
shard's documents by id, its distinct terms and each term's postings (document, occurrences).
Corpus counts (documents, terms, documents that hold a term) are sums over shards.

`search` takes the queries in bounded blocks. In each shard the lists of the asked terms are
cut into blocks of different lengths. A dynamic program picks the cuts: it minimises the sum of
(block maximum - posting) over all postings plus a price for each block, over all cuts with
blocks of at most LONGEST postings, for all lists at once. For one query the block ends of its
lists cut the documents into ranges; the bound of a range is the sum of the block maxima of the
lists that have a posting in it. The ranges of the greatest bounds set a first threshold, then
the walk goes from pivots to pivots in document order: to the next ranges whose bounds reach the
threshold. What it passes over cannot be among the best, so the result is exact. The shards'
best, k for each query, meet in one ranking.

Terms are runs of ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII.
A posting's weight is an integer, see `impacts`; scores are sums of 64-bit integers.

Defined cases: null and empty texts have no terms and are counted nowhere; documents without an
id are counted and ranked after all others of the same score; repeated rows are documents of
their own; a query without terms, or whose terms no document holds, has no rows; each query
row is asked by itself, also where ids repeat or are null; other columns do not matter; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorloom.llm import blocks as B

SHARD_TERMS = 6_000_000  # occurrences of terms in a shard
PIECE_BYTES = 2 << 20  # of text cut into terms together
LONGEST = 64  # postings in a block
PRICE = 6.0  # of a block, in mean deviations of the list's weights
PRIMED = 8  # ranges that set the first threshold
PIVOTS, AHEAD = 32, 1024  # pivots scored together, and ranges looked ahead for them
ITEMS, ITEM_BYTES = 1000, 4 << 20  # queries asked together, and their text
INDEX = "ids binary, has_id binary, sizes binary, terms binary, docs binary, times binary, n_docs long, n_terms long"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.codes, self.sizes, self.ids, self.n = [], [], [], 0

    def add(self, texts: list[bytes], ids: list) -> None:
        words = [terms(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        known = self.vocabulary
        here = np.array([known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()], np.int32)
        if len(coded):
            self.codes.append(here[coded.indices.to_numpy()])
        self.sizes.append(sizes)
        self.ids += ids
        self.n += int(sizes.sum())

    def row(self) -> pa.RecordBatch:
        has_id = np.array([i is not None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, ~has_id))  # by id, rows without one last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.concatenate(self.sizes)
        vocabulary = list(self.vocabulary)
        rank = np.empty(len(vocabulary), np.int64)
        rank[sorted(range(len(vocabulary)), key=vocabulary.__getitem__)] = np.arange(len(vocabulary))
        codes = rank[np.concatenate(self.codes)] if self.codes else np.zeros(0, np.int64)
        pairs, times = np.unique(codes * len(order) + np.repeat(place, sizes), return_counts=True)
        code, doc = np.divmod(pairs, max(len(order), 1))
        table = pa.table({"term": pa.array(sorted(vocabulary), pa.binary()), "n": pa.array(np.bincount(code, minlength=len(vocabulary)), pa.int64())})
        sizes = sizes[order]
        cells = [ids[order].tobytes(), has_id[order].tobytes(), sizes.tobytes(), B.to_blob(table), doc.astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), int((sizes > 0).sum()), int(sizes.sum())]
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if isinstance(c, int) else pa.binary()) for c in cells], names=names)


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Shards of docs (doc_id, text), in a table in the checkpoint folder; `blocks.dropped` deletes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, ids = B.texts(table), table["doc_id"].cast(pa.int64()).to_pylist()
            part = np.cumsum([len(t) for t in texts]) // PIECE_BYTES
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(texts)]]).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                shard.add(texts[i:j], ids[i:j])
                if shard.n >= shard_terms:
                    yield shard.row()
                    shard = _Shard()
                    B.trim()
        if shard.ids:
            yield shard.row()
            B.trim()

    return B.saved(docs.select("doc_id", "text").mapInArrow(run, INDEX))


def impacts(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer weight of occurrences in documents of so many terms; grows with times, falls with size."""
    m = 100 - 90 + (90 * sizes * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def rarity(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cut_blocks(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> list[np.ndarray]:
    """For each list values[start : start + size] the first places of its blocks.

    Least sum over postings of (block maximum - value) plus a price a block, exact over all
    cuts into blocks of at most `longest`. All lists go forward together, a posting a step;
    a step holds, for each list and each place a block may have begun at, the block's maximum.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order].astype(np.int64), sizes[order].astype(np.int64)
    n = len(sizes)
    values = values.astype(np.float64)
    mean = np.array([values[s : s + z].mean() if z else 0.0 for s, z in zip(starts, sizes, strict=True)])
    cost = price * np.array([np.abs(values[s : s + z] - m).mean() if z else 0.0 for s, z, m in zip(starts, sizes, mean, strict=True)]) + 1.0
    top = np.full((n, longest), -np.inf)  # maximum of the block begun at the slot's place
    paid = np.full((n, longest), np.inf)  # least total before that block, its price, and the sum of values before it
    total, passed = np.zeros(n), np.zeros(n)
    begun = np.full(longest, -1, np.int64)
    choice = np.zeros(int(sizes.sum()), np.int32)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for i in range(int(sizes[0]) if n else 0):
        k = int(np.searchsorted(-sizes, -i, side="left"))  # lists longer than i
        slot = i % longest
        begun[slot] = i
        x = values[starts[:k] + i]
        top[:k, slot] = x
        paid[:k, slot] = total[:k] + cost[:k] + passed[:k]
        np.maximum(top[:k], x[:, None], out=top[:k])
        span = np.where(begun >= 0, i - begun + 1, 1)
        sums = np.where(np.isfinite(paid[:k]), paid[:k] + span * top[:k], np.inf)
        best = sums.argmin(axis=1)
        passed[:k] += x
        total[:k] = sums[np.arange(k), best] - passed[:k]
        choice[at[:k] + i] = begun[best]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for t in range(n):
        cuts, i = [], int(sizes[t]) - 1
        while i >= 0:
            cuts.append(int(choice[at[t] + i]))
            i = cuts[-1] - 1
        out[order[t]] = np.array(cuts[::-1], np.int64)
    return out


class Postings:
    """One term's documents in a shard with their weights, in blocks."""

    __slots__ = ("docs", "ends", "tops", "values")

    def __init__(self, docs: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> None:
        self.docs, self.values = docs, values
        self.ends = docs[np.append(cuts[1:], len(docs)) - 1]  # last document of each block
        self.tops = np.maximum.reduceat(values, cuts)


def best_of(lists: list[tuple[int, Postings]], n_docs: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, document) with a score above 0, ties to the smaller document, and how many ranges were scored.

    lists: (weight of the term, its postings).
    """
    edges = np.unique(np.concatenate([p.ends for _, p in lists])) + 1  # a range ends before its edge
    edges[-1] = n_docs
    begins = np.concatenate([[0], edges[:-1]])
    docs = np.concatenate([p.docs for _, p in lists])
    values = np.concatenate([w * p.values for w, p in lists]).astype(np.float64)  # whole numbers below 2 ** 53, so sums are exact
    bound = np.zeros(len(edges), np.int64)
    to = np.empty((len(lists), len(edges)), np.int64)
    for t, (w, p) in enumerate(lists):
        to[t] = np.searchsorted(p.docs, edges)
        live = np.flatnonzero(np.diff(to[t], prepend=0))
        # no block end lies inside a range, so all its postings are of one block
        bound[live] += w * p.tops[np.searchsorted(p.ends, begins[live])]
    come = np.concatenate([np.zeros((len(lists), 1), np.int64), to[:, :-1]], axis=1)
    base = np.cumsum([0, *(len(p.docs) for _, p in lists[:-1])])[:, None]
    come, to = come + base, to + base
    best: list[tuple[int, int]] = []  # (-score, document), best first
    scored = 0

    def floor() -> int:
        return -best[-1][0] if len(best) == k else 1

    def score(ranges: np.ndarray) -> None:
        nonlocal best, scored
        scored += len(ranges)
        a, n = come[:, ranges].ravel(), (to[:, ranges] - come[:, ranges]).ravel()
        width = edges[ranges] - begins[ranges]
        slots = np.cumsum(width) - width
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.bincount(docs[at] + np.repeat(np.tile(slots - begins[ranges], len(lists)), n), values[at], int(width.sum()))
        good = np.flatnonzero(found >= floor())
        doc = good + (begins[ranges] - slots)[np.searchsorted(slots, good, side="right") - 1]
        first = np.lexsort((doc, -found[good]))[:k]
        best = sorted(best + [(-int(found[good[i]]), int(doc[i])) for i in first])[:k]

    first = np.sort(np.argsort(-bound, kind="stable")[:PRIMED])
    score(first)
    bound[first] = -1
    r = 0
    while r < len(edges):
        pivots = r + np.flatnonzero(bound[r : r + AHEAD] >= floor())[:PIVOTS]
        if len(pivots):
            score(pivots)
        r = int(pivots[-1]) + 1 if len(pivots) == PIVOTS else r + AHEAD
    return [(-s, d) for s, d in best], scored


def _asked(batch: pa.RecordBatch, asked: pa.Array) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(row, places of the asked terms, first posting of each of the shard's terms) of each shard."""
    for i in range(batch.num_rows):
        row = {n: batch[n][i].as_py() for n in batch.schema.names}
        table = B.from_blob(row["terms"])
        at = pc.index_in(asked, value_set=table["term"]).to_numpy(zero_copy_only=False)
        yield row, at, np.concatenate([[0], np.cumsum(table["n"].to_numpy())])


def document_counts(shards: DataFrame, asked: list[bytes]) -> dict[int, int]:
    """Documents that hold each asked term, by its place in the list; the list is bounded by the block of queries."""
    wanted = pa.array(asked, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(asked), np.int64)
        for batch in batches:
            for _, at, first in _asked(batch, wanted):
                there = np.flatnonzero(~np.isnan(at))
                sums[there] += np.diff(first)[at[there].astype(np.int64)]
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], names=["place", "n"])

    found = shards.select("terms").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return {r["place"]: r["n"] for r in found.collect()}


def _searched(shards: DataFrame, queries: list[list[bytes]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, doc_id, score: each shard's best for each query."""
    asked = sorted({t for q in queries for t in q})
    place = {t: i for i, t in enumerate(asked)}
    df = document_counts(shards, asked)
    weight = {i: rarity(n_docs, n) for i, n in df.items()}
    wanted = [[place[t] for t in dict.fromkeys(q) if weight.get(place[t], 0) > 0] for q in queries]
    names = pa.array(asked, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, first in _asked(batch, names):
                docs, times = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["times"], np.int32)
                sizes, ids, has_id = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool)
                there = [i for i in weight if weight[i] > 0 and not math.isnan(at[i])]
                slices = [slice(first[int(at[i])], first[int(at[i]) + 1]) for i in there]
                values = [impacts(times[s].astype(np.int64), sizes[docs[s]], n_docs, n_terms) for s in slices]
                lengths = np.array([len(v) for v in values], np.int64)
                cuts = cut_blocks(np.concatenate(values), np.cumsum(lengths) - lengths, lengths) if there else []
                held = {i: Postings(docs[s], v, c) for i, s, v, c in zip(there, slices, values, cuts, strict=True)}
                out = []
                for q, places in enumerate(wanted):
                    if lists := [(weight[i], held[i]) for i in places if i in held]:
                        out += [(q, int(ids[d]) if has_id[d] else None, s) for s, d in best_of(lists, len(ids), k)[0]]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])
            B.trim()

    return shards.mapInArrow(run, "query long, doc_id long, score long")


def _query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows (item_id, terms) in blocks of bounded number and size."""
    rows = ((r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator())
    block, size = [], 0
    while got := list(islice(rows, 1)):
        item, text = got[0]
        raw = (text or "").encode()
        if block and size + len(raw) > ITEM_BYTES or len(block) == ITEMS:
            yield block
            block, size = [], 0
        block.append((item, terms(raw)))
        size += len(raw)
    if block:
        yield block


def search(shards: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, equal scores by ascending doc_id."""
    spark = shards.sparkSession
    schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    out = None
    for block in _query_blocks(items) if n_terms else ():
        found = _searched(shards, [t for _, t in block], n_docs, n_terms, k)
        # every shard sends k rows a query at most, and each task keeps k of them before they meet
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("query", T.LongType()), items.schema["item_id"]]))
        # a block of queries is bounded
        ranked = ranked.join(F.broadcast(named), "query").select(*schema.names)
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], schema) if out is None else out
