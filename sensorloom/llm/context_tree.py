"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, then a newline as the end.
Each byte is decomposed into eight binary decisions; a decision's context is the six
bytes before it in the running text, the nearest first, so it reaches into the words
before (spaces stand before the first byte). With word_contexts it ends at the start of
the byte's own word, which makes the model a speller of single words. Every
(context, decision) node holds a Krichevsky-Trofimov estimate, and context-tree
weighting mixes the estimates of all depths: from the leaves up, a node's weighted
probability is the mean of its own estimate's and its children's product. The tree is
built once from the training texts' counts (the estimate depends on counts alone, so
this equals feeding the texts one by one), and then scores every text unchanged. On
the way down, a node keeps its share of belief and passes the rest to the deeper
context; where a deeper one was never seen, the deepest seen takes all of it.

Only distinct grams and words travel: blocks send their seven-byte grams with counts to
the bucket of the two nearest context bytes, where the subtree is weighted, and get the
grams' log probabilities back in single precision (summed in double); words go to word buckets for the base score. The top of the tree (depths 0 and 1, at most 257 x 255 nodes whatever
the input) is put together on the driver.

Defined cases: a null or blank text is the end token alone; a null doc_id is held out;
with no training rows every estimate is one half; repeated rows count again.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import blocks as B

DEPTH = 6
END = b"\n"
#: Raw bytes of a block, and of the texts whose grams are made at a time.
BLOCK_BYTES = 20 << 20
RUN_BYTES = 1 << 19


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def _send(n: int, word_contexts: bool):
    """Grams with counts go to buckets 0 to n - 1, words with counts to n to 2 n - 1."""

    def send(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        doc_ids = table["doc_id"].to_pylist()
        seen: set[bytes] = set()
        learnt: Counter = Counter()
        for doc_id, text in zip(doc_ids, B.texts(table), strict=True):
            (seen if held_out(doc_id) else learnt).update([*text.lower().split(), END])
        per: list[list[bytes]] = [[] for _ in range(n)]
        for word in learnt.keys() | seen:
            per[zlib.crc32(word) % n].append(word)
        for bucket, words in enumerate(per):
            if words:
                yield n + bucket, B.dumps((b" ".join(words), np.array([learnt.get(w, 0) for w in words], np.int64)))
        del seen, learnt, per
        merged = Merged()
        for start, key, first in _runs(table, word_contexts):
            held = [held_out(d) for d in doc_ids[start : start + len(first)]]
            held = np.repeat(held, np.diff(np.append(first, len(key))))
            unseen = np.unique(key[held])
            own, count = np.unique(key[~held], return_counts=True)
            merged.add(own, count)
            merged.add(unseen, np.zeros(len(unseen), np.int64))
        keys, counts = merged.all()
        to = bucket_of(keys, n)
        for bucket in np.unique(to).tolist():
            yield bucket, _pressed(keys[to == bucket], counts[to == bucket])

    return send


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> 40) * 40503 >> 4) % n


def _planes(x: np.ndarray) -> bytes:
    """The values, equal bytes of all next to each other, compressed."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return B.dumps((x.dtype.str, len(x), len(raw), pa.compress(raw, "zstd", asbytes=True)))


def _values(payload: bytes) -> np.ndarray:
    dtype, n, size, raw = B.loads(payload)
    raw = np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(dtype).ravel()


def _pressed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, with their counts."""
    return B.dumps((_planes(np.diff(keys, prepend=0)), _planes(counts)))


def _pressed_out(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = B.loads(payload)
    return np.cumsum(_values(steps)), _values(counts)


def _vocabulary(payloads: list[bytes]) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for p in payloads:
        raw, c = B.loads(p)
        for w, k in zip(raw.split(b" "), c.tolist(), strict=True):
            counts[w] = counts.get(w, 0) + k
    return counts


def pieces(text: bytes, word_contexts: bool) -> list[bytes]:
    """The parts of a text beyond whose start no context reaches: the text, or each of its words."""
    parts = [w + b" " for w in text.lower().split()] + [END]
    return parts if word_contexts else [b"".join(parts)]


def grams(parts: list[bytes]) -> np.ndarray:
    """Keys of the parts' bytes in context.

    A key holds the six bytes before, the nearest highest, then the byte itself.
    """
    pad = b" " * DEPTH
    raw = np.frombuffer(b"".join(pad + t for t in parts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in parts], np.int64)
    begins = np.cumsum(lengths + DEPTH) - lengths
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(begins - first, lengths)
    key = raw[at]
    for d in range(1, DEPTH + 1):
        key += raw[at - d] << (8 * (DEPTH + 1 - d))
    return key


def _runs(table: pa.Table, word_contexts: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first text, the keys, and where each text's keys begin, for a run of texts at a time."""
    start, held, sizes, size = 0, [], [], 0
    for text in B.texts(table):
        own = pieces(text, word_contexts)
        held += own
        sizes.append(sum(map(len, own)))
        size += sizes[-1]
        if size >= RUN_BYTES:
            yield start, grams(held), np.cumsum(sizes) - sizes
            start, held, sizes, size = start + len(sizes), [], [], 0
    if sizes:
        yield start, grams(held), np.cumsum(sizes) - sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[at]
    return keys, np.add.reduceat(counts, at)


class Merged:
    """Keys with summed counts, added up whenever half as many came in as there are.

    What is added up is held once: the parts go as they are joined, and the joined rows as they are sorted.
    """

    def __init__(self) -> None:
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.fresh = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.fresh += len(keys)
        if self.fresh >= max(len(self.parts[0][0]) // 2, 1 << 20):
            self.all()

    def _joined(self, place: int) -> np.ndarray:
        out = np.concatenate([p[place] for p in self.parts])
        self.parts = [(None, p[1]) for p in self.parts] if place == 0 else []
        return out

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts, self.fresh = [summed(self._joined(0), self._joined(1))], 0
        return self.parts[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive x, by Stirling's series at x + 8."""
    shift = sum(np.log(x + i) for i in range(8))
    z = x + 8
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: key (context, decision), counts, and what the weighting makes of them."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> None:
        k = np.arange(8)
        node = ((context[:, None] << 8) | (1 << k) | (symbol[:, None] >> (8 - k))).ravel()
        bit = ((symbol[:, None] >> (7 - k)) & 1).ravel()
        weight = np.repeat(counts, 8)
        self.key, inverse = np.unique(node, return_inverse=True)
        n = np.bincount(inverse, weight, len(self.key))
        self.ones = np.bincount(inverse, weight * bit, len(self.key))
        self.zeros = n - self.ones

    def parents(self) -> np.ndarray:
        """Keys of the nodes one context byte shorter; the farthest byte is the lowest."""
        return ((self.key >> 16) << 8) | (self.key & 255)

    def weigh(self, below: np.ndarray | None) -> None:
        """below: summed log weighted probabilities of the children; None at the deepest level."""
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.log_w, self.stay = own, np.ones(len(own))
        else:
            self.log_w = np.logaddexp(own, below) - math.log(2)
            self.stay = np.exp(own - math.log(2) - self.log_w)

    def descend(self, mixed: np.ndarray | float, rest: np.ndarray | float) -> None:
        """mixed and rest: probability of a one mixed so far, and belief left, from the parents."""
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.stop = mixed + rest * kt
        self.mixed, self.rest = mixed + rest * self.stay * kt, rest * (1 - self.stay)


def child_sums(level: Level, child: Level) -> np.ndarray:
    at = np.searchsorted(level.key, child.parents())
    return np.bincount(at, child.log_w, len(level.key))


def lower_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth 2 to DEPTH over the grams' counts, weighted from the leaves up."""
    some = counts > 0
    keys, counts = keys[some], counts[some].astype(np.float64)
    levels: list[Level] = []
    for d in range(DEPTH, 1, -1):
        pair, c = summed(((keys >> (8 * (DEPTH + 1 - d))) << 8) | (keys & 255), counts)
        level = Level(pair >> 8, pair & 255, c)
        level.weigh(child_sums(level, levels[-1]) if levels else None)
        levels.append(level)
    return levels[::-1]


class Top:
    """Depths 0 and 1, from sums over the subtrees below."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        order = np.argsort(key)
        self.one = self._level(key[order], zeros[order], ones[order], below[order])
        root, inverse = np.unique(self.one.parents(), return_inverse=True)
        sums = [np.bincount(inverse, x, len(root)) for x in (self.one.zeros, self.one.ones, self.one.log_w)]
        self.root = self._level(root, *sums)
        self.root.descend(np.zeros(len(root)), np.ones(len(root)))
        self.one.descend(self.root.mixed[inverse], self.root.rest[inverse])

    @staticmethod
    def _level(key, zeros, ones, below) -> Level:
        level = object.__new__(Level)
        level.key, level.zeros, level.ones = key, zeros, ones
        level.weigh(below)
        return level


def code_lengths(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each gram's byte in its context, under the tree of the counts."""
    levels = lower_levels(keys, counts)
    above = top.one
    for level in levels:
        at = np.searchsorted(above.key, level.parents())
        level.descend(above.mixed[at], above.rest[at])
        above = level
    symbol = keys & 255
    out = np.zeros(len(keys))
    for k in range(8):
        decision = (1 << k) | (symbol >> (8 - k))
        p = np.full(len(keys), 0.5)
        for d, level in enumerate([top.root, top.one, *levels]):
            if len(level.key):
                node = ((keys >> (8 * (DEPTH + 1 - d))) << 8) | decision
                at = np.minimum(np.searchsorted(level.key, node), len(level.key) - 1)
                p = np.where(level.key[at] == node, level.stop[at], p)
        out += np.log10(np.where((symbol >> (7 - k)) & 1 == 1, p, 1 - p))
    return out


def _merged(payloads) -> tuple[np.ndarray, np.ndarray]:
    merged = Merged()
    for p in payloads:
        merged.add(*_pressed_out(p))
    return merged.all()


def score(docs: DataFrame, word_contexts: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    word_contexts=False lets contexts cross words, which is the model of the whole text.
    """
    packed = B.pack(docs.select("doc_id", "text"), BLOCK_BYTES)
    n = B.bucket_count(packed)
    sent = B.dealt(B.scatter(packed, _send(n, word_contexts)), "bucket")
    B.released(docs.sparkSession)

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.array(list(_vocabulary(pdf["payload"].tolist()).values()), np.int64)
        return pd.DataFrame({"tokens": [int(counts.sum())], "distinct": [int((counts > 0).sum())]})

    counted = sent.where(F.col("bucket") >= n).groupBy("bucket").applyInPandas(count, "tokens long, distinct long")
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def subtree(key, pdf: pd.DataFrame) -> pd.DataFrame:
        levels = lower_levels(*_merged(pdf["payload"]))
        two = levels[0]
        up, inverse = np.unique(two.parents(), return_inverse=True)
        sums = [np.bincount(inverse, x, len(up)) for x in (two.zeros, two.ones, two.log_w)]
        del levels, two
        B.trim()
        return pd.DataFrame({"node": up, "zeros": sums[0], "ones": sums[1], "below": sums[2]})

    tops = sent.where(F.col("bucket") < n).groupBy("bucket").applyInPandas(subtree, "node long, zeros double, ones double, below double")
    tops = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas().sort_values("node")
    top = Top(tops["node"].to_numpy(np.int64), tops["zeros"].to_numpy(), tops["ones"].to_numpy(), tops["below"].to_numpy())

    def answer(bucket: int, messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        if bucket >= n:
            counts = _vocabulary([p for _, p in messages])
            for block, p in messages:
                raw = B.loads(p)[0]
                yield block, B.dumps((bucket, raw, np.array([counts[w] for w in raw.split(b" ")], np.int64)))
            return
        keys, counts = _merged([p for _, p in messages])
        logs = code_lengths(keys, counts, top)
        for block, p in messages:
            own = _pressed_out(p)[0]
            yield block, B.dumps((bucket, _planes(np.diff(own, prepend=0)), _planes(logs[np.searchsorted(keys, own)].astype(np.float32))))
        del keys, counts, logs
        B.trim()

    tokens, distinct = int(total[0]), int(total[1])
    floor = tokens + 0.5 * (distinct + 1)

    def finish(_: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        known: dict[bytes, int] = {}
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in payloads:
            bucket, own, value = B.loads(p)
            if bucket >= n:
                known.update(zip(own.split(b" "), value.tolist(), strict=True))
            else:
                parts[bucket] = np.cumsum(_values(own)), _values(value)
        payloads.clear()
        scores, sizes = [], []
        for _, key, first in _runs(table, word_contexts):
            order = np.argsort(key)
            ordered = key[order]
            to = bucket_of(ordered, n)
            # few values, so a radix sort
            by_bucket = np.argsort(to.astype(np.uint16) if n <= 1 << 16 else to, kind="stable")
            edges = np.searchsorted(to[by_bucket], np.arange(n + 1))
            value = np.empty(len(key))
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                at = by_bucket[edges[bucket] : edges[bucket + 1]]
                own, log = parts[bucket]
                value[order[at]] = log[np.searchsorted(own, ordered[at])]
            scores += np.add.reduceat(value, first).tolist()
            sizes += np.diff(np.append(first, len(key))).tolist()
        del parts
        rows = []
        for doc_id, text, total_score, size in zip(table["doc_id"].to_pylist(), B.texts(table), scores, sizes, strict=True):
            counts = np.array([known[w] for w in [*text.lower().split(), END]], np.int64)
            base = float(np.log10((counts + 0.5) / floor).sum())
            rows.append((held_out(doc_id), len(counts), int((counts > 0).sum()), base, total_score, -total_score / math.log10(2) / size))
        cols = list(zip(*rows, strict=True))
        yield pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(cols[0], pa.bool_()), "n_tokens": pa.array(cols[1], pa.int64()), "n_known": pa.array(cols[2], pa.int64()),
            "train_tokens": pa.array([tokens] * len(rows), pa.int64()), "base_score": pa.array(cols[3], pa.float64()), "score": pa.array(cols[4], pa.float64()), "bits_per_byte": pa.array(cols[5], pa.float64()),
        })

    answers = B.at_buckets(sent, answer)
    return B.gather(packed, answers, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
