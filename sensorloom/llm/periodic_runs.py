"""Runs of periodic words: suffix automata with ordered sets of end positions.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(min_length, exponent * q) that no neighbouring word extends keeping period q.

The automaton of a word sequence is built online. Along its suffix links the sets of end
positions are merged, the smaller into the larger, longest states first. Two positions that
become neighbours in the set of a state of length L, d <= L words apart, end two occurrences
of the same L words that touch or overlap: a square of period d, and d is its smallest period
because no end position lies between. Each square is extended to its run once.

In a run of exponent e every word occurs e times at least, so a word that occurs less often
lies in none. Documents are cut at such words, again inside each piece, and automata are built
for what is left; no run is lost by that. Every document is worked on where it is read: no
row is shuffled. Memory grows with the longest piece, by about 700 bytes a word.

Defined cases: null, empty and blank texts have no words and no runs, their collapsed text is
empty (`collapse` leaves null as it is); repeated rows are answered each; other columns do
not matter to `report` and are carried by `collapse`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import blocks as B

Run = tuple[int, int, int]  # start, length, period

PIECE_BYTES = 2 << 20  # of text whose words are numbered together
CHUNK = 1024  # positions in a part of an ordered set
REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Ends:
    """Ordered set of end positions in sorted parts of bounded size."""

    __slots__ = ("n", "parts", "tops")

    def __init__(self, first: int) -> None:
        self.parts, self.tops, self.n = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def around(self, x: int) -> tuple[int, int]:
        """The positions before and after x, or ones too far away to matter."""
        i = bisect_left(self.tops, x)
        if i == len(self.tops):
            return self.tops[-1], 1 << 60
        part = self.parts[i]
        j = bisect_left(part, x)
        return part[j - 1] if j else (self.tops[i - 1] if i else -(1 << 60)), part[j]

    def add(self, x: int) -> None:
        i = min(bisect_left(self.tops, x), len(self.tops) - 1)
        part = self.parts[i]
        insort(part, x)
        self.n += 1
        if len(part) > CHUNK:
            self.parts[i : i + 1] = [part[: CHUNK // 2], part[CHUNK // 2 :]]
            self.tops[i : i + 1] = [part[CHUNK // 2 - 1], part[-1]]
        else:
            self.tops[i] = part[-1]


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of each state of the suffix automaton of s; end is -1 for copies of states and the root."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(s):
        new = len(length)
        length.append(length[last] + 1)
        end.append(at)
        moves.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                end.append(-1)
                moves.append(dict(moves[q]))
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def _equal_stretch(a: np.ndarray, k: int, d: int) -> tuple[int, int]:
    """The longest [low, high) about k in which a[j] == a[j + d]."""
    low, step = k, 32
    while low > 0:
        at = max(0, low - step)
        differ = np.flatnonzero(a[at:low] != a[at + d : low + d])
        if len(differ):
            low = at + int(differ[-1]) + 1
            break
        low, step = at, step * 2
    high, step, top = k + 1, 32, len(a) - d
    while high < top:
        to = min(top, high + step)
        differ = np.flatnonzero(a[high:to] != a[high + d : to + d])
        if len(differ):
            high += int(differ[0])
            break
        high, step = to, step * 2
    return low, high


def piece_runs(a: np.ndarray, min_length: int = 6, exponent: int = 4) -> list[Run]:
    """All runs of the sequence a of word numbers, by start and then period."""
    length, link, end = automaton(a.tolist())
    sets: list[Ends | None] = [None] * len(length)
    known: dict[int, list[tuple[int, int]]] = {}  # by period: stretches of positions equal to the one a period on
    found: list[Run] = []

    def seed(x: int, y: int) -> None:
        d = y - x
        held = known.setdefault(d, [])
        i = bisect_left(held, (x, 1 << 60)) - 1
        if i >= 0 and held[i][1] > x:
            return
        low, high = _equal_stretch(a, x, d)
        insort(held, (low, high))
        if high - low + d >= max(min_length, exponent * d):
            found.append((low, high - low + d, d))

    for v in np.argsort(-np.asarray(length), kind="stable").tolist()[:-1]:  # all but the root, longest first
        mine, up = sets[v], link[v]
        if end[v] >= 0:  # a prefix of a ends here; its state may already hold longer states' positions
            mine = _merge(mine, Ends(end[v]), length[v], seed)
        sets[v] = None
        if up > 0:
            sets[up] = _merge(sets[up], mine, length[up], seed)
    return sorted(found)


def _merge(one: Ends | None, other: Ends, length: int, seed: Callable[[int, int], None]) -> Ends:
    """Both sets' positions in the larger set; seeds each new pair of neighbours up to length apart."""
    if one is None:
        return other
    large, small = (one, other) if one.n >= other.n else (other, one)
    xs = list(small)
    for i, x in enumerate(xs):
        before, after = large.around(x)
        # neighbours that come from the small set itself have met before
        if x - before <= length and (i == 0 or xs[i - 1] < before):
            seed(before, x)
        if after - x <= length and (i + 1 == len(xs) or xs[i + 1] > after):
            seed(x, after)
    for x in xs:
        large.add(x)
    return large


def pieces(codes: np.ndarray, owner: np.ndarray, min_length: int, exponent: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(positions, piece of each): consecutive words of one owner in which every word occurs exponent times.

    Fewer rounds than would be needed to come to rest leave larger pieces, never wrong ones.
    """
    at, piece = np.arange(len(codes)), owner
    for _ in range(rounds):
        if not len(at):
            break
        _, inverse, counts = np.unique(piece * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        keep = counts[inverse] >= exponent
        kept, was = at[keep], piece[keep]
        if not len(kept):
            return kept, was
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (was[1:] != was[:-1])
        label = np.cumsum(new) - 1
        long = np.bincount(label)[label] >= min_length
        done = keep.all() and long.all()
        at, piece = kept[long], label[long]
        if done:
            break
    return at, piece


def runs_of(texts: list[bytes], min_length: int = 6, exponent: int = 4) -> Iterator[tuple[list[bytes], list[Run]]]:
    """(words, runs) of each text, in order."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[Run]] = [[] for _ in texts]
    if first[-1]:
        codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        at, piece = pieces(codes, np.repeat(np.arange(len(texts)), sizes), min_length, exponent)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low = int(at[i])
            k = int(np.searchsorted(first, low, side="right")) - 1
            shift = low - int(first[k])
            found[k] += [(start + shift, n, q) for start, n, q in piece_runs(codes[low : low + j - i], min_length, exponent)]
    for w, r in zip(words, found, strict=True):
        yield w, sorted(r, key=lambda x: (x[0], x[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, n, q in runs:
        keep[start + q : start + n] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _pieces_of(table: pa.Table) -> Iterator[pa.Table]:
    """Slices with a bounded size of text, or of one row."""
    sizes = np.array([len(t) for t in B.texts(table)], np.int64)
    part = np.cumsum(sizes) // PIECE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j > i:
            yield table.slice(i, j - i)


def _mapped(docs: DataFrame, make: Callable[[pa.Table, list[tuple[list[bytes], list[Run]]]], pa.Table], schema, min_length: int, exponent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _pieces_of(pa.Table.from_batches([batch])):
                yield from make(table, list(runs_of(B.texts(table), min_length, exponent))).to_batches()
            B.trim()

    return docs.mapInArrow(run, schema)


def runs(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, start, length, period of every run, in words from 0."""

    def make(table: pa.Table, found: list) -> pa.Table:
        rows = [(i, *r) for i, (_, runs) in enumerate(found) for r in runs]
        column = lambda k: pa.array([r[k] for r in rows], pa.int64())
        return pa.table({"doc_id": table["doc_id"].take(column(0)), "start": column(1), "length": column(2), "period": column(3)})

    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "period")]).schema
    return _mapped(docs.select("doc_id", "text"), make, schema, min_length, exponent)


def collapse(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """docs with its columns; in texts with runs one period of each is left and words are joined by one space. Other texts stay as they are."""

    def make(table: pa.Table, found: list) -> pa.Table:
        old = table["text"].to_pylist()
        new = [b" ".join(kept_words(w, r)).decode() if r else t for t, (w, r) in zip(old, found, strict=True)]
        cols = {n: table[n] for n in table.column_names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([c if t == o else len(t) for c, t, o in zip(table["n_chars"].to_pylist(), new, old, strict=True)], table["n_chars"].type)
        return pa.table(cols)

    return _mapped(docs, make, docs.schema, min_length, exponent)


def best(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties go to the smaller start, then the smaller period."""
    top = None
    for r in runs:  # they come by start and then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def report(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """For each row: the number of runs, the run of the greatest exponent, digests of all runs and of the collapsed words."""

    def make(table: pa.Table, found: list) -> pa.Table:
        tops = [best(r) for _, r in found]
        column = lambda f: pa.array([None if t is None else f(t) for t in tops], pa.int64())
        sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()),
            "n_runs": pa.array([len(r) for _, r in found], pa.int64()),
            "start": column(lambda t: t[0]), "length": column(lambda t: t[1]), "period": column(lambda t: t[2]), "exponent_milli": column(lambda t: 1000 * t[1] // t[2]),
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode() for _, r in found),
            "collapsed_sha256": sha(b" ".join(kept_words(w, r)) for w, r in found),
        })

    return _mapped(docs.select("doc_id", "text"), make, REPORT, min_length, exponent)
