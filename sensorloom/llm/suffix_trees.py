"""Removal of repeated passages: suffix trees of suffixes that are dealt out by prefixes.

A window is `length` consecutive words of one document. A word goes if it lies in a window
whose words also start in a document with a smaller id. The windows are the suffixes of the
corpus that matter, each with at least `length` words before its document ends.

Prefixes. Among the runs of GRAM words inside a window the one with the smallest hash, the
leftmost of equals, is its anchor; the words up to the anchor's end are the window's prefix, so
prefixes have 8 to `length` words, and equal windows have equal prefixes. Neighbouring windows
with one anchor are a stretch and travel as one piece of text, from which the tree reads all
their suffixes. A prefix that one document alone holds cannot start a repeat; no text of it
leaves its block. Where too many different stretches meet at one anchor, their prefixes are
made longer, to `length` - 10 words, and where too many meet again, to `length` words: at
most LIMIT stretches share a prefix, or the whole windows are equal and one minimum is all there is.

Trees. Prefixes are packed into groups of about GROUP suffixes. A group's suffixes are
sorted by doubling of ranks, with their longest common prefixes, and the inner nodes of their
tree are found with a stack. Leaves below a node of depth `length` or more share a window;
such nodes are the repeats, and the topmost of them has the smallest document id for all its leaves.
Equal stretches, most of exact copies, are one leaf that stands for all its documents: it
carries the smallest and the greatest id.

Blocks send a message for each distinct anchor and stretch, not for each occurrence, and text
travels once for each distinct repeated stretch. Stretches are told apart by 128-bit digests of
their words; anchors by 64-bit hashes, where a clash costs time only.

Defined cases: null, empty and blank texts have no words, nothing goes; texts shorter than a
window stay; documents without an id are nobody's source and lose nothing; rows of one id
are no source for each other; other columns are carried by `dedup`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import blocks as B

GRAM = 8
SPAN = 11  # windows that share a prefix of length - 10 words
PIECE_BYTES = 1 << 20  # of text cut into words together
CHUNK = 1 << 18  # windows whose anchors are sought together
LIMIT = 2000  # different stretches that may share a prefix
GROUP = 200_000  # words in a group of prefixes
STRETCH = "bucket long, prefix long, digest binary, low long, high long, skip int, n int, before int, words binary"
ANSWER = "bucket long, digest binary, skip int, n int, low long"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(GRAM)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: one run of bytes with a blank after each word, where words start, and each text's first word."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = _BLANK[raw]
        after = np.concatenate([[True], blank[:-1]])
        starts, ends = np.flatnonzero(~blank & after), np.flatnonzero(blank & ~after)
        self.bytes = np.where(blank, np.uint8(32), raw)[~(blank & after)].tobytes()
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        self.first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        self.n = len(starts)

    def cut(self, i: int, j: int) -> bytes:
        return self.bytes[self.at[i] : self.at[j] - 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from sums of powers over its bytes."""
        out = np.empty(self.n, np.uint64)
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + PIECE_BYTES)) - 1)
            here = self.at[i : j + 1] - self.at[i]
            part = np.frombuffer(self.bytes, np.uint8, int(here[-1]), int(self.at[i])).astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _powers(_BASE, len(part)))])
            out[i:j] = (sums[here[1:]] - sums[here[:-1]]) * _powers(_BACK, len(part) + 1)[here[:-1]]
            i = j
        return _mixed(out)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, PIECE_BYTES) + 64, base, np.uint64))])
        _POWERS[int(base)] = held
    return held[:n]


def anchors(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of its anchor, the anchor's hash) for each window of the words' hashes."""
    m = len(codes) - GRAM + 1
    gram = np.zeros(m, np.uint64)
    for j in range(GRAM):
        gram += codes[j : j + m] * _ODD[j]
    gram = _mixed(gram)
    width, size, at = length - GRAM + 1, 1, np.arange(m)
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(gram[b] < gram[a], b, a), size + step
    return at, gram[at]


def stretches(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor, anchor's hash) of each stretch, in order."""
    sizes = np.diff(words.first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes, found = words.hashes(), []
    for c in range(0, words.n - length + 1, CHUNK):
        part = codes[c : c + CHUNK + length - 1]
        at, gram = anchors(part, length)
        p = np.arange(c, c + len(at))
        fits = p + length <= words.first[1:][owner[p]]
        p, at, gram = p[fits], at[fits] + c, gram[fits]
        if len(p):
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
            found.append((owner[p[new]], p[new], np.diff(np.append(new, len(p))), at[new], gram[new]))
    if not found:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slices(table: pa.Table) -> Iterator[tuple[int, Words]]:
    """(first row, words) of slices of the rows with a bounded size of text, or of one row."""
    texts = B.texts(table)
    part = np.cumsum([len(t) for t in texts]) // PIECE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(texts)]]).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield i, Words(texts[i:j])


def _pieces(table: pa.Table, length: int) -> Iterator[tuple[int, Words, tuple]]:
    for i, words in _slices(table):
        yield i, words, stretches(words, length)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["doc_id"].cast(pa.int64())
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _bounds(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the least low and the greatest high."""
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.minimum.reduceat(low, at) if len(at) else low, np.maximum.reduceat(high, at) if len(at) else high


def _anchors_of(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of the rows with the smallest and greatest id that holds them."""
    ids, known = _ids(table)
    grams, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, (owner, _, _, _, gram) in _pieces(table, length):
        there = known[owner + i]
        grams.append(gram[there])
        docs.append(ids[owner[there] + i])
    docs = np.concatenate(docs)
    return _bounds(np.concatenate(grams), docs, docs)


def _by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (keys >> np.uint64(32)).astype(np.int64) % n
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield int(bucket[order[i]]), order[i:j]


def _send_anchors(n: int, length: int):
    def send(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        grams, low, high = _anchors_of(table, length)
        for bucket, at in _by_bucket(grams, n):
            yield bucket, B.dumps((grams[at].tobytes(), low[at].tobytes(), high[at].tobytes()))

    return send


def _arrays(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, low, high = B.loads(payload)
    return np.frombuffer(keys, np.uint64), np.frombuffer(low, np.int64), np.frombuffer(high, np.int64)


def _shared(bucket: int, messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Tells each block which of its anchors two documents or more hold."""
    got = [_arrays(p) for _, p in messages]
    keys, low, high = _bounds(*(np.concatenate(x) for x in zip(*got, strict=True)))
    keys = keys[low < high]
    for (block, _), (mine, _, _) in zip(messages, got, strict=True):
        mine = mine[np.isin(mine, keys)]
        if len(mine):
            yield block, mine.tobytes()


def _digests(words: Words, start: np.ndarray, count: np.ndarray, length: int) -> list[bytes]:
    cut = words.cut
    return [xxhash.xxh3_128_digest(cut(p, p + n + length - 1)) for p, n in zip(start.tolist(), count.tolist(), strict=True)]


def _bucket_of(digest: bytes, n: int) -> int:
    return int.from_bytes(digest[:4], "big") % n


def _send_stretches(n: int, length: int):
    """For the blocks' second message: its distinct stretches with a shared anchor, each with its smallest and greatest id."""

    def finish(block: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        shared = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in payloads]))
        ids, known = _ids(table)
        held: dict[bytes, tuple[int, int]] = {}
        for i, words, (owner, start, count, _, gram) in _pieces(table, length):
            there = np.flatnonzero(known[owner + i] & np.isin(gram, shared))
            docs = ids[owner[there] + i].tolist()
            for d, doc in zip(_digests(words, start[there], count[there], length), docs, strict=True):
                low, high = held.get(d, (doc, doc))
                held[d] = (min(low, doc), max(high, doc))
        per: dict[int, list[bytes]] = {}
        for d in held:
            per.setdefault(_bucket_of(d, n), []).append(d)
        payload = [B.dumps((b"".join(ds), np.array([held[d] for d in ds], np.int64).tobytes())) for ds in per.values()]
        yield pa.table({"block": pa.array([block] * len(per), pa.int64()), "bucket": pa.array(list(per), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return finish


def _stretches_in(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    digests, bounds = B.loads(payload)
    return [digests[i : i + 16] for i in range(0, len(digests), 16)], np.frombuffer(bounds, np.int64).reshape(-1, 2)


def _spoken_for(bucket: int, messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Names, for each stretch, one block that sends its words, with the ids that bound all its documents."""
    held: dict[bytes, list[int]] = {}
    for block, payload in messages:
        digests, bounds = _stretches_in(payload)
        for d, (low, high) in zip(digests, bounds.tolist(), strict=True):
            one = held.setdefault(d, [block, low, high])
            one[1:] = min(one[1], low), max(one[2], high)
    per: dict[int, list[bytes]] = {}
    for d, (block, _, _) in held.items():
        per.setdefault(block, []).append(d)
    for block, ds in per.items():
        yield block, B.dumps((b"".join(ds), np.array([held[d][1:] for d in ds], np.int64).tobytes()))


def _speak(n: int, length: int):
    """Rows of the stretches this block sends the words of."""

    def finish(_: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        wanted: dict[bytes, tuple[int, int]] = {}
        for p in payloads:
            digests, bounds = _stretches_in(p)
            wanted |= dict(zip(digests, map(tuple, bounds.tolist()), strict=True))
        rows: list[tuple] = []
        for _, words, (_, start, count, at, gram) in _pieces(table, length):
            for k, d in enumerate(_digests(words, start, count, length)):
                if d in wanted:
                    low, high = wanted.pop(d)
                    p, c = int(start[k]), int(count[k])
                    rows.append((_bucket_of(d, n), int(gram[k].astype(np.int64)), d, low, high, 0, c, int(at[k]) - p, words.cut(p, p + c + length - 1)))
        yield _table(rows, STRETCH)

    return finish


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, _TYPES[t]) for (name, t), c in zip(fields, columns, strict=True)})


def _lengthened(length: int):
    """Each stretch in parts of at most SPAN windows; the prefix is all that the part's windows share, length - SPAN + 1 words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["words"].split(b" ")
                # parts are cut by the windows' distance to the anchor, which equal windows have in common
                for lot in range((r["before"] - r["n"] + 1) // SPAN, r["before"] // SPAN + 1):
                    i, j = max(0, r["before"] - (lot + 1) * SPAN + 1), min(r["n"], r["before"] - lot * SPAN + 1)
                    left, right = r["before"] - lot * SPAN, r["before"] - (lot + 1) * SPAN + 1 + length
                    key = b"%d " % lot + b" ".join(words[left:right])
                    rows.append((r["bucket"], xxhash.xxh3_64_intdigest(key) - (1 << 63), r["digest"], r["low"], r["high"], r["skip"] + i, j - i, r["before"] - i, b" ".join(words[i : j + length - 1])))
            yield from _table(rows, STRETCH).to_batches()

    return run


def _windows(length: int):
    """A row for each window, its whole words' digest for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["words"].split(b" ")
                for i in range(r["n"]):
                    rows.append((r["bucket"], 0, r["digest"], r["low"], r["high"], r["skip"] + i, 1, 0, xxhash.xxh3_128_digest(b" ".join(words[i : i + length]))))
            yield from _table(rows, STRETCH).to_batches()

    return run


class Suffixes:
    """Suffixes of some sequences in order, with the longest common prefixes of neighbours.

    keep: the positions, in the sequences laid end to end, whose suffixes count. No common
    prefix runs over the end of a sequence, and none is counted beyond `most` words.
    """

    def __init__(self, sequences: list[np.ndarray], keep: np.ndarray, most: int) -> None:
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes + 1) - 1
        codes = np.full(int(ends[-1]) + 1 if len(ends) else 0, -1, np.int64)
        codes[np.setdiff1d(np.arange(len(codes)), ends, assume_unique=True)] = np.concatenate(sequences) if sequences else []
        codes[ends] = codes.max(initial=0) + 1 + np.arange(len(ends))  # no two ends are equal
        ranks, step = [np.unique(codes, return_inverse=True)[1]], 1
        while step < most:
            last = ranks[-1]
            ahead = np.concatenate([last[step:], np.arange(min(step, len(last)))])  # beyond the last end nothing compares equal any more
            ranks.append(np.unique(last * (len(last) + 1) + ahead, return_inverse=True)[1])
            step *= 2
        self.order = keep[np.argsort(ranks[-1][keep], kind="stable")]
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            top = len(ranks[k]) - 1
            same = (ranks[k][np.minimum(a, top)] == ranks[k][np.minimum(b, top)]) & (a <= top) & (b <= top)
            self.common += same * (1 << k)
            a, b = a + same * (1 << k), b + same * (1 << k)

    def deep_nodes(self, depth: int) -> list[tuple[int, int, int, bool]]:
        """(depth, first leaf, last leaf, topmost) of the tree's inner nodes of at least that depth; topmost ones have no such node above."""
        out = []
        deep = np.flatnonzero(self.common >= depth)
        for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else ():
            stack: list[tuple[int, int]] = []  # (depth, first leaf)
            for i, c in zip(run.tolist(), self.common[run].tolist(), strict=True):
                first = i
                while stack and stack[-1][0] > c:
                    d, first = stack.pop()
                    out.append((d, first, i, False))
                if not stack or stack[-1][0] < c:
                    stack.append((c, first))
            while stack:
                d, first = stack.pop()
                out.append((d, first, int(run[-1]) + 1, not stack))
        return out


def _grown(length: int):
    """Answers of a group: for runs of a stretch's windows the smallest id of a document that holds them, where that tells anyone anything."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [w.split(b" ") for w in pdf["words"]]
        sizes = np.array([len(w) for w in parts], np.int64)
        codes = pa.array([x for w in parts for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        n = pdf["n"].to_numpy(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = (starts + np.arange(len(n)))[owner] + window  # each sequence before has one end mark
        tree = Suffixes([codes[s : s + z] for s, z in zip(starts, sizes, strict=True)], place, 2 * length)
        leaf = np.searchsorted(place, tree.order)  # places rise with owner and window
        low = pdf["low"].to_numpy(np.int64)[owner[leaf]]
        least = low.copy()
        for _, i, j, topmost in tree.deep_nodes(length):
            if topmost:
                least[i : j + 1] = low[i : j + 1].min()
        by_window = np.empty(len(least), np.int64)
        by_window[leaf] = least
        useful = by_window < pdf["high"].to_numpy(np.int64)[owner]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (by_window[1:] != by_window[:-1]) | (useful[1:] != useful[:-1])])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(new)))
        at, count = at[useful[at]], count[useful[at]]
        rows = pdf.iloc[owner[at]]
        return pd.DataFrame({"bucket": rows["bucket"].to_numpy(), "digest": rows["digest"].to_numpy(), "skip": (rows["skip"].to_numpy() + window[at]).astype(np.int32), "n": count.astype(np.int32), "low": by_window[at]})

    return run


def _answers(sent: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(ANSWER rows for the stretches whose words were sent, a table that they are read from)."""
    total = sent.agg(F.sum(F.col("n") + length)).first()[0] or 0
    groups = total // GROUP + 1

    def hot(df: DataFrame) -> DataFrame:
        return df.groupBy("prefix").agg(F.count("*").alias("__n")).where(F.col("__n") > LIMIT).select("prefix")

    longer = B.saved(sent.join(hot(sent), "prefix", "left_semi").select(*sent.columns).mapInArrow(_lengthened(length), STRETCH))
    equal = longer.join(hot(longer), "prefix", "left_semi").select(*sent.columns).mapInArrow(_windows(length), STRETCH)
    least = equal.groupBy("words").agg(F.min("low").alias("least"))
    whole = equal.join(least, "words").where("least < high").select("bucket", "digest", "skip", "n", F.col("least").alias("low"))
    treed = sent.join(hot(sent), "prefix", "left_anti").select(*sent.columns).unionByName(longer.join(hot(longer), "prefix", "left_anti").select(*sent.columns))
    grown = treed.withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("group").applyInPandas(_grown(length), ANSWER)
    return grown.unionByName(whole), longer


def _told(key, asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to each block that asked about their stretches."""
    found: dict[bytes, list[tuple[int, int, int]]] = {}
    for d, i, n, low in zip(answers["digest"], answers["skip"], answers["n"], answers["low"], strict=True):
        found.setdefault(bytes(d), []).append((int(i), int(n), int(low)))
    out: dict[int, dict] = {}
    for block, payload in zip(asked["block"].tolist(), asked["payload"], strict=True):
        for d in _stretches_in(payload)[0]:
            if d in found:
                out.setdefault(block, {})[d] = found[d]
    return pd.DataFrame({"block": pd.Series(list(out), dtype="int64"), "bucket": pd.Series([int(key[0])] * len(out), dtype="int64"), "payload": pd.Series([B.dumps(x) for x in out.values()], dtype=object)})


def _removed(table: pa.Table, payloads: list[bytes], length: int) -> Iterator[tuple[Words, list[np.ndarray]]]:
    """(words, for each text which of its words go) of slices of the rows, in order."""
    found: dict[bytes, list[tuple[int, int, int]]] = {}
    for p in payloads:
        found |= B.loads(p)
    ids, known = _ids(table)
    for i, words in _slices(table):
        step = np.zeros(words.n + 1, np.int64)
        if found:
            owner, start, count, _, _ = stretches(words, length)
            for k, d in enumerate(_digests(words, start, count, length)):
                row = i + int(owner[k])
                for skip, n, low in found.get(d, ()) if known[row] else ():
                    if ids[row] > low:
                        p = int(start[k]) + skip
                        step[p] += 1
                        step[p + n + length - 1] -= 1
        gone = np.cumsum(step[:-1]) > 0
        yield words, [gone[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _apply(docs: DataFrame, length: int, finish: Callable, schema) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"windows have {GRAM} words at least")
    packed = B.pack(docs)
    n = B.bucket_count(packed)
    shared = B.at_buckets(B.scatter(packed, _send_anchors(n, length)), _shared)
    asked = B.saved(B.gather(packed, shared, _send_stretches(n, length), B.MESSAGE, every=False))
    sent = B.saved(B.gather(packed, B.at_buckets(asked, _spoken_for), _speak(n, length), STRETCH, every=False))
    answers, longer = _answers(sent, length)
    told = B.saved(asked.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(_told, B.MESSAGE))
    B.dropped(asked, sent, longer)
    return B.gather(packed, told, finish, schema)


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, for each row."""

    def finish(_: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        rows = []
        for words, gone in _removed(table, payloads, length):
            for first, go in zip(words.first[:-1].tolist(), gone, strict=True):
                rows.append((len(go), int(go.sum()), hashlib.sha256(_kept(words, first, go)).hexdigest()))
        n_words, n_removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _apply(docs.select("doc_id", "text"), length, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(words: Words, first: int, gone: np.ndarray) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]))).reshape(-1, 2) + first
    return b" ".join(words.cut(i, j) for i, j in edges.tolist())


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with its columns; texts that lose words are the kept ones joined by one space, n_chars, if there, recounted. Other texts stay as they are."""
    names = docs.columns

    def finish(_: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        old = table["text"].to_pylist()
        new = []
        for words, gone in _removed(table, payloads, length):
            for first, go in zip(words.first[:-1].tolist(), gone, strict=True):
                new.append(_kept(words, first, go).decode() if go.any() else old[len(new)])
        cols = {n: table[n] for n in names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([c if t == o else len(t) for c, t, o in zip(table["n_chars"].to_pylist(), new, old, strict=True)], table["n_chars"].type)
        yield pa.table(cols)

    return _apply(docs, length, finish, docs.schema)
