"""Removal of repeated byte strings with a column-wise multi-document BWT.

Every byte covered by a string of `length` bytes that also starts elsewhere goes. Each
window of that length is assigned to its anchor, the leftmost smallest hash among its
byte 32-grams: equal windows have equal anchors at equal offsets. Anchors that occur
once cannot stand in a repeated window and drop out by hash counts; for the others, the
segment of bytes that holds all windows of that anchor occurrence goes to the anchor's
bucket. Equal segments count as one with a multiplicity. Where an anchor has several
distinct segments, the bucket builds the collection's Burrows-Wheeler transform and
longest common prefixes column by column: each round inserts one symbol of every
string, right to left, reading the last round's BWT and LCP columns front to back and
writing the next ones; columns beyond a memory limit lie in files. Symbols are runs of
several bytes and a segment stands for as many strings, one for each byte phase, so
rounds are fewer by that factor. A window is repeated when its suffix has `length` or
more bytes in common with a neighbour.

Anchor collisions only make more segments meet; the BWT decides. Memory holds one
block, or one collection's columns; a hot anchor's equal segments are merged in each
block before they travel, and collections are cut between anchors at `collection_bytes`.

Defined cases: null text is empty; documents shorter than `length` keep all; repeated
rows are copies of each other and go entirely (beyond `length`); matches never cross
documents.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorloom.llm import blocks as B

GRAM = 32
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(b) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the text: anchor hashes, and the first and last window starts of each occurrence."""
    n = len(text) - length + 1
    for at in range(0, max(n, 0), PIECE):
        b = np.frombuffer(text, np.uint8, min(PIECE, n - at) + length - 1, at)
        packed = (gram_hashes(b) & ~np.uint64((1 << 20) - 1)) | np.arange(len(b) - GRAM + 1, dtype=np.uint64)
        low = sliding_min(packed, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        yield low[first] >> np.uint64(20), first + at, np.append(first[1:], len(low)) - 1 + at


def _doc_anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(anchors(text, length))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(key):
        return
    to = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(to[order[a]]), order[a:z]


def _send_hashes(length: int, n: int):
    def send(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        found = [_doc_anchors(t, length)[0] for t in B.texts(table)]
        h, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        for bucket, at in _split(h, n):
            yield bucket, B.dumps((h[at], counts[at] > 1))

    return send


def _repeated(_: int, messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    parts = [B.loads(p) for _, p in messages]
    h, counts = np.unique(np.concatenate([x for x, _ in parts]), return_counts=True)
    own = np.concatenate([x[m] for x, m in parts])
    many = np.union1d(h[counts > 1], own)
    for (block, _), (x, _) in zip(messages, parts, strict=True):
        hit = x[np.isin(x, many, assume_unique=True)]
        if len(hit):
            yield block, hit.tobytes()


def _send_segments(length: int, n: int):
    def finish(block: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.Table]:
        many = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in payloads]))
        per: dict[int, dict[tuple[int, bytes], list[tuple[int, int]]]] = {}
        for doc, text in enumerate(B.texts(table)):
            h, first, last = _doc_anchors(text, length)
            hit = many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h
            for x, a, z in zip(h[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                per.setdefault(x % n, {}).setdefault((x, text[a : z + length]), []).append((doc, a))
        out = []
        for bucket, segments in per.items():
            keys = list(segments)
            where = np.array([(i, d, a) for i, k in enumerate(keys) for d, a in segments[k]], np.int64)
            out.append((bucket, B.dumps((np.array([k[0] for k in keys], np.uint64), [k[1] for k in keys], where))))
        yield pa.table({"block": pa.array([block] * len(out), pa.int64()), "bucket": pa.array([b for b, _ in out], pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return finish


class Column:
    """A column that is written and read front to back; beyond the memory limit it is a file."""

    def __init__(self, values: np.ndarray, memory: int) -> None:
        self.dtype, self.file = values.dtype, tempfile.SpooledTemporaryFile(max_size=memory)
        self.file.write(values.tobytes())

    def read(self) -> np.ndarray:
        self.file.seek(0)
        values = np.frombuffer(self.file.read(), self.dtype)
        self.file.close()
        return values


def _symbols(segments: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """At each byte of the joined segments, the code (from 1, in order) of the `width` bytes there; and the segments' starts."""
    raw = np.frombuffer(b"".join(segments) + bytes(width), np.uint8).astype(np.uint64)
    word = np.zeros(len(raw) - width, np.uint64)
    for i in range(width):
        word = (word << np.uint64(8)) | raw[i : i + len(word)]
    known, code = np.unique(word, return_inverse=True)
    starts = np.cumsum([0, *map(len, segments[:-1])])
    return (code + 1).astype(np.uint16 if len(known) < 1 << 16 else np.uint32), starts


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of the symbols, by radix sorts of 16 bits each."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    if symbols.dtype.itemsize > 2:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def shared_windows(segments: list[bytes], length: int, memory: int = 32 << 20) -> list[np.ndarray]:
    """For each of distinct segments, which of its windows of `length` bytes occur in another.

    A symbol is a run of `width` bytes, the largest divisor of the length up to 8, and each
    segment stands for `width` strings of symbols, one from each of its first bytes; so
    each window is a whole number of symbols of one string.

    Column-wise construction: round t inserts the suffix of t symbols of every string that
    has one. With BWT symbol c before the last inserted suffix at p, the next suffix goes
    behind all that start with less than c and the earlier occurrences of c; its common
    prefix with its predecessor is one more than the least LCP since that occurrence.
    """
    width = max(w for w in range(1, 9) if length % w == 0)
    code, starts = _symbols(segments, width)
    sizes = np.array([len(s) for s in segments], np.int64)
    first = (starts[:, None] + np.arange(width)).ravel()
    counts = ((sizes[:, None] - np.arange(width)) // width).ravel()
    used = counts * width >= length
    first, counts, owner = first[used], counts[used], np.flatnonzero(used) // width
    out = [np.zeros(max(0, int(s) - length + 1), bool) for s in sizes]
    m = len(counts)
    if not m:
        return out
    # symbol 0 ends a string
    bwt = Column(code[first + (counts - 1) * width], memory)
    lcp = Column(np.zeros(m, np.uint32), memory)
    at, active = np.arange(m), np.arange(m)
    for t in range(1, int(counts.max()) + 1):
        old_bwt, old_lcp = bwt.read(), lcp.read()
        order = _order(old_bwt)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        r = rank[at]
        symbol = old_bwt[at]
        gone = int((old_bwt == 0).sum())
        place = m + r - gone
        prev = order[np.maximum(r - 1, 0)]
        leads = (r > 0) & (old_bwt[prev] == symbol)
        after = order[np.minimum(r + 1, len(order) - 1)]
        follows = (r + 1 < len(order)) & (old_bwt[after] == symbol)
        size = len(old_bwt) + len(active)
        fresh = np.zeros(size, bool)
        fresh[place] = True
        new_bwt, new_lcp = np.empty(size, code.dtype), np.empty(size, np.uint32)
        new_bwt[~fresh], new_lcp[~fresh] = old_bwt, old_lcp
        left = counts[active] - t
        new_bwt[place] = np.where(left > 0, code[first[active] + np.maximum(left - 1, 0) * width], 0)
        new_lcp[place] = 0
        new_lcp[place[leads]] = _least(old_lcp, prev[leads] + 1, at[leads] + 1) + 1
        new_lcp[place[follows] + 1] = _least(old_lcp, at[follows] + 1, after[follows] + 1) + 1
        bwt, lcp = Column(new_bwt, memory), Column(new_lcp, memory)
        at, active = place[left > 0], active[left > 0]
    final, common = bwt.read(), np.append(lcp.read(), 0)
    order = _order(final)
    step = np.empty(len(order), np.int64)
    step[order] = np.arange(len(order)) + m - int((final == 0).sum())
    at, active = np.arange(m), np.arange(m)
    for t in range(1, int(counts.max()) + 1):
        at = step[at]
        if t * width >= length:
            hit = active[np.maximum(common[at], common[at + 1]) * width >= length]
            for i, x in zip(owner[hit].tolist(), (first[hit] + (counts[hit] - t) * width - starts[owner[hit]]).tolist(), strict=True):
                out[i][x] = True
        going = counts[active] > t
        at, active = at[going], active[going]
    return out


def _least(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Minimum of values[a:z] for each pair of a < z, by minima over powers of two."""
    out = np.zeros(len(a), values.dtype)
    power = np.frexp((z - a).astype(np.float64))[1] - 1
    level = values
    for j in range(int(power.max(initial=-1)) + 1):
        if j:
            half = 1 << (j - 1)
            level = np.minimum(level[:-half], level[half:])
        ask = np.flatnonzero(power == j)
        out[ask] = np.minimum(level[a[ask]], level[z[ask] - (1 << j)])
    return out


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _resolve(length: int, collection_bytes: int):
    def reduce(_: int, messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [B.loads(p) for _, p in messages]
        times: dict[tuple[int, bytes], int] = {}
        for h, segments, where in parts:
            n = np.bincount(where[:, 0], minlength=len(segments)).tolist()
            for x, s, k in zip(h.tolist(), segments, n, strict=True):
                times[x, s] = times.get((x, s), 0) + k
        by_anchor: dict[int, list[bytes]] = {}
        for x, s in times:
            by_anchor.setdefault(x, []).append(s)
        found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        batch: list[tuple[int, bytes]] = []

        def flush():
            for key, flags in zip(batch, shared_windows([s for _, s in batch], length), strict=True):
                found[key] = _intervals(flags | (times[key] > 1))
            batch.clear()

        size = 0
        for x, segments in by_anchor.items():
            if len(segments) == 1:
                s = segments[0]
                found[x, s] = [(0, len(s) - length + 1)] if times[x, s] > 1 else []
                continue
            if size and size + sum(map(len, segments)) > collection_bytes:
                flush()
                size = 0
            batch += [(x, s) for s in segments]
            size += sum(map(len, segments))
        if batch:
            flush()
        for (block, _), (h, segments, where) in zip(messages, parts, strict=True):
            spans = [found[x, s] for x, s in zip(h.tolist(), segments, strict=True)]
            rows = [(d, a + u, a + v - 1 + length) for i, d, a in where.tolist() for u, v in spans[i]]
            if rows:
                yield block, np.array(rows, np.int32).tobytes()

    return reduce


def removed_spans(docs: DataFrame, finish, schema, length: int = 200, collection_bytes: int = 60_000) -> DataFrame:
    """Rows that finish(table, spans) makes of each block; spans[i] are row i's merged removed byte ranges."""
    packed = B.pack(docs)
    n = B.bucket_count(packed)
    counts = B.scatter(packed, _send_hashes(length, n))
    many = B.at_buckets(counts, _repeated)
    segments = B.gather(packed, many, _send_segments(length, n), B.MESSAGE, every=False)
    ranges = B.at_buckets(segments, _resolve(length, collection_bytes))

    def close(_: int, table: pa.Table, payloads: list[bytes]):
        rows = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(p, np.int32).reshape(-1, 3).astype(np.int64) for p in payloads)])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        spans: list[list[list[int]]] = [[] for _ in range(table.num_rows)]
        for d, a, z in rows.tolist():
            own = spans[d]
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], z)
            else:
                own.append([a, z])
        yield finish(table, spans)

    return B.gather(packed, ranges, close, schema)


def keep(text: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


def report(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, for each row."""

    def finish(table: pa.Table, spans) -> pa.Table:
        texts = B.texts(table)
        return pa.table({
            "doc_id": table["doc_id"],
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([sum(z - a for a, z in s) for s in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(keep(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
        })

    return removed_spans(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with kept, the bytes of the text that stay, as binary (a cut may split a character)."""

    def finish(table: pa.Table, spans) -> pa.Table:
        return pa.table({**{n: table[n] for n in names}, "kept": pa.array([keep(t, s) for t, s in zip(B.texts(table), spans, strict=True)], pa.binary())})

    names = [c for c in docs.columns if c != "kept"]
    return removed_spans(docs, finish, docs.select(*names).schema.add("kept", "binary"), length)
