"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII whitespace with A-Z lower-cased. For each
key a shard keeps the exact number of documents that hold it (its reference count)
under a 128-bit digest. The keys that enough documents hold also stand in the shard's
cuckoo filter. Inserting documents adds to the counts and deleting documents takes
away; a key enters or leaves the filter when its count crosses the limit, so a deletion
undoes an insertion exactly. A lookup asks the filter first and then the counts, so
a false positive of the filter drops nothing.

Defined cases: a null or empty text is one empty line; empty keys are never dropped;
a key counts once per document row however often the row repeats it; repeated rows
count as documents of their own; an empty table gives an empty state and no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from sensorloom.llm import blocks as B

SPACE = b" \t\n\x0b\x0c\r"
STATE = "bucket long, digests binary, refs binary, filter binary"
SLOTS, KICKS = 4, 200


class CuckooFilter:
    """Set of 128-bit digests with deletion: 16-bit fingerprints, two buckets of four slots each.

    add() answers False when the table is full; the owner then rebuilds it larger from
    its exact table. discard() must only be called for digests that were added.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        n = 1
        while n * SLOTS * 0.85 < max(capacity, 1):
            n *= 2
        self.table = np.zeros((n, SLOTS), dtype=np.uint16) if table is None else table

    @staticmethod
    def prints(digests: np.ndarray) -> np.ndarray:
        return (digests[:, 0] >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = self.prints(digests)
        first = (digests[:, 1] & mask).astype(np.int64)
        return fp, first, first ^ self.jump(fp)

    def jump(self, fp):
        return ((np.asarray(fp).astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def add(self, digests: np.ndarray) -> bool:
        rng = np.random.default_rng(len(digests))
        for fp, i, j in zip(*self.places(digests), strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:
                at = i
                for _ in range(KICKS):
                    slot = rng.integers(SLOTS)
                    fp, self.table[at, slot] = self.table[at, slot], fp
                    at = at ^ int(self.jump(fp))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def discard(self, digests: np.ndarray) -> None:
        for fp, i, j in zip(*self.places(digests), strict=True):
            for at in (i, j):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def __contains__(self, digest) -> bool:
        return bool(self.holds(np.asarray([digest], dtype=np.uint64))[0])

    def holds(self, digests: np.ndarray) -> np.ndarray:
        fp, i, j = self.places(digests)
        return ((self.table[i] == fp[:, None]) | (self.table[j] == fp[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy())


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def as_pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = text.split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def _send(n: int):
    def send(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        held: Counter = Counter()
        for text in B.texts(table):
            held.update({k for k in line_keys(text)[1] if k})
        per: dict[int, list[tuple[bytes, int]]] = {}
        for key, docs in held.items():
            d = digest(key)
            per.setdefault(int.from_bytes(d[:4], "big") % n, []).append((d, docs))
        for bucket, got in per.items():
            yield bucket, B.dumps((b"".join(d for d, _ in got), np.array([c for _, c in got], dtype=np.int64).tobytes()))

    return send


def _sum(digests: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests, refs = digests[order], refs[order]
    first = np.ones(len(digests), dtype=bool)
    first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return digests[at], np.add.reduceat(refs, at) if len(at) else refs


def _find(table: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table):
        return np.full(len(digests), -1)
    hay = table[:, 0]
    lo = np.searchsorted(hay, digests[:, 0])
    lo = np.minimum(lo, len(hay) - 1)
    hit = (table[lo] == digests).all(axis=1)
    out = np.where(hit, lo, -1)
    clash = np.flatnonzero(~hit & (hay[lo] == digests[:, 0]))  # equal first halves
    for i in clash:
        j = lo[i]
        while j < len(hay) and hay[j] == digests[i, 0]:
            if table[j, 1] == digests[i, 1]:
                out[i] = j
                break
            j += 1
    return out


class LineIndex:
    """Reference counts and filters by shard, as a DataFrame that can be written and read.

    min_docs: documents that must hold a key before its lines are dropped.
    shards is fixed when the index is made and part of what must be kept with it.
    """

    def __init__(self, state: DataFrame | None, shards: int, min_docs: int = 10) -> None:
        self.state, self.shards, self.min_docs = state, shards, min_docs

    def _changed(self, messages: DataFrame, sign: int) -> LineIndex:
        limit = self.min_docs
        old = self.state if self.state is not None else messages.sparkSession.createDataFrame([], STATE)

        def run(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            parts = [B.loads(p) for p in new["payload"]]
            digests = [as_pairs(d) for d, _ in parts]
            refs = [sign * np.frombuffer(r, dtype=np.int64) for _, r in parts]
            was_d, was_r, cuckoo = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), None
            if len(old):
                was_d, was_r = as_pairs(old["digests"].iloc[0]), np.frombuffer(old["refs"].iloc[0], np.int64)
                cuckoo = CuckooFilter.from_bytes(old["filter"].iloc[0])
            d, r = _sum(np.concatenate([was_d, *digests]), np.concatenate([was_r, *refs]))
            if (r < 0).any():
                raise ValueError("a document was deleted that had not been inserted")
            before = np.zeros(len(d), np.int64)
            at = _find(d, was_d)
            before[at] = was_r
            enter, leave = d[(r >= limit) & (before < limit)], d[(r < limit) & (before >= limit)]
            full = True
            if cuckoo is not None:
                cuckoo.discard(leave)
                full = not cuckoo.add(enter)
            if full:
                room = 2 * int((r >= limit).sum())
                while not (cuckoo := CuckooFilter(room)).add(d[r >= limit]):
                    room *= 2
            d, r = d[r > 0], r[r > 0]
            return pd.DataFrame({"bucket": [int(key[0])], "digests": [d.tobytes()], "refs": [r.tobytes()], "filter": [cuckoo.to_bytes()]})

        state = messages.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(run, STATE)
        return LineIndex(B.saved(state), self.shards, limit)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(self._messages(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(self._messages(docs), -1)

    def _messages(self, docs: DataFrame) -> DataFrame:
        return B.scatter(B.pack(docs.select("text")), _send(self.shards))

    def common(self, messages: DataFrame) -> DataFrame:
        """Answers to the blocks: digests of their keys that enough documents hold."""
        limit = self.min_docs

        def run(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(old):
                table, refs = as_pairs(old["digests"].iloc[0]), np.frombuffer(old["refs"].iloc[0], np.int64)
                cuckoo = CuckooFilter.from_bytes(old["filter"].iloc[0])
                for block, payload in zip(new["block"], new["payload"], strict=True):
                    asked = as_pairs(B.loads(payload)[0])
                    maybe = asked[cuckoo.holds(asked)]
                    at = _find(table, maybe)
                    sure = maybe[(at >= 0) & (refs[at] >= limit)]
                    if len(sure):
                        out.append((int(block), sure.tobytes()))
            return pd.DataFrame({"block": pd.Series([b for b, _ in out], dtype="int64"), "bucket": pd.Series([int(key[0])] * len(out), dtype="int64"), "payload": pd.Series([p for _, p in out], dtype=object)})

        return messages.groupBy("bucket").cogroup(self.state.groupBy("bucket")).applyInPandas(run, B.MESSAGE)


def _kept(text: bytes, common: set[bytes]) -> tuple[int, int, bytes]:
    lines, keys = line_keys(text)
    if not common:
        return len(lines), 0, text
    kept = [x for x, k in zip(lines, keys, strict=True) if not k or digest(k) not in common]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _common_of(payloads: list[bytes]) -> set[bytes]:
    return {raw[i : i + 16] for raw in payloads for i in range(0, len(raw), 16)}


def _apply(docs: DataFrame, min_docs: int, finish, schema) -> DataFrame:
    """Pack docs, count their lines in a new index and finish each block with its common keys."""
    packed = B.pack(docs)
    shards = B.bucket_count(packed)
    messages = B.saved(B.scatter(packed, _send(shards)))
    index = LineIndex(None, shards, min_docs)._changed(messages, 1)
    return B.gather(packed, index.common(messages), finish, schema)


def line_report(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for each row of docs."""

    def finish(_: int, table: pa.Table, payloads: list[bytes]):
        common = _common_of(payloads)
        rows = [_kept(t, common) for t in B.texts(table)]
        yield pa.table({
            "doc_id": table["doc_id"],
            "n_lines": pa.array([r[0] for r in rows], pa.int64()),
            "n_dropped": pa.array([r[1] for r in rows], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
        })

    return _apply(docs.select("doc_id", "text"), min_docs, finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs with its columns, the common lines gone from the text and n_chars, if there, recounted.

    A null text stays null; a document that loses all its lines stays with an empty text.
    """
    names = docs.columns

    def finish(_: int, table: pa.Table, payloads: list[bytes]):
        common = _common_of(payloads)
        old = table["text"].to_pylist()
        new = [None if o is None else _kept(o.encode(), common)[2].decode() for o in old]
        cols = {n: table[n] for n in names}
        cols["text"] = pa.array(new, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([c if t is None or t == o else len(t) for c, t, o in zip(table["n_chars"].to_pylist(), new, old, strict=True)], table["n_chars"].type)
        yield pa.table(cols)

    return _apply(docs, min_docs, finish, docs.schema)
