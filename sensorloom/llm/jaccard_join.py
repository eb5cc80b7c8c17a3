"""Exact n-gram Jaccard self-join with PartEnum signatures.

A document's set holds the 64-bit hashes of its word n-grams. Sets fall into bands of
equal size (the next band starts where similarity with the last is impossible), and a
pair that is similar enough lies in one band or two adjacent ones. For a pair of bands
the sets' symmetric difference is at most k elements, so when the feature domain is
hashed into first-level partitions, at least one of them differs in no more than its
share of k; each first-level partition is split into second-level ones and the subsets
of those that must then agree are enumerated. A set's signature is such a subset
restricted to the set, so similar sets share one. With one difference at most to a
first-level partition the subsets are single second-level partitions, which is the
form used here: k + 1 + spare partitions in all.

Partitions that are empty in both sets agree but say nothing; up to `spare` of them
are covered by the spare partitions. Sets with more empty ones take part, in addition,
in a further enumeration with another hash, and at the last level empty partitions
count too. So no similar pair is lost.

Equal sets are collapsed to a class before signatures are made. Rows that share a
signature make a star about the first of them, in one hashed order; stars with the same
centre are one, so a pair that shares many signatures meets about once. The rows of a star
are compared by sketches in tiles, and a task names only pairs that connect components
which its earlier pairs do not, so pairs grow as rows do; this is enough for components.
class_links and link_counts verify every pair that shares a signature instead. Before a set travels, the pair
must pass the sets' parity sketches, which bound the difference from below and so lose
nothing. Sets are compared where the blocks of their texts lie.

Defined cases: null or blank text has an empty set and links with nothing; fewer words
than n give one n-gram of them all; repeated rows are documents of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import blocks as B
from sensorloom.llm.graph import connected_components

ROW_BITS = 22
LEVELS = 4
SKETCH_BITS = 1024
TILE = 2048
_MUL = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _MUL + w[i : len(w) - n + 1 + i])
    return np.unique(h)


class Plan:
    """Bands and partition counts for similarity >= num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self._tops: list[int] = [0]

    def band(self, size: int) -> int:
        """Index of the band; band i reaches from tops[i-1] + 1 to tops[i]."""
        while self._tops[-1] < size:
            low = self._tops[-1] + 1
            self._tops.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self._tops, size))

    def differences(self, band: int) -> int:
        """Largest symmetric difference of a similar pair whose larger set is in the band."""
        while len(self._tops) <= band:
            self.band(self._tops[-1] + 1)
        return 2 * self._tops[band] * (self.den - self.num) // (self.den + self.num)

    def spare(self, k: int) -> int:
        return 0 if k == 0 else 1 + (k + 1) // 24

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit signatures of non-empty sets, and for each the place of its set; sets of one band are signed together."""
        sigs, places = [], []
        own = np.array([self.band(len(s)) for s in sets], np.int64)
        for mine in np.unique(own).tolist():
            members = np.flatnonzero(own == mine)
            every = np.concatenate([sets[i] for i in members.tolist()])
            whose = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members.tolist()])
            for band in (mine, mine + 1):
                k = self.differences(band)
                spare = self.spare(k)
                n = k + 1 + spare
                place, elements, of = members, every, whose
                for level in range(LEVELS):
                    seed = np.uint64((band * LEVELS + level + 1) * 2654435761)
                    part = of * n + ((mix(elements + seed) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
                    h = mix(elements ^ seed)
                    low, high = (np.bincount(part, (h >> np.uint64(b)) & np.uint64(0xFFFFFFFF), len(place) * n).astype(np.uint64) for b in (0, 32))
                    total = low + (high << np.uint64(32))
                    some = np.bincount(part, minlength=len(place) * n) > 0
                    last = level == LEVELS - 1
                    take = np.arange(len(some)) if last else np.flatnonzero(some)
                    sigs.append(mix(total[take] + mix((take % n).astype(np.uint64) + seed * np.uint64(977))))
                    places.append(place[take // n])
                    again = n - some.reshape(-1, n).sum(axis=1) > spare
                    if last or not again.any():
                        break
                    stay = again[of]
                    place, elements, of = place[again], elements[stay], (np.cumsum(again) - 1)[of[stay]]
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        return np.concatenate(sigs or none[0]), np.concatenate(places or none[1])


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * den < len(large) * num or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _row(block: int, i: int) -> int:
    # block is partition << 32 | sequence; both are far below the bits left to them
    return ((block >> 32) << 42) | ((block & 0xFFFFF) << ROW_BITS) | i


def _block_of(row: str) -> str:
    return f"shiftleft(shiftright({row}, 42), 32) + (shiftright({row}, {ROW_BITS}) & {0xFFFFF}L)"


def _stats(n: int):
    def finish(block: int, table: pa.Table, _) -> Iterator[pa.Table]:
        words, size, hi, lo = WordHashes(), [], [], []
        for text in B.texts(table):
            s = shingle_set(text, n, words)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            size.append(len(s))
            hi.append((d >> 64) - (1 << 63))
            lo.append((d & (1 << 64) - 1) - (1 << 63))
        yield pa.table({"row": pa.array([_row(block, i) for i in range(len(size))], pa.int64()), "doc_id": table["doc_id"], "n_shingles": pa.array(size, pa.int64()), "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64())})

    return finish


def _per_block(df: DataFrame, to: str, *cols: str) -> DataFrame:
    """Rows of df as one message for the block of `to`; cols are arrays in the order of rows."""
    packed = df.withColumn("block", F.expr(_block_of(to))).groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("m"))
    return packed.select("block", F.lit(0).cast("long").alias("bucket"), F.col("m"))


def _at_blocks(packed: DataFrame, asked: DataFrame, finish, schema: str) -> DataFrame:
    joined = packed.select("block", "blob").join(asked.select("block", "m"), "block")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for out in finish(batch["block"][i].as_py(), B.from_blob(batch["blob"][i].as_py()), batch["m"].slice(i, 1).flatten()):
                    yield from out.to_batches(max_chunksize=2000)
                B.trim()

    return joined.mapInArrow(run, schema)


def _sign(n: int, plan_args: tuple[int, int], buckets: int):
    def finish(block: int, table: pa.Table, owners: pa.StructArray) -> Iterator[pa.Table]:
        plan, words, text = Plan(*plan_args), WordHashes(), B.texts(table)
        mask = (1 << ROW_BITS) - 1
        rows = owners.field("row").to_numpy()
        sig, place = plan.signatures([shingle_set(text[r & mask], n, words) for r in rows.tolist()])
        if not len(sig):
            return
        row = rows[place]
        to = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        parts = [(int(to[order][c]), order[c:d]) for c, d in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        yield pa.table({"block": pa.array([block] * len(parts), pa.int64()), "bucket": pa.array([b for b, _ in parts], pa.int64()), "payload": pa.array([_thin(sig[o], row[o] & mask) for _, o in parts], pa.binary())})

    return finish


def _thin(sig: np.ndarray, row: np.ndarray) -> bytes:
    """Five bytes of each signature, which with the bucket tell signatures apart well enough (pairs are verified), and the row."""
    small = np.uint16 if row.max() < 1 << 16 else np.uint32
    return B.dumps(((sig >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), row.astype(small)))


def _thick(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw, row = B.loads(payload)
    sig = np.zeros((len(row), 8), np.uint8)
    sig[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return sig.view(np.uint64).ravel(), row.astype(np.int64)


def _pairs_of(messages: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each signature that several rows share, its first row in the order of hashes with each of the others; distinct pairs."""
    sig, row = [], []
    for block, payload in messages:
        s, r = _thick(payload)
        sig.append(s)
        row.append(_row(block, 0) + r)
    sig, row = np.concatenate(sig), np.concatenate(row)
    order = np.lexsort((mix(row.view(np.uint64)), sig))
    sig, row = sig[order], row[order]
    fresh = np.concatenate([[True], sig[1:] != sig[:-1]])
    centre = row[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    pairs = np.unique(np.stack([centre, row], axis=1)[centre != row], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _stars(messages: DataFrame) -> DataFrame:
    """(a, b): rows that share a signature as stars; a comes first, in one hashed order, of all rows that share one with both."""

    def run(key, pdf):
        a, b = _pairs_of(list(zip(pdf["block"].tolist(), pdf["payload"], strict=True)))
        return pd.DataFrame({"a": a, "b": b})

    return messages.groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def _verified(packed: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets are similar; a's set travels to b's block, once for each block."""

    def fetch(block: int, table: pa.Table, asked: pa.StructArray) -> Iterator[pa.Table]:
        words, text, mask = WordHashes(), B.texts(table), (1 << ROW_BITS) - 1
        rows, to, sets = [], [], []
        cache: dict[int, bytes] = {}
        for a, target in zip(asked.field("a").to_pylist(), asked.field("to").to_pylist(), strict=True):
            if a not in cache:
                cache[a] = shingle_set(text[a & mask], n, words).tobytes()
            rows.append(a)
            to.append(target)
            sets.append(cache[a])
        yield pa.table({"a": pa.array(rows, pa.int64()), "to": pa.array(to, pa.int64()), "elements": pa.array(sets, pa.binary())})

    def compare(block: int, table: pa.Table, asked: pa.StructArray) -> Iterator[pa.Table]:
        words, text, mask = WordHashes(), B.texts(table), (1 << ROW_BITS) - 1
        own: dict[int, np.ndarray] = {}
        out_a, out_b = [], []
        elements, partners = asked.field("elements"), asked.field("bs")
        for k, a in enumerate(asked.field("a").to_pylist()):
            theirs = np.frombuffer(elements[k].as_py(), np.uint64)
            for b in partners[k].as_py():
                if b not in own:
                    own[b] = shingle_set(text[b & mask], n, words)
                if similar(theirs, own[b], num, den):
                    out_a.append(a)
                    out_b.append(b)
        yield pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    to = F.expr(_block_of("b")).alias("to")
    wanted = B.saved(pairs.select("a", "b", to).groupBy("a", "to").agg(F.collect_list("b").alias("bs")))
    sets = _at_blocks(packed, _per_block(wanted, "a", "a", "to"), fetch, "a long, to long, elements binary")
    ready = sets.join(wanted, ["a", "to"]).groupBy(F.col("to").alias("block")).agg(F.collect_list(F.struct("a", "elements", "bs")).alias("m"))
    found = B.saved(_at_blocks(packed, ready, compare, "a long, b long"))
    B.dropped(wanted)
    return found


def _sketches(packed: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """row, size, bits of the rows' sets: the parity of the elements that fall on each of the sketch's bits.

    The bits in which two sketches differ are never more than the elements in which
    their sets do, so a pair may be dropped by its sketches without loss.
    """

    def finish(block: int, table: pa.Table, asked: pa.StructArray) -> Iterator[pa.Table]:
        words, text, mask = WordHashes(), B.texts(table), (1 << ROW_BITS) - 1
        wanted, size, bits = asked.field("row").to_pylist(), [], []
        for row in wanted:
            s = shingle_set(text[row & mask], n, words)
            size.append(len(s))
            bits.append(sketch(s).tobytes())
        yield pa.table({"row": pa.array(wanted, pa.int64()), "size": pa.array(size, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return _at_blocks(packed, _per_block(rows, "row", "row"), finish, "row long, size long, bits binary")


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities over a power of two of bits, twice the set's size or more; halves laid over each other give a shorter sketch."""
    bits = SKETCH_BITS
    while bits < 2 * len(elements):
        bits *= 2
    odd = np.bincount((mix(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _tiles(stars: DataFrame, parts: DataFrame | None, sketches: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """(lo, hi, m): tiles of bounded size of the stars whose rows are in different components.

    A star's rows hold every pair that shares a signature with its centre first. m holds the
    rows' node, c (component; each its own without parts), size, bits, chunk and no (partners
    that verification refused). With refused pairs (a, b), only rows of the components
    that they lie in take part.
    """
    own = stars.select(F.col("a").alias("gid"), F.col("b").alias("node")).unionByName(stars.select(F.col("a").alias("gid"), F.col("a").alias("node")).distinct())
    if parts is None:
        own = own.withColumn("c", F.col("node"))
    else:
        ends = refused.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(refused.select(F.col("b").alias("node"), F.col("a").alias("other")))
        touched = ends.select("node").distinct().join(parts, "node", "left").select(F.coalesce("component", "node").alias("c")).distinct()
        # rows of touched components: those that links have joined, and refused rows that none has
        linked = parts.join(touched, F.col("component") == F.col("c"), "left_semi").select("node", F.col("component").alias("c"))
        alone = ends.select("node").distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("c"))
        own = own.join(linked.unionByName(alone), "node").select("gid", "node", "c")
    mixed = own.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("k")).where("low < high").select("gid", "k")
    own = own.join(mixed, "gid").join(sketches.withColumnRenamed("row", "node"), "node")
    if refused is None:
        own = own.withColumn("no", F.lit(None).cast("array<long>"))
    else:
        own = own.join(ends.groupBy("node").agg(F.collect_list("other").alias("no")), "node", "left")
    own = own.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, "chunk").alias("lo"), F.greatest(o, "chunk").alias("hi")))).alias("t")
    member = ["node", "c", "size", "bits", "chunk", "no"]
    tiles = own.select("gid", *member, tile)
    return tiles.groupBy("gid", "t").agg(F.collect_list(F.struct(*member)).alias("m")).select("t.lo", "t.hi", "m")


class Tile:
    """Members of a tile: left are those of chunk lo, right those of chunk hi."""

    def __init__(self, lo: int, hi: int, members: pa.StructArray, num: int, den: int) -> None:
        self.node, self.c, self.size, side = (members.field(x).to_numpy() for x in ("node", "c", "size", "chunk"))
        each = [np.frombuffer(x, np.int64) for x in members.field("bits").to_pylist()]
        shortest = min(map(len, each))
        self.bits = np.stack([fold(x, shortest) for x in each]).view(np.uint64)
        self.left, self.right, self.same = np.flatnonzero(side == lo), np.flatnonzero(side == hi), lo == hi
        self.no, self.num, self.den = members.field("no"), num, den

    def pairs(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the left and of the right side that have different labels and, by size and sketch, a chance to be similar; the surest first."""
        step = max(1, (1 << 20) // (self.bits.shape[1] * max(1, len(self.right))))
        _, at, times = np.unique(label, return_inverse=True, return_counts=True)
        # members of the most frequent label need not be compared with each other
        most_frequent = at == times.argmax()
        left = self.left[~most_frequent[self.left]] if self.same else self.left
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        for at in range(0, len(left), step):
            own = left[at : at + step, None]
            most, least = np.maximum(self.size[own], self.size[self.right]), np.minimum(self.size[own], self.size[self.right])
            differ = np.bitwise_count(self.bits[own] ^ self.bits[self.right]).sum(axis=2, dtype=np.int64)
            fits = (label[own] != label[self.right]) & (self.den * least >= self.num * most) & ((self.den + self.num) * differ <= (self.den - self.num) * (most + least))
            if self.same:
                fits &= (own < self.right) | most_frequent[self.right]
            x, y = np.nonzero(fits)
            found.append((own[x, 0], self.right[y], differ[x, y] / (most[x, y] + least[x, y])))
        i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(apart, kind="stable")
        i, j = i[order], j[order]
        taken = {(k, node) for k in np.unique(i).tolist() for node in self.no[k].as_py() or ()}
        if taken:
            fresh = np.array([pair not in taken for pair in zip(i.tolist(), self.node[j].tolist(), strict=True)], bool)
            i, j = i[fresh], j[fresh]
        return i, j


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, roots: dict[int, int]) -> list[int]:
    """Which of the pairs of members connect their labels as far as all pairs can, one less than labels at most.

    roots says which labels other tiles' pairs have connected, and is added to.
    """

    def root(c: int) -> int:
        while (up := roots.get(c, c)) != c:
            roots[c] = roots.get(up, up)
            c = up
        return c

    taken: list[int] = []
    while True:
        known, at = np.unique(label, return_inverse=True)
        label = np.array([root(c) for c in known.tolist()], np.int64)[at]
        apart = np.flatnonzero(label[i] != label[j])
        if not len(apart):
            return taken
        first = np.unique(np.concatenate([label[i[apart]], label[j[apart]]]), return_index=True)[1] % len(apart)
        for e in apart[np.unique(first)].tolist():
            low, high = sorted((root(int(label[i[e]])), root(int(label[j[e]]))))
            if low != high:
                roots[high] = low
                taken.append(e)


def _forests(tiles: DataFrame, num: int, den: int, times: int) -> DataFrame:
    """(a, b), a < b: the pairs of `times` forests over the tiles of each task, no pair in two of them for one tile."""

    def run(batches):
        connected: list[dict[int, int]] = [{} for _ in range(times)]
        for batch in batches:
            for t in range(batch.num_rows):
                tile = Tile(batch["lo"][t].as_py(), batch["hi"][t].as_py(), batch["m"].slice(t, 1).flatten(), num, den)
                i, j = tile.pairs(tile.c)
                named = []
                for roots in connected:
                    if named and not len(i):
                        break
                    taken = _forest(tile.c, i, j, roots)
                    named.append((tile.node[i[taken]], tile.node[j[taken]]))
                    i, j = np.delete(i, taken), np.delete(j, taken)
                a, b = (np.concatenate(x) for x in zip(*named, strict=True))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _every(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all possible pairs of members in different components, a < b, once."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tile = Tile(batch["lo"][i].as_py(), batch["hi"][i].as_py(), batch["m"].slice(i, 1).flatten(), num, den)
                a, b = (tile.node[x] for x in tile.pairs(tile.c))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _grouped(packed: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the packed documents with their class, stars of class owners that share a signature, and the owners' sketches.

    The first frame has row, doc_id, n_shingles and owner, the row that stands for all
    rows with the same set (null for an empty one).
    """
    none = packed.sparkSession.createDataFrame([], B.MESSAGE)
    rows = B.saved(B.gather(packed, none, _stats(words), "row long, doc_id long, n_shingles long, hi long, lo long"))
    owners = B.saved(rows.where("n_shingles > 0").groupBy("n_shingles", "hi", "lo").agg(F.min("row").alias("owner")))
    asked = _per_block(owners.select(F.col("owner").alias("row")), "row", "row")
    signed = _at_blocks(packed, asked, _sign(words, (num, den), B.bucket_count(packed)), B.MESSAGE)
    stars = B.saved(_stars(signed))
    sketches = B.saved(_sketches(packed, stars.select(F.explode(F.array("a", "b")).alias("row")).distinct(), words))
    owned = rows.join(owners, ["n_shingles", "hi", "lo"], "left").select("row", "doc_id", "n_shingles", "owner")
    return owned, stars, sketches


def classes(packed: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the packed documents with their class, and (node, component) of the owners that link with another.

    The first frame is that of _grouped. Links are verified as far as components need, by
    forests of possible pairs over the stars. A forest whose pairs are all similar leaves
    nothing to compare; where some were refused, the components they lie in are met again
    without the refused pairs, by more forests at a time, until none is refused.
    """
    rows, stars, sketches = _grouped(packed, words, num, den)
    parts, refused, times = None, None, 2
    while True:
        named = B.saved(_forests(_tiles(stars, parts, sketches, refused), num, den, times))
        if named.isEmpty() and parts is not None:
            break
        found = _verified(packed, named, words, num, den)
        failed = named.join(found, ["a", "b"], "left_anti")
        # stars of the components so far, and the new links
        old = [] if parts is None else [parts.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        parts = connected_components(functools.reduce(DataFrame.unionByName, old, found))
        refused = B.saved(failed if refused is None else failed.unionByName(refused))
        B.dropped(named, found)
        if refused.isEmpty():
            break
        times *= 8
    B.dropped(stars, sketches)
    return rows, parts


def class_links(packed: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows as in classes, and every link (a, b) of class owners: each possible pair that shares a star is verified, a < b, once."""
    rows, stars, sketches = _grouped(packed, words, num, den)
    pairs = B.saved(_every(_tiles(stars, None, sketches), num, den))
    links = _verified(packed, pairs, words, num, den)
    B.dropped(stars, sketches, pairs)
    return rows, links


def _components(packed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """row, doc_id, n_shingles and part, the owner row that names the component (null for empty sets)."""
    rows, parts = classes(packed, words, num, den)
    parts = parts.withColumnRenamed("node", "owner")
    return rows.join(parts, "owner", "left").withColumn("part", F.coalesce("component", "owner")).select("row", "doc_id", "n_shingles", "part")


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    tagged = _components(B.pack(docs.select("doc_id", "text")), words, num, den)
    lowest = tagged.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("low"))
    return tagged.join(lowest, "part", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def link_counts(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs.

    n_links is the number of other rows whose sets are similar, equal ones included.
    """
    rows, links = class_links(B.pack(docs.select("doc_id", "text")), words, num, den)
    sizes = B.saved(rows.where("owner is not null").groupBy("owner").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("owner").alias("b"), "n"), "b").groupBy(F.col("a").alias("owner")).agg(F.sum("n").alias("others"))
    parts = connected_components(links).withColumnRenamed("node", "owner")
    owners = sizes.join(others, "owner", "left").join(parts, "owner", "left").withColumn("part", F.coalesce("component", "owner"))
    owners = B.saved(owners.select("owner", "part", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    lowest = owners.groupBy("part").agg(F.min("low").alias("lowest"))
    owners = owners.join(lowest, "part").select("owner", "lowest", "n_links")
    return rows.join(owners, "owner", "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with its columns, one row of each component: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays; a null doc_id comes after all others.
    Documents without words all stay.
    """
    packed = B.pack(docs)
    tagged = _components(packed, words, num, den).where("part is not null")
    first = tagged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
    gone = tagged.join(first.where("n > 1"), "part").where("row <> first.row").select("row")
    per_block = _per_block(gone, "row", "row")
    joined = packed.select("block", "blob").join(per_block.select("block", F.col("m.row").alias("gone")), "block", "left")

    def run(batches):
        for batch in batches:
            for blob, out in zip(batch["blob"], batch["gone"], strict=True):
                table = B.from_blob(blob.as_py())
                keep = np.ones(table.num_rows, bool)
                keep[[r & (1 << ROW_BITS) - 1 for r in out.as_py() or []]] = False
                yield from table.filter(pa.array(keep)).to_batches(max_chunksize=2000)

    return joined.mapInArrow(run, docs.schema)
