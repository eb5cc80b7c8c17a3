"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

For every item length, the windows of that many words in which a document shares a
word shingle with an item of that length get a 64-bit SimHash of their shingles (a
window similar enough shares one, so none is lost). A multi-index over the items'
fingerprints, cut into radius + 1 blocks, finds every window within `radius` bits of an
item: two fingerprints that differ in no more bits agree on a block. Each such pair is
verified by the weighted Jaccard similarity of its shingles (weights: occurrences).

Only windows, candidate pairs and items move; texts stay in their scan except for the
documents that share a shingle with an item. The items' shingles and the keys of those
documents are broadcast when there are no more than `broadcast_rows`, else joined by hash.

Defined cases: null or blank text has no windows; a document shorter than an item is one
window; items with fewer words than a shingle are one shingle; items without words
match nothing; equal rows count once; ties for the best window go to the earliest; a null
item_id is an id like any other; of several texts of one id each is compared alone, and the
windows that match any of them are reported together. Windows of similarity `similarity`
whose fingerprints differ in more than `radius` bits are missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import saved

LANES = 16
_ONES = 0x0001000100010001


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.filter(F.split(F.translate(text, upper, lower), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: str, n: str) -> str:
    """SQL: hashes of the n-word shingles of an array of words, in order; n is at most its size."""
    return f"transform(sequence(0, size({words}) - {n}), i -> xxhash64(concat_ws(' ', slice({words}, i + 1, {n}))))"


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """item_key, item_id, length, width (words to a shingle), hashes; items without words are left out.

    item_key tells id and words apart, so null ids and several texts of one id are items of their own.
    """
    cut = items.select("item_id", words_of(F.coalesce("text", F.lit(""))).alias("w")).where("size(w) > 0").distinct()
    cut = cut.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "w").alias("item_key"), "item_id", "w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(n)).alias("width"))
    return cut.select("item_key", "item_id", "length", "width", F.expr(shingle_hashes("w", "width")).alias("hashes"))


def lane_sums(h: str) -> list[Column]:
    """Sixteen sums of four 16-bit lanes that count the set bits of the hashes."""
    return [F.sum(F.expr(f"shiftrightunsigned({h}, {j}) & {_ONES}L")).alias(f"s{j}") for j in range(LANES)]


def fingerprint(count: str) -> Column:
    """The 64 majority bits of the lane sums s0..s15 over count hashes; a tie is 0."""
    bits = [f"if(((shiftrightunsigned(s{j}, {16 * q})) & 65535L) * 2 > {count}, shiftleft(1L, {j + 16 * q}), 0L)" for j in range(LANES) for q in range(4)]
    return F.expr(" + ".join(bits))


def block_keys(fp: str, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks, each with its number."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    keys = [f"shiftleft({i}L, 40) + (shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.expr(f"array({', '.join(keys)})")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint where its rows are few enough, counted here."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def matches(docs: DataFrame, items: DataFrame, n: int = 5, similarity: float = 0.8, radius: int = 20, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, best_start (0-based word), best_similarity.

    One row for each document and item of which some window is similar enough.
    """
    bench = saved(item_shingles(items, n))
    spread = bench.select("item_key", "item_id", "length", "width", F.explode("hashes").alias("h"))
    by_hash = _small(saved(spread.select("h", "length", "width").distinct()), broadcast_rows)
    widths = sorted(r[0] for r in bench.select("width").distinct().collect()) or [n]
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    texts = docs.select(key.alias("key"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own = texts.select("key", words_of("text").alias("w")).where("size(w) > 0")
    hits = None
    for width in widths:
        zipped = F.arrays_zip(*[F.expr(f"slice(w, {i + 1}, size(w) - {width - 1})").alias(f"w{i}") for i in range(width)])
        at = own.where(f"size(w) >= {width}").select("key", F.size("w").alias("size"), F.posexplode(zipped).alias("pos", "z"))
        h = F.xxhash64(F.concat_ws(" ", *[f"z.w{i}" for i in range(width)]))
        found = at.select("key", "size", "pos", h.alias("h")).join(by_hash.where(F.col("width") == width), "h")
        hits = found if hits is None else hits.unionByName(found)
    first = "greatest(0, pos - (length - width))"
    last = "greatest(0, least(pos, size - length))"
    starts = hits.select("key", "length", "width", F.expr(f"explode(sequence(least({first}, {last}), {last}))").alias("start"))
    starts = saved(starts.distinct())
    # documents with hits, each once, as shingle hashes of each width that is needed
    wanted = _small(saved(starts.select("key", "width").distinct()), broadcast_rows)
    hit_docs = texts.join(wanted, "key").withColumn("w", words_of("text")).dropDuplicates(["key", "width"])
    hit_docs = saved(hit_docs.select("key", "doc_id", "text_hash", "width", F.expr(shingle_hashes("w", "width")).alias("hashes")))
    window = F.slice("hashes", F.col("start") + 1, F.col("length") - F.col("width") + 1)
    group = ["key", "length", "width", "start"]
    cut = starts.join(hit_docs, ["key", "width"]).select(*group, F.explode(window).alias("h"))
    counted = cut.groupBy(*group).agg(*lane_sums("h"), F.count("*").alias("m"))
    windows = saved(counted.select(*group, "m", fingerprint("m").alias("fp")))
    index = spread.groupBy("item_key", "item_id", "length").agg(*lane_sums("h"), F.count("*").alias("im")).select("item_key", "item_id", "length", "im", fingerprint("im").alias("item_fp"))
    index = _small(saved(index.select("item_key", "item_id", "length", "im", "item_fp", F.explode(block_keys("item_fp", radius)).alias("block"))), broadcast_rows)
    near = windows.select(*group, "m", "fp", F.explode(block_keys("fp", radius)).alias("block")).join(index, ["length", "block"])
    pair = [*group, "m", "item_key", "item_id", "im"]
    pairs = saved(near.where(f"bit_count(fp ^ item_fp) <= {radius}").select(*pair).distinct())
    shared = pairs.join(hit_docs, ["key", "width"]).select(*pair, F.explode(window).alias("h")).groupBy(*pair, "h").agg(F.count("*").alias("c"))
    item_counts = _small(saved(spread.groupBy("item_key", "length", "h").agg(F.count("*").alias("ic"))), broadcast_rows)
    both = shared.join(item_counts, ["item_key", "length", "h"]).groupBy(*pair).agg(F.sum(F.least("c", "ic")).alias("common"))
    scored = both.withColumn("similarity", F.col("common") / (F.col("m") + F.col("im") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("key", "item_id").agg(
        F.countDistinct("start").alias("n_windows"),
        F.expr("min(struct(-similarity as s, start)).start").cast("long").alias("best_start"),
        F.round(F.max("similarity"), 6).alias("best_similarity"),
    )
    names = hit_docs.select("key", "doc_id", "text_hash").distinct()
    return best.join(names, "key").select("doc_id", "text_hash", "item_id", "n_windows", "best_start", "best_similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents of which a window matches an item; their columns as they were."""
    found = matches(docs, items, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
