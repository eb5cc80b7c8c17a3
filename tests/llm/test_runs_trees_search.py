import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import blocks, lexical_search, periodic_runs, suffix_trees
from sensorloom.llm.queries import _with_planted_repeats

SCHEMA = "doc_id long, text string, start string, low int, n_chars long, words string, score string"


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, None, None, "y") for i, t in rows], SCHEMA)


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def words_of(t):
    return [w for w in re.split("[ \t-\r]+", t or "") if w]


# --- periodic runs --------------------------------------------------------------------------------


def all_runs(s, least, exponent):
    """Every run, tried period by period."""
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(s[k] == s[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_words(r, most=70):
    s = []
    k = r.choice([1, 2, 2, 3, 6])
    for _ in range(r.randint(0, 8)):
        s += [f"w{r.randrange(k)}" for _ in range(r.randint(1, 7))] * r.choice([1, 1, 2, 5, 9])
    return s[: r.randint(0, most)]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_match_brute_force(least, exponent):
    r = random.Random(least)
    lists = [periodic_words(r) for _ in range(400)]
    got = list(periodic_runs.runs_of([" ".join(s).encode() for s in lists], least, exponent))
    assert [g for _, g in got] == [all_runs(s, least, exponent) for s in lists]


def test_seeds_are_primitive_squares_in_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs.piece_runs(np.frombuffer(b.encode(), np.uint8), 2, 2) == all_runs(b, 2, 2)


def test_ordered_sets_split():
    r = random.Random(3)
    xs = r.sample(range(10**6), 5000)
    held = periodic_runs.Ends(xs[0])
    for x in xs[1:]:
        held.add(x)
    want = sorted(xs)
    assert list(held) == want and len(held.parts) > 2
    for x in r.sample(range(10**6), 300):
        if x not in want:
            before, after = held.around(x)
            assert before == max([w for w in want if w < x], default=-(1 << 60)) and after == min([w for w in want if w > x], default=1 << 60)


def test_run_report(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a a a a a a", "a a a a a", "x a b a b a b a b a y", "a b a b a b", "A a " * 8] + [" ".join(periodic_words(r)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[5])]
    got = sorted(map(tuple, periodic_runs.report(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = words_of(t)
        runs = all_runs(w, 6, 4)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = (None,) * 4 if top is None else (top[0], top[1], top[2], 1000 * top[1] // top[2])
        want.append((i, len(runs), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha([x for k, x in enumerate(w) if k not in gone])))
    assert got == sorted(want, key=str)
    assert periodic_runs.report(frame(spark, [])).count() == 0 and periodic_runs.runs(frame(spark, [])).count() == 0


def test_runs_and_collapse(spark):
    docs = frame(spark, [(1, "x  a b a b a b a b a y"), (2, None), (3, "keep  these   blanks"), (None, "z z z z z z")])
    assert sorted(map(tuple, periodic_runs.runs(docs).collect()), key=str) == [(1, 1, 9, 2), (None, 0, 6, 1)]
    out = {r["doc_id"]: r for r in periodic_runs.collapse(docs).collect()}
    assert [out[i]["text"] for i in (1, 2, 3, None)] == ["x a b y", None, "keep  these   blanks", "z"]
    assert out[1]["n_chars"] == 7 and out[1]["low"] == 1 and periodic_runs.collapse(docs).columns == docs.columns


def test_planted_repeats(spark):
    rows = [(i, " ".join(f"v{(i * k) % 97}" for k in range(i % 50))) for i in range(120)] + [(None, "a b"), (7, None)]
    got = {(r["doc_id"], r["text"]) for r in _with_planted_repeats(frame(spark, rows)).collect()}
    import zlib

    want = set()
    for i, t in rows:
        w = words_of(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))
        want.add((i, t))
    assert got == want


def test_long_texts_of_few_words():
    began = time.perf_counter()
    for s in (["a"] * 300_000, [f"x{i % 3000}" for i in range(60_000)], random.Random(1).choices("ab", k=60_000)):
        (_, runs), *_ = periodic_runs.runs_of([" ".join(s).encode()])
        assert runs
    assert time.perf_counter() - began < 60


# --- suffix trees ---------------------------------------------------------------------------------


def without_repeats(rows, length):
    first = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        out.append((i, len(w), len(gone), sha([x for j, x in enumerate(w) if j not in gone])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeating():
    r = random.Random(7)
    pool = [f"w{i}" for i in range(400)]
    passages = [r.choices(pool, k=n) for n in (10, 20, 25, 60, 200)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choices(pool, k=r.randint(0, 40)) if r.random() < 0.5 else r.choice(passages)[r.randint(0, 5) :]
        rows.append((i, "  ".join(w) if i % 7 else "\n".join(w)))
    rows += [(i, " ".join(passages[4] + [f"u{i}"])) for i in range(200, 230)]  # one passage in many documents
    rows += [(500 + i, "tick tock " * 60 + f"e{i}") for i in range(8)]
    return rows + [(3, rows[3][1]), (4, rows[12][1]), (None, rows[12][1]), (None, rows[3][1]), (900, None), (901, ""), (902, " \t "), (903, "é " * 40), (904, "é " * 41)]


@pytest.mark.parametrize("length", [8, 20])
def test_removal_matches_brute_force(spark, repeating, length):
    got = sorted(map(tuple, suffix_trees.report(frame(spark, repeating), length).collect()), key=str)
    want = without_repeats(repeating, length)
    assert got == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("limit", [1, 6])
def test_crowded_prefixes_grow_longer(spark, repeating, monkeypatch, limit):
    monkeypatch.setattr(suffix_trees, "LIMIT", limit)
    monkeypatch.setattr(suffix_trees, "GROUP", 3000)
    got = sorted(map(tuple, suffix_trees.report(frame(spark, repeating), 20).collect()), key=str)
    assert got == without_repeats(repeating, 20)


def test_texts_beyond_a_chunk(monkeypatch):
    monkeypatch.setattr(suffix_trees, "CHUNK", 64)
    monkeypatch.setattr(suffix_trees, "PIECE_BYTES", 200)
    r = random.Random(2)
    w = [f"w{r.randrange(50)}" for _ in range(1000)]
    words = suffix_trees.Words([" ".join(w[:600]).encode(), b"", "\t".join(w[600:]).encode()])
    assert words.n == 1000 and words.cut(598, 602).decode().split() == w[598:602] and words.first.tolist() == [0, 600, 600, 1000]
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(set(w)) and all(hashes[i] == hashes[w.index(x)] for i, x in enumerate(w))
    owner, start, count, at, _ = suffix_trees.stretches(words, 20)
    covered = [p for s, n in zip(start, count, strict=True) for p in range(s, s + n)]
    assert covered == [*range(581), *range(600, 981)] and set(owner.tolist()) == {0, 2}
    assert all(s + n - 1 <= a <= s + 20 - suffix_trees.GRAM for s, n, a in zip(start, count, at, strict=True))


def test_tree_nodes_are_maximal_repeats():
    r = random.Random(4)
    seqs = [np.array([r.randrange(3) for _ in range(r.randint(1, 30))]) for _ in range(8)]
    starts = np.cumsum([0] + [len(s) + 1 for s in seqs[:-1]])
    keep = np.concatenate([np.arange(len(s)) + b for s, b in zip(seqs, starts, strict=True)])
    tree = suffix_trees.Suffixes(seqs, keep, 64)
    suffix = {int(b + i): tuple(s[i:]) for s, b in zip(seqs, starts, strict=True) for i in range(len(s))}
    got = Counter()
    for depth, i, j, _ in tree.deep_nodes(3):
        below = [suffix[p] for p in tree.order[i : j + 1].tolist()]
        got[below[0][:depth]] = len(below)
        assert len({x[:depth] for x in below}) == 1
    want = Counter()
    for v in suffix.values():
        for d in range(3, len(v) + 1):
            want[v[:d]] += 1
    right = {p: n for p, n in want.items() if n > 1 and all(want[p + (c,)] < n for c in range(3))}
    assert dict(got) == right


def test_dedup_keeps_columns_and_other_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = frame(spark, [(1, passage), (2, f"a  b {passage}  c"), (3, "x  y"), (4, None), (None, passage)])
    out = {r["doc_id"]: r for r in suffix_trees.dedup(docs).collect()}
    assert [out[i]["text"] for i in (1, 2, 3, 4, None)] == [passage, "a b c", "x  y", None, passage]
    assert out[2]["n_chars"] == 5 and suffix_trees.dedup(docs).columns == docs.columns
    assert suffix_trees.report(frame(spark, [])).count() == 0


# --- ranked search --------------------------------------------------------------------------------


def terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in counted if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    r = random.Random(9)
    pool = [f"t{i}" for i in range(60)] + ["É", "über", "Ab-c", "don't"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, " ".join(r.choices(pool, weights, k=r.randint(0, 60)))) for i in range(400)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[9][1]), (None, docs[9][1]), (600, None), (601, ""), (602, "... --"), (603, "t1 " * 3000)]
    items = [(i, " ".join(r.choices(pool, k=r.randint(1, 12)))) for i in range(30)] + [(3, "t1 t2 T2"), (None, "t3"), (40, None), (41, "unheard of"), (42, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("shard_terms", [500, 10**6])
def test_search_matches_brute_force(spark, library, shard_terms):
    docs, items = library
    shards = lexical_search.index(frame(spark, docs).repartition(3), shard_terms)
    got = sorted(map(tuple, lexical_search.search(shards, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(docs, items)
    blocks.dropped(shards)


def test_search_in_blocks_of_queries(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical_search, "ITEMS", 12)
    shards = lexical_search.index(frame(spark, docs))
    got = sorted(map(tuple, lexical_search.search(shards, spark.createDataFrame(items, "item_id long, text string"), 3).collect()), key=str)
    assert got == ranked(docs, items, 3)


def test_search_of_nothing(spark, library):
    docs, items = library
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(frame(spark, docs[:5])), none).count() == 0
    assert lexical_search.search(lexical_search.index(frame(spark, [])), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_block_cuts_are_the_cheapest():
    r = random.Random(2)
    for _ in range(60):
        lists = [[r.randint(0, 30) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 4))]
        sizes = np.array([len(x) for x in lists])
        cuts = lexical_search.cut_blocks(np.array(sum(lists, [])), np.cumsum(sizes) - sizes, sizes, longest=5, price=2.0)
        for x, c in zip(lists, cuts, strict=True):
            x = np.array(x, float)
            price = 2.0 * np.abs(x - x.mean()).mean() + 1
            cost = lambda a, b: (b - a) * x[a:b].max() - x[a:b].sum() + price  # noqa: B023, E731
            best = [0.0]
            for j in range(1, len(x) + 1):
                best.append(min(best[i] + cost(i, j) for i in range(max(0, j - 5), j)))
            ends = [*c.tolist(), len(x)]
            assert math.isclose(sum(cost(a, b) for a, b in zip(ends, ends[1:], strict=False)), best[-1])


def test_blocks_are_skipped():
    """Most ranges of a long list of common words are passed over once rare words have set the threshold."""
    r = np.random.default_rng(1)
    lists = []
    for share, weight in ((0.5, 100), (0.4, 200), (0.01, 4000), (0.005, 5000)):
        docs = np.flatnonzero(r.random(20_000) < share).astype(np.int32)
        values = r.integers(400_000, 600_000, len(docs))
        cuts = lexical_search.cut_blocks(values, np.zeros(1, np.int64), np.array([len(docs)]))[0]
        lists.append((weight, lexical_search.Postings(docs, values, cuts)))
    best, scored = lexical_search.best_of(lists, 20_000, 10)
    full = np.zeros(20_000, np.int64)
    for w, p in lists:
        full[p.docs] += w * p.values
    order = np.lexsort((np.arange(20_000), -full))[:10]
    assert best == [(int(full[d]), int(d)) for d in order]
    ranges = len(np.unique(np.concatenate([p.ends for _, p in lists])))
    assert scored < ranges / 3


def test_terms_match_the_pattern(spark):
    text = "".join(map(chr, range(1, 300))) + "ÄÖ ß½ \U0001f600x"
    assert [t.decode() for t in lexical_search.terms(text.encode())] == terms(text)
