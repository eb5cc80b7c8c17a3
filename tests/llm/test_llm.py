import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import blocks, collision_ann, context_tree, decontaminate, graph, jaccard_join, language_id, line_dedup, mixing, pii, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string"
WORDS = "alpha beta gamma delta omega sigma kappa zeta theta lambda mu nu xi pi rho tau".split()


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    texts = [" ".join(base), " ".join(near), " ".join(base), "Same Line\n" + " ".join(words(40, 2)), "same line \n\n" + " ".join(words(300, 3)), None, "", "   \n\t", "one", "one", "two words",
             "café " + " ".join(words(30, 4)), " ".join(words(3000, 5)), "1234 5678"]
    return [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "clash") for i, t in enumerate(texts)] + [(0, " ".join(base), "en", "s", 1, None), (None, " ".join(words(50, 6)), None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(s):
    return [w for w in re.split(r"[ \t-\r]+", low(s or "")) if w]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines(docs, corpus, empty):
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.Counter(k for _, t, *_ in corpus for k in {strip(x) for x in (t or "").split("\n")})
    want = []
    for i, t, *_ in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not strip(x) or held[strip(x)] < 2]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert rows_of(line_dedup.line_report(docs, 2)) == sorted(want, key=str)
    assert line_dedup.line_report(empty, 2).count() == 0 and line_dedup.dedup_lines(docs, 2).columns == docs.columns


def test_lines_are_reversible(docs):
    index = line_dedup.LineIndex(None, 3, 2)
    first, rest = docs.where("doc_id < 4"), docs.where("doc_id >= 4")
    once = index.insert(first)
    back = once.insert(rest).delete(rest)
    table = lambda i: sorted((r.bucket, sorted(zip(map(tuple, line_dedup.as_pairs(bytes(r.digests)).tolist()), np.frombuffer(r.refs, np.int64).tolist(), strict=True))) for r in i.state.collect() if r.refs)
    assert table(once) == table(back)
    for r in back.state.collect():
        d, n = line_dedup.as_pairs(bytes(r.digests)), np.frombuffer(r.refs, np.int64)
        assert line_dedup.CuckooFilter.from_bytes(bytes(r.filter)).holds(d[n >= 2]).all()


def test_cuckoo_filter():
    d = np.random.default_rng(0).integers(0, 1 << 63, (2000, 2), dtype=np.uint64)
    f = line_dedup.CuckooFilter(3000)
    assert f.add(d[:1000]) and f.holds(d[:1000]).all() and f.holds(d[1000:]).mean() < 0.01
    f.discard(d[:500])
    assert f.holds(d[500:1000]).all() and f.holds(d[:500]).mean() < 0.01


def brute_components(corpus, n, num, den):
    sets = []
    for _, t, *_ in corpus:
        w = split(t)
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    part = list(range(len(corpus)))
    for _ in corpus:
        for a, s in enumerate(sets):
            for b, u in enumerate(sets):
                if s and u and den * len(s & u) >= num * len(s | u):
                    part[a] = part[b] = min(part[a], part[b])
    out = []
    for i, (d, *_) in enumerate(corpus):
        ids = [corpus[j][0] for j in range(len(corpus)) if part[j] == part[i] and corpus[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_jaccard_join(docs, corpus, empty):
    assert rows_of(jaccard_join.components(docs, 4, 85, 100)) == brute_components(corpus, 4, 85, 100)
    assert jaccard_join.components(empty).count() == 0
    kept = jaccard_join.drop_copies(docs, 4, 85, 100)
    assert kept.columns == docs.columns and kept.where("text = 'one'").count() == 1 and kept.where("text is null").count() == 1


def test_jaccard_links(spark, docs, corpus, empty, monkeypatch):
    """Every link inside a component is found and weighs the class's rows, over several tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base = words(120, 40)
    texts = [" ".join([*base[: 4 * i], f"new{i}", *base[4 * i + 1 :]]) for i in range(30)] + [" ".join(base)] * 3
    texts += [" ".join([*base[:30], *words(6, 41), *base[36:]]), " ".join(words(50, 42)), None]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    grams = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for _, t in rows for w in [split(t)]]
    want = {}
    for i, (d, _) in enumerate(rows):
        want[d] = sum(1 for j, s in enumerate(grams) if j != i and s and 100 * len(s & grams[i]) >= 85 * len(s | grams[i]))
    got = jaccard_join.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: r.n_links for r in got} == want and sum(want.values()) > 2 * len(rows) * 10
    counted = jaccard_join.link_counts(docs, 4, 85, 100)
    assert rows_of(counted.drop("n_links")) == brute_components(corpus, 4, 85, 100) and jaccard_join.link_counts(empty).count() == 0


def test_partenum_signatures_meet():
    plan, rng = jaccard_join.Plan(85, 100), np.random.default_rng(2)
    for size in [*range(1, 60), 200, 900]:
        a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        for _ in range(5):
            b = a.copy()
            while True:
                c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 62, dtype=np.uint64)))
                if not jaccard_join.similar(a, c, 85, 100):
                    break
                b = c
            assert len(np.intersect1d(plan.signatures([a])[0], plan.signatures([b])[0]))
            p, q = jaccard_join.sketch(a), jaccard_join.sketch(b)
            p, q = (jaccard_join.fold(x, min(len(p), len(q))) for x in (p, q))
            assert np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_decontamination(spark, docs, empty):
    item = words(30, 9)
    close = item[:28] + ["other", "words"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "two words"), (4, "")], "item_id long, text string")
    extra = spark.createDataFrame([(50, " ".join(words(80, 10) + item + words(9, 11))), (51, " ".join(words(20, 12) + close)), (52, " ".join(item[:12]))], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra).unionByName(extra.limit(1))
    got = {(r.doc_id, r.item_id): r.best_similarity for r in decontaminate.matches(every, bench).collect()}
    assert got[50, 1] == 1.0 and got[51, 1] >= 0.8 and got[10, 3] == 1.0 and (52, 1) not in got and len(got) == 3
    assert {r.doc_id for r in decontaminate.drop_contaminated(every, bench).collect()} == {r.doc_id for r in every.collect()} - {50, 51, 10}
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_by_item_row(spark):
    """A null id and two texts of one length under one id match each on its own."""
    a, b, c = (" ".join(words(20, 70 + i)) for i in range(3))
    bench = spark.createDataFrame([(None, a), (7, b), (7, c)], "item_id long, text string")
    every = spark.createDataFrame([(1, "x y " + a), (2, b + " z"), (3, c), (4, " ".join(words(20, 79)))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.best_start, r.best_similarity) for r in decontaminate.matches(every, bench).collect()}
    assert set(got) == {(1, None), (2, 7), (3, 7)} and all(s == 1.0 for *_, s in got.values()) and got[1, None][1] == 2
    assert [r.doc_id for r in decontaminate.drop_contaminated(every, bench).collect()] == [4]


def test_mixing(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"), F.lit("t").alias("copy"))
    out = mixing.mix(many, {"rare": 0.5}).groupBy("source").count().collect()
    assert {r.source: round(r["count"] / 4000, 1) for r in out} == {"rare": 0.5, "common": 0.5}
    got = mixing.mix(many, seed=3)
    assert "copies" in got.columns and rows_of(got) == rows_of(mixing.mix(many, seed=3))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).where("source is null").count() >= 0


def test_mixing_by_weights(spark):
    """Zero weights, negative ones, sources beyond the broadcast limit, clashing names."""
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    named = many.where("source is not null")
    assert mixing.mix(named, {f"s{i}": 0.0 for i in range(7)}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(many, {"s1": -1.0})
    assert rows_of(mixing.mix(many, broadcast_sources=2)) == rows_of(mixing.mix(many))
    assert mixing.mix(many.withColumn("rate", F.lit(5))).where("rate <> 5").count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<title>T &amp; x</title><script>var t="<p>"</script><p>Hi&nbsp;<b>you</b></p><a href="/l">z</a>'), (2, None, None)], "page_id long, url string, html string")
    out = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses_from_pages(pages)).collect()}
    text, meta = out[1, "conversion"], out[1, "metadata"]
    assert text.block == "T & x\nHi you\nz" and "outlink: /l" in meta.block and text.refers_to == meta.refers_to and text.record_id != meta.record_id
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest() and out[2, "conversion"].block == ""
    assert "WARC-Target-URI" not in out[2, "conversion"].headers and f"WARC-Refers-To: <{text.refers_to}>" in text.headers


def test_warc_text():
    assert warc.plain_text("caf&eacute; &#8217;x&#x41; &lt;b&gt; &amp;lt; a<!-- <p> -->b<STYLE>p{}</style >c<p>d</p>e < f") == "caf\u00e9 \u2019xA <b> &lt; a b c d\ne < f"
    assert warc.plain_text("a<script>no end <b>c</b>") == "a no end c" and warc.plain_text("x<!-- no end") == "x<!-- no end" and warc.plain_text("") == ""
    assert warc.page_title("<Title a=1>T &amp;\n x</TITLE >") == "T & x" and warc.page_title("<title>no end") == ""
    assert warc.page_links('<a href="/1?a&amp;b">x</a><a name=x><A class="c" HREF = "/2">y<a href="no end') == ["/1?a&b", "/2"]


@pytest.mark.parametrize("page", ["<" * 1_000_000, "<script>" * 100_000, "<!--" * 200_000, "<a " * 300_000, "<title>" * 100_000, "<a href=\"" * 100_000, "&" * 500_000])
def test_warc_is_linear(page):
    began = time.perf_counter()
    warc.plain_text(page), warc.page_title(page), warc.page_links(page)
    assert time.perf_counter() - began < 10


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one\r\n\r\ntwo &eacute;</p>"), (1, "http://a/", "<p>one</p>"), (2, "http://b/\nx", ""), (3, None, None)], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    derived = warc.derive(warc.responses_from_pages(pages)).cache()
    assert derived.where("instr(headers, 'WARC-Target-URI: http://b/%0Ax') > 0").count() == 2
    warc.write_records(derived, str(tmp_path / "out"))
    back = warc.read_records(spark, str(tmp_path / "out")).collect()
    assert sorted((r.headers, r.block) for r in back) == sorted((r.headers, r.block) for r in derived.collect()) and all(r.complete for r in back)
    text = "".join(f"WARC/1.1\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{i}>\r\nWARC-Target-URI: http://c/{i}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {size or len(block.encode())}\r\n\r\n{block}\r\n\r\n"
                   for i, (kind, block, size) in enumerate([("warcinfo", "software: x\r\n", 0), ("response", "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<title>\u00e9</title>", 0), ("response", "HTTP/1.1 204 No\r\n\r\n", 0), ("response", "HTTP/1.1 200 OK\r\n\r\ncut", 99)]))
    (tmp_path / "in.warc").write_bytes(text.encode())
    got = {r.record_id: r for r in warc.read_responses(spark, str(tmp_path / "in.warc")).collect()}
    assert set(got) == {"urn:uuid:1", "urn:uuid:2"} and got["urn:uuid:1"].payload == "<title>\u00e9</title>" and got["urn:uuid:2"].payload == ""
    meta = warc.derive(warc.read_responses(spark, str(tmp_path / "in.warc"))).where("record_type = 'metadata'").collect()
    assert {r.refers_to for r in meta} == set(got) and any("source-header: X: y" in r.block and "title: \u00e9" in r.block for r in meta)
    assert warc.derive(warc.responses_from_pages(pages.limit(0))).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (name, p) in enumerate(PII.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (name != "ip" or all(int(x) < 256 for x in m.group().split("."))) and (name != "card" or (12 <= len(d) <= 19 and luhn(d))) and (name != "phone" or 9 <= len(d) <= 15):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_pii(spark, docs, empty):
    texts = ["a@b.c_d@e.f x@y.z 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 +1 (234) 567-8901. +12", "é\U0001f600 bob@x.de", "..@a.b@c.d %@-.-", "+++1 234567890 +49 (0)30 1234567", "call (555) 123-4567", None, ""]
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(mine).collect():
        want = brute_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.report(docs).count() == docs.count() and pii.report(empty).count() == 0


@pytest.mark.parametrize("text", ["1" * 300_000 + ".", "1." * 150_000, "+1" + "(" * 300_000, "a" * 300_000 + "@", "1 " * 150_000])
def test_pii_is_linear(spark, text):
    began = time.perf_counter()
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
    assert time.perf_counter() - began < 30


def test_pii_loose_spans(spark):
    """Written-out mail addresses and national phone numbers come out beside the base spans."""
    texts = [f"write to user{i}@site{i}.org or call +1 555 {200 + i} {4000 + i}" for i in range(40)]
    texts += [f"release {i}.300.1.2 of serial +99 {i + 10}000000" for i in range(40)]
    loose = [f"mail bob{i} [at] x{i} [dot] com, call (555) 123-4{100 + i}" for i in range(20)]
    mine = spark.createDataFrame(list(enumerate(texts + loose)), "doc_id long, text string")
    for r in pii.report(mine).where("doc_id >= 80").collect():
        t = loose[r.doc_id - 80]
        mail, phone = t.index("bob"), t.index("(555)")
        assert r.spans == f"email:{mail}:{t.index(',')},phone:{phone}:{len(t)}"
    near = [f"visa card 4556 7375 8689 98{10 + i}, ok" for i in range(60)] + [f"isbn 978030640{100 + i}" for i in range(60)] + [None]
    got = pii.report(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect()
    assert all(r.n_card == luhn(re.sub("[^0-9]", "", near[r.doc_id])) and r.spans == "card:10:29" for r in got if r.doc_id < 60) and all(r.spans == "" for r in got if r.doc_id >= 120)
    assert sum(r.spans != "" for r in got if 60 <= r.doc_id < 120) == sum(r.n_card for r in got if 60 <= r.doc_id < 120)
    spans = [(0, "b [at] x (dot) com"), (0, "b [at] x [dot] zz"), (3, "(555) 123-4567"), (3, "+1 555 123 4567"), (3, "+999 123 4567")]
    seen = spark.createDataFrame([(k, False, f, "", "") for k, f in spans], "kind int, base boolean, found string, before string, after string")
    assert [r.gazetteer for r in pii.votes(seen).collect()] == [1, -1, 0, 1, -1]


def test_suffix_dedup(docs, corpus, empty):
    length, seen = 200, collections.Counter()
    data = [(i, (t or "").encode()) for i, t, *_ in corpus]
    for _, b in data:
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    want = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                cover[j : j + length] = True
        kept = bytes(x for x, c in zip(b, cover, strict=False) if not c)
        want.append((i, len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert rows_of(suffix_dedup.report(docs)) == sorted(want, key=str) and suffix_dedup.report(empty).count() == 0


def test_suffix_dedup_of_short_documents(spark):
    """Blocks without a document of the length, nulls, and both beside longer ones; a column named kept gives way."""
    schema = "doc_id long, text string, kept string"
    for texts in (["short"], [None, None], ["a" * 10, None, "b" * 199], ["a" * 10, "xy" * 150, None, "xy" * 150]):
        got = suffix_dedup.report(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], schema).repartition(3)).collect()
        twice = {i for i, t in enumerate(texts) if t and len(t) == 300}
        assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got} == {i: (len(t or ""), 300 if i in twice else 0) for i, t in enumerate(texts)}
        assert suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], schema)).where("kept = cast('k' as binary)").count() == 0


def test_column_wise_bwt():
    rng = random.Random(3)
    for _ in range(20):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        segments = list({base[rng.randint(0, 20) : rng.randint(25, 60)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(12)})
        got = suffix_dedup.shared_windows(segments, 8, memory=64)
        for i, s in enumerate(segments):
            for j in range(len(s) - 7):
                assert got[i][j] == (sum(t.startswith(s[j : j + 8], a) for t in segments for a in range(len(t))) > 1)


def test_context_tree(spark, docs, empty):
    texts = ["ab ab abc", "ba ab", "Abc abc d", "zz ab é", "", None]
    got = {r.doc_id: r for r in context_tree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    grams = lambda t: [b"      " + w + b" " for w in (t or "").lower().encode().split()] + [b"      \n"]
    train = [i for i in got if not context_tree.held_out(i)]
    for i in train:
        for s in grams(texts[i]):
            for p in range(6, len(s)):
                for k in range(8):
                    for d in range(7):
                        counts[s[p - d : p], (1 << k) | s[p] >> 8 - k][s[p] >> 7 - k & 1] += 1
                        if d:
                            kids[s[p - d + 1 : p], (1 << k) | s[p] >> 8 - k].add((s[p - d : p], (1 << k) | s[p] >> 8 - k))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weigh = lambda n: kt(*counts[n]) if len(n[0]) == 6 else np.logaddexp(kt(*counts[n]), sum(map(weigh, kids[n]))) - math.log(2)

    def log10(s, p, k):
        left, mixed, out = 1.0, 0.0, 0.5
        for d in range(7):
            n = (s[p - d : p], (1 << k) | s[p] >> 8 - k)
            if n not in counts:
                break
            one = (counts[n][1] + 0.5) / (sum(counts[n]) + 1)
            out, stay = mixed + left * one, 1.0 if d == 6 else math.exp(kt(*counts[n]) - math.log(2) - weigh(n))
            mixed, left = mixed + left * stay * one, left * (1 - stay)
        return math.log10(out if s[p] >> 7 - k & 1 else 1 - out)

    tokens = collections.Counter(w for i in train for w in [*split(texts[i]), "\n"])
    n, v = sum(tokens.values()), len(tokens)
    for i, r in got.items():
        assert r.score == pytest.approx(sum(log10(s, p, k) for s in grams(texts[i]) for p in range(6, len(s)) for k in range(8)))
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*split(texts[i]), "\n"])) and r.train_tokens == n
    assert context_tree.score(docs).count() == docs.count() and context_tree.score(empty).count() == 0


def test_context_tree_crosses_words(spark):
    """Brute force over the running text; the order of words counts."""
    texts = ["one two three one two three", "one two one two four", "two three one", "one two three", "three two one", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three one two"), (None, "two two one three one")]
    got = {(r.doc_id, r.n_tokens, round(r.score, 9)): r for r in context_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), word_contexts=False).collect()}
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    gram = lambda t: b"      " + b"".join(w + b" " for w in (t or "").lower().encode().split()) + b"\n"
    for i, t in rows:
        if not context_tree.held_out(i):
            s = gram(t)
            for p in range(6, len(s)):
                for k in range(8):
                    for d in range(7):
                        node = (1 << k) | s[p] >> 8 - k
                        counts[s[p - d : p], node][s[p] >> 7 - k & 1] += 1
                        if d:
                            kids[s[p - d + 1 : p], node].add((s[p - d : p], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weigh = lambda n: kt(*counts[n]) if len(n[0]) == 6 else np.logaddexp(kt(*counts[n]), sum(map(weigh, kids[n]))) - math.log(2)

    def log10(s, p, k):
        left, mixed, out = 1.0, 0.0, 0.5
        for d in range(7):
            n = (s[p - d : p], (1 << k) | s[p] >> 8 - k)
            if n not in counts:
                break
            one = (counts[n][1] + 0.5) / (sum(counts[n]) + 1)
            out, stay = mixed + left * one, 1.0 if d == 6 else math.exp(kt(*counts[n]) - math.log(2) - weigh(n))
            mixed, left = mixed + left * stay * one, left * (1 - stay)
        return math.log10(out if s[p] >> 7 - k & 1 else 1 - out)

    want = [(i, sum(log10(s, p, k) for p in range(6, len(s)) for k in range(8)), len(s) - 6) for i, t in rows for s in [gram(t)]]
    assert sorted(r.score for r in got.values()) == pytest.approx(sorted(w for _, w, _ in want))
    assert sorted(r.bits_per_byte for r in got.values()) == pytest.approx(sorted(-w / math.log10(2) / z for _, w, z in want))
    same, mixed = sorted((r.score for r in got.values() if r.doc_id is None), reverse=True)
    assert same > mixed + 1


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[10:14] = x[9]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (920, [float("nan")] + [1.0] * 15, 1), (940, [None] + [1.0] * 15, 1)]
    got = collections.defaultdict(list)
    for r in collision_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(v - x[i] @ x[q]) < 1e-9 for i, v in got[q])
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.9 * 45 * 20


@pytest.mark.parametrize("longest", [1, 20])
def test_nearest_has_no_candidate_cap(longest):
    """Neighbours beyond the first tenth of a shard are found, also beside one very long vector."""
    x = np.random.default_rng(6).normal(size=(6000, 24))
    x[7] *= longest
    index, hits = collision_ann.ShardIndex(np.arange(6000), x), 0
    for q in range(0, 6000, 150):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(6000), -s))[:20]) & set(index.search(x[q], q, 20)[0]))
    assert hits >= 0.98 * 40 * 20


def test_nearest_at_a_full_shard():
    """As many vectors as one index holds by default; equal vectors, ties to the smaller id."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(64, 32))[rng.integers(0, 64, 16_384)] * 0.5 + rng.normal(size=(16_384, 32))
    x[100:120] = x[99]
    index, hits = collision_ann.ShardIndex(np.arange(16_384), x), 0
    for q in range(0, 16_384, 1024):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(16_384), -s))[:20]) & set(index.search(x[q], q, 20)[0]))
    assert hits >= 0.95 * 16 * 20
    ids, scores = index.search(x[99], 99, 20)
    assert list(ids) == list(range(100, 120)) or scores[0] > x[99] @ x[99] + 1e-9


def test_nearest_of_nothing(spark):
    schema = "vec_id long, embedding array<double>, rank int"
    assert collision_ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(None, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (21, [1.0, 1.0, 0.0], 1), (40, [0.5, 0.0], 1)]
    got = collision_ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 40, 0.5), (40, 1, 20, 0.5)]


def test_language(spark, docs, empty):
    made = [(i, " ".join(f"{'aeiou'[j % 5]}{'ntrs'[(i + j) % 4]}{'xq' if i % 2 else 'lm'}" for j in range(30)), "q" if i % 2 else "m") for i in range(300)]
    df = spark.createDataFrame([*made, (900, None, "q"), (901, "12 34", "m"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df, usable=language_id.fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == v for i, _, v in made) and all(got[i].lang_pred == "und" and not got[i].lang_accepted for i in (900, 901, 902))
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    twice = language_id.identify(df.withColumn("lang_pred", F.lit(1)).withColumn("LANG_SCORE", F.lit("x")), model)
    assert twice.columns == [*df.columns, "lang_pred", "lang_score", "lang_accepted"] and twice.where("lang_pred = 'q'").count() == 150
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0 and language_id.identify(docs, language_id.fit(docs)).count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    bench = words(30, 20)
    texts = [(i, "common line here\n" + " ".join(words(60, 100 + i)), "en") for i in range(12)]
    texts += [(20, " ".join(words(80, 200)), "en"), (21, " ".join(words(80, 200)), "en"), (22, " ".join(words(20, 201) + bench), "en"), (23, "123 456", "en"), (24, None, "en")]
    spark.createDataFrame([(i, t, v, "s", 0 if t is None else len(t)) for i, t, v in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    blocks.use_checkpoints(spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = blocks.saved(stage(spark, docs, str(tmp_path)))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "language_id":
            assert {i: r.text for i, r in after.items()} == BRUTE[name](before, " ".join(bench))
    assert {r.doc_id for r in docs.collect()} == {*range(12), 20} and docs.where("text like 'common%'").count() == 0
    unit = lambda i: int(hashlib.md5(f"count 1|{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = collections.Counter({i: sum(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) <= unit(i) for k in range(30)) for i in after})
    got = collections.Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    assert got == +want
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(+want)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def _brute_lines(rows, bench):
    held = collections.Counter(k for r in rows.values() for k in {low(x.strip(" \t\n\x0b\x0c\r")) for x in r.text.split("\n")} - {""})
    return {i: "\n".join(x for x in r.text.split("\n") if held[low(x.strip(" \t\n\x0b\x0c\r"))] < 10) for i, r in rows.items()}


def _brute_join(rows, bench):
    corpus = [(i, r.text) for i, r in rows.items()]
    return {i: rows[i].text for i, _, part in brute_components(corpus, 5, 80, 100) if i == part}


def _brute_leaks(rows, bench):
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    item, out = grams(split(bench)), {}
    for i, r in rows.items():
        w, n = split(r.text), len(split(bench))
        sims = [sum((g & item).values()) / max(1, sum((g | item).values())) for at in range(max(1, len(w) - n + 1)) for g in [grams(w[at : at + n])]]
        if max(sims) < 0.8:
            out[i] = r.text
    return out


BRUTE = {"line_dedup": _brute_lines, "jaccard_join": _brute_join, "decontaminate": _brute_leaks}
