"""Personal data by weak supervision, in DataFrame operations only.

Base patterns give spans that always stay. Looser patterns, and card numbers of the right
length whose checksum fails, give further candidates. Labelers vote on every candidate
(for, against or not at all): the strict pattern, a checksum or range rule, gazetteers of
mail domains, dialling codes, reserved addresses and card issuers, words of its context,
the characters at its edges, and its shape. Expectation-maximisation over the votes
estimates, for each kind, every labeler's reliability and every candidate's probability
(two classes, labelers independent given the class); the candidates' probabilities then train a naive Bayes classifier over features of the span itself.
A further candidate becomes a span when both agree, at `threshold`.

Votes and features are counted by DataFrame aggregation: the table of vote patterns has
at most 3**6 rows for each kind, the features fewer, whatever the input.

Offsets are code points, the end exclusive. Defined cases: null text is empty and has
no spans; repeated rows give repeated results; candidates that overlap a base span or
an earlier candidate are dropped; with no candidates nothing is fitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import saved

KINDS = ("email", "ip", "card", "phone")

_MAIL = "[A-Za-z0-9._%+-]"
#: The same spans as the patterns of the contract, found without rescanning: a mail address
#: starts where its run of characters does or right behind the last one; an address starts
#: where its run of digits does; a card number is a whole run of single-spaced digits, of 12 to 19.
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: mail addresses written out, addresses with spaces at the dots, card numbers grouped by dots, national phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(\x20?\.\x20[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9.])[0-9]{4}(\.[0-9]{4}){3}(?![0-9.])",
    "phone": r"(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to match at all; checked first because it is cheap.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "instr(text, '.') > 0", "card": "true", "phone": "instr(text, '+') > 0"}
LOOSE_NEEDS = {"email": "instr(lower(text), 'at') > 0 AND (instr(text, '[dot') > 0 OR instr(text, '(dot') > 0)", "ip": "instr(text, '. ') > 0", "card": "instr(text, '.') > 0", "phone": "instr(text, '(') > 0"}
#: Words in the context of a span, before it, that speak for or against each kind.
FOR = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|client", "card": "card|visa|credit|pay|account|amex", "phone": r"\btel|phone|call|fax|mobile|\bcell"}
AGAINST = {"email": "example of|format", "ip": "version|release|section|chapter", "card": "isbn|serial|order|tracking|invoice", "phone": "isbn|serial|order|part no|version"}
#: Gazetteers: top-level domains, country dialling codes, reserved address blocks, card issuer prefixes.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?!0\.|127\.|255\.|169\.254\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(1|33|34|44|49|39|41|43|7|81|86|91)[^0-9]?",
}
#: How long a whole number, or how formed an address, mostly is.
SHAPE = {"email": r"\.[A-Za-z]{2,}$", "ip": r"^[0-9]{1,3}(\D+[0-9]{1,3}){3}$", "card": r"^(\D*[0-9]){15,16}$", "phone": r"^(\D*[0-9]){10,13}$"}
VOTES = ("strict", "rule", "gazetteer", "context", "edge", "shape")
CONTEXT = 40


SPAN = "kind:int,base:boolean,start:int,end:int,found:string,before:string,after:string"
CHUNK = 256


def _found(pattern: str, needs: str, kind: int, base: bool) -> str:
    """SQL: (kind, base, start, end, found, before, after) of the pattern's matches, left to right.

    Matches and the gaps between them alternate, so their lengths give the offsets and what
    stands around a match. They are walked in chunks, each from where those before it end,
    so that a text of very many matches takes no time in their square.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    none = f"cast(array() as array<struct<{SPAN}>>)"
    pieces = f"named_struct('m', regexp_extract_all(text, '{p}', 0), 'g', split(text, '{p}', -1))"
    zipped = f"transform(array({pieces}), t -> transform(t.m, (m, i) -> named_struct('m', m, 'gap', t.g[i], 'after', left(concat(coalesce(get(t.g, i + 1), ''), coalesce(get(t.m, i + 1), '')), 1))))[0]"
    chunks = f"transform(array({zipped}), z -> transform(sequence(0, (size(z) - 1) div {CHUNK}), i -> slice(z, i * {CHUNK} + 1, {CHUNK})))[0]"
    tail = f"right(concat(a.tail, x.gap, x.m), {CONTEXT})"
    step = "a.at + length(x.gap) + length(x.m)"
    over = f"aggregate(c, named_struct('at', a.at, 'tail', a.tail), (a, x) -> named_struct('at', {step}, 'tail', {tail}))"
    starts = f"""aggregate(cs, named_struct('at', 0, 'tail', '', 'out', cast(array() as array<struct<at:int,tail:string>>)),
      (a, c) -> transform(array({over}), e -> named_struct('at', e.at, 'tail', e.tail, 'out', concat(a.out, array(named_struct('at', a.at, 'tail', a.tail)))))[0], a -> a.out)"""
    made = f"named_struct('kind', {kind}, 'base', {str(base).lower()}, 'start', a.at + length(x.gap), 'end', {step}, 'found', x.m, 'before', right(concat(a.tail, x.gap), {CONTEXT}), 'after', x.after)"
    walk = f"aggregate(c, named_struct('at', b.at, 'tail', b.tail, 'out', {none}), (a, x) -> named_struct('at', {step}, 'tail', {tail}, 'out', concat(a.out, array({made}))), a -> a.out)"
    return f"if({needs} AND text rlike '{p}', flatten(transform(array({chunks}), cs -> flatten(zip_with(cs, {starts}, (c, b) -> {walk})))), {none})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    doubled = f"transform(sequence(1, length({d})), i -> cast(substring({d}, length({d}) - i + 1, 1) as int) * if(i % 2 = 0, 2, 1))"
    return f"aggregate({doubled}, 0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"


def _octets(x: str) -> str:
    parts = f"split(regexp_replace({x}, '[^0-9.]', ''), '\\\\.')"
    return f"forall({parts}, o -> length(ltrim('0', o)) <= 3 AND coalesce(try_cast(ltrim('0', o) as int), 0) <= 255)"


def _valid(x: str) -> str:
    """SQL: the rule of x's kind holds: octet range, Luhn, number of digits."""
    d = _digits(f"{x}.found")
    return f"CASE {x}.kind WHEN 0 THEN true WHEN 1 THEN {_octets(x + '.found')} WHEN 2 THEN length({d}) BETWEEN 12 AND 19 AND {_luhn(d)} ELSE length({d}) BETWEEN 9 AND 15 END"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs' rows as doc_id, text, base (the base spans by start, then kind) and near (card numbers of the right length that fail the checksum)."""
    every = ", ".join(_found(PATTERNS[k], NEEDS[k], i, True) for i, k in enumerate(KINDS))
    judged = f"transform(concat({every}), x -> named_struct('x', x, 'valid', {_valid('x')}))"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__j", F.expr(judged))
    ordered = "array_sort(transform(filter(__j, j -> j.valid), j -> j.x), (a, b) -> if(a.start <> b.start, a.start - b.start, a.kind - b.kind))"
    other = ", ".join(f"'{f.split(':')[0]}', " + ("false" if f.startswith("base") else f"j.x.{f.split(':')[0]}") for f in SPAN.split(","))
    near = f"transform(filter(__j, j -> j.x.kind = 2 AND NOT j.valid), j -> named_struct({other}))"
    return rows.select("doc_id", "text", F.expr(ordered).alias("base"), F.expr(near).alias("near"))


def candidates(based: DataFrame) -> DataFrame:
    """doc_id and all: base spans and further candidates clear of them, with context and edges."""
    every = ", ".join(_found(LOOSE[k], LOOSE_NEEDS[k], i, False) for i, k in enumerate(KINDS))
    clear = f"filter(concat(near, {every}), x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
    return based.select("doc_id", F.concat("base", F.expr(clear)).alias("all"))


def _case(table: dict[str, str], make) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {make(table[k])}" for i, k in enumerate(KINDS)) + " END"


def _plain(x: str) -> str:
    """SQL: x with a written-out at and dots as signs."""
    return rf"regexp_replace(regexp_replace({x}, '\\x20?[\\[(]at[\\])]\\x20?', '@'), '\\x20?[\\[(]dot[\\])]\\x20?', '.')"


def votes(spans: DataFrame) -> DataFrame:
    """Spans (kind, base, found, before, after) with one column for each labeler: 1, -1 or 0.

    Written-out mail addresses are looked up as mail addresses; a national phone number has
    no dialling code, so the gazetteer does not vote on it.
    """
    quoted = lambda p: "'" + p.replace("\\", "\\\\") + "'"
    plain_found = _plain("found")
    plain = spans.withColumn("x", F.struct("kind", "found"))
    speaks = _case(FOR, lambda p: f"lower(before) rlike {quoted(p)}")
    denies = _case(AGAINST, lambda p: f"lower(before) rlike {quoted(p)}")
    listed = _case(GAZETTEER, lambda p: f"{_plain('found')} rlike {quoted(p)}")
    return plain.select(
        *spans.columns,
        F.expr("if(base, 1, 0)").alias("strict"),
        F.expr(f"if({_valid('x')}, if(kind = 0, 0, 1), -1)").alias("rule"),
        F.expr(f"CASE WHEN kind = 3 AND left(found, 1) <> '+' THEN 0 WHEN {listed} THEN 1 ELSE -1 END").alias("gazetteer"),
        F.expr(f"CASE WHEN {denies} THEN -1 WHEN {speaks} THEN 1 ELSE 0 END").alias("context"),
        F.expr("if(before rlike '[A-Za-z0-9]$' OR after rlike '[A-Za-z0-9]', -1, 1)").alias("edge"),
        F.expr(f"if({_case(SHAPE, lambda p: plain_found + " rlike " + quoted(p))}, 1, -1)").alias("shape"),
    )


def estimate(patterns: DataFrame, rounds: int = 12) -> dict[int, dict]:
    """Reliabilities by EM over the counted vote patterns: for each kind, prior and P(vote | class) for each labeler.

    A labeler that does not vote says nothing about the class. Starts from the majority vote; every round is one aggregation of the small table.
    """
    belief = F.expr("1 / (1 + exp(-1.5D * (" + " + ".join(VOTES) + ")))")
    params: dict[int, dict] = {}
    for _ in range(rounds):
        p = patterns.withColumn("p", belief)
        sums = [F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("all")]
        for v in VOTES:
            for value in (-1, 1):
                hit = (F.col(v) == value).cast("double") * F.col("n")
                sums += [F.sum(hit * F.col("p")).alias(f"{v}_{value}_y"), F.sum(hit * (1 - F.col("p"))).alias(f"{v}_{value}_n")]
        # one row for each kind
        for row in p.groupBy("kind").agg(*sums).collect():
            yes, no = row["yes"], row["all"] - row["yes"]
            one = params[row["kind"]] = {"prior": (yes + 1) / (yes + no + 2)}
            for v in VOTES:
                spoke = {c: row[f"{v}_-1_{c}"] + row[f"{v}_1_{c}"] + 2 for c in "yn"}
                one[v] = {i: ((row[f"{v}_{i}_y"] + 1) / spoke["y"], (row[f"{v}_{i}_n"] + 1) / spoke["n"]) for i in (-1, 1)}
        if not params:
            return {}
        belief = posterior(params)
    return params


def _by_kind(params: dict[int, dict], make) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {make(one)}" for k, one in sorted(params.items())) + " END"


def posterior(params: dict[int, dict]) -> Column:
    """Probability of the class given the votes."""

    def log_odds(one: dict) -> str:
        out = f"ln({one['prior']!r}D / {1 - one['prior']!r}D)"
        for v in VOTES:
            ratio = " ".join(f"WHEN {i} THEN ln({y!r}D / {n!r}D)" for i, (y, n) in one[v].items())
            out += f" + CASE {v} {ratio} ELSE 0D END"
        return out

    return F.expr(f"1 / (1 + exp(-({_by_kind(params, log_odds)})))")


def features(found: str = "found") -> Column:
    """The span's features: kind with its shape's length, leading characters and separators."""
    shape = f"regexp_replace(regexp_replace(regexp_replace({found}, '[0-9]+', '9'), '[a-z]+', 'a'), '[A-Z]+', 'A')"
    return F.expr(f"array(concat('shape ', kind, ' ', left({shape}, 16)), concat('length ', kind, ' ', least(length({found}), 32)), concat('after ', kind, ' ', after rlike '[,.;:)]'), concat('before ', kind, ' ', before rlike '[:(]\\\\s*$'))")


def train_classifier(judged: DataFrame) -> DataFrame:
    """kind, feature, weight: naive Bayes log odds of the kind's features over the kind's own, trained by the probabilities p and smoothed towards none."""
    total = judged.groupBy("kind").agg(F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n"))
    counts = judged.select("kind", F.explode(features()).alias("feature"), "p").groupBy("kind", "feature").agg(F.sum("p").alias("fy"), F.sum(1 - F.col("p")).alias("fn"))
    # total has one row for each kind
    return counts.join(F.broadcast(total), "kind").select("kind", "feature", F.expr("ln((fy + (y + 1) / (y + n + 2)) / (fn + (n + 1) / (y + n + 2))) - ln((y + 1) / (n + 1))").alias("weight"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def detect(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """doc_id, spans (array of kind, base, start, end, found), in order, for each row."""
    cols = "kind int, base boolean, start int, end int, found string"
    fields = [c.split()[0] for c in cols.split(", ")]
    rows = saved(candidates(base_spans(docs)).withColumn("row", F.monotonically_increasing_id()))
    spans = saved(votes(rows.select("row", F.explode("all").alias("s")).select("row", "s.*")))
    patterns = saved(spans.groupBy("kind", *VOTES).agg(F.count("*").cast("double").alias("n")))
    params = estimate(patterns)
    kept = F.expr("filter(all, x -> x.base)")
    slim = F.transform(F.col("chosen"), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    extra = spans.where("NOT base")
    if not params or extra.isEmpty():
        return rows.select("doc_id", kept.alias("chosen")).select("doc_id", slim.alias("spans"))
    judged = spans.withColumn("p", posterior(params))
    model = train_classifier(judged)
    asked = judged.where("NOT base").select("row", "kind", "base", "start", "end", "found", "p", F.explode(features()).alias("feature"))
    scored = asked.join(model, ["kind", "feature"]).groupBy("row", *fields, "p").agg(F.sum("weight").alias("odds"))
    odds = F.expr(_by_kind(params, lambda one: f"{one['prior'] / (1 - one['prior'])!r}D"))
    added = scored.where((F.col("p") >= threshold) & (1 / (1 + F.exp(-F.col("odds")) / odds) >= threshold))
    added = added.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("added"))
    clear = """aggregate(array_sort(added, (a, b) -> if(a.start <> b.start, a.start - b.start, a.kind - b.kind)), slice(added, 1, 0),
      (a, x) -> if(exists(a, b -> x.start < b.end), a, concat(a, array(x))))"""
    both = rows.join(added.withColumn("added", F.expr(clear)), "row", "left").select("doc_id", kept.alias("chosen"), "added").select("doc_id", slim.alias("spans"), "added")
    return both.select("doc_id", F.expr("array_sort(concat(spans, coalesce(added, slice(spans, 1, 0))), (a, b) -> if(a.start <> b.start, a.start - b.start, a.kind - b.kind))").alias("spans"))


def report(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """doc_id, base spans by kind, SHA-256 of the base spans, and all spans as text."""
    found = detect(docs, threshold).withColumn("base", F.expr("filter(spans, x -> x.base)"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))
