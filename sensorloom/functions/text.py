"""Text records of embedding rows, prompts, and the parsing of generated text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.schemas import IDS

#: Hints by activity; others get `human motion`.
MOTION_HINTS = {"walking": "periodic locomotion", "running": "high-energy periodic locomotion", "cycling": "cyclic lower-body motion", "sitting": "low-motion posture", "standing": "quiet upright posture"}
#: The number pattern, the marker pattern, the tokens that are stripped, the end token.
NUMBER = r"[-+]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][-+]?\d+)?"
MARKER = r"(?:\[sep\]\s*)?Target(?:\s+values)?\s*:"
STRIPPED = ("<|endoftext|>", "</s>", "[answer]")
EOS = "<|endoftext|>"


def numeric_key(name: str) -> tuple[float, str]:
    digits = name[len(name.rstrip("0123456789")) :]
    return (int(digits) if digits else 1e9, name)


def format_number(c: Column, digits: int, exact: bool = False) -> Column:
    """Fixed decimals; nan, inf and -inf as such. exact rounds the binary value half to even, in batches; else ties round up."""
    if not exact:
        return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", c))

    @F.pandas_udf("string")
    def half_even(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.{digits}f}", na_action="ignore")

    return half_even(c)


def round_signed(c: Column, digits: int) -> Column:
    """Half away from zero; what rounds to zero keeps its sign, so that -0.00001 is written -0.0000."""
    scaled = F.abs(c) * 10.0**digits
    whole = F.floor(scaled)
    # from 2^52 on a double has no fraction
    return F.when(scaled < 2.0**52, F.signum(c) * (whole + (scaled - whole >= 0.5).cast("int")) / 10.0**digits).otherwise(c)


def joined(parts: list[Column], by: str) -> Column:
    return F.concat_ws(by, *parts)


def shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def hint() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MOTION_HINTS.items() for x in kv])[F.col("activity_name")], F.lit("human motion"))


# The wording of prompts and records below is the format that models were trained on.


def prompt(values: list[str], template: str = "fim_template_textual_encoding", dataset: str = "sensor", shape: str = "18-channel 256-step") -> Column:
    """The generation prompt of a row; dataset and shape name the task in the structured forms."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    name, n = F.col("activity_name"), len(values)
    if template == "compact_values_v2":
        fields = [F.concat(F.lit("activity="), name), F.concat(F.lit("activity_id="), whole("activity_id")), F.concat(F.lit("subject_id="), whole("subject_id")), F.concat(F.lit("window_id="), whole("window_id")), F.concat(F.lit("hint="), hint()), F.lit(f"task={dataset}_embedding_{n}_values")]
        return F.concat(F.lit("Condition: "), joined(fields, "; "), F.lit("\nTarget values:\n"))
    if template == "structured_v2":
        lines = [F.lit("Condition:"), F.concat(F.lit("activity_name = "), name), *[F.concat(F.lit(f"{c} = "), whole(c)) for c in ("activity_id", "subject_id", "window_id")]]
        lines += [F.lit(f"task = generate a standardized {dataset} {shape} motion embedding"), F.concat(F.lit("motion_hint = "), hint()), F.lit(f"\nInput:\nvalues = [blank] x {n}\n\nTarget:\n")]
        return joined(lines, "\n")
    condition = joined([F.concat(F.lit("activity_name is "), name), *[F.concat(F.lit(f"{c} is "), whole(c)) for c in ("activity_id", "window_id", "subject_id")]], ", ")
    return F.concat(F.lit("Condition: "), condition, F.lit(" [sep] Input: " + ", ".join(f"{v} is [blank]" for v in values) + " [sep] Target: "))


def record(columns: list[str], values: list[str], template: str = "fim_template_textual_encoding", digits: int = 4, eos: str = EOS, dataset: str = "sensor", exact: bool = False) -> Column:
    """The training text of a row; columns in text order. Unknown templates act as the default one."""
    number = lambda c: format_number(F.col(c), digits, exact) if c in values else shown(c)
    ordered = [c for c in columns if c in values]
    if template in ("structured_v2", "compact_values_v2"):
        ordered = sorted(ordered, key=numeric_key)
        body = joined([number(c) for c in ordered], ", ") if template == "compact_values_v2" else F.concat(joined([F.concat(F.lit(f"{c} = "), number(c)) for c in ordered], "; "), F.lit(";"))
        return F.concat(prompt(ordered, template, dataset), body, F.lit(f" [end]{eos}"))
    if template == "base_template":
        return F.concat(joined([F.concat(F.lit(f"{c} is "), number(c)) for c in columns], ", "), F.lit(eos))
    if template == "fim_template":
        target = joined([F.concat(number(c), F.lit(" [answer]")) for c in columns], " ")
        return F.concat(F.lit("Input: " + ", ".join(f"{c} is [blank]" for c in columns) + " [sep] Target: "), target, F.lit(eos))
    condition = joined([F.concat(F.lit(f"{c} is "), shown(c)) for c in columns if c not in values], ", ")
    target = joined([F.concat(number(c), F.lit(" [answer]")) for c in ordered], " ")
    return F.concat(F.lit("Condition: "), condition, F.lit(" [sep] Input: " + ", ".join(f"{c} is [blank]" for c in ordered) + " [sep] Target: "), target, F.lit(eos))


def permuted_record(columns: list[str], values: list[str], digits: int = 4, eos: str = EOS, seed: int = 42, template: str = "fim_template_textual_encoding", dataset: str = "sensor") -> Column:
    """The template with columns in an order that hashes of seed, window and name give: the same on every run.

    The structured forms name their fields and sort their values, so they are those of `record`.
    """
    if template in ("structured_v2", "compact_values_v2"):
        return record(columns, values, template, digits, eos, dataset)
    number = lambda c: format_number(F.col(c), digits) if c in values else shown(c)
    cells = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col("window_id"), F.lit(c)).alias("h"), F.lit(c).alias("c"), F.lit(c in values).alias("n"), number(c).alias("v")) for c in columns])
    cells = F.array_sort(cells)
    named = lambda x: F.concat(x["c"], F.lit(" is "), x["v"])
    blank = lambda x: F.concat(x["c"], F.lit(" is [blank]"))
    answer = lambda x: F.concat(x["v"], F.lit(" [answer]"))
    if template == "base_template":
        return F.concat(F.array_join(F.transform(cells, named), ", "), F.lit(eos))
    if template == "fim_template":
        return F.concat(F.lit("Input: "), F.array_join(F.transform(cells, blank), ", "), F.lit(" [sep] Target: "), F.array_join(F.transform(cells, answer), " "), F.lit(eos))
    numbers = F.filter(cells, lambda x: x["n"])
    condition = F.array_join(F.transform(F.filter(cells, lambda x: ~x["n"]), named), ", ")
    return F.concat(F.lit("Condition: "), condition, F.lit(" [sep] Input: "), F.array_join(F.transform(numbers, blank), ", "), F.lit(" [sep] Target: "), F.array_join(F.transform(numbers, answer), " "), F.lit(eos))


def text_records(df: DataFrame, values: list[str], **options) -> DataFrame:
    """text and the row's columns."""
    return df.select(record([*[c for c in IDS if c in df.columns], *values], values, **options).alias("text"), *df.columns)


def target_tail(text: Column) -> Column:
    """What follows the last target marker, else all; line ends are blanks."""
    flat = F.regexp_replace(text, r"[\r\n]", " ")
    return F.when(flat.rlike(f"(?i){MARKER}"), F.regexp_extract(flat, f"(?is)^.*{MARKER}(.*)$", 1)).otherwise(flat)


def marker_status(text: Column) -> Column:
    return F.when(F.regexp_replace(text, r"[\r\n]", " ").rlike(f"(?i){MARKER}"), "ok").otherwise("target_marker_missing")


def parse_named(tail: Column, values: list[str]) -> Column:
    """Values written as `name = number` or `name is number`, by column; of repeats the last counts."""
    pattern = F.lit(rf"(?i)\b(value_\d+)\s*(?:=|is)\s*({NUMBER})")
    pairs = F.arrays_zip(F.regexp_extract_all(tail, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(tail, pattern, F.lit(2)).alias("v"))

    def last(name: str) -> Column:
        own = F.filter(pairs, lambda p: p["k"] == name)
        return F.try_element_at(own, F.lit(-1))["v"].try_cast("double")

    return F.array(*[last(v) for v in values])


def parse_sequential(tail: Column, values: list[str]) -> Column:
    """The first numbers in order, once names and marker tokens are out of the way."""
    t = F.regexp_replace(tail, r"(?i)value_\d+", "VALUE")
    for token in STRIPPED:
        t = F.replace(t, F.lit(token), F.lit(" "))
    found = F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array(*[F.get(found, F.lit(i)).try_cast("double") for i in range(len(values))])


def parse(df: DataFrame, text: str, values: list[str]) -> DataFrame:
    """df with one column for each value and the parse's debug columns.

    Named values are tried first; with none found the numbers are taken in order.
    """
    out = df.withColumn("__tail", target_tail(F.col(text))).withColumn("marker_status", marker_status(F.col(text)))
    named, ordered = parse_named(F.col("__tail"), values), parse_sequential(F.col("__tail"), values)
    out = out.withColumn("__named", named).withColumn("__any", F.exists("__named", lambda x: x.isNotNull()))
    out = out.withColumn("__v", F.when(F.col("__any"), F.col("__named")).otherwise(ordered))
    tokens = F.regexp_extract_all("__tail", F.lit(f"({NUMBER})"), F.lit(1))
    missing = F.filter(F.transform(F.col("__v"), lambda x, i: F.when(x.isNull(), F.element_at(F.array(*[F.lit(v) for v in values]), i + 1))), lambda x: x.isNotNull())
    stripped = F.rtrim("__tail")
    out = out.withColumns({v: F.col("__v")[i] for i, v in enumerate(values)})
    out = out.withColumns({
        "missing_columns": missing, "expected_numeric_count": F.lit(len(values)), "missing_numeric_count": F.size(missing), "parsed_numeric_count": len(values) - F.size(missing),
        "extracted_token_count": F.size(tokens), "last_extracted_token": F.try_element_at(tokens, F.lit(-1)), "parse_mode": F.when(F.col("__any"), "named").otherwise("sequential"),
        "parse_status": F.when(F.size(missing) == 0, "ok").otherwise("missing_values"), "tail_truncation_hint": stripped.rlike(r"[-.\[,]$"), "tail_last_char": F.right(stripped, F.lit(1)), "target_tail_preview": F.left("__tail", F.lit(500)),
    })
    return out.drop("__tail", "__named", "__any", "__v")


def parse_values(df: DataFrame, text: str, values: list[str]) -> DataFrame:
    """The row's columns and its parsed values, without what parse says about them."""
    return parse(df, text, values).select(*df.columns, *values)


def token_budget(values: int, configured: int, limit: int, prompt_tokens: int) -> tuple[int, int]:
    """(most, fewest) new tokens for so many values inside the context limit."""
    return max(1, min(max(configured, 8 * values), limit - prompt_tokens - 1)), 6 * values


def llm_records(metadata: DataFrame, features: DataFrame, channels: list[str]) -> DataFrame:
    """Nested records with condition text, the embedding (if there), mean and std statistics, and templates."""
    stats = [c for c in features.columns if c.endswith(("__mean", "__std"))]
    both = metadata.join(features.select("window_id", *stats), "window_id")
    # fixed values: the wording of the condition, the templates and the placeholder
    text = F.concat(F.lit("Activity: "), "activity_name", F.lit(". Subject: "), "subject_id", F.lit(". Window length: "), "window_length", F.lit(f". Channels: {', '.join(channels)}."))
    return both.select(
        *IDS, text.alias("condition_text"), (F.col("values") if "values" in metadata.columns else F.lit(None).cast("array<double>")).alias("embedding_placeholder"),
        F.create_map(*[x for s in stats for x in (F.lit(s), F.col(s))]).alias("stats_placeholder"),
        F.lit("Condition: activity is {activity_name}. Subject: {subject_id}. Window embedding: {embedding_placeholder}. Describe or generate the sensor trajectory.").alias("input_template_raw_to_text"),
        F.lit("Condition: activity is {activity_name}. Subject: {subject_id}. Summary stats: {stats_placeholder}. Generate a plausible sensor window.").alias("input_template_stats_to_text"),
        F.lit("<future_sensor_sequence_or_text_target>").alias("target_placeholder"),
    )
