"""Evidence checks: numbers and dates of a text column against table cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import calendar_pattern

# Fixed patterns. An identifier is masked as a whole, so its digits are no claims.
#
# A date that was taken is replaced by one private character, which the later patterns treat as the
# digits it stands for: a number that runs into a date is no claim, as it would overlap the date.
DASHED, WORDED = "\ue000", "\ue001"  # ends in a digit; ends in a character of its own
NOT_AFTER = r"(?<![A-Za-z0-9\uE000{0}])"
NOT_BEFORE = r"(?![A-Za-z0-9\uE000\uE001{0}])"
IDENTIFIER = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]*(?:[-_][A-Z0-9]+)+(?![A-Za-z0-9])"
ISO_DATE = NOT_AFTER.format("") + calendar_pattern("-", "-", "") + NOT_BEFORE.format("")
CHINESE_DATE = NOT_AFTER.format("") + calendar_pattern(r"\s*年\s*", r"\s*月\s*", r"\s*日")
MONTH = r"(0?[1-9]|1[0-2])"
DAY = r"(0?[1-9]|[12]\d|3[01])"
MONTH_DAYS: tuple[str, ...] = (
    NOT_AFTER.format("") + MONTH + r"\s*月\s*" + DAY + r"\s*日",
    NOT_AFTER.format(r".\-") + MONTH + "-" + DAY + NOT_BEFORE.format(r".\-"),
    NOT_AFTER.format(r"./\-") + MONTH + "/" + DAY + NOT_BEFORE.format(r"./\-"),
)
NUMBER = (
    r"(?:" + NOT_AFTER.format("_⟧") + r"(?:±|[+\-−])?(?:\d{1,3}(?:[,，]\d{3})+|\d+)|\uE000(?:[,，]\d{3})*)"
    r"(?:\.\uE001|(?:\.(?:\d+|\uE000))?[%％]?" + NOT_BEFORE.format("_⟦") + ")"
)
TOLERANCE = 0.005
WIDE_DIGITS = "０１２３４５６７８９"


def date_key(text: Column) -> Column:
    """A matched date text as YYYY-MM-DD."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.concat(
        F.lpad(parts[0], 4, "0"), F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"),
        F.lpad(parts[2], 2, "0"),
    )


def month_day_key(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.concat(F.lpad(parts[0], 2, "0"), F.lit("-"), F.lpad(parts[1], 2, "0"))


def number_value(text: Column) -> Column:
    plain = F.translate(text, "−,，%％±+", "-")
    return plain.try_cast("double")


# Fixed patterns: numbers that describe the presentation of an answer. Each is replaced by a tag
# whose letter hides it from the general number pattern.
WHOLE = r"(\d{1,3}(?:[,，]\d{3})+|\d+)"
TAGGED = r"⟦([ocz])([\d,，]+)⟧"
PRESENTATION: tuple[tuple[str, str, str], ...] = (
    (r"(第)" + WHOLE + r"(?![\d.,%％A-Za-z_])", "$1⟦o$2⟧", "第"),
    (r"(?m)^(\s*(?:[-+]\s+|\*\s*)?(?:\*\*)?)" + WHOLE + r"(?=(?:\*\*)?(?:\.(?![\d])|[．、)）:：]))", "$1⟦o$2⟧", r"[0-9*][.．、)）:：]"),
    (r"()(?<![A-Za-z0-9_.,，+±−-])" + WHOLE + r"(?=\s{0,2}[个项条家种款位行])", "$1⟦c$2⟧", "[个项条家种款位行]"),
    (r"((?:前|[Tt][Oo][Pp])\s*)" + WHOLE + r"(?![\d.,%％A-Za-z_])", "$1⟦c$2⟧", "前|[Tt][Oo][Pp]"),
    (r"((?:大于|超过|不为|非|>|≥)\s*)(0)(?![\d.,%％A-Za-z_])", "$1⟦z$2⟧", "大于|超过|不为|非|>|≥"),
)


UNSEEN = f"{WIDE_DIGITS}{DASHED}{WORDED}⟦⟧"


def claims_column(texts: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with an array column: all numbers, percentages, dates and month-days of a whole text.

    Dates are taken first and masked, so their parts are not read again as numbers. An element has kind,
    pos (order within its kind), raw, value (numbers), day (dates) and place (ordinal, count or zero for
    numbers that only describe the presentation).
    """
    kept, at = texts.columns, [f"_{name}_{i}" for i in range(len(MONTH_DAYS) + 3)]
    # Every claim holds a digit, so texts without one need no further pass. Full-width digits count; they
    # become ASCII one by one, so places stay. Few texts have any, or a sign that is used below.
    plain = F.when(F.col(text).rlike(f"[{UNSEEN}]"), F.translate(text, UNSEEN, "0123456789" + " " * 4)).otherwise(F.col(text))
    digits = F.col(text).rlike(f"[0-9{WIDE_DIGITS}]")
    step = texts.select("*", F.when(digits, F.regexp_replace(plain, IDENTIFIER, " ")).alias(at[0]))
    # A pattern runs only where its fixed sign occurs.
    masks = (
        (ISO_DATE, DASHED, "-"),
        (CHINESE_DATE, WORDED, "日"),
        *zip(MONTH_DAYS, (WORDED, DASHED, DASHED), ("日", "-", "/")),
    )
    for i, (pattern, mask, sign) in enumerate(masks):
        before = F.col(at[i])
        masked = F.when(before.contains(sign), F.regexp_replace(before, pattern, mask)).otherwise(before)
        step = step.select("*", masked.alias(at[i + 1]))
    tagged = f"_{name}_tagged"
    step = step.withColumn(tagged, F.col(at[len(masks)]))
    for pattern, replacement, signs in PRESENTATION:
        before = F.col(tagged)
        step = step.withColumn(
            tagged,
            F.when(before.rlike(signs), F.regexp_replace(before, pattern, replacement)).otherwise(before),
        )

    def hits(column: str, pattern: str, sign: str = "") -> Column:
        found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
        nothing = F.array().cast("array<string>")
        return F.when(F.col(column).contains(sign), found).otherwise(nothing) if sign else F.coalesce(found, nothing)

    def claims_of(kind: str, found: Column) -> Column:
        def claim(raw: Column, pos: Column) -> Column:
            number, day = F.lit(None).cast("double"), F.lit(None).cast("string")
            name_of, place, plain_raw = F.lit(kind), F.lit(None).cast("string"), raw
            if kind == "number":
                tag = F.regexp_extract(raw, TAGGED, 1)
                place = F.when(tag == "o", "ordinal").when(tag == "c", "count").when(tag == "z", "zero")
                plain_raw = F.when(tag != "", F.regexp_extract(raw, TAGGED, 2)).otherwise(raw)
                name_of = F.when(raw.rlike("[%％]$"), "percentage").otherwise(kind)
                number = number_value(plain_raw)
            else:
                day = date_key(raw) if kind == "date" else month_day_key(raw)
            return F.struct(
                name_of.alias("kind"), pos.cast("int").alias("pos"), plain_raw.alias("raw"), number.alias("value"),
                day.alias("day"), place.alias("place"),
            )

        return F.transform(found, claim)

    t = at
    months = [hits(t[i + 2], p, sign) for i, (p, sign) in enumerate(zip(MONTH_DAYS, "日-/"))]
    numbers = F.filter(hits(tagged, f"{NUMBER}|{TAGGED}"), lambda raw: ~raw.rlike("[\\uE000\\uE001]"))
    found = F.concat(
        claims_of("date", F.concat(hits(t[0], ISO_DATE, "-"), hits(t[1], CHINESE_DATE, "日"))),
        claims_of("month_day", F.concat(*months)),
        claims_of("number", numbers),
    )
    return step.select(*kept, found.alias(name))


def claim_rows(frame: DataFrame, key: str, claims: str, *more: str) -> DataFrame:
    """One row for each element of a claims column.

    An inner explode would bring a filter on the array's size, and a filter goes through the masking steps
    down to the text with all of them repeated inside it.
    """
    columns = ("kind", "pos", "raw", "value", "day", "place", *more)
    rows = frame.select(key, F.explode_outer(claims).alias("c")).where(F.col("c").isNotNull())
    return rows.select(key, *[f"c.{c}" for c in columns])


def extract_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """All numbers, percentages, dates and month-days of every whole text, one row each (`claims_column`)."""
    return claim_rows(claims_column(texts.select(key, text), text, "claims"), key, "claims")


def evidence_cells(
    table: DataFrame, key: str, numbers: Sequence[str], days: Sequence[str]
) -> DataFrame:
    """Table cells as long rows: key, column name, number and day."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).cast("double").alias("number"),
            F.lit(None).cast("string").alias("day"),
        )
        for c in numbers
    ] + [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("number"),
            F.col(c).cast("string").alias("day"),
        )
        for c in days
    ]
    return (
        table.select(key, F.explode(F.array(*cells)).alias("c"))
        .select(key, "c.column_name", "c.number", "c.day")
        .where(F.col("number").isNotNull() | F.col("day").isNotNull())
    )


def string_cells(table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Text cells as long rows: a cell that is a whole number text or date text counts as such, any
    other text of two characters or more is a literal."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.trim(c).alias("text")) for c in columns]
    )
    rows = table.select(key, F.explode(cells).alias("c")).select(key, "c.column_name", "c.text")
    text = F.col("text")
    plain = text.rlike(f"^(?:{NUMBER})$") & ~text.rlike("[%％]$")
    is_date = text.rlike(f"^(?:{ISO_DATE})$") | text.rlike(f"^(?:{CHINESE_DATE})$")
    return rows.where(text.isNotNull()).select(
        key,
        "column_name",
        F.when(plain, number_value(text)).alias("number"),
        F.when(is_date, date_key(text)).alias("day"),
        F.when(~plain & (F.length(text) >= 2), text).alias("literal"),
    )


def mask_present(text: Column, literals: Column) -> Column:
    """A text with every one of its literals blanked where it stands alone, the longest that begins at a place
    first: one alternation, of the literals that occur in the text."""
    present = F.filter(F.array_distinct(literals), lambda l: F.contains(text, l))
    longest = F.transform(
        F.array_sort(F.transform(present, lambda l: F.struct((-F.length(l)).alias("o"), l.alias("l")))), lambda x: x["l"]
    )
    # Quoting ends where a literal holds its end mark, so the mark itself is written out.
    quoted = F.transform(longest, lambda l: F.concat(F.lit(r"\Q"), F.replace(l, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])"))
    return F.when(F.size(present) > 0, F.regexp_replace(text, pattern, F.lit(" "))).otherwise(text)


def mask_literals(texts: DataFrame, key: str, text: str, literals: DataFrame) -> DataFrame:
    """Texts with every literal of their own key blanked (`mask_present`).

    The literals of a key are gathered without its text; `literals` should have few a key.
    """
    gathered = literals.where(F.col("literal").isNotNull()).groupBy(key).agg(F.collect_set("literal").alias("_literals"))
    nothing = F.array().cast("array<string>")
    return (
        texts.join(gathered, key, "left")
        .withColumn(text, mask_present(F.col(text), F.coalesce("_literals", nothing)))
        .drop("_literals")
    )


MANY_CELLS = 1000


def gathered_cells(cells: DataFrame, key: str) -> DataFrame:
    """key, numbers, days, literals: the distinct cells of each key as arrays."""
    return cells.groupBy(key).agg(
        *[F.collect_set(c).alias(f"_{c}s") for c in ("number", "day", "literal")],
    )


def identifier_values(text: Column) -> Column:
    """Digit groups of the identifiers in a text, as an array of numbers."""
    digits = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)),
            lambda found: F.regexp_extract_all(found, F.lit(r"\d+"), F.lit(0)),
        )
    )
    return F.transform(digits, lambda d: d.try_cast("double"))


def supported(claim: Column, numbers: Column, days: Column) -> Column:
    """Whether some cell supports a claim: a number within 0.5 % of the cell, a percentage also as a
    hundredth, a date or month-day exactly."""
    def near(value: Column) -> Column:
        def fits(cell: Column) -> Column:
            size, stated = F.abs(cell), F.abs(value) * 200
            return (F.signum(cell) == F.signum(value)) & (size * 199 <= stated) & (stated <= size * 201)

        return F.exists(numbers, fits)

    value, day = claim["value"], claim["day"]
    return F.coalesce(
        (value.isNotNull() & (near(value) | ((claim["kind"] == "percentage") & near(value / 100))))
        | (day.isNotNull() & F.exists(days, lambda d: (d == day) | (F.substring(d, 6, 5) == day))),
        F.lit(False),
    )


def needs_evidence(
    claim: Column, values: Column, days: Column, codes: Column, cell_days: Column, row_count: Column
) -> Column:
    """Whether a claim is none of the exempt ones: in the question or owned text, a code of the result, the
    number of its rows, a list ordinal or count, a threshold of zero, a bare year of a date cell."""
    def among(value: Column, known: Column) -> Column:
        return F.exists(known, lambda k: k == value)

    value, place, number = claim["value"], claim["place"], claim["kind"] == "number"
    in_context = among(value, values) | ((claim["kind"] == "percentage") & among(value / 100, values))
    day_known = F.exists(days, lambda d: d == claim["day"])
    within = value.between(F.when(place == "ordinal", 1).otherwise(0), row_count)
    presented = (place == "zero") | (place.isin("ordinal", "count") & within)
    year = F.exists(cell_days, lambda d: F.substring(d, 1, 4).cast("double") == value)
    rules = (in_context, day_known, among(value, codes), number & (value == row_count), presented, number & year)
    return ~reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])


def check_in_rows(answers: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Checked claims with their flag, from one row per answer that holds its cells as arrays."""
    nothing = {c: F.array().cast(f"array<{t}>") for c, t in (("number", "double"), ("day", "string"), ("literal", "string"))}
    rows = answers.join(gathered_cells(cells, key), key, "left").select(
        key,
        "answer",
        F.concat_ws("\n", "question", "exempt_text").alias("_owned"),
        F.col("row_count").cast("double").alias("_rows"),
        *[F.coalesce(f"_{c}s", nothing[c]).alias(f"_{c}s") for c in nothing],
    )
    rows = rows.withColumn("answer", mask_present(F.col("answer"), F.col("_literals")))
    rows = claims_column(claims_column(rows, "answer", "_claims"), "_owned", "_context")
    context_numbers = F.filter("_context", lambda c: c["value"].isNotNull())
    values = F.concat(
        F.transform(context_numbers, lambda c: c["value"]),
        F.transform(F.filter(context_numbers, lambda c: c["kind"] == "percentage"), lambda c: c["value"] / 100),
        identifier_values(F.col("_owned")),
    )
    context_days = F.filter("_context", lambda c: c["day"].isNotNull())
    days = F.concat(
        F.transform(context_days, lambda c: c["day"]),
        F.transform(F.filter(context_days, lambda c: c["kind"] == "date"), lambda c: F.substring(c["day"], 6, 5)),
    )
    codes = F.flatten(F.transform("_literals", identifier_values))
    rows = rows.select("*", values.alias("_values"), days.alias("_owned_days"), codes.alias("_codes"))
    kept = F.filter(
        "_claims",
        lambda c: needs_evidence(c, F.col("_values"), F.col("_owned_days"), F.col("_codes"), F.col("_days"), F.col("_rows")),
    )
    flagged = F.transform(kept, lambda c: c.withField("matched", supported(c, F.col("_numbers"), F.col("_days"))))
    return claim_rows(rows.select(key, flagged.alias("_found")), key, "_found", "matched")


def check_answers(answers: DataFrame, cells: DataFrame, key: str, many: int = MANY_CELLS) -> DataFrame:
    """Claims of each answer that need evidence, each with a flag whether a cell of its result supports it.

    `answers` has the key, answer, question, exempt_text and row_count; `cells` has number, day and literal
    per cell of the answer's result. An answer meets its cells in one row; answers with more than `many`
    cells, which would make that row large, are checked by joins instead, to the same result.
    """
    large = cells.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > many).select(key)
    if large.isEmpty():
        return check_in_rows(answers, cells, key)
    small = check_in_rows(*(t.join(large, key, "left_anti") for t in (answers, cells)), key)
    wide, its_cells = (t.join(large, key, "left_semi") for t in (answers, cells))
    return small.unionByName(match_claims(checked_claims(wide, its_cells, key), its_cells, key))


def checked_claims(answers: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Claims of each answer that need evidence.

    `answers` has the key, answer, question, exempt_text and row_count; `cells` has number, day and
    literal per cell of the answer's result.
    """
    masked = mask_literals(answers, key, "answer", cells)
    claims = extract_claims(masked, key, "answer")
    owned = answers.select(key, F.concat_ws("\n", "question", "exempt_text").alias("owned"))
    kept = exempt_context(claims, owned, key, "owned")
    codes = identifier_numbers(cells.where(F.col("literal").isNotNull()), key, "literal")
    kept = kept.join(codes, [key, "value"], "left_anti").select(*claims.columns)
    kept = exempt_row_count(kept, answers, key)
    kept = exempt_presentation(kept, answers, key)
    return exempt_years(kept, cells, key)


BUCKET_WIDTH = 0.02


def magnitude_bucket(value: Column) -> Column:
    """Logarithmic bucket of a positive number, 2 % wide."""
    return F.floor(F.ln(value) / F.log1p(F.lit(BUCKET_WIDTH))).cast("bigint")


def smallest_above(
    asked: DataFrame, offered: DataFrame, keys: Sequence[str], reach: float
) -> DataFrame:
    """For each asked position the smallest offered position at or above it, up to `reach` times.

    Both sides carry `at` > 0. Rows meet by magnitude bucket, and a single ordered pass over each
    bucket finds the neighbour, so no pairs are formed however many rows share the keys. A reach of
    at most one bucket width touches at most two buckets.
    """
    others = [c for c in asked.columns if c not in (*keys, "at")]
    buckets = F.array_distinct(
        F.array(magnitude_bucket(F.col("at")), magnitude_bucket(F.col("at") * reach))
    )
    probes = asked.select("*", F.explode(buckets).alias("bucket"), F.lit(1).alias("is_probe"))
    cells = offered.select(
        *keys, "at", magnitude_bucket(F.col("at")).alias("bucket"), F.lit(0).alias("is_probe"),
        *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in others],
    )
    downward = Window.partitionBy(*keys, "bucket").orderBy(F.desc("at"), "is_probe")
    so_far = downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.last(F.when(F.col("is_probe") == 0, F.col("at")), True).over(so_far)
    return (
        probes.unionByName(cells)
        .withColumn("nearest", nearest)
        .where((F.col("is_probe") == 1) & F.col("nearest").isNotNull())
        .select(*keys, *others, "at", "nearest")
    )


def band_matches(wanted: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Distinct (key, value) pairs of `wanted` within 0.5 % of some cell of the same key.

    The test |v - c| <= 0.5 % |c| is 199 |c| <= 200 |v| <= 201 |c|, which is exact for whole
    numbers. Both bounds grow with c, so the smallest cell with 201 |c| >= 200 |v| decides.
    """
    asked = wanted.select(key, "value").distinct().where("value != 0").select(
        key, F.signum("value").alias("side"), "value", (F.abs("value") * 200).alias("at")
    )
    offered = cells.where("number != 0").select(key, "number").distinct().select(
        key, F.signum("number").alias("side"), (F.abs("number") * 201).alias("at")
    )
    found = smallest_above(asked, offered, [key, "side"], 1.0102)
    supported = found.where(F.col("nearest") / 201 * 199 <= F.col("at")).select(key, "value")
    zeros = cells.where("number = 0").select(key, F.lit(0.0).alias("value"))
    return supported.unionByName(zeros).distinct()


def covered_cells(cells: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Distinct (key, value) pairs of `cells` that have some value within 0.5 % of the cell."""
    asked = cells.select(key, "value").distinct().where("value != 0").select(
        key, F.signum("value").alias("side"), "value", (F.abs("value") * 199).alias("at")
    )
    offered = values.select(key, F.col("value").alias("number")).distinct().where(
        "number != 0"
    ).select(key, F.signum("number").alias("side"), (F.abs("number") * 200).alias("at"))
    found = smallest_above(asked, offered, [key, "side"], 1.0102)
    covered = found.where(F.col("nearest") <= F.abs("value") * 201).select(key, "value")
    zeros = values.where("value = 0").select(key, "value").join(
        cells.where("value = 0").select(key, "value").distinct(), [key, "value"], "left_semi"
    )
    return covered.unionByName(zeros).distinct()


def values_without_match(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Distinct expected values of a group that no actual value of the group matches."""
    wanted = expected.select(key, "value").distinct()
    return wanted.join(covered_cells(wanted, actual, key), [key, "value"], "left_anti")


def match_claims(claims: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Every claim with a flag whether some cell of the same key supports it.

    Numbers match within 0.5 % of the cell, percentages also as a hundredth, dates and month-days
    exactly.
    """
    numbers = claims.where(F.col("value").isNotNull())
    as_share = numbers.where("kind = 'percentage'").withColumn("value", F.col("value") / 100)
    wanted = numbers.select(key, "value").unionByName(as_share.select(key, "value"))
    supported = band_matches(wanted, cells, key)
    hit = supported.withColumn("hit", F.lit(True))
    share_hit = hit.select(key, F.col("value").alias("share"), F.col("hit").alias("share_hit"))
    days = cells.where(F.col("day").isNotNull()).select(key, "day").distinct()
    day_hit = days.unionByName(days.select(key, F.substring("day", 6, 5).alias("day"))).distinct()
    day_hit = day_hit.withColumn("day_hit", F.lit(True))
    matched = (
        F.coalesce("hit", F.lit(False))
        | F.coalesce("share_hit", F.lit(False))
        | F.coalesce("day_hit", F.lit(False))
    )
    return (
        claims.withColumn("share", F.when(F.col("kind") == "percentage", F.col("value") / 100))
        .join(hit, [key, "value"], "left")
        .join(share_hit, [key, "share"], "left")
        .join(day_hit, [key, "day"], "left")
        .select(*claims.columns, matched.alias("matched"))
    )


def identifier_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Digit groups of the identifiers in a text, as numbers of the context."""
    return texts.select(key, F.explode(identifier_values(F.col(text))).alias("value")).distinct()


def exempt_context(claims: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Claims without those whose number or day already occurs in the question or other owned text.

    A percentage counts with its value and with its hundredth on both sides; the digits of
    identifiers in the text count as numbers.
    """
    context = extract_claims(texts, key, text)
    numbers = context.where(F.col("value").isNotNull())
    values = (
        numbers.select(key, "value")
        .unionByName(numbers.where("kind = 'percentage'").select(key, (F.col("value") / 100).alias("value")))
        .unionByName(identifier_numbers(texts, key, text))
        .distinct()
    )
    days = context.where(F.col("day").isNotNull())
    all_days = days.select(key, "day").unionByName(
        days.where("kind = 'date'").select(key, F.substring("day", 6, 5).alias("day"))
    )
    hundredths = values.withColumnRenamed("value", "hundredth")
    return (
        claims.withColumn("hundredth", F.when(F.col("kind") == "percentage", F.col("value") / 100))
        .join(values, [key, "value"], "left_anti")
        .join(hundredths, [key, "hundredth"], "left_anti")
        .join(all_days.distinct(), [key, "day"], "left_anti")
        .select(*claims.columns)
    )


def exempt_row_count(claims: DataFrame, row_counts: DataFrame, key: str) -> DataFrame:
    """Claims without plain numbers that only state the number of result rows."""
    stated = row_counts.select(key, F.col("row_count").cast("double").alias("stated"))
    restated = (F.col("kind") == "number") & (F.col("value") == F.col("stated"))
    return (
        claims.join(stated, key, "left").where(~F.coalesce(restated, F.lit(False))).drop("stated")
    )


def exempt_years(claims: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Claims without bare years that occur in a date cell."""
    years = (
        cells.where(F.col("day").isNotNull())
        .select(key, F.substring("day", 1, 4).cast("double").alias("value"))
        .distinct()
        .withColumn("year_seen", F.lit(True))
    )
    return (
        claims.join(years, [key, "value"], "left")
        .where(~((F.col("kind") == "number") & F.coalesce("year_seen", F.lit(False))))
        .drop("year_seen")
    )


def exempt_presentation(claims: DataFrame, row_counts: DataFrame, key: str) -> DataFrame:
    """Claims without list ordinals and counts up to the number of result rows, and without zero as
    a comparison threshold."""
    within = F.col("value").between(
        F.when(F.col("place") == "ordinal", 1).otherwise(0), F.col("row_count")
    )
    free = (F.col("place") == "zero") | (F.col("place").isin("ordinal", "count") & within)
    return (
        claims.join(row_counts.select(key, "row_count"), key, "left")
        .where(~F.coalesce(free, F.lit(False)))
        .drop("row_count")
    )


def verdicts(matched: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Checked and unmatched claims per answer; an answer without claims passes."""
    per_answer = matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("checked_count"),
        F.count_if(~F.col("matched")).alias("unmatched_count"),
    )
    unmatched = F.coalesce("unmatched_count", F.lit(0))
    return answers.select(key).join(per_answer, key, "left").select(
        key,
        F.coalesce("checked_count", F.lit(0)).alias("checked_count"),
        unmatched.alias("unmatched_count"),
        F.when(unmatched > 0, "fail").otherwise("pass").alias("verdict"),
    )
