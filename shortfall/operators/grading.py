"""Grading of result columns against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.functions.numbers import round_to
from shortfall.operators.evidence import values_without_match


def grade_sets(questions: DataFrame, gold: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """Superset and exact-set grades per question; a refused question passes neither.

    A response contains the gold set when every distinct gold value has a response value within
    0.5 %; it is exact when both also have the same number of distinct values.
    """
    missing = values_without_match(gold, response, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("missing")
    )

    def sizes(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(key).agg(F.count_distinct("value").alias(name))

    zero = F.lit(0)
    contains = ~F.col("refused") & (F.coalesce("missing", zero) == 0)
    same_size = F.coalesce("gold_n", zero) == F.coalesce("response_n", zero)
    return (
        questions.join(missing, key, "left")
        .join(sizes(gold, "gold_n"), key, "left")
        .join(sizes(response, "response_n"), key, "left")
        .select(
            *questions.columns, contains.alias("superset_ok"), (contains & same_size).alias("exact_ok")
        )
    )


def pair_up(gold: DataFrame, response: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All (gold column, response column) pairs of a question as a grouping key `pair`, and the cells of both
    sides under it. A side's cells are repeated once per column of the other side, which are few."""
    columns = gold.select(key, "gold_column").distinct().join(response.select(key, "response_column").distinct(), key)
    pairs = columns.select(key, "gold_column", "response_column", F.struct(key, "gold_column", "response_column").alias("pair"))
    return (
        pairs,
        gold.join(pairs, [key, "gold_column"]).select("pair", "number", "text"),
        response.join(pairs, [key, "response_column"]).select("pair", "number", "text"),
    )


def cells_without_match(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Distinct expected cells (number or text) of a group that no actual cell of the group matches."""
    def numbers(cells: DataFrame) -> DataFrame:
        return cells.where(F.col("number").isNotNull()).select(key, F.col("number").alias("value"))

    def texts(cells: DataFrame) -> DataFrame:
        return cells.where(F.col("number").isNull()).select(key, F.col("text").alias("value")).distinct()

    unmatched = values_without_match(numbers(expected), numbers(actual), key)
    unknown = texts(expected).join(texts(actual), [key, "value"], "left_anti")
    return unmatched.withColumn("value", F.col("value").cast("string")).unionByName(unknown)


CHECKS: tuple[str, ...] = ("exact_set", "superset", "contains_values")


def grade_columns(questions: DataFrame, gold: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """Every question with `passed`, by its own check.

    `questions` has the key, check, refused and question text; `gold` and `response` have one row per cell:
    key, column (gold_column, response_column), row number (`row`, gold only), number or text. Superset
    and exact-set checks pass when some response column holds all distinct values of some gold column,
    exact when it also has as many. Contains-values takes the first gold row: each of its values that the
    question does not name itself must be in some response cell. A refused question passes none.
    """
    sets = questions.where(F.col("check").isin("exact_set", "superset")).select(key)
    pairs, wanted, offered = pair_up(gold.join(sets, key, "left_semi"), response.join(sets, key, "left_semi"), key)
    missing = cells_without_match(wanted, offered, "pair").groupBy("pair").agg(F.count(F.lit(1)).alias("missing"))

    def sizes(cells: DataFrame, name: str) -> DataFrame:
        return cells.groupBy("pair").agg(F.count_distinct(F.coalesce(F.col("number").cast("string"), "text")).alias(name))

    holds = F.col("missing").isNull()
    any_pair = (
        pairs.join(missing, "pair", "left")
        .join(sizes(wanted, "gold_n"), "pair", "left")
        .join(sizes(offered, "response_n"), "pair", "left")
        .groupBy(key)
        .agg(
            F.bool_or(holds).alias("superset_ok"),
            F.bool_or(holds & (F.col("gold_n") == F.col("response_n"))).alias("exact_ok"),
        )
    )
    named = questions.where("check = 'contains_values'").select(key, "question")
    first = gold.where("row = 0").join(named, key)
    shown = F.when(F.col("number") == F.floor("number"), F.col("number").cast("bigint").cast("string")).otherwise(
        F.coalesce(F.col("number").cast("string"), "text")
    )
    asked = first.where(~F.col("question").contains(shown)).select(key, "number", "text")
    lacking = cells_without_match(asked, response.join(named, key, "left_semi").select(key, "number", "text"), key)
    passed = (
        F.when(F.col("check") == "exact_set", F.coalesce("exact_ok", F.lit(False)))
        .when(F.col("check") == "superset", F.coalesce("superset_ok", F.lit(False)))
        .otherwise(F.col("lacks").isNull())
    )
    return (
        questions.join(any_pair, key, "left")
        .join(lacking.select(key, F.lit(True).alias("lacks")).distinct(), key, "left")
        .select(*questions.columns, (passed & ~F.col("refused")).alias("passed"))
    )


def rates(graded: DataFrame, category: str) -> DataFrame:
    """Passed questions and percentage per category."""
    total = F.count(F.lit(1))
    return graded.groupBy(category).agg(
        total.alias("questions"),
        F.count_if("exact_ok").alias("exact_passed"),
        F.count_if("superset_ok").alias("superset_passed"),
        F.count_if("refused").alias("refused"),
        round_to(F.count_if("superset_ok") * 100 / total, 2).alias("superset_pct"),
    )


def paired(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two runs over the same questions: passed counts and the questions that changed."""
    a, b = F.col("first_ok"), F.col("second_ok")
    both = first.select(key, F.col("passed").alias("first_ok")).join(
        second.select(key, F.col("passed").alias("second_ok")), key
    )
    return both.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(a).alias("first_passed"),
        F.count_if(b).alias("second_passed"),
        F.count_if(b & ~a).alias("improved"),
        F.count_if(a & ~b).alias("regressed"),
    )


def changed(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The improved and regressed questions themselves."""
    a, b = F.col("first_ok"), F.col("second_ok")
    both = first.select(key, F.col("passed").alias("first_ok")).join(
        second.select(key, F.col("passed").alias("second_ok")), key
    )
    return both.where(a != b).select(key, F.when(b, "improved").otherwise("regressed").alias("change"))
