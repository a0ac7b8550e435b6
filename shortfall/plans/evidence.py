"""Evidence checks, grading and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.functions.dates import calendar_pattern
from shortfall.functions.numbers import round_to
from shortfall.operators import evidence, grading, retrieval
from shortfall.oracle.ctes import rnd
from shortfall.plans.registry import query
from shortfall.sources import derived

# The same extraction in a dialect without look-around: every run of word characters gets a start
# mark \\x01 and an end mark \\x02, and the patterns ask for the marks.


def marked(text: str, word: str = "A-Za-z0-9") -> str:
    return f"regexp_replace({text}, '([{word}]+)', chr(1) || '\\1' || chr(2), 'g')"


def around(text: str, signs: str) -> str:
    """Different marks 3 and 4 where the run touches one of the signs."""
    before = f"regexp_replace({text}, '([{signs}])\\x01', '\\1' || chr(3), 'g')"
    return f"regexp_replace({before}, '\\x02([{signs}])', chr(4) || '\\1', 'g')"


def unmarked(text: str) -> str:
    return f"translate({text}, chr(1) || chr(2) || chr(3) || chr(4), '')"


SQL_ISO = r"\x01" + calendar_pattern(r"\x02-\x01", r"\x02-\x01", r"\x02")
SQL_CHINESE = r"\x01" + calendar_pattern(r"\x02\s*年\s*\x01", r"\x02\s*月\s*\x01", r"\x02\s*日")
SQL_IDENTIFIER = r"\x01[A-Z][A-Z0-9]*\x02([-_]\x01[A-Z0-9]+\x02)+"
SQL_MONTH_DAYS = (
    r"\x01" + evidence.MONTH + r"\x02\s*月\s*\x01" + evidence.DAY + r"\x02\s*日",
    r"\x01" + evidence.MONTH + r"\x04-\x03" + evidence.DAY + r"\x02",
    r"\x01" + evidence.MONTH + r"\x04/\x03" + evidence.DAY + r"\x02",
)
SQL_NUMBER = (
    r"(?:(?:±|[+\-−])?\x01(?:\d{1,3}\x02(?:[,，]\x01\d{3}\x02)+|\d+\x02)|\x{E000}(?:[,，]\x01\d{3}\x02)*)"
    r"(?:\.(?:\x01\d+\x02|[\x{E000}\x{E001}]))?[%％]?"
)


def mask_step(source: str, name: str, pattern: str, mask: str, text: str) -> str:
    """Keeps the marked text as <name>m, and the text after masking as <name>."""
    return (
        f"SELECT *, {unmarked(f"regexp_replace({name}m, '{pattern}', {mask}, 'g')")} AS {name} "
        f"FROM (SELECT *, {text} AS {name}m FROM {source})"
    )


NUMBER_TEXT = (
    f"regexp_replace(regexp_replace({marked('s5', 'A-Za-z0-9_')}, '([\\x02\\x{{E000}}])[+\\-−±]', '\\1 ', 'g'), "
    "'[%％]([\\x01\\x{E000}\\x{E001}])', chr(3) || '\\1', 'g')"
)
DOCUMENT_CLAIMS = {
    # Every seventh text has its digits widened, so that both kinds occur.
    "wide_documents": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN translate(text, '0123456789', '{evidence.WIDE_DIGITS}') ELSE text END AS wide FROM documents""",
    "step0": mask_step("wide_documents", "s0", SQL_IDENTIFIER, "' '", marked(f"translate(wide, '{evidence.WIDE_DIGITS}', '0123456789')")),
    "step1": mask_step("step0", "s1", SQL_ISO, "chr(57344)", marked("s0")),
    "step2": mask_step("step1", "s2", SQL_CHINESE, "chr(57345)", marked("s1")),
    "step3": mask_step("step2", "s3", SQL_MONTH_DAYS[0], "chr(57345)", marked("s2")),
    "step4": mask_step("step3", "s4", SQL_MONTH_DAYS[1], "chr(57344)", around(marked("s3"), ".\\-")),
    "step5": mask_step("step4", "s5", SQL_MONTH_DAYS[2], "chr(57344)", around(marked("s4"), "./\\-")),
    "hits": f"""SELECT doc_id, 'date' AS kind, unnest(list_concat(regexp_extract_all(s1m, '{SQL_ISO}'), regexp_extract_all(s2m, '{SQL_CHINESE}'))) AS raw FROM step5
        UNION ALL SELECT doc_id, 'month_day', unnest(list_concat(list_concat(regexp_extract_all(s3m, '{SQL_MONTH_DAYS[0]}'),
          regexp_extract_all(s4m, '{SQL_MONTH_DAYS[1]}')), regexp_extract_all(s5m, '{SQL_MONTH_DAYS[2]}'))) FROM step5
        UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all({NUMBER_TEXT}, '{SQL_NUMBER}')) FROM step5""",
    "document_claims": f"""SELECT doc_id, CASE WHEN kind = 'number' AND regexp_matches(raw, '[%％]$') THEN 'percentage' ELSE kind END AS kind,
        CASE WHEN kind = 'number' THEN translate({unmarked('raw')}, '−,，%％±+', '-')::DOUBLE END AS value,
        CASE kind WHEN 'date' THEN lpad(d[1], 4, '0') || '-' || lpad(d[2], 2, '0') || '-' || lpad(d[3], 2, '0')
          WHEN 'month_day' THEN lpad(d[1], 2, '0') || '-' || lpad(d[2], 2, '0') END AS day
        FROM (SELECT *, regexp_extract_all({unmarked('raw')}, '[0-9]+') AS d FROM hits
          WHERE NOT contains(raw, chr(57344)) AND NOT contains(raw, chr(57345)))""",
}


@query("claim_extract", "SELECT doc_id, kind, value, day FROM document_claims", DOCUMENT_CLAIMS)
def claim_extract(p):
    wide = F.translate("text", "0123456789", evidence.WIDE_DIGITS)
    texts = p.read("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, wide).otherwise(F.col("text")).alias("text"))
    claims = evidence.extract_claims(texts, "doc_id", "text")
    return claims.select("doc_id", "kind", "value", "day")


CLAIM_TABLES = {
    "answers": """SELECT material_pn AS answer_id, gap_date, doi_days, supplier_concentration, min_lt, gap_qty, primary_supplier_id,
        CASE WHEN material_pn % 5 = 0 THEN ceil(gap_qty * 1.02::DOUBLE)::BIGINT + 1 ELSE gap_qty END AS stated FROM risk_detail""",
    # A right bay is a literal of the table and a right supplier the number of a code in it, so neither is a claim.
    "claims": f"""SELECT answer_id, primary_supplier_id, 'number' AS kind, stated::DOUBLE AS value, NULL AS day FROM answers
        UNION ALL SELECT answer_id, primary_supplier_id, 'number', {rnd("doi_days", 1)}, NULL FROM answers
        UNION ALL SELECT answer_id, primary_supplier_id, 'percentage', supplier_concentration, NULL FROM answers
        UNION ALL SELECT answer_id, primary_supplier_id, 'number', 100 + (answer_id + 1) % 800, NULL FROM answers WHERE answer_id % 9 = 0
        UNION ALL SELECT answer_id, primary_supplier_id, 'number', primary_supplier_id + 40, NULL FROM answers WHERE answer_id % 11 = 0
        UNION ALL SELECT answer_id, primary_supplier_id, 'date', NULL, gap_date::VARCHAR FROM answers WHERE gap_date IS NOT NULL""",
    "checked": """SELECT answer_id, kind, value, day FROM claims WHERE NOT coalesce(value IN (14, 28, answer_id, primary_supplier_id), false)
        AND NOT coalesce(kind = 'percentage' AND value / 100 IN (14, 28, answer_id), false)
        AND NOT coalesce(kind = 'number' AND value = 1, false)""",
    "cells": """SELECT answer_id, unnest([gap_qty::DOUBLE, doi_days, supplier_concentration, min_lt::DOUBLE]) AS number,
        gap_date::VARCHAR AS day FROM answers""",
    "years_of": "SELECT answer_id, year(gap_date)::DOUBLE AS y FROM answers WHERE gap_date IS NOT NULL",
    "matched": """SELECT c.*, EXISTS (SELECT 1 FROM cells e WHERE e.answer_id = c.answer_id AND (
          (kind <> 'date' AND (199 * number <= 200 * value AND 200 * value <= 201 * number))
          OR (kind = 'percentage' AND 199 * number <= 200 * (value / 100) AND 200 * (value / 100) <= 201 * number)
          OR (kind = 'date' AND e.day = c.day))) AS matched
        FROM checked c WHERE NOT EXISTS (SELECT 1 FROM years_of y WHERE y.answer_id = c.answer_id AND kind = 'number' AND y.y = value)""",
}


def answer_claims(p) -> tuple[DataFrame, DataFrame]:
    """Answers, and their claims after all exemptions, each with a flag whether a cell supports it."""
    answers, cells = derived.answers(p), evidence_rows(p)
    named = p.stored_risk.select(
        F.col("material_pn").alias("answer_id"),
        derived.bay(F.col("material_pn")).alias("bay"),
        derived.supplier_code(F.col("primary_supplier_id")).alias("supplier"),
    )
    cells = cells.unionByName(evidence.string_cells(named, "answer_id", ["bay", "supplier"]), allowMissingColumns=True)
    return answers, evidence.check_answers(answers, cells, "answer_id")


def evidence_rows(p) -> DataFrame:
    table = p.stored_risk.withColumnRenamed("material_pn", "answer_id")
    return evidence.evidence_cells(
        table, "answer_id", ["gap_qty", "doi_days", "supplier_concentration", "min_lt"], ["gap_date"]
    )


@query(
    "evidence_cells",
    " UNION ALL ".join(
        [f"SELECT material_pn AS answer_id, '{c}' AS column_name, {c}::DOUBLE AS number, NULL::VARCHAR AS day FROM risk_detail"
         for c in ("gap_qty", "doi_days", "supplier_concentration", "min_lt")]
        + ["SELECT material_pn, 'gap_date', NULL, gap_date::VARCHAR FROM risk_detail WHERE gap_date IS NOT NULL"]
    ),
)
def evidence_cells(p):
    return evidence_rows(p)


@query("claim_match", "SELECT answer_id, kind, value, day, matched FROM matched", CLAIM_TABLES)
def claim_match(p):
    _, matched = answer_claims(p)
    return matched.select("answer_id", "kind", "value", "day", "matched")


@query(
    "claim_verdict",
    """SELECT a.answer_id, count(m.answer_id) AS checked_count, count(*) FILTER (WHERE NOT m.matched) AS unmatched_count,
       CASE WHEN count(*) FILTER (WHERE NOT m.matched) > 0 THEN 'fail' ELSE 'pass' END AS verdict
       FROM answers a LEFT JOIN matched m USING (answer_id) GROUP BY a.answer_id""",
    CLAIM_TABLES,
)
def claim_verdict(p):
    answers, matched = answer_claims(p)
    return evidence.verdicts(matched, answers, "answer_id")


# One question per item group: which materials are RED (gold) against which are RED or ORANGE and
# have a gap (response); every third group is refused, and its category is adversarial.
GRADES = {
    "groups": """SELECT DISTINCT item_group AS question_id, commodity AS category,
        (length(item_group) + ascii(right(item_group, 1))) % 3 = 0 AS refused FROM materials""",
    "gold": """SELECT item_group AS question_id, gap_qty::DOUBLE AS value FROM material_risk JOIN materials USING (material_pn)
        WHERE risk_level = 'RED'""",
    "response": """SELECT item_group AS question_id, gap_qty::DOUBLE AS value FROM material_risk JOIN materials USING (material_pn)
        WHERE risk_level = 'RED' OR (gap_qty > 0 AND supplier_concentration > 60)""",
    "dg": "SELECT DISTINCT question_id, value FROM gold",
    "dr": "SELECT DISTINCT question_id, value FROM response",
    "graded": """SELECT g.question_id, g.category, g.refused,
        NOT g.refused AND NOT EXISTS (SELECT 1 FROM dg WHERE dg.question_id = g.question_id AND NOT EXISTS (
          SELECT 1 FROM dr WHERE dr.question_id = dg.question_id AND 199 * dg.value <= 200 * dr.value AND 200 * dr.value <= 201 * dg.value)) AS superset_ok,
        (SELECT count(*) FROM dg WHERE dg.question_id = g.question_id) AS gold_n,
        (SELECT count(*) FROM dr WHERE dr.question_id = g.question_id) AS response_n FROM groups g""",
}


def graded(p) -> DataFrame:
    rows = p.stored_risk.join(p.materials, "material_pn").withColumnRenamed("item_group", "question_id")
    value = F.col("gap_qty").cast("double").alias("value")
    gold = rows.where("risk_level = 'RED'").select("question_id", value)
    response = rows.where("risk_level = 'RED' OR (gap_qty > 0 AND supplier_concentration > 60)").select(
        "question_id", value
    )
    label = F.length("item_group") + F.ascii(F.right(F.col("item_group"), F.lit(1)))
    questions = p.materials.select(
        F.col("item_group").alias("question_id"), F.col("commodity").alias("category"),
        (label % 3 == 0).alias("refused"),
    ).distinct()
    return grading.grade_sets(questions, gold, response, "question_id")


@query(
    "grade_rates",
    f"""SELECT category, count(*) AS questions, count(*) FILTER (WHERE superset_ok AND gold_n = response_n) AS exact_passed,
        count(*) FILTER (WHERE superset_ok) AS superset_passed, count(*) FILTER (WHERE refused) AS refused,
        {rnd("count(*) FILTER (WHERE superset_ok) * 100 / count(*)", 2)} AS superset_pct FROM graded GROUP BY category""",
    GRADES,
)
def grade_rates(p):
    return grading.rates(graded(p), "category")


@query(
    "paired_arms",
    """SELECT count(*) AS questions, count(*) FILTER (WHERE exact) AS first_passed, count(*) FILTER (WHERE superset_ok) AS second_passed,
       count(*) FILTER (WHERE superset_ok AND NOT exact) AS improved, count(*) FILTER (WHERE exact AND NOT superset_ok) AS regressed
       FROM (SELECT *, superset_ok AND gold_n = response_n AS exact FROM graded)""",
    GRADES,
)
def paired_arms(p):
    both = graded(p)
    first = both.select("question_id", F.col("exact_ok").alias("passed"))
    second = both.select("question_id", F.col("superset_ok").alias("passed"))
    return grading.paired(first, second, "question_id")


@query(
    "paired_changes",
    """SELECT question_id, CASE WHEN superset_ok THEN 'improved' ELSE 'regressed' END AS change
       FROM (SELECT *, superset_ok AND gold_n = response_n AS exact FROM graded) WHERE superset_ok <> exact""",
    GRADES,
)
def paired_changes(p):
    """The questions themselves that improved or regressed."""
    both = graded(p)
    arms = (both.select("question_id", F.col(c).alias("passed")) for c in ("exact_ok", "superset_ok"))
    return grading.changed(*arms, "question_id")


# Materials of an item group by id or by name: the gold rows are the RED ones; the response has other columns
# in another order. The check of a question follows from its group, and one question names its answer.
COLUMN_GRADES = {
    "asked": """SELECT item_group AS question_id, any_value(commodity) AS category, (length(item_group) + ascii(right(item_group, 1))) % 5 = 0 AS refused,
        (['exact_set', 'superset', 'contains_values'])[(ascii(right(item_group, 1)) + length(item_group)) % 3 + 1] AS kind,
        'What is short in ' || item_group || ', besides ' || min(material_pn) || '?' AS question FROM materials GROUP BY item_group""",
    "gold_rows": """SELECT item_group AS question_id, gap_qty::DOUBLE AS gap, material_name AS name, material_pn::VARCHAR AS pn,
        row_number() OVER (PARTITION BY item_group ORDER BY material_pn) - 1 AS rn FROM material_risk JOIN materials USING (material_pn) WHERE risk_level = 'RED'""",
    "gold_cells": """SELECT question_id, 0 AS gc, rn, gap AS number, NULL::VARCHAR AS text FROM gold_rows
        UNION ALL SELECT question_id, 1, rn, NULL, name FROM gold_rows""",
    "response_rows": """SELECT item_group AS question_id, doi_days AS doi, material_name AS name, gap_qty * 1.004::DOUBLE AS gap
        FROM material_risk JOIN materials USING (material_pn) WHERE risk_level = 'RED' OR (gap_qty > 0 AND supplier_concentration > 60)""",
    "response_cells": """SELECT question_id, 0 AS rc, doi AS number, NULL::VARCHAR AS text FROM response_rows
        UNION ALL SELECT question_id, 1, gap, NULL FROM response_rows
        UNION ALL SELECT question_id, 2, NULL, name FROM response_rows WHERE length(question_id) % 2 = 0""",
    "dgc": "SELECT DISTINCT question_id, gc, number, text FROM gold_cells",
    "drc": "SELECT DISTINCT question_id, rc, number, text FROM response_cells",
    "fits": """SELECT g.question_id, gc, rc, bool_and(EXISTS (SELECT 1 FROM drc r WHERE r.question_id = g.question_id AND r.rc = p.rc
        AND ((199 * g.number <= 200 * r.number AND 200 * r.number <= 201 * g.number) OR r.text = g.text))) AS holds, count(*) AS gold_n
        FROM dgc g JOIN (SELECT DISTINCT question_id, rc FROM drc) p USING (question_id) GROUP BY g.question_id, gc, rc""",
    "sized": "SELECT f.*, (SELECT count(*) FROM drc r WHERE r.question_id = f.question_id AND r.rc = f.rc) AS response_n FROM fits f",
    "column_graded": """SELECT a.*, NOT refused AND CASE kind
        WHEN 'exact_set' THEN EXISTS (SELECT 1 FROM sized s WHERE s.question_id = a.question_id AND holds AND gold_n = response_n)
        WHEN 'superset' THEN EXISTS (SELECT 1 FROM sized s WHERE s.question_id = a.question_id AND holds)
        ELSE NOT EXISTS (SELECT 1 FROM gold_cells g WHERE g.question_id = a.question_id AND rn = 0
          AND NOT contains(a.question, coalesce(g.text, g.number::BIGINT::VARCHAR))
          AND NOT EXISTS (SELECT 1 FROM response_cells r WHERE r.question_id = g.question_id
            AND ((199 * g.number <= 200 * r.number AND 200 * r.number <= 201 * g.number) OR r.text = g.text))) END AS passed FROM asked a""",
}


@query(
    "grade_columns",
    f"""SELECT category, kind AS "check", count(*) AS questions, count(*) FILTER (WHERE passed) AS passed,
        {rnd("count(*) FILTER (WHERE passed) * 100 / count(*)", 2)} AS passed_pct FROM column_graded GROUP BY category, kind""",
    COLUMN_GRADES,
)
def grade_columns(p):
    """Rates by category and check: any gold column against any response column, and contained values."""
    rows = p.stored_risk.join(p.materials, "material_pn").withColumnRenamed("item_group", "question_id")
    red = rows.where("risk_level = 'RED'")
    near = rows.where("risk_level = 'RED' OR (gap_qty > 0 AND supplier_concentration > 60)")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def cells(frame: DataFrame, column: str, place: int, number, text, *more) -> DataFrame:
        return frame.select("question_id", F.lit(place).alias(column), number.alias("number"), text.alias("text"), *more)

    # Only the first row of a group is told apart: it has the least number.
    least = red.groupBy("question_id").agg(F.min("material_pn").alias("least"))
    numbered = red.join(least, "question_id").withColumn("row", F.when(F.col("material_pn") == F.col("least"), 0).otherwise(1))
    gap = F.col("gap_qty").cast("double")
    gold = cells(numbered, "gold_column", 0, gap, no_text, "row").unionByName(
        cells(numbered, "gold_column", 1, no_number, F.col("material_name"), "row")
    )
    response = (
        cells(near, "response_column", 0, F.col("doi_days"), no_text)
        .unionByName(cells(near, "response_column", 1, gap * 1.004, no_text))
        .unionByName(cells(near.where(F.length("question_id") % 2 == 0), "response_column", 2, no_number, F.col("material_name")))
    )
    label = F.length("item_group") + F.ascii(F.right(F.col("item_group"), F.lit(1)))
    kind = F.element_at(F.array(*[F.lit(c) for c in grading.CHECKS]), (label % 3 + 1).cast("int"))
    asked = p.materials.groupBy("item_group").agg(F.min("commodity").alias("category"), F.min("material_pn").alias("least"))
    named = F.concat(F.lit("What is short in "), "item_group", F.lit(", besides "), F.col("least").cast("string"), F.lit("?"))
    questions = asked.select(
        F.col("item_group").alias("question_id"), "category", kind.alias("check"), (label % 5 == 0).alias("refused"),
        named.alias("question"),
    )
    graded = grading.grade_columns(questions, gold, response, "question_id")
    total = F.count(F.lit(1))
    return graded.groupBy("category", "check").agg(
        total.alias("questions"),
        F.count_if("passed").alias("passed"),
        round_to(F.count_if("passed") * 100 / total, 2).alias("passed_pct"),
    )


# -- retrieval ---------------------------------------------------------------------------

TOP_K = 4
TOP_SQL = {
    "near": """SELECT q.vec_id AS query_id, x.vec_id, floor(round(s, 9) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS similarity,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, x.vec_id) AS rank FROM (
        SELECT q.vec_id AS qid, x.vec_id AS xid, list_dot_product(q.e, x.e) / (q.n * x.n) AS s FROM v q, v x WHERE q.vec_id <> x.vec_id)
        JOIN v q ON q.vec_id = qid JOIN v x ON x.vec_id = xid""",
    "v": "SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings",
}


def nearest(p) -> DataFrame:
    """Every vector against all others."""
    vectors = p.read("embeddings").select("vec_id", "embedding")
    return retrieval.cosine_top_k(vectors, vectors, TOP_K, leave_one_out=True)


@query("cosine_topk", f"SELECT query_id, rank::INTEGER AS rank, vec_id, similarity FROM near WHERE rank <= {TOP_K}", TOP_SQL)
def cosine_topk(p):
    return nearest(p).withColumn("similarity", round_to(F.col("similarity"), 6))


@query(
    "retrieval_quality",
    f"""SELECT count(*) AS queries, count(*) FILTER (WHERE top1) / count(*) AS top1_same_rate,
        count(*) FILTER (WHERE topk) / count(*) AS topk_same_rate, {rnd("sum(ss) / sum(sc)", 5)} AS similarity_mean,
        min(sm) AS similarity_min FROM (SELECT query_id, bool_or(q.label = x.label AND rank = 1) AS top1, bool_or(q.label = x.label) AS topk,
        sum(similarity) AS ss, count(*) AS sc, min(similarity) AS sm FROM near
        JOIN v q ON q.vec_id = query_id JOIN v x ON x.vec_id = near.vec_id WHERE rank <= {TOP_K} GROUP BY query_id)""",
    TOP_SQL,
)
def retrieval_quality(p):
    top = nearest(p).withColumn("similarity", round_to(F.col("similarity"), 6))
    found = retrieval.retrieval_quality(top, p.read("embeddings").select("vec_id", "label"))
    return found.withColumn("similarity_mean", round_to(F.col("similarity_mean"), 5))


@query(
    "embedding_dims",
    """SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS dimensions, min(len(embedding))::INTEGER AS min_dimension,
       max(len(embedding))::INTEGER AS max_dimension, count(DISTINCT len(embedding)) = 1 AND min(len(embedding)) > 0 AS consistent FROM embeddings""",
)
def embedding_dims(p):
    return retrieval.dimension_check(p.read("embeddings"))
