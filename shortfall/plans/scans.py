"""Scan, sink and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortfall.functions import numbers
from shortfall.functions.numbers import round_to
from shortfall.oracle.ctes import RISK_LIST, rnd
from shortfall.oracle.derived import INTAKE, WIDE, strip
from shortfall.plans.registry import query
from shortfall.plans.tables import day_columns, wide_days
from shortfall.sources import derived, readers, sinks
from shortfall.sources.workspace import freed_shuffles, scratch_path

# -- scans -------------------------------------------------------------------------------


@query(
    "scan_typed",
    """SELECT material_pn::VARCHAR AS material_pn, supplier_id::VARCHAR AS supplier_id, split_pct::DECIMAL(5, 2)::DOUBLE AS split_pct,
       lead_time_days::INTEGER AS lead_time_days, moq::INTEGER AS moq FROM supply_split""",
)
def scan_typed(p):
    path = scratch_path(p.spark, "typed")
    p.supply_split.write.parquet(path)
    typed = readers.read_table(p.spark, path, "supply_split")
    return typed.withColumn("split_pct", F.col("split_pct").cast("double"))


@query(
    "scan_csv_filtered",
    """SELECT 'SKU' || sku_id AS item_id, 'CA_' || sku_id % 3 AS store_id, sum(units_sold)::BIGINT AS units_sold
       FROM sales WHERE sku_id % 2 = 0 AND sku_id % 4 <> 3 AND sku_id % 5 <> 4 GROUP BY sku_id""",
)
def scan_csv_filtered(p):
    """Wide daily sales written as CSV, then scanned with the category, department and store filter."""
    path = scratch_path(p.spark, "wide")
    sku = F.col("sku_id")
    wide = wide_days(p).select(
        F.concat(F.lit("SKU"), sku.cast("string")).alias("item_id"),
        F.when(sku % 4 == 3, "FOODS_2").otherwise("FOODS_3").alias("dept_id"),
        F.when(sku % 2 == 0, "FOODS").otherwise("HOBBIES").alias("cat_id"),
        F.concat(F.when(sku % 5 == 4, "TX_").otherwise("CA_"), (sku % 3).cast("string")).alias("store_id"),
        *day_columns(p),
    )
    with freed_shuffles(p.spark):
        wide.write.option("header", True).csv(path)
    kept = readers.read_wide_sales(p.spark, path, "FOODS", "FOODS_3", "CA_")
    days = F.expr(f"cast(array({', '.join(day_columns(p))}) AS array<bigint>)")
    total = F.aggregate(days, F.lit(0).cast("bigint"), lambda total, units: total + units)
    return kept.select("item_id", "store_id", total.alias("units_sold"))


@query("scan_csv_dates", "SELECT date, weekday, event_name, is_weekend FROM calendar")
def scan_csv_dates(p):
    path = scratch_path(p.spark, "calendar")
    p.calendar.write.option("header", True).option("dateFormat", "yyyy/MM/dd").csv(path)
    schema = "date DATE, weekday STRING, event_name STRING, is_weekend BOOLEAN"
    return readers.read_dated_csv(p.spark, path, schema, "yyyy/MM/dd")


BROKEN = "CASE WHEN event_id % 10 = 7 THEN substring(props, 1, 4) ELSE props END"


@query(
    "scan_json_lines",
    f"""SELECT event_id, CASE WHEN event_id % 10 = 7 THEN NULL ELSE regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER END AS k,
        CASE WHEN event_id % 10 = 7 THEN {BROKEN} END AS bad_line FROM events""",
)
def scan_json_lines(p):
    """JSON texts with every tenth one cut off; good rows give fields, bad ones keep their text."""
    lines = p.read("events").select("event_id", F.expr(BROKEN).alias("line"))
    good, bad = readers.split_json(lines, "line", T.StructType.fromDDL("k INT"))
    return good.withColumn("bad_line", F.lit(None).cast("string")).unionByName(
        bad.select("event_id", F.lit(None).cast("int").alias("k"), F.col("line").alias("bad_line"))
    )


@query(
    "scan_upload",
    """SELECT row_number() OVER (PARTITION BY row_ref[1:12]::BIGINT % 4 ORDER BY row_ref) + 1 AS row_number, row_ref AS source_ref,
       nullif(po_id, '') AS po_id, material_pn, supplier_id, qty, eta_date FROM upload""",
    INTAKE,
)
def scan_upload(p):
    """The whole upload as four untyped CSV files, each in its own order. The row cap is a rule of the intake,
    tested on its own."""
    path = scratch_path(p.spark, "upload")
    rows = derived.upload(p, derived.dropped_lines(p), "drop").withColumnRenamed("row_ref", "source_ref")
    files = rows.write.partitionBy("drop").option("header", True).option("compression", "gzip")
    with freed_shuffles(p.spark):
        files.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_upload(p.spark, path, limit=None).drop("row_ref")


# -- sinks: write, then read back -----------------------------------------------------------


@query("sink_parquet_sorted", f"SELECT {RISK_LIST} FROM material_risk")
def sink_parquet_sorted(p):
    path = scratch_path(p.spark, "sorted")
    sinks.write_sorted(p.material_risk, path, ["material_pn", "eval_date"])
    return p.spark.read.parquet(path)


@query("sink_csv_bom", "SELECT supplier_id::VARCHAR AS supplier_id, supplier_name, region FROM suppliers")
def sink_csv_bom(p):
    path = scratch_path(p.spark, "bom")
    sinks.write_csv_bom(p.suppliers, path)
    return p.spark.read.option("header", True).csv(path)


@query(
    "sink_replace",
    "SELECT sku_id, date, model_name, CAST(CAST(yhat AS DECIMAL(10, 2)) AS DOUBLE) AS yhat FROM published_forecasts",
)
def sink_replace(p):
    """Published forecasts as decimals; all rows of the model before are replaced."""
    path = scratch_path(p.spark, "forecast")
    daily = sinks.published(p.published_forecasts.drop("eval_date"))
    sinks.replace_table(daily.withColumn("yhat", F.lit(-1).cast(sinks.PUBLISHED)), path)
    sinks.replace_table(daily, path)
    return p.spark.read.parquet(path).withColumn("yhat", F.col("yhat").cast("double"))


@query(
    "sink_snapshot_replace",
    f"""SELECT material_pn, eval_date, CASE WHEN eval_date = (SELECT t FROM bounds) THEN risk_level ELSE 'OLD' END AS risk_level,
        gap_qty FROM risk_history""",
)
def sink_snapshot_replace(p):
    """All snapshots are stored under a placeholder level; then today's is replaced, twice."""
    path = scratch_path(p.spark, "snapshots")
    rows = p.snapshots.select("material_pn", "eval_date", "risk_level", "gap_qty")
    sinks.replace_snapshots(rows.withColumn("risk_level", F.lit("OLD")), path)
    today = rows.where(F.col("eval_date") == p.today)
    for _ in range(2):
        sinks.replace_snapshots(today, path)
    return p.spark.read.parquet(path).select("material_pn", "eval_date", "risk_level", "gap_qty")


# -- scalar functions -------------------------------------------------------------------------


@query(
    "scalar_dates",
    """SELECT DISTINCT d AS day, (d + 28)::DATE AS plus_28, (d - 7)::DATE AS minus_7, ((SELECT t FROM bounds) - d)::INTEGER AS days_to_t,
       year(d)::INTEGER AS y, month(d)::INTEGER AS m, weekofyear(d)::INTEGER AS iso_week, (isodow(d) - 1)::INTEGER AS dow,
       date_trunc('week', d)::DATE AS monday, strftime(d, '%Y-%m-%d') AS iso FROM (SELECT o_orderdate::DATE AS d FROM orders)""",
)
def scalar_dates(p):
    days = p.read("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        "day", F.date_add("day", 28).alias("plus_28"), F.date_sub("day", 7).alias("minus_7"),
        F.datediff(p.today, "day").alias("days_to_t"), F.year("day").alias("y"), F.month("day").alias("m"),
        F.weekofyear("day").alias("iso_week"), F.weekday("day").alias("dow"),
        F.date_trunc("week", "day").cast("date").alias("monday"),
        F.date_format("day", "yyyy-MM-dd").alias("iso"),
    )


@query(
    "scalar_strings",
    """SELECT material_pn, upper(material_name) AS upper_name, length(material_name)::INTEGER AS n_chars,
       material_name ILIKE '%RING%' AS has_ring, starts_with(material_name, 'red') AS is_red, ends_with(material_name, 'bolt') AS is_bolt,
       split_part(item_group, '-', 2) AS size_class, replace(material_name, ' ', '_') AS slug,
       concat_ws(';', commodity, item_group) AS joined, nullif(commodity, 'PROMO') AS not_promo FROM materials""",
)
def scalar_strings(p):
    name = F.col("material_name")
    return p.materials.select(
        "material_pn", F.upper(name).alias("upper_name"), F.length(name).alias("n_chars"),
        name.ilike("%RING%").alias("has_ring"), name.startswith("red").alias("is_red"),
        name.endswith("bolt").alias("is_bolt"), F.split("item_group", "-")[1].alias("size_class"),
        F.regexp_replace(name, " ", "_").alias("slug"),
        F.concat_ws(";", "commodity", "item_group").alias("joined"),
        F.nullif("commodity", F.lit("PROMO")).alias("not_promo"),
    )


@query(
    "scalar_numeric_parse",
    f"""SELECT row_ref, qty, CASE WHEN regexp_full_match(w, '[0-9]+') AND w::BIGINT > 0 THEN w::INTEGER END AS strict_qty,
        CASE WHEN regexp_full_match(w, '[1-9][0-9]{{0,2}}(,[0-9]{{3}})+') THEN replace(w, ',', '')::INTEGER
          WHEN regexp_full_match(w, '[0-9]+[.]0+') THEN split_part(w, '.', 1)::INTEGER
          WHEN regexp_full_match(w, '[0-9]+') THEN w::INTEGER END AS repaired_qty,
        coalesce(try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y.%m.%d'), try_strptime(d, '%Y年%m月%d日'),
          CASE WHEN regexp_full_match(d, '[0-9]{{8}}') THEN try_strptime(d, '%Y%m%d') END)::DATE AS repaired_eta
        FROM (SELECT *, {WIDE.format(strip('qty'))} AS w, {strip('eta_date')} AS d FROM upload)""",
    INTAKE,
)
def scalar_numeric_parse(p):
    qty = F.col("qty")
    return derived.upload(p).select(
        "row_ref", "qty", numbers.strict_positive_integer(qty).alias("strict_qty"),
        numbers.repaired_quantity(qty).alias("repaired_qty"),
        numbers.repaired_date(F.col("eta_date")).alias("repaired_eta"),
    )


@query(
    "scalar_decimals",
    f"""SELECT l_linenumber, {rnd("sum(l_quantity) / count(*)", 2)} AS mean_qty, ceil(avg(l_quantity))::BIGINT AS upper_qty,
        least(max(l_quantity), 40.0::DOUBLE) AS capped, greatest(min(l_quantity), 2.0::DOUBLE) AS floored,
        CASE WHEN count(*) FILTER (WHERE l_quantity > 100) = 0 THEN NULL ELSE 1.0::DOUBLE END AS safe_ratio FROM lineitem GROUP BY l_linenumber""",
)
def scalar_decimals(p):
    qty = F.col("l_quantity")
    return p.read("lineitem").groupBy("l_linenumber").agg(
        round_to(F.sum(qty) / F.count(F.lit(1)), 2).alias("mean_qty"),
        F.ceil(F.avg(qty)).cast("bigint").alias("upper_qty"),
        F.least(F.max(qty), F.lit(40.0)).alias("capped"),
        F.greatest(F.min(qty), F.lit(2.0)).alias("floored"),
        F.try_divide(F.count_if(qty > 100), F.count_if(qty > 100)).alias("safe_ratio"),
    )


@query(
    "scalar_json",
    """SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k,
       '{"k":' || regexp_extract(props, '"k": *([0-9]+)', 1) || ',"kind":"' || event_type || '"}' AS dumped FROM events""",
)
def scalar_json(p):
    k = F.from_json("props", "k INT")["k"]
    return p.read("events").select(
        "event_id", k.alias("k"),
        F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("dumped"),
    )


@query("scalar_sha256", "SELECT doc_id, sha256(text) AS text_sha, length(text)::BIGINT AS n FROM documents")
def scalar_sha256(p):
    return p.read("documents").select(
        "doc_id", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("bigint").alias("n")
    )


@query(
    "scalar_vectors",
    f"""SELECT vec_id, len(embedding)::INTEGER AS dims, {rnd("100 + list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))", 6)} AS mirror_dot,
        {rnd("sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))", 6)} AS norm FROM embeddings""",
)
def scalar_vectors(p):
    x = F.transform("embedding", lambda v: v.cast("double"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda l, r: l * r), F.lit(0.0), lambda s, v: s + v)

    return p.read("embeddings").select(
        "vec_id", F.size("embedding").alias("dims"),
        round_to(100 + dot(x, F.reverse(x)), 6).alias("mirror_dot"),
        round_to(F.sqrt(dot(x, x)), 6).alias("norm"),
    )
