"""Declared schemas and keys of the planning tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The declared column types of the planning tables.
SCHEMAS: dict[str, str] = {
    "sales_daily": "sku_id STRING, date DATE, units_sold INT",
    "calendar": "date DATE, weekday STRING, event_name STRING, is_weekend BOOLEAN",
    "prices": "sku_id STRING, week_start DATE, sell_price DECIMAL(8,2)",
    "products": "sku_id STRING, product_name STRING, product_family STRING",
    "materials": "material_pn STRING, material_name STRING, commodity STRING, item_group STRING, "
    "unit_cost DECIMAL(8,4)",
    "bom": "sku_id STRING, material_pn STRING, qty_per_unit DECIMAL(8,3)",
    "suppliers": "supplier_id STRING, supplier_name STRING, region STRING",
    "supply_split": "material_pn STRING, supplier_id STRING, split_pct DECIMAL(5,2), "
    "lead_time_days INT, moq INT",
    "inventory_onhand": "material_pn STRING, snapshot_date DATE, qty_onhand INT",
    "open_po": "po_id STRING, material_pn STRING, supplier_id STRING, qty INT, eta_date DATE",
    "forecast_daily": "sku_id STRING, date DATE, model_name STRING, yhat DECIMAL(10,2)",
    "forecast_metrics": "model_name STRING, fold INT, mape DECIMAL(18,3), wmape DECIMAL(18,3), "
    "wrmsse DECIMAL(18,3)",
    "material_risk": "material_pn STRING, eval_date DATE, doi_days DOUBLE, lt_coverage DOUBLE, "
    "supplier_concentration DOUBLE, gap_qty BIGINT, gap_date DATE, risk_level STRING, "
    "risk_reasons STRING",
    "qa_embedding": "question_id STRING, question STRING, gold_sql STRING, category STRING, "
    "embedding ARRAY<FLOAT>",
    "ingest_batch": "batch_id STRING, filename STRING, row_count INT, created_at TIMESTAMP",
    "ingest_batch_row": "batch_id STRING, po_id STRING",
}

KEYS: dict[str, tuple[str, ...]] = {
    "sales_daily": ("sku_id", "date"),
    "calendar": ("date",),
    "prices": ("sku_id", "week_start"),
    "products": ("sku_id",),
    "materials": ("material_pn",),
    "bom": ("sku_id", "material_pn"),
    "suppliers": ("supplier_id",),
    "supply_split": ("material_pn", "supplier_id"),
    "inventory_onhand": ("material_pn", "snapshot_date"),
    "open_po": ("po_id",),
    "forecast_daily": ("sku_id", "date", "model_name"),
    "material_risk": ("material_pn", "eval_date"),
}

RELATIONS: tuple[tuple[str, str, str, str], ...] = (
    ("bom", "sku_id", "products", "sku_id"),
    ("bom", "material_pn", "materials", "material_pn"),
    ("supply_split", "material_pn", "materials", "material_pn"),
    ("supply_split", "supplier_id", "suppliers", "supplier_id"),
    ("open_po", "material_pn", "materials", "material_pn"),
    ("open_po", "supplier_id", "suppliers", "supplier_id"),
)


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])
