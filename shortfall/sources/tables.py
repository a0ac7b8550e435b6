"""The planning tables, derived from order lines, parts and suppliers.

`PlanningTables` only describes DataFrames; nothing runs until a caller acts on one. The rules of
each table are listed in README.md.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON, cutoff_dates, week_start
from shortfall.functions.numbers import unit_cents
from shortfall.operators import forecast as fc
from shortfall.operators import risk as rk
from shortfall.operators import models, shape
from shortfall.sources.snapshots import SnapshotStore, input_mark
from shortfall.sources.workspace import freed_shuffles, scratch_path

PARTS_PER_SKU = 20
PARTNERS = 10
SNAPSHOTS = 9
PUBLISHED_DIGITS = 2
DEMAND_DIGITS = 6
RISK_INPUTS = ("lineitem", "orders", "part")


class PlanningTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # -- anchors -------------------------------------------------------------------------

    @cached_property
    def today(self) -> Column:
        """T, the last order date. One aggregated value is fetched, so that every date filter is a
        literal and reaches the file scans."""
        return self._one_date(self.read("orders").agg(F.max("o_orderdate").cast("date")))

    @cached_property
    def first_day(self) -> Column:
        return self._one_date(self.read("lineitem").agg(F.min("l_shipdate").cast("date")))

    @staticmethod
    def _one_date(aggregate: DataFrame) -> Column:
        value = aggregate.first()[0]
        if value is None:
            raise ValueError("the source table is empty")
        return F.lit(value)

    # -- order lines ---------------------------------------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        return self.read("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.col("l_partkey").alias("material_pn"),
            F.expr(f"l_partkey div {PARTS_PER_SKU}").alias("sku_id"),
            (F.col("l_suppkey") % PARTNERS).alias("supplier_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            "l_extendedprice",
            "l_shipdate",
            F.col("l_shipdate").cast("date").alias("date"),
        )

    @cached_property
    def past_lines(self) -> DataFrame:
        return self.lines.where(F.col("l_shipdate") <= self.today)

    @cached_property
    def future_lines(self) -> DataFrame:
        return self.lines.where(F.col("l_shipdate") > self.today)

    # -- sales ---------------------------------------------------------------------------

    @cached_property
    def sales(self) -> DataFrame:
        """Days with sales only."""
        return self.past_lines.groupBy("sku_id", "date").agg(F.sum("quantity").alias("units_sold"))

    @cached_property
    def sales_daily(self) -> DataFrame:
        """Every SKU on every day up to T."""
        return shape.densify(self.sales, "sku_id", "units_sold", self.first_day, self.today)

    def recent_daily(self, days: int) -> DataFrame:
        """Every SKU on each of the last days up to T; no earlier day is written out."""
        recent = self.sales.where(F.col("date") > F.date_sub(self.today, days))
        last_day = self.sales.select(
            "sku_id", self.today.alias("date"), F.lit(0).cast("bigint").alias("units_sold")
        ).distinct()
        sparse = recent.unionByName(last_day).groupBy("sku_id", "date").agg(F.sum("units_sold").alias("units_sold"))
        return shape.densify(sparse, "sku_id", "units_sold", F.date_sub(self.today, days - 1), self.today)

    @cached_property
    def day_spine(self) -> DataFrame:
        """Every date from the first sale to the end of the horizon: order dates and the days between."""
        ordered = self.read("orders").select(
            F.lit(0).alias("all"), F.col("o_orderdate").cast("date").alias("date"), F.lit(0).alias("none")
        )
        dense = shape.densify(
            ordered.where(F.col("date").isNotNull()).distinct(), "all", "none", self.first_day, F.date_add(self.today, HORIZON)
        )
        return dense.where(F.col("date") >= self.first_day).select("date")

    @cached_property
    def event_peaks(self) -> DataFrame:
        """Day of the month on which an event type has most rows, and its name; at most 31 rows."""
        by_day = self.read("events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        best = by_day.groupBy("event_type").agg(F.max_by("day", F.struct("n", -F.col("day"))).alias("day"))
        return best.groupBy("day").agg(F.min("event_type").alias("name"))

    @cached_property
    def raw_calendar(self) -> DataFrame:
        """Dates with two event columns, empty strings where there is none. Event types come back every
        month on their busiest day; a day may also open a quarter."""
        opens_quarter = (F.dayofmonth("date") == 1) & (F.month("date") % 3 == 1)
        second = F.when(opens_quarter, F.lit("QuarterStart")).otherwise(F.lit(""))
        return self.day_spine.join(
            F.broadcast(self.event_peaks), F.dayofmonth("date") == F.col("day"), "left"
        ).select("date", F.coalesce("name", F.lit("")).alias("event_name_1"), second.alias("event_name_2"))

    @cached_property
    def calendar(self) -> DataFrame:
        return self.raw_calendar.select(
            "date",
            F.date_format("date", "EEEE").alias("weekday"),
            shape.join_event_names(F.col("event_name_1"), F.col("event_name_2")).alias(
                "event_name"
            ),
            (F.weekday("date") >= 5).alias("is_weekend"),
        )

    @cached_property
    def price_cents(self) -> DataFrame:
        unit = unit_cents(F.col("l_extendedprice"), F.col("quantity"))
        rows = self.past_lines.select(
            "sku_id", week_start(F.col("date")).alias("week_start"), unit.alias("cents")
        )
        return shape.exact_median(rows, ["sku_id", "week_start"], "cents")

    @cached_property
    def prices(self) -> DataFrame:
        return self.price_cents.select(
            "sku_id", "week_start", (F.col("cents") / 100.0).alias("sell_price")
        )

    # -- dimensions ----------------------------------------------------------------------

    @cached_property
    def materials(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("material_pn"),
            F.col("p_name").alias("material_name"),
            F.col("p_type").alias("commodity"),
            F.concat_ws("-", "p_type", F.expr("cast(p_size div 10 as string)")).alias("item_group"),
            F.col("p_retailprice").alias("unit_cost"),
        )

    @cached_property
    def products(self) -> DataFrame:
        sku = F.expr(f"p_partkey div {PARTS_PER_SKU}").alias("sku_id")
        return (
            self.read("part")
            .groupBy(sku)
            .agg(F.min_by("p_name", "p_partkey").alias("product_name"))
            .select(
                "sku_id",
                "product_name",
                F.concat(F.lit("FAMILY-"), (F.col("sku_id") % 4).cast("string")).alias(
                    "product_family"
                ),
            )
        )

    @cached_property
    def bom(self) -> DataFrame:
        """Every part belongs to its own SKU; every fifth one is shared with the next SKU."""
        parts = self.read("part")
        last_part = parts.agg(F.max("p_partkey")).scalar()
        pn = F.col("p_partkey")
        own = F.expr(f"p_partkey div {PARTS_PER_SKU}")
        shared = (pn % 5 == 0) & (pn + PARTS_PER_SKU <= last_part)
        return parts.select(
            F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))).alias(
                "sku_id"
            ),
            pn.alias("material_pn"),
            ((1 + pn % 8) / 16.0).alias("qty_per_unit"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        """Partners: the supplier keys folded to ten groups, named after the smallest key."""
        places = (
            self.read("nation")
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "r_name")
        )
        first = self.read("supplier").groupBy((F.col("s_suppkey") % PARTNERS).alias("supplier_id")).agg(
            F.min_by(F.struct("s_name", "s_nationkey"), "s_suppkey").alias("s")
        )
        return first.join(places, F.col("s.s_nationkey") == F.col("n_nationkey")).select(
            "supplier_id",
            F.col("s.s_name").alias("supplier_name"),
            F.col("r_name").alias("region"),
        ).hint("broadcast")  # at most PARTNERS rows by construction

    @cached_property
    def supply_split(self) -> DataFrame:
        """One to three partners per material by quantity; shares in hundredths sum to 100."""
        pn, sup = F.col("material_pn"), F.col("supplier_id")
        of_material = Window.partitionBy("material_pn")
        ranked = (
            self.lines.groupBy("material_pn", "supplier_id")
            .agg(F.sum("quantity").alias("q"))
            .withColumn("rank", F.row_number().over(of_material.orderBy(F.desc("q"), "supplier_id")))
            .where(F.col("rank") <= 3)
            .where(F.col("rank") <= 1 + pn % 3)
            .withColumn("total", F.sum("q").over(of_material))
            .withColumn("points", F.expr("(10000 * q) div total"))
            .withColumn(
                "others",
                F.sum(F.when(F.col("rank") > 1, F.col("points")).otherwise(0)).over(of_material),
            )
        )
        points = F.when(F.col("rank") == 1, 10000 - F.col("others")).otherwise(F.col("points"))
        return ranked.select(
            "material_pn",
            "supplier_id",
            (points / 100.0).alias("split_pct"),
            (7 + (pn * 7 + sup * 13) % 84).alias("lead_time_days"),
            (100 + (pn * 31 + sup * 17) % 4900).alias("moq"),
        )

    @cached_property
    def open_po(self) -> DataFrame:
        """Order lines that ship after T."""
        keys = ["l_orderkey", "l_linenumber", "material_pn", "supplier_id", "date"]
        return (
            self.future_lines.groupBy(*keys)
            .agg(F.sum("quantity").alias("qty"))
            .select(
                po_number(keys).alias("po_id"),
                "material_pn",
                "supplier_id",
                "qty",
                F.col("date").alias("eta_date"),
            )
        )

    @cached_property
    def inventory_onhand(self) -> DataFrame:
        """Weekly snapshots, a varying number of days of the average demand."""
        # Summed from the daily sales, so that plans which also forecast share their shuffle.
        units = self.sales.groupBy("sku_id").agg(F.sum("units_sold").alias("units"))
        days = F.datediff(self.today, self.first_day) + 1
        base = (
            units.join(self.bom, "sku_id")
            .groupBy("material_pn")
            .agg(F.sum(F.col("units") * F.col("qty_per_unit")).alias("base"))
        )
        cover = 1 + (F.col("material_pn") * 37 + F.col("k") * 11) % 90
        return base.select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1))).alias("k")
        ).select(
            "material_pn",
            F.date_sub(self.today, F.col("k") * 7).alias("snapshot_date"),
            F.floor(F.col("base") * cover / days).cast("bigint").alias("qty_onhand"),
        )

    # -- engine outputs ------------------------------------------------------------------

    @cached_property
    def now(self) -> list[Column]:
        return [self.today]

    @cached_property
    def past_cutoffs(self) -> list[Column]:
        """Eight weekly cutoffs before T."""
        return cutoff_dates(self.today, 8, 7)

    @cached_property
    def forecast(self) -> DataFrame:
        """Seasonal-naive forecast from T, one array per SKU."""
        return self.forecast_at(self.now)

    @cached_property
    def forecast_daily(self) -> DataFrame:
        return fc.daily_rows(self.forecast)

    def forecast_at(self, cutoffs: list[Column], model: str = "seasonal_naive") -> DataFrame:
        """Forecast arrays of a model at every cutoff; those of fitted models are published to two decimals."""
        if model == "seasonal_naive":
            return fc.seasonal_naive(self.sales, cutoffs)
        if model == "smoothing":
            found = models.smoothing_forecast(self.sales, cutoffs, self.first_day)
        elif model == "tweedie":
            inputs = (self.sales, self.first_day, self.today, self.calendar, self.prices)
            found = models.tweedie_arrays(*inputs, cutoffs=cutoffs)
        else:
            raise ValueError(f"no model named {model}")
        return fc.rounded(found, PUBLISHED_DIGITS)

    def published_at(self, cutoffs: list[Column]) -> DataFrame:
        """Daily forecasts of both models at every cutoff, to two decimals."""
        naive = fc.daily_rows(self.forecast_at(cutoffs))
        return naive.unionByName(fc.daily_rows(self.forecast_at(cutoffs, "smoothing")))

    @cached_property
    def published_forecasts(self) -> DataFrame:
        return self.published_at(self.now)

    @cached_property
    def material_demand(self) -> DataFrame:
        return rk.explode_bom(self.forecast, self.bom)

    @cached_property
    def demand_to_date(self) -> DataFrame:
        return rk.demand_to_date(self.forecast, self.bom)

    def risk_at(self, cutoffs: list[Column], model: str = "seasonal_naive") -> DataFrame:
        """Risk of all materials at every cutoff, on the forecasts of a model at that cutoff."""
        return rk.material_risk(
            self.forecast_at(cutoffs, model),
            self.bom,
            self.inventory_onhand,
            self.open_po,
            self.supply_split,
            cutoffs,
            # The naive forecast has whole units, and its sums are exact.
            digits=None if model == "seasonal_naive" else DEMAND_DIGITS,
        )

    @cached_property
    def risk_detail(self) -> DataFrame:
        """The snapshot at T with the inputs of each grade."""
        return self.risk_at(self.now)

    def stored(self, frame: DataFrame, label: str) -> DataFrame:
        """The frame written to the shared folder, for plans that read it several times; a label is
        written once per instance and stands for one frame."""
        if label not in self._stored:
            path = scratch_path(self.spark, label)
            with freed_shuffles(self.spark):
                frame.write.option("compression", "zstd").parquet(path)
            self._stored[label] = self.spark.read.parquet(path)
        return self._stored[label]

    @cached_property
    def stored_risk(self) -> DataFrame:
        return self.stored(self.risk_detail, "risk")

    @cached_property
    def material_risk(self) -> DataFrame:
        return self.risk_detail.select(*rk.RISK_COLUMNS)

    @cached_property
    def risk_history(self) -> DataFrame:
        """Snapshots at the eight past cutoffs and at T, computed together."""
        return self.risk_at([*self.past_cutoffs, self.today]).select(*rk.RISK_COLUMNS)

    @cached_property
    def snapshot_store(self) -> SnapshotStore:
        mark = input_mark(self.spark, self.folder, RISK_INPUTS)
        return SnapshotStore(self.spark, mark, rk.RISK_SCHEMA)

    def snapshots_at(self, cutoffs: list[Column]) -> DataFrame:
        """Kept snapshots at these cutoffs; the missing ones are computed and added to the store."""
        dates = list(self.spark.range(1).select(*cutoffs).first())
        found = self.snapshot_store.at(dates, lambda days: self.risk_at(days).select(*rk.RISK_COLUMNS))
        return found.select(*rk.RISK_COLUMNS)

    @cached_property
    def snapshots(self) -> DataFrame:
        """Kept snapshots at the eight past cutoffs and at T."""
        return self.snapshots_at([*self.past_cutoffs, self.today])

    @cached_property
    def profile(self) -> DataFrame:
        return rk.supply_profile(self.supply_split)

    @cached_property
    def risk_by_commodity(self) -> DataFrame:
        return rk.risk_by_dimension(self.material_risk, self.materials, "commodity")

    @cached_property
    def risk_by_item_group(self) -> DataFrame:
        return rk.risk_by_dimension(self.material_risk, self.materials, "item_group")

    @cached_property
    def risk_by_supplier(self) -> DataFrame:
        return rk.risk_by_supplier(self.material_risk, self.supply_split, self.suppliers)


def po_number(keys: list[str]) -> Column:
    *numbers, day = keys
    return F.concat(
        F.lit("PO-"),
        F.concat_ws("-", *[F.col(k).cast("string") for k in numbers]),
        F.lit("-"),
        compact_day(F.col(day)),
    )


def compact_day(day: Column) -> Column:
    """YYYYMMDD."""
    return F.replace(day.cast("string"), F.lit("-"), F.lit(""))


def zero_padded(number: Column, width: int) -> Column:
    """Decimal digits with leading zeros; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
