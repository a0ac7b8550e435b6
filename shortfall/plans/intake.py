"""Purchase-order intake, item routing and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.operators import intake as po
from shortfall.oracle.derived import FIELDS, INTAKE, NO_ERROR, errors, flags, strip
from shortfall.plans.registry import query
from shortfall.sources import derived, sinks
from shortfall.sources.workspace import freed_shuffles, scratch_path
from shortfall.streaming import intake as streaming

COUNTS = f"""count(*) AS total_rows, count(*) FILTER (WHERE {NO_ERROR}) AS valid_count,
    sum({" + ".join(f"({f}_error IS NOT NULL)::BIGINT" for f in FIELDS)})::BIGINT AS error_count,
    count(*) FILTER (WHERE NOT ({NO_ERROR})) AS rejected_rows"""
CELLS = ", ".join(f"{strip(f)} AS {f}" for f in ("po_id", "material_pn", "supplier_id")) + ", qty_value AS qty, eta_value AS eta_date"


def references(p) -> tuple[DataFrame, DataFrame]:
    return derived.coded_materials(p), derived.coded_suppliers(p)


def flagged(p, rows: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Checked upload. The check reads it twice, but a row of it is only a projection of an order line, so
    it is derived twice rather than written out first."""
    materials, suppliers = references(p)
    return po.flag_rows(
        derived.upload(p) if rows is None else rows, materials, suppliers,
        order_numbers(p) if target is None else target,
    )


def order_numbers(p) -> DataFrame:
    """Numbers of the open orders, which a check and the one after repair look up several times."""
    return p.stored(p.open_po.select("po_id"), "order-numbers")


def repaired(p) -> tuple[DataFrame, DataFrame]:
    """The stored result of the first check, and the repair candidates. Of the upload nothing else is stored, so
    that large ones are on disk once."""
    first = p.stored(po.graded(flagged(p)), "flagged")
    return first, po.repair_candidates(first, *references(p), order_numbers(p))


@query("intake_mapped", "SELECT row_ref, po_id, material_pn, supplier_id, qty, eta_date FROM upload", INTAKE)
def intake_mapped(p):
    headers = {"po_id": "采购 单号", "material_pn": "料号", "supplier_id": "供应商_编码", "qty": "数量", "eta_date": "ETA"}
    foreign = derived.upload(p).withColumnsRenamed(headers)
    mapping = po.map_headers([c for c in foreign.columns if c != "row_ref"])
    return po.apply_mapping(foreign, mapping)


@query("intake_validate", f"SELECT row_ref, {CELLS} FROM flagged WHERE {NO_ERROR}", INTAKE)
def intake_validate(p):
    return po.valid_rows(flagged(p))


@query("intake_errors", errors("flagged"), INTAKE)
def intake_errors(p):
    return po.error_rows(flagged(p))


@query("intake_counts", f"SELECT {COUNTS} FROM flagged", INTAKE)
def intake_counts(p):
    return po.counts(flagged(p))


@query(
    "intake_preview",
    f"SELECT e.*, (SELECT count(*) FROM ({errors('flagged')})) AS all_errors FROM ({errors('flagged')}) e ORDER BY row_ref, field LIMIT 500",
    INTAKE,
)
def intake_preview(p):
    found = p.stored(po.error_rows(flagged(p)), "errors")
    total = found.agg(F.count(F.lit(1))).scalar()
    return found.orderBy("row_ref", "field").limit(500).withColumn("all_errors", total)


@query(
    "intake_repair_diff",
    " UNION ALL ".join(
        f"SELECT row_ref, '{f}' AS field, {f} AS original_value, {f}_new AS new_value, '{po.RULES[f]}' AS rule_name FROM candidates WHERE {f}_new IS NOT NULL"
        for f in FIELDS
    ),
    INTAKE,
)
def intake_repair_diff(p):
    return po.repair_diff(repaired(p)[1])


@query("intake_revalidated", errors("reflagged"), INTAKE)
def intake_revalidated(p):
    first, candidates = repaired(p)
    rows = p.stored(po.touched_rows(first, p.stored(candidates, "candidates")), "touched")
    return po.error_rows(flagged(p, rows))


def imported(p) -> DataFrame:
    """Accepted rows, one batch per delivery year."""
    batch = F.concat(F.lit("ING-"), F.year("eta_date").cast("string"))
    return po.with_batch(po.valid_rows(flagged(p)), batch)


IMPORTED = f"{CELLS}, batch_id"


@query("intake_import", f"SELECT {IMPORTED} FROM imported", INTAKE)
def intake_import(p):
    path = scratch_path(p.spark, "import")
    sinks.append_batch(imported(p), path)
    return p.spark.read.parquet(path).select("po_id", "material_pn", "supplier_id", "qty", "eta_date", "batch_id")


@query("intake_rollback", f"SELECT po_id, qty FROM (SELECT {IMPORTED} FROM imported) WHERE batch_id <> 'ING-1999'", INTAKE)
def intake_rollback(p):
    rows = p.stored(imported(p), "imported")
    return po.undo_batch(rows, rows.select("po_id", "batch_id"), "ING-1999").select("po_id", "qty")


@query(
    "intake_recheck",
    f"SELECT {COUNTS} FROM confirmed",
    {
        **INTAKE,
        "grown": f"""SELECT po_id FROM open_po UNION ALL SELECT {strip("po_id")} FROM flagged
            WHERE {NO_ERROR} AND eta_value <= DATE '1998-12-31'""",
        "confirmed": flags("upload", "grown"),
    },
)
def intake_recheck(p):
    # Between validation and confirmation the rows due until 1998 came in by another way.
    others = po.valid_rows(flagged(p)).where(F.col("eta_date") <= F.lit("1998-12-31").cast("date"))
    target = p.open_po.select("po_id").unionByName(others.select("po_id"))
    return po.counts(flagged(p, target=target))


ROUTING = """CASE WHEN sender NOT IN ('purchase', 'signup', 'click') THEN 'blocked'
    WHEN NOT ends_with(lower(filename), '.xlsx') THEN 'invalid_file' ELSE 'pending_review' END"""


@query(
    "intake_routing",
    f"""SELECT item_id, message_uid, sender, filename, {ROUTING} AS status,
        CASE {ROUTING} WHEN 'blocked' THEN 'sender_not_allowed' WHEN 'invalid_file' THEN 'unsupported_file_type' END AS error_code
        FROM mail_items""",
    INTAKE,
)
def intake_routing(p):
    return po.route_items(derived.mail_items(p), derived.ALLOWED_SENDERS).drop("content")


FIRST_ITEMS = """SELECT message_uid, sha256, item_id, sender, filename, copies FROM (SELECT *,
    count(*) OVER (PARTITION BY message_uid, sha256) AS copies,
    row_number() OVER (PARTITION BY message_uid, sha256 ORDER BY item_id) AS rn FROM mail_items) WHERE rn = 1"""


@query("intake_dedup", FIRST_ITEMS, INTAKE)
def intake_dedup(p):
    return po.first_items(derived.mail_items(p)).drop("content")


@query(
    "intake_listing",
    "SELECT batch_id, count(*) AS row_count, max(eta_value) AS last_eta FROM imported GROUP BY batch_id ORDER BY batch_id DESC",
    INTAKE,
)
def intake_listing(p):
    return imported(p).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("eta_date").alias("last_eta")
    ).orderBy(F.desc("batch_id"))


# -- streaming ---------------------------------------------------------------------------


def event_stream(p) -> DataFrame:
    schema = p.read("events").schema
    stream = (
        p.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(p.folder)
    )
    return stream.select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("message_uid"),
        F.col("event_type").alias("sender"),
        F.when(F.floor(F.col("value")) % 10 == 0, "note.txt").otherwise("Orders.XLSX").alias("filename"),
        F.col("props").cast("binary").alias("content"),
    )


@query(
    "stream_intake",
    f"SELECT item_id, message_uid, sender, filename, {ROUTING} AS status FROM ({FIRST_ITEMS})",
    INTAKE,
)
def stream_intake(p):
    """New items of the stream, deduplicated and routed; two runs, the second adds nothing."""
    target, checkpoint = scratch_path(p.spark, "items"), scratch_path(p.spark, "items-checkpoint")
    fresh = streaming.once_only(p.spark, scratch_path(p.spark, "items-seen"))

    def routed(items: DataFrame, number: int) -> DataFrame:
        return po.route_items(fresh(items, number), derived.ALLOWED_SENDERS)

    for _ in range(2):
        streaming.run_once(event_stream(p), checkpoint, target, routed)
    return p.spark.read.parquet(target).select("item_id", "message_uid", "sender", "filename", "status")


@query("stream_dedup", f"SELECT message_uid, sha256, item_id FROM ({FIRST_ITEMS})", INTAKE)
def stream_dedup(p):
    """The same events through two streams with their own checkpoints; the stored keys keep every
    item once."""
    target = scratch_path(p.spark, "dedup")
    keep = streaming.once_only(p.spark, scratch_path(p.spark, "dedup-seen"))
    for name in ("first", "second"):
        checkpoint = scratch_path(p.spark, "dedup-checkpoint")
        streaming.run_once(event_stream(p), checkpoint, target, keep, name)
    return p.spark.read.parquet(target).select("message_uid", "sha256", "item_id")


UPLOAD_SCHEMA = "row_ref string, po_id string, material_pn string, supplier_id string, qty string, eta_date string"


def dropped_upload(p) -> DataFrame:
    """The upload written as dropped CSV files, each order in one file, and read as a stream."""
    folder = scratch_path(p.spark, "drop")
    # Bare order lines are shuffled; their cells are written next to where they are made.
    lines = p.lines.repartition(F.substring(derived.line_reference(), 1, 12))
    files = derived.upload(p, lines).write.option("header", True).option("compression", "gzip")
    with freed_shuffles(p.spark):
        files.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return streaming.file_drop(p.spark, folder, UPLOAD_SCHEMA)


@query(
    "stream_file_drop",
    "SELECT row_ref, nullif(po_id, '') AS po_id, material_pn, supplier_id, qty, eta_date, 'local@demo' AS sender FROM upload",
    INTAKE,
)
def stream_file_drop(p):
    target, checkpoint = scratch_path(p.spark, "rows"), scratch_path(p.spark, "rows-checkpoint")
    stream = dropped_upload(p)
    for _ in range(2):
        streaming.run_once(stream, checkpoint, target, lambda rows, number: rows)
    return p.spark.read.parquet(target).select(*[f.split()[0] for f in UPLOAD_SCHEMA.split(", ")], "sender")


@query("stream_validate", errors("flagged"), INTAKE)
def stream_validate(p):
    """Stream-static validation of every dropped file."""
    target, checkpoint = scratch_path(p.spark, "errors"), scratch_path(p.spark, "errors-checkpoint")
    check = streaming.validated(*references(p), p.open_po)
    streaming.run_once(dropped_upload(p), checkpoint, target, check)
    return p.spark.read.parquet(target).select("row_ref", "field", "code")


CSV_CELL = """CASE WHEN {0} = '' THEN '""' WHEN contains({0}, ',') THEN '"' || {0} || '"' ELSE {0} END"""


@query(
    "stream_files",
    f"""SELECT drop_no, length(text)::BIGINT AS n_chars, sha256(text) AS sha256, 2::BIGINT AS copies FROM (
        SELECT row_ref[1:12]::BIGINT % 4 AS drop_no, 'row_ref,po_id,qty,eta_date' || chr(10) || string_agg(row_ref || ',' ||
          {CSV_CELL.format("po_id")} || ',' || {CSV_CELL.format("qty")} || ',' || eta_date, chr(10) ORDER BY row_ref) || chr(10) AS text
        FROM upload GROUP BY 1)""",
    INTAKE,
)
def stream_files(p):
    """Whole files as a stream, kept once by their content: each file is dropped twice, in two folders."""
    folder, target = scratch_path(p.spark, "files"), scratch_path(p.spark, "files-kept")
    rows = derived.upload(p, derived.dropped_lines(p), "drop").select("drop", "row_ref", "po_id", "qty", "eta_date")
    for copy in ("a", "b"):
        files = rows.write.partitionBy("drop").option("header", True)
        with freed_shuffles(p.spark):
            files.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/copy={copy}")

    def items(files: DataFrame) -> DataFrame:
        return files.select(
            F.lit(0).cast("bigint").alias("message_uid"),
            F.xxhash64("path").alias("item_id"),
            F.regexp_extract("path", "drop=([0-9]+)", 1).cast("bigint").alias("drop_no"),
            "sha256", "path",
        )

    fresh = streaming.once_only(p.spark, scratch_path(p.spark, "files-seen"))
    stream = streaming.text_drop(p.spark, f"{folder}/copy=*/drop=*")
    checkpoint = scratch_path(p.spark, "files-checkpoint")
    for _ in range(2):  # the second run has nothing new
        streaming.run_once(stream, checkpoint, target, streaming.kept_files(items, fresh))
    # A piece ends with a line, so none cuts a character.
    length = F.sum(F.length(F.decode("piece", "UTF-8"))).cast("bigint")
    stored = p.spark.read.parquet(target)
    return stored.groupBy("item_id", "drop_no", "sha256", "copies").agg(length.alias("n_chars")).select("drop_no", "n_chars", "sha256", "copies")
