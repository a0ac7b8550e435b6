"""DuckDB texts of the derived upload, item and claim tables."""

from __future__ import annotations

PO = "'PO-' || l_orderkey || '-' || l_linenumber || '-' || material_pn || '-' || supplier_id || '-' || strftime(date, '%Y%m%d')"
SHORT = "'PO-' || l_orderkey || '-' || l_linenumber"
CODE = "printf('PN-%05d', material_pn)"
SUPPLIER = "printf('SUP-%03d', supplier_id)"
DAY = "year(date) || '{0}' || month(date) || '{1}' || day(date) || '{2}'"


WIDE = "translate({0}, '０１２３４５６７８９', '0123456789')"
# White space at the ends, and the compatibility folding of the characters that the upload has.
STRIP = "trim({0}, ' ' || chr(9) || chr(160) || chr(8195) || chr(12288))"
FOLD = "translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹０１２３４５６７８９', '01234567890123456789')"


def strip(text: str) -> str:
    return STRIP.format(text)


def folded(text: str) -> str:
    return strip(FOLD.format(text))


def flags(upload: str, target: str) -> str:
    """Error code per field of every upload row."""
    return f"""SELECT u.*, CASE WHEN {strip("po_id")} = '' THEN 'required'
        WHEN row_ref <> min(row_ref) OVER (PARTITION BY {strip("po_id")}) THEN 'duplicate_in_file'
        WHEN {strip("po_id")} IN (SELECT po_id FROM {target}) THEN 'already_exists' END AS po_id_error,
        CASE WHEN {strip("material_pn")} NOT IN (SELECT code FROM material_codes) THEN 'unknown_material' END AS material_pn_error,
        CASE WHEN {strip("supplier_id")} NOT IN (SELECT code FROM supplier_codes) THEN 'unknown_supplier' END AS supplier_id_error,
        CASE WHEN qty_value IS NULL THEN 'invalid_positive_integer' END AS qty_error,
        CASE WHEN eta_value IS NULL THEN 'invalid_date' END AS eta_date_error FROM (
        SELECT *, CASE WHEN regexp_full_match({WIDE.format(strip("qty"))}, '[0-9]+') AND {WIDE.format(strip("qty"))}::BIGINT > 0
          THEN {WIDE.format(strip("qty"))}::INTEGER END AS qty_value,
        CASE WHEN regexp_full_match({strip("eta_date")}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({strip("eta_date")} AS DATE) END AS eta_value
        FROM {upload}) u"""


NO_ERROR = "coalesce(po_id_error, material_pn_error, supplier_id_error, qty_error, eta_date_error) IS NULL"
FIELDS = ("po_id", "material_pn", "supplier_id", "qty", "eta_date")


def errors(flagged: str) -> str:
    return " UNION ALL ".join(
        f"SELECT row_ref, '{f}' AS field, {f}_error AS code FROM {flagged} WHERE {f}_error IS NOT NULL"
        for f in FIELDS
    )



INTAKE: dict[str, str] = {
    "material_codes": f"SELECT {CODE} AS code FROM materials",
    "supplier_codes": f"SELECT {SUPPLIER} AS code FROM suppliers",
    "upload": f"""SELECT printf('%012d', l_orderkey) || '-' || printf('%02d', l_linenumber) || '-' || printf('%012d', material_pn)
        || '-' || strftime(date, '%Y%m%d') || '-' || printf('%012d', round(l_extendedprice * 100)::BIGINT) AS row_ref,
        CASE k WHEN 9 THEN '' WHEN 13 THEN {SHORT} WHEN 14 THEN lower({SHORT}) ELSE {PO} END AS po_id,
        CASE WHEN k = 4 AND o = 4 THEN translate({CODE}, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') WHEN k = 4 THEN lower({CODE})
          WHEN k = 6 THEN 'X' || {CODE} ELSE {CODE} END || CASE WHEN o = 0 THEN chr(9) ELSE '' END AS material_pn,
        CASE WHEN o = 1 THEN chr(12288) ELSE '' END ||
          CASE k WHEN 8 THEN 'SUP-99999' WHEN 15 THEN lower({SUPPLIER}) ELSE {SUPPLIER} END AS supplier_id,
        CASE WHEN o = 2 THEN chr(160) ELSE '' END || CASE k WHEN 2 THEN '1,' || lpad(quantity::VARCHAR, 3, '0')
          WHEN 3 THEN translate(quantity::VARCHAR, '0123456789', CASE WHEN o = 5 THEN '⁰¹²³⁴⁵⁶⁷⁸⁹' ELSE '０１２３４５６７８９' END)
          WHEN 5 THEN '-' || quantity WHEN 11 THEN quantity || '.0' ELSE quantity::VARCHAR END
          || CASE WHEN o = 2 THEN chr(160) ELSE '' END AS qty,
        CASE WHEN o = 3 THEN chr(8195) ELSE '' END || CASE k WHEN 0 THEN {DAY.format('/', '/', '')} WHEN 1 THEN {DAY.format('年', '月', '日')} WHEN 7 THEN '2016/2/30'
          WHEN 10 THEN strftime(date, '%Y%m%d') WHEN 12 THEN {DAY.format('.', '.', '')}
          ELSE strftime(date, '%Y-%m-%d') END AS eta_date
        FROM (SELECT *, l_orderkey % 16 AS k, l_orderkey // 16 % 8 AS o FROM lines)""",
    "flagged": flags("upload", "open_po"),
    "candidates": f"""SELECT row_ref, po_id, material_pn, supplier_id, qty, eta_date,
        CASE WHEN po_id_error IS NOT NULL AND upper({folded('po_id')}) <> po_id AND upper({folded('po_id')}) NOT IN (SELECT po_id FROM open_po)
          THEN upper({folded('po_id')}) END AS po_id_new,
        CASE WHEN material_pn_error IS NOT NULL AND upper({folded('material_pn')}) <> material_pn
          AND upper({folded('material_pn')}) IN (SELECT code FROM material_codes) THEN upper({folded('material_pn')}) END AS material_pn_new,
        CASE WHEN supplier_id_error IS NOT NULL AND upper({folded('supplier_id')}) <> supplier_id
          AND upper({folded('supplier_id')}) IN (SELECT code FROM supplier_codes) THEN upper({folded('supplier_id')}) END AS supplier_id_new,
        CASE WHEN qty_error IS NULL THEN NULL
          WHEN regexp_full_match({folded('qty')}, '[1-9][0-9]{{0,2}}(,[0-9]{{3}})+') THEN replace({folded('qty')}, ',', '')
          WHEN regexp_full_match({folded('qty')}, '[0-9]+[.]0+') THEN split_part({folded('qty')}, '.', 1)
          WHEN regexp_full_match({folded('qty')}, '[0-9]+') THEN {folded('qty')} END AS qty_new,
        CASE WHEN eta_date_error IS NOT NULL THEN coalesce(
          try_strptime({strip('eta_date')}, '%Y/%m/%d'), try_strptime({strip('eta_date')}, '%Y.%m.%d'), try_strptime({strip('eta_date')}, '%Y年%m月%d日'),
          CASE WHEN regexp_full_match({strip('eta_date')}, '[0-9]{{8}}') THEN try_strptime({strip('eta_date')}, '%Y%m%d') END)::DATE::VARCHAR END AS eta_date_new
        FROM flagged WHERE NOT ({NO_ERROR})""",
    "repaired": f"""SELECT row_ref, po_id, material_pn, supplier_id, qty, eta_date FROM flagged WHERE {NO_ERROR}
        UNION ALL SELECT row_ref, coalesce(po_id_new, po_id), coalesce(material_pn_new, material_pn),
        coalesce(supplier_id_new, supplier_id), coalesce(qty_new, qty), coalesce(eta_date_new, eta_date) FROM candidates""",
    "reflagged": flags("repaired", "open_po"),
    "mail_items": """SELECT event_id AS item_id, user_id AS message_uid, event_type AS sender,
        CASE WHEN floor(value)::BIGINT % 10 = 0 THEN 'note.txt' ELSE 'Orders.XLSX' END AS filename,
        sha256(props) AS sha256 FROM events""",
    "imported": f"SELECT *, 'ING-' || strftime(eta_value, '%Y') AS batch_id FROM flagged WHERE {NO_ERROR}",
}
