"""SQL of the validator's queries: the cards' lines and codes to fields, flags in the order of the rules, ledger and score."""

from __future__ import annotations

from evidentia.functions.text import NUMBER_SHAPES
from evidentia.operators import rules as rule
from evidentia.operators.extract import REPLACEABLE, SAME_LINE
from evidentia.operators.layout import TEMPLATES
from evidentia.plans.intake_oracle import _CODES
from evidentia.plans.oracle import _CONTEXT, _ENDS, CARDS, DATE_FLAGS, LATER, LINES, LOGICAL, MRZ_FLAGS, NAMES, REF, REQUIRED_FLAGS, _same, _zone, char36, day, iso, rules

_SURE = "0.5::DOUBLE + 0.05::DOUBLE * (({d} + 3 * {n}) % 10)"
_PLAIN = "trim(replace({0}, '<', ' '))"
_WORDS = "list_filter(string_split(regexp_replace(upper(surname), '[^A-Z]+', ' ', 'g'), ' '), lambda w: w <> '')"
_CLEAN = """CASE WHEN name = 'document_number' THEN regexp_replace(upper(value), '[^A-Z0-9]', '', 'g')
    WHEN name IN ('date_of_birth', 'date_of_expiry', 'issue_date') THEN coalesce(nullif(regexp_extract(value, '[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}', 0), ''), regexp_replace(value, '\\s+', '', 'g'))
    WHEN name = 'sex' THEN coalesce(nullif(upper(regexp_extract(value, '(?i)(male|female|M|F)', 1)), ''), trim(value)) ELSE value END"""
_BARE = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"


def _listed(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


_FIELDS = f"""{LINES}, {LATER}, {NAMES}{_CODES[len(CARDS):]},
kinds AS (SELECT key AS doc_id, CASE key % 10 WHEN 3 THEN 'pan_card' WHEN 4 THEN 'driving_license' ELSE 'passport' END AS document_type, CASE WHEN key % 2 = 0 THEN 'back' ELSE 'front' END AS side, key % 10 IN (3, 4) AS forced FROM cards WHERE key % 50 <> 7),
u AS (
  SELECT doc_id, name, value, 0 AS way, line_no, p, line_no AS spot FROM ({" UNION ALL ".join(_same(k, p, n) for k, (p, n) in enumerate(SAME_LINE))})
  UNION ALL SELECT doc_id, name, value, 1, line_no, p, spot FROM cand WHERE first = 1
  UNION ALL SELECT l.doc_id, 'surname', l.value, 2, 0, 0, (SELECT min(line_no) FROM ends e WHERE e.doc_id = l.doc_id AND e.t = l.value AND NOT {_ENDS.replace("trim(text)", "e.t")} AND NOT {_CONTEXT("e.text")}) FROM loose l),
visual AS (SELECT doc_id, name, value, {_SURE.format(d="doc_id", n="spot")} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY way, line_no, p) AS r FROM u) WHERE r = 1),
boxes AS (SELECT doc_id, document_type, line_no, trim(text) AS value, {_SURE.format(d="doc_id", n="line_no")} AS confidence, 0.05::DOUBLE + 0.09::DOUBLE * ((doc_id + line_no) % 7) AS x, 0.02::DOUBLE + 0.095::DOUBLE * line_no + 0.01::DOUBLE * (doc_id % 5) AS y, 0.15::DOUBLE + 0.05::DOUBLE * (doc_id % 4) AS wide FROM lines JOIN kinds USING (doc_id)),
places AS (SELECT * FROM (VALUES {_listed((t, *f) for t, fields in TEMPLATES.items() for f in fields)}) v(document_type, name, x0, y0, x1, y1)),
inside AS (SELECT *, round((least(x + wide, x1) - greatest(x, x0)) * (least(y + 0.03::DOUBLE, y1) - greatest(y, y0)) / (wide * 0.03::DOUBLE), 9) AS share FROM boxes JOIN places USING (document_type) WHERE value <> '' AND x < x1 AND x + wide > x0 AND y < y1 AND y + 0.03 > y0),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, share DESC, line_no) AS r FROM inside WHERE share >= 0.5),
template AS (SELECT * FROM (SELECT doc_id, name, {_CLEAN} AS value, confidence FROM best WHERE r = 1) WHERE value <> ''),
printed AS (
  SELECT coalesce(v.doc_id, t.doc_id) AS doc_id, coalesce(v.name, t.name) AS name, t.value IS NOT NULL AND (v.value IS NULL OR (v.name IN ({", ".join(map(repr, REPLACEABLE))}) AND t.confidence > v.confidence)) AS won,
    v.value AS vv, t.value AS tv, v.confidence AS vc, t.confidence AS tc FROM visual v FULL JOIN template t ON t.doc_id = v.doc_id AND t.name = v.name),
coded AS (SELECT doc_id, name, arg_min(value, seq) AS value FROM (
  SELECT doc_id, seq, 'document_number' AS name, CASE channel WHEN 'aadhaar_qr' THEN regexp_extract(text, 'uid="([^"]*)"', 1) WHEN 'dl_barcode' THEN 'UT012019' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS value FROM codes
  UNION ALL SELECT doc_id, seq, 'surname', regexp_extract(text, 'name="([^"]*)"', 1) FROM codes WHERE channel = 'aadhaar_qr' UNION ALL SELECT doc_id, seq, 'sex', regexp_extract(text, 'gender="([^"]*)"', 1) FROM codes WHERE channel = 'aadhaar_qr'
  UNION ALL SELECT doc_id, seq, 'date_of_birth', right(text, 10) FROM codes WHERE channel = 'dl_barcode') WHERE coalesce(value, '') <> '' AND doc_id % 3 <> 1 GROUP BY ALL),
zone AS (SELECT * FROM (WITH lines AS (SELECT key, mrz1 AS l1, rpad(CASE WHEN key % 5 = 0 THEN substr(mrz2, 1, 42) ELSE mrz2 END, 44, '<') AS l2, NULL AS l3 FROM cards) {_zone("TD3")}) WHERE key % 50 <> 7),
z AS (SELECT *, key AS doc_id, {iso("birth", True)} AS zb, {iso("expiry", False)} AS ze FROM zone),
zoned AS (SELECT doc_id, name, value FROM (
  SELECT doc_id, 'document_number' AS name, {_PLAIN.format("document_number")} AS value FROM z UNION ALL SELECT doc_id, 'nationality', {_PLAIN.format("nationality")} FROM z UNION ALL SELECT doc_id, 'sex', {_PLAIN.format("sex")} FROM z
  UNION ALL SELECT doc_id, 'personal_number', {_PLAIN.format("optional")} FROM z UNION ALL SELECT doc_id, 'date_of_birth', coalesce(zb, {_PLAIN.format("birth")}) FROM z UNION ALL SELECT doc_id, 'date_of_expiry', coalesce(ze, {_PLAIN.format("expiry")}) FROM z
  UNION ALL SELECT doc_id, 'surname', surname FROM z UNION ALL SELECT doc_id, 'given_names', given_names FROM z) WHERE coalesce(value, '') <> ''),
fields AS (SELECT doc_id, name, value, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY rank) AS r FROM (
  SELECT doc_id, name, CASE WHEN won THEN tv ELSE vv END AS value, CASE WHEN won THEN tc ELSE vc END AS confidence, CASE WHEN won THEN 'template' ELSE 'visual' END AS source, 0 AS rank FROM printed
  UNION ALL SELECT doc_id, name, value, 0.99, 'barcode', 1 FROM coded UNION ALL SELECT doc_id, name, value, 1.0, 'mrz', 2 FROM zoned)) WHERE r = 1 AND doc_id IN (SELECT doc_id FROM kinds))"""

_VALUES = ", ".join(f"max(value) FILTER (name = '{n}') AS {c}" for n, c in (("document_number", "number"), ("surname", "surname"), ("date_of_birth", "birth"), ("issue_date", "issue"), ("date_of_expiry", "expiry")))
_NUMBER = "replace(trim(number), '<', '')"
_PAN = [
    ("there AND NOT shape", "pan_structure_invalid", "warning", "document_number"), ("there AND shape AND NOT contains('CPHFATBLJG', substr(n, 4, 1))", "pan_status_code_invalid", "warning", "document_number"),
    ("there AND shape AND len(w) > 0 AND substr(n, 5, 1) NOT IN (substr(w[1], 1, 1), substr(w[-1], 1, 1))", "pan_name_char_mismatch", "warning", "document_number"),
    ("there AND shape AND len(w) > 0 AND substr(n, 5, 1) IN (substr(w[1], 1, 1), substr(w[-1], 1, 1))", "pan_name_char_match", "info", "document_number"),
    (f"there AND shape AND {char36('n')} = substr(n, 10, 1)", "pan_checksum_ok", "info", "document_number"), (f"there AND shape AND {char36('n')} <> substr(n, 10, 1)", "pan_checksum_failed", "warning", "document_number"),
]
_CROSS = [
    (f"CAST(zb AS DATE) <> {day('printed_birth')}", "cross_source_date_mismatch", "warning", "date_of_birth"), (f"CAST(ze AS DATE) <> {day('printed_expiry')}", "cross_source_date_mismatch", "warning", "date_of_expiry"),
    (f"number_source = 'visual' AND trim(number) <> '' AND replace(trim(document_number), '<', '') NOT IN ('', upper({_NUMBER}))", "cross_source_number_mismatch", "warning", "document_number"),
]
_STATE = [
    ("doc_id % 50 = 8", "companion_image_preprocessing_failed", "warning", ""), ("true", "ocr_read_from", "info", ""), ("doc_id IN (SELECT doc_id FROM template)", "template_roi_applied", "info", ""),
    ("doc_id % 3 <> 1", "machine_channel_read", "info", ""), ("forced", "type_hint_conflict", "warning", ""),
]
_FAMILIES = [
    rules("kinds", _STATE), DATE_FLAGS, REQUIRED_FLAGS,
    rules("vals", [("trim(number) <> '' AND NOT (CASE document_type " + " ".join(f"WHEN '{t}' THEN regexp_matches({_NUMBER}, '{NUMBER_SHAPES[t]}')" for t in ("passport", "pan_card", "driving_license")) + " END)", "document_number_format", "warning", "document_number")]),
    rules("(SELECT * FROM vals WHERE document_type = 'driving_license' AND doc_id % 3 <> 1)", [
        (f"{_BARE.format('number')} NOT IN ('', 'UT012019' || lpad(CAST(doc_id AS VARCHAR), 9, '0'))", "dl_barcode_number_mismatch", "high", "document_number"),
        (f"{day('birth')} <> (SELECT c.birth FROM cards c WHERE c.key = doc_id)", "dl_barcode_dob_mismatch", "warning", "date_of_birth")]),
    rules(f"(SELECT doc_id, trim(number) <> '' AS there, n, regexp_full_match(n, '[A-Z]{{3}}.[A-Z][0-9]{{4}}[A-Z]') AS shape, w FROM (SELECT *, upper({_NUMBER}) AS n, {_WORDS} AS w FROM vals WHERE document_type = 'pan_card'))", _PAN),
    rules("kinds", [("document_type = 'driving_license' AND doc_id % 3 = 1", "secure_anchor_missing", "warning", "machine_readable_zone")]),
    MRZ_FLAGS, rules("(SELECT doc_id, zb, ze, document_number, number, number_source, v.birth AS printed_birth, v.expiry AS printed_expiry FROM z JOIN vals v USING (doc_id))", _CROSS),
    rules("kinds", [("true", "blacklist_not_configured", "info", "")]),
]

VALIDATED = f"""WITH {_FIELDS},
docs AS (SELECT doc_id, document_type, side FROM kinds), need AS (SELECT * FROM (VALUES {_listed((t, n, k) for t, names in rule.REQUIRED.items() for k, n in enumerate(names))}) v(document_type, name, k)),
vals AS (SELECT * FROM kinds LEFT JOIN (SELECT doc_id, {_VALUES}, max(source) FILTER (name = 'document_number') AS number_source FROM fields GROUP BY 1) USING (doc_id)),
dd AS (SELECT doc_id, birth, issue, expiry, {day("birth", LOGICAL)} AS b, {day("issue", LOGICAL)} AS i, {day("expiry", LOGICAL)} AS e FROM vals),
flags AS (SELECT doc_id, code, severity, nullif(field, '') AS field, row_number() OVER (PARTITION BY doc_id ORDER BY fam, k, code, field) AS seq, CASE severity WHEN 'high' THEN 22.0 WHEN 'warning' THEN 8.0 ELSE 0.0 END AS points
  FROM ({" UNION ALL ".join(f"SELECT {k} AS fam, * FROM ({sql})" for k, sql in enumerate(_FAMILIES))})),
unsure AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n FROM fields WHERE confidence < 0.6)"""

ORACLES = {
    "document_validation": f"""{VALIDATED}, f AS (SELECT doc_id, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, sum(points) AS points FROM flags GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM unsure GROUP BY 1)
        SELECT doc_id, document_type, CASE WHEN forced THEN 1.0::DOUBLE ELSE 0.98::DOUBLE END AS classification_confidence, true AS mrz_found, n_high, n_warning, n_info, CAST(greatest(0, 100 - least(60.0, points) - least(10.0, 2.0 * coalesce(n, 0))) AS INTEGER) AS score FROM kinds JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
        UNION ALL SELECT key, 'unknown', 0.0::DOUBLE, false, 0, 1, 0, 0 FROM cards WHERE key % 50 = 7""",
    "document_ledger": f"""{VALIDATED}, e AS (
          SELECT doc_id, 0 AS part, seq AS n, code, severity, field, points, 60.0 AS cap FROM flags UNION ALL SELECT doc_id, 1, n, 'low_ocr_confidence', 'info', name, 2.0, 10.0 FROM unsure UNION ALL SELECT doc_id, 3, 0, 'remaining_points', 'info', NULL, 0.0, 0.0 FROM kinds),
        d AS (SELECT *, least(cap, upto) - least(cap, upto - points) AS deduction FROM (SELECT *, sum(points) OVER (PARTITION BY doc_id, part ORDER BY n) AS upto FROM e))
        SELECT doc_id, CAST(row_number() OVER o AS INTEGER) AS seq, code, severity, field, CAST(deduction AS DOUBLE) AS deduction, CAST(greatest(100 - sum(deduction) OVER o, CASE WHEN part = 3 THEN 0.0 ELSE -1e9 END) AS DOUBLE) AS balance FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY part, n)""",
}
