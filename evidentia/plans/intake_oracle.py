"""SQL of the intake queries."""

from __future__ import annotations

from evidentia.plans.oracle import _TD1, _TD2, CARDS, DD, FACES, FIELD_ROWS, LINES, REF, REGISTRY, FACED_RISK, TEXTS, _zone

_MARKUP = """'<PrintLetterBarcodeData uid="' || uid || '" name="' || CASE WHEN key % 4 = 0 THEN '' ELSE given_names END || '" gender="' || CASE WHEN key % 3 = 0 THEN 'M' ELSE 'F' END || '"/>'"""
_CODES = CARDS + f""",
m AS (SELECT *, {_MARKUP} AS markup, CASE WHEN key % 3 = 0 THEN 'lic ut01 2019 ' ELSE 'LIC UT012019' END || lpad(CAST(key AS VARCHAR), 9, '0') || '; NAME: SOME ONE; ' || strftime(birth, '%d-%m-%Y') AS licence FROM cards),
codes AS (SELECT key AS doc_id, 0 AS seq, 'QRCODE' AS format, CASE WHEN key % 2 = 0 THEN markup ELSE 'no payload' END AS text, CASE WHEN key % 2 = 0 THEN 'aadhaar_qr' ELSE 'unclassified' END AS channel FROM m
    UNION ALL SELECT key, 1, 'PDF417', licence, 'dl_barcode' FROM m UNION ALL SELECT key, 2, 'CODE128', licence, 'unclassified' FROM m
    UNION ALL SELECT key, 3, 'QRCODE', CASE WHEN key % 5 = 0 THEN replace(markup, 'uid="', 'uid="9') ELSE '' END, CASE WHEN key % 5 = 0 THEN 'aadhaar_qr' ELSE 'unclassified' END FROM m)"""

_SHARED = ["document_type", "country", "document_number", "nationality", "birth", "sex", "expiry", "optional", "surname", "given_names", "document_number_ok", "birth_ok", "expiry_ok", "composite_ok", "check_skipped"]


def _any(form: int, fmt: str, message: str) -> str:
    ok = f"({message}) IS NULL"
    return f"SELECT key, {form} AS form, CASE WHEN ({message}) = 'unknown line lengths' THEN NULL ELSE '{fmt}' END AS format, {ok} AS recognised, {message} AS message, " + ", ".join(f"CASE WHEN {ok} THEN {c} END AS {c}" for c in _SHARED)


ORACLES = {
    "barcode_channels": f"WITH {_CODES} SELECT doc_id, seq, format, text, channel, row_number() OVER (PARTITION BY doc_id, channel ORDER BY seq) = 1 AS first_of_channel FROM codes",
    "barcode_fields": f"""WITH {_CODES}, p AS (SELECT doc_id, seq, channel, text, unnest(['document_number', 'surname', 'sex', 'date_of_birth']) AS name FROM codes),
        v AS (SELECT doc_id, seq, name, CASE WHEN channel = 'aadhaar_qr' THEN CASE name WHEN 'document_number' THEN regexp_extract(text, 'uid="([^"]*)"', 1) WHEN 'surname' THEN regexp_extract(text, 'name="([^"]*)"', 1) WHEN 'sex' THEN regexp_extract(text, 'gender="([^"]*)"', 1) END
            WHEN channel = 'dl_barcode' THEN CASE name WHEN 'document_number' THEN 'UT012019' || lpad(CAST(doc_id AS VARCHAR), 9, '0') WHEN 'date_of_birth' THEN right(text, 10) END END AS value FROM p)
        SELECT doc_id, name, arg_min(value, seq) AS value, CAST(0.99 AS DOUBLE) AS confidence FROM v WHERE coalesce(value, '') <> '' GROUP BY ALL""",
    "two_sided_lines": f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN line_no < 6 THEN 'front' ELSE 'back' END AS side, text FROM lines",
    "field_cleaners": f"""WITH {CARDS} SELECT key AS doc_id, 'document_number' AS name, CASE WHEN key % 2 = 0 THEN uid ELSE number END AS value FROM cards
        UNION ALL SELECT key, 'date_of_birth', CASE WHEN key % 3 = 0 THEN '11' ELSE strftime(birth, '%-d/%-m/%Y') END FROM cards
        UNION ALL SELECT key, 'sex', CASE key % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'x' ELSE 'M' END FROM cards UNION ALL SELECT key, 'surname', ' ' || surname FROM cards""",
    "passport_in_lines": f"WITH {LINES}, t AS (SELECT doc_id, upper(string_agg(text, ' ' ORDER BY line_no)) AS t FROM lines GROUP BY 1) SELECT doc_id, nullif(regexp_extract(t, '[A-Z][0-9]{{7}}', 0), '') AS passport_number FROM t",
    "reading_confidence": f"WITH {CARDS}{FIELD_ROWS}, x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE confidence END AS c FROM fields WHERE doc_id % 4 <> 1), g AS (SELECT doc_id, count(*) AS n, avg(c) FILTER (c > 0) AS mean FROM x GROUP BY 1) SELECT doc_id, CAST(CASE WHEN n > 0 THEN round(round(coalesce(mean, 0.85) * 100, 6), 1) WHEN doc_id % 3 = 0 THEN 99 WHEN doc_id % 2 = 0 THEN 98 ELSE 88 END AS DOUBLE) AS ocr_confidence FROM docs LEFT JOIN g USING (doc_id)",
    "weighted_angle": "WITH s AS (SELECT l_orderkey AS image_id, l_partkey % 60 - 30.0::DOUBLE AS dx, CAST(l_quantity AS DOUBLE) - 20.0::DOUBLE AS dy FROM lineitem), a AS (SELECT image_id, sqrt(dx * dx + dy * dy) AS w, degrees(atan2(dy, dx)) AS r FROM s), f AS (SELECT image_id, w, CASE WHEN r > 45 THEN r - 90 WHEN r < -45 THEN r + 90 ELSE r END AS a FROM a) SELECT image_id, round(coalesce(sum(a * w) FILTER (w >= 20) / sum(w) FILTER (w >= 20), 0.0), 6) AS angle FROM f GROUP BY 1",
    "demo_signals": "SELECT c_custkey AS image_id, round(CAST(list_sum(list_transform(range(1, least(length(c_name), 64) + 1), lambda i: ascii(substr(c_name, i, 1)))) % 100 AS DOUBLE) / 100, 6) AS bias, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST('0x' || substr(sha256(c_name), i, 1) AS INTEGER))) % 3 AS INTEGER) AS picked FROM customer",
    "mrz_parse_any": f"""SELECT * FROM (WITH {CARDS}, lines AS (SELECT key, mrz1 AS l1, mrz2 AS l2, NULL AS l3 FROM cards) {_any(3, "TD3", "CASE WHEN key % 5 = 0 THEN 'unknown line lengths' END")} FROM ({_zone("TD3")}))
        UNION ALL SELECT * FROM (WITH {_TD2} {_any(2, "TD2", "CASE WHEN key % 6 = 0 THEN 'characters of line 2' END")} FROM ({_zone("TD2")}))
        UNION ALL SELECT * FROM (WITH {_TD1} {_any(1, "TD1", "CAST(NULL AS VARCHAR)")} FROM ({_zone("TD1")}))""",
    "expiry_days": f"WITH {TEXTS}{DD} SELECT doc_id, e < {REF} AS expired, CAST(e - {REF} AS INTEGER) AS days_to_expiry FROM dd",
    "json_inputs": f"WITH {REGISTRY} SELECT document_number, CASE WHEN document_number % 5 > 1 THEN round(CAST(list_avg([x for x in [font, layout, dimensions, compression] if x IS NOT NULL]) AS DOUBLE), 6) END AS mean, round(CAST(font AS DOUBLE), 6) AS first FROM prints",
    "face_verification": f"WITH {FACES[2:]}, r AS (SELECT identity_id, round(round(s, 9), 3) AS s FROM face) SELECT identity_id, s AS similarity_score, s >= 0.72 AS match, round(round(least(0.99, 0.6 + s * 0.4), 9), 3) AS confidence FROM r",
    "fingerprint_ranked": f"WITH {REGISTRY} SELECT *, CAST(row_number() OVER (PARTITION BY document_number ORDER BY match DESC, sibling) AS INTEGER) AS rank FROM matches WHERE match IS NOT NULL",
    "graph_neighbourhood": f"""WITH {REGISTRY}, asked AS (SELECT DISTINCT identity_id FROM docs JOIN customer ON c_custkey = identity_id WHERE status = 'BLACKLISTED'),
        around AS (SELECT DISTINCT o.identity_id, d.family_id, d.document_number, d.identity_id AS owner_id FROM asked JOIN docs o USING (identity_id) JOIN fam USING (family_id) JOIN docs d USING (family_id)),
        e AS (SELECT identity_id, 'person:' || identity_id AS a, 'document:' || document_number AS b FROM asked JOIN docs USING (identity_id)
            UNION ALL SELECT identity_id, 'document:' || document_number, 'pattern:' || family_id FROM around
            UNION ALL SELECT identity_id, 'person:' || owner_id, 'document:' || document_number FROM around JOIN customer ON c_custkey = owner_id
            UNION ALL SELECT identity_id, 'person:' || identity_id, 'checkpoint:' || checkpoint FROM asked JOIN ev USING (identity_id))
        SELECT DISTINCT identity_id, least(a, b) AS src, greatest(a, b) AS dst FROM e""",
    "network_report": f"WITH {REGISTRY}, c AS (SELECT identity_id, string_agg(checkpoint, ',' ORDER BY checkpoint) AS checkpoints FROM (SELECT DISTINCT identity_id, checkpoint FROM ev) GROUP BY 1), p AS (SELECT identity_id, arg_max(common_pattern, family_id) AS common_pattern FROM real GROUP BY 1) SELECT c_custkey AS identity_id, coalesce(connected_cases, 0) AS connected_cases, common_pattern, coalesce(checkpoints, '') AS checkpoints_involved FROM customer LEFT JOIN cases ON cases.identity_id = c_custkey LEFT JOIN c ON c.identity_id = c_custkey LEFT JOIN p ON p.identity_id = c_custkey",
    "screening_log": f"WITH {FACED_RISK} SELECT identity_id AS verification_id, 'event=screening_complete verification_id=' || identity_id || ' document=' || identity_id || ' risk_score=' || CAST(risk_score AS INTEGER) || ' risk_level=' || risk_level || ' officer=officer-1' AS line FROM final",
}
