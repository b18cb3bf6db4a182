"""Each query of the catalogue in DuckDB's SQL, written for its own sake: joins, windows and list functions of that engine."""

from __future__ import annotations

from evidentia.functions.checkdigits import INVERSES, POWERS, PRODUCTS
from evidentia.operators.layout import TEMPLATES
from evidentia.operators.extract import LABELS, NOT_A_NAME, SAME_LINE, UNLABELLED, VALUE_SHAPES

REF = "DATE '2026-01-01'"


def digit(x: str) -> str:
    """The 7-3-1 check digit of a SQL text."""
    value = f"(CASE WHEN substr({x}, i, 1) = '<' THEN 0 WHEN substr({x}, i, 1) BETWEEN '0' AND '9' THEN ascii(substr({x}, i, 1)) - 48 ELSE ascii(substr({x}, i, 1)) - 55 END)"
    return f"(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: {value} * (CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END))), 0) % 10)"


def holds(data: str, check: str) -> str:
    return f"(CASE WHEN {check} = '<' THEN true WHEN {check} BETWEEN '0' AND '9' THEN CAST({digit(data)} AS VARCHAR) = {check} ELSE false END)"


def verhoeff(x: str, shift: int) -> str:
    step = f"{PRODUCTS}[c * 10 + {POWERS}[((i - 1 + {shift}) % 8) * 10 + d + 1] + 1]"
    digits = f"list_transform(range(length({x})), lambda j: CAST(substr({x}, length({x}) - j, 1) AS INTEGER))"
    pairs = f"list_zip({digits}, range(1, length({x}) + 1))"
    step = step.replace(" d ", " p[1] ").replace("i - 1", "p[2] - 1")
    return f"list_reduce(list_transform({pairs}, lambda p: [p[1], p[2]]), lambda acc, p: [{step.replace('c * 10', 'acc[1] * 10')}], [0])[1]"


def valid(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN {verhoeff(x, 0)} = 0 ELSE false END)"


def char36(x: str) -> str:
    value = f"(CASE WHEN substr({x}, i, 1) BETWEEN '0' AND '9' THEN ascii(substr({x}, i, 1)) - 48 ELSE ascii(substr({x}, i, 1)) - 55 END)"
    total = f"(list_sum(list_transform(range(1, 10), lambda i: {value} * i)) % 36)"
    return f"(CASE WHEN {total} < 10 THEN CAST({total} AS VARCHAR) ELSE chr(CAST({total} + 55 AS INTEGER)) END)"


CARDS = f"""
c0 AS (
  SELECT c_custkey AS key, 'L' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number,
    CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS DATE) AS birth,
    CAST(DATE '2015-01-01' + CAST(c_custkey * 53 % 9000 AS INTEGER) AS DATE) AS expiry,
    CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END AS sex, 'CUSTOMER' AS surname,
    translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS given_names FROM customer),
c1 AS (SELECT *, strftime(birth, '%y%m%d') AS b, strftime(expiry, '%y%m%d') AS e, rpad('ZE' || lpad(CAST(key % 1000 AS VARCHAR), 4, '0'), 14, '<') AS o,
    lpad(CAST(key * 7919 % 100000000 AS VARCHAR), 11, '0') AS stem,
    'ALK' || substr('CPHFATBLJGXZ', CAST(key % 12 AS INTEGER) + 1, 1) || substr('CQ', CAST(key % 2 AS INTEGER) + 1, 1) || lpad(CAST(key * 31 % 10000 AS VARCHAR), 4, '0') AS pan9 FROM c0),
c2 AS (SELECT *, number || {digit("number")} AS p1, b || {digit("b")} AS p2, e || {digit("e")} || o || {digit("o")} AS p3,
    stem || {INVERSES}[{verhoeff("stem", 1)} + 1] AS uid0 FROM c1),
cards AS (SELECT key, number, birth, expiry, sex, surname, given_names, rpad('P<UTO' || surname || '<<' || given_names, 44, '<') AS mrz1,
    (CASE WHEN key % 7 = 0 THEN substr(p1, 1, 8) || (CAST(substr(p1, 9, 1) AS INTEGER) + 1) % 10 || substr(p1, 10, 1) ELSE p1 END) || 'UTO' || p2 || sex || p3 || {digit("(p1 || p2 || p3)")} AS mrz2,
    CASE WHEN key % 7 = 0 THEN substr(uid0, 1, 4) || (CAST(substr(uid0, 5, 1) AS INTEGER) + 1) % 10 || substr(uid0, 6, 7) ELSE uid0 END AS uid,
    pan9 || (CASE WHEN key % 5 = 0 THEN 'Q' ELSE {char36("pan9")} END) AS pan FROM c2)"""


def _zone(fmt: str) -> str:
    at = {
        "TD3": dict(document_type="l1,1,2", country="l1,3,3", document_number="l2,1,9", nationality="l2,11,3", birth="l2,14,6", sex="l2,21,1", expiry="l2,22,6", optional="l2,29,14"),
        "TD2": dict(document_type="l1,1,2", country="l1,3,3", document_number="l2,1,9", nationality="l2,11,3", birth="l2,14,6", sex="l2,21,1", expiry="l2,22,6", optional="l2,29,7"),
        "TD1": dict(document_type="l1,1,2", country="l1,3,3", document_number="l1,6,9", optional="l1,16,15", birth="l2,1,6", sex="l2,8,1", expiry="l2,9,6", nationality="l2,16,3", optional2="l2,19,11"),
    }[fmt]
    names = {"TD3": "substr(l1,6,39)", "TD2": "substr(l1,6,31)", "TD1": "l3"}[fmt]
    checks = {
        "TD3": dict(document_number="l2,10,1", birth="l2,20,1", expiry="l2,28,1", optional="l2,43,1"),
        "TD2": dict(document_number="l2,10,1", birth="l2,20,1", expiry="l2,28,1"),
        "TD1": dict(document_number="l1,15,1", birth="l2,7,1", expiry="l2,15,1"),
    }[fmt]
    whole = {
        "TD3": "(substr(l2,1,10) || substr(l2,14,7) || substr(l2,22,22))",
        "TD2": "(substr(l2,1,10) || substr(l2,14,7) || substr(l2,22,14))",
        "TD1": "(substr(l1,6,25) || substr(l2,1,7) || substr(l2,9,7) || substr(l2,19,11))",
    }[fmt]
    last = {"TD3": "substr(l2,44,1)", "TD2": "substr(l2,36,1)", "TD1": "substr(l2,30,1)"}[fmt]
    n, width = {"TD3": (2, 44), "TD2": (2, 36), "TD1": (3, 30)}[fmt]
    ok = " AND ".join(f"regexp_full_match(l{i}, '[A-Z0-9<]{{{width}}}')" for i in range(1, n + 1))
    out = [f"CASE WHEN ok THEN substr({v}) END AS {k}" for k, v in at.items()]
    out += [f"CASE WHEN ok THEN trim(replace(CASE WHEN position('<<' IN nm) > 0 THEN substr(nm, 1, position('<<' IN nm) - 1) ELSE nm END, '<', ' ')) END AS surname"]
    out += ["CASE WHEN ok THEN CASE WHEN position('<<' IN nm) > 0 THEN trim(replace(substr(nm, position('<<' IN nm) + 2), '<', ' ')) ELSE '' END END AS given_names"]
    out += [f"CASE WHEN ok THEN {holds(f'substr({at[k]})', f'substr({v})')} END AS {k}_ok" for k, v in checks.items()]
    out += [f"CASE WHEN ok THEN {holds(whole, last)} END AS composite_ok"]
    out += ["CASE WHEN ok THEN " + " OR ".join(f"{x} = '<'" for x in [*(f"substr({v})" for v in checks.values()), last]) + " END AS check_skipped"]
    return f"SELECT key, ok AS recognised, {', '.join(out)} FROM (SELECT *, {ok} AS ok, regexp_replace({names}, '<+$', '') AS nm FROM lines)"


def iso(x: str, past: bool) -> str:
    yy = f"CAST(substr({x}, 1, 2) AS INTEGER)"
    year = f"(CASE WHEN {yy} > 26 THEN 1900 + {yy} ELSE 2000 + {yy} END)" if past else f"(CASE WHEN abs(2000 + {yy} - 2026) < abs(1900 + {yy} - 2026) THEN 2000 + {yy} ELSE 1900 + {yy} END)"
    return f"strftime(try_strptime(CAST({year} AS VARCHAR) || '-' || substr({x}, 3, 2) || '-' || substr({x}, 5, 2), '%Y-%m-%d'), '%Y-%m-%d')"


_LAYOUTS = {"y-": (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), "y/": (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"), "y.": (r"\d{4}\.\d{1,2}\.\d{1,2}", "%Y.%m.%d"), "d-": (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), "d/": (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), "d.": (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"), "m/": (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y")}


def day(x: str, layouts: str = "y- y/ y. d- d/ d.") -> str:
    tries = [f"CASE WHEN regexp_full_match(trim({x}), '{_LAYOUTS[k][0]}') THEN CAST(try_strptime(trim({x}), '{_LAYOUTS[k][1]}') AS DATE) END" for k in layouts.split()]
    return f"coalesce({', '.join(tries)})"


LOGICAL, FIELDS = "y- d/ d- y/ m/", "y- d/ y/ d-"

TEXTS = CARDS + """,
texts AS (SELECT key AS doc_id,
    CASE key % 8 WHEN 0 THEN strftime(birth, '%Y-%m-%d') WHEN 1 THEN strftime(birth, '%-d/%-m/%Y') WHEN 2 THEN strftime(birth, '%d-%m-%Y') WHEN 3 THEN strftime(birth, '%Y/%m/%d')
      WHEN 4 THEN strftime(birth, '%d.%m.%Y') WHEN 5 THEN '31/02/1995' WHEN 6 THEN '' ELSE '2035-06-01' END AS birth,
    CASE key % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(expiry - 3650, '%Y-%m-%d') WHEN 2 THEN '1940-01-01' WHEN 3 THEN '2040-02-02' ELSE ' ' || strftime(expiry + 5, '%d/%m/%Y') || ' ' END AS issue,
    CASE key % 6 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '2026-01-01' ELSE strftime(expiry, '%Y-%m-%d') END AS expiry FROM cards)"""

KIND = "['passport','aadhaar','pan_card','driving_license','voter_id','id_card','national_id','residence_permit','unknown'][CAST({k} % 9 AS INTEGER) + 1]"


def rules(source: str, listed: list[tuple[str, str, str, str]]) -> str:
    """UNION ALL of (condition, code, severity, field), with the rule's number as k."""
    return " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, '{severity}' AS severity, '{field}' AS field, {k} AS k FROM {source} WHERE {condition}" for k, (condition, code, severity, field) in enumerate(listed))


DATE_FLAGS = rules("dd", [
    ("trim(birth) <> '' AND b IS NULL", "invalid_date_format", "warning", "date_of_birth"),
    ("trim(expiry) <> '' AND e IS NULL", "invalid_date_format", "warning", "date_of_expiry"),
    ("trim(issue) <> '' AND i IS NULL", "invalid_date_format", "warning", "date_of_issue"),
    (f"e < {REF}", "expired", "warning", "date_of_expiry"), ("e < i", "expiry_before_issue", "high", "date_of_expiry"),
    ("i < b", "issue_before_birth", "high", "date_of_issue"), (f"b > {REF}", "dob_in_future", "high", "date_of_birth"),
    (f"i > {REF}", "issue_in_future", "high", "date_of_issue"),
    (f"b <= {REF} AND date_part('year', age({REF}, b)) > 120", "age_out_of_plausibility", "warning", "date_of_birth"),
    ("coalesce(trim(birth), '') = ''", "dob_missing", "info", "date_of_birth"), ("coalesce(trim(expiry), '') = ''", "expiry_missing", "info", "date_of_expiry"),
    ("coalesce(trim(issue), '') = ''", "issue_missing", "info", "date_of_issue"),
])
DD = f", dd AS (SELECT *, {day('birth', LOGICAL)} AS b, {day('issue', LOGICAL)} AS i, {day('expiry', LOGICAL)} AS e FROM texts)"

FIELD_ROWS = """,
fields AS (
  SELECT key AS doc_id, 'document_number' AS name, number AS value, CASE WHEN key % 4 = 0 THEN 0.4 ELSE 0.9 END AS confidence FROM cards
  UNION ALL SELECT key, 'surname', surname, CASE WHEN (key + 1) % 4 = 0 THEN 0.4 ELSE 0.9 END FROM cards WHERE key % 6 <> 0
  UNION ALL SELECT key, 'given_names', CASE WHEN key % 4 = 0 THEN ' ' ELSE given_names END, CASE WHEN (key + 2) % 4 = 0 THEN 0.4 ELSE 0.9 END FROM cards
  UNION ALL SELECT key, 'date_of_birth', strftime(birth, '%d/%m/%Y'), CASE WHEN (key + 3) % 4 = 0 THEN 0.4 ELSE 0.9 END FROM cards
  UNION ALL SELECT key, 'date_of_expiry', strftime(expiry, '%Y-%m-%d'), CASE WHEN (key + 4) % 4 = 0 THEN 0.4 ELSE 0.9 END FROM cards WHERE key % 5 <> 0
  UNION ALL SELECT key, 'nationality', 'UTO', CASE WHEN (key + 5) % 4 = 0 THEN 0.4 ELSE 0.9 END FROM cards),
docs AS (SELECT c_custkey AS doc_id, """ + KIND.format(k="c_custkey") + """ AS document_type, CASE WHEN c_custkey % 2 = 0 THEN 'back' ELSE 'front' END AS side FROM customer),
need AS (SELECT t AS document_type, unnest(n) AS name, unnest(range(len(n))) AS k FROM (VALUES
  ('passport', ['document_number','surname','given_names','date_of_birth','date_of_expiry','nationality']),
  ('id_card', ['document_number','surname','given_names','date_of_birth','date_of_expiry']), ('national_id', ['document_number','surname','date_of_birth']),
  ('driving_license', ['document_number','surname','date_of_birth','date_of_expiry']), ('voter_id', ['document_number','surname','date_of_birth']),
  ('pan_card', ['document_number','surname','date_of_birth']), ('aadhaar', ['document_number','surname','date_of_birth']),
  ('residence_permit', ['document_number','surname','date_of_birth','date_of_expiry'])) AS v(t, n))"""
REQUIRED_FLAGS = """SELECT d.doc_id, 'missing_required_field' AS code, 'warning' AS severity, n.name AS field, n.k FROM docs d JOIN need n USING (document_type)
  WHERE NOT (document_type = 'aadhaar' AND side = 'back') AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.doc_id = d.doc_id AND f.name = n.name AND trim(f.value) <> '')"""

TD3_LINES = ", lines AS (SELECT key, mrz1 AS l1, mrz2 AS l2, NULL AS l3 FROM cards), zone AS (" + _zone("TD3") + ")"
MRZ_FLAGS = rules("(SELECT key AS doc_id, * EXCLUDE (key) FROM zone)", [
    ("NOT recognised", "mrz_unrecognized", "warning", "mrz"), ("recognised AND NOT composite_ok", "mrz_composite_check_failed", "high", "mrz"),
    *((f"recognised AND NOT {c}_ok", "mrz_field_check_failed", "warning", c) for c in ("birth", "document_number", "expiry", "optional")),
    ("recognised AND composite_ok AND birth_ok AND document_number_ok AND expiry_ok AND optional_ok", "mrz_checks_verified", "info", "mrz"),
])
ALL_FLAGS = f"WITH {TEXTS}{DD}{FIELD_ROWS}{TD3_LINES}, flags AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fam, k) AS seq, CASE severity WHEN 'high' THEN 22.0 WHEN 'warning' THEN 8.0 ELSE 0.0 END AS points FROM (SELECT 0 AS fam, * FROM ({DATE_FLAGS}) UNION ALL SELECT 1, * FROM ({REQUIRED_FLAGS}) UNION ALL SELECT 2, * FROM ({MRZ_FLAGS})))"

LINES = CARDS + """,
lines AS (SELECT key AS doc_id, unnest(range(10)) AS line_no, unnest([
    ['PASSPORT','UIDAI AADHAAR','INCOME TAX PAN CARD','SPECIMEN','ELECTOR VOTER ID'][CAST(key % 5 AS INTEGER) + 1], 'Name: CUSTOMER ' || given_names,
    CASE WHEN key % 2 = 0 THEN 'DOB: ' || strftime(birth, '%d/%m/%Y') ELSE 'DOB' END, strftime(birth, '%d/%m/%Y'), CASE WHEN key % 3 = 0 THEN 'SEX: MALE' ELSE 'Gender' END,
    CASE WHEN key % 3 = 1 THEN 'female' ELSE 'photo' END, 'Document No: ' || number, mrz1, CASE WHEN key % 5 = 0 THEN substr(mrz2, 1, 42) ELSE mrz2 END, 'END OF DOCUMENT']) AS text FROM cards)"""

REGISTRY = """
member AS (SELECT l_orderkey AS document_number, min(l_suppkey) AS family_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 GROUP BY 1),
docs AS (SELECT o_orderkey AS document_number, o_custkey AS identity_id, CAST(o_orderdate AS DATE) AS issue_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL 120 MONTH AS DATE) AS expiry_date,
    CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'O' THEN 'EXPIRED' WHEN 'P' THEN 'BLACKLISTED' END AS status, family_id FROM orders LEFT JOIN member ON document_number = o_orderkey),
fam AS (SELECT s_suppkey AS family_id, s_name AS common_pattern FROM supplier),
ev AS (SELECT event_id, user_id AS identity_id, event_type AS checkpoint, CASE WHEN value < 60 THEN 'LOW' WHEN value < 200 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, ts FROM events),
prints AS (SELECT l_orderkey AS document_number, max(l_discount + 0.0) * 10 AS font, max(l_tax + 0.0) * 10 AS layout, max(l_quantity) / 50 AS dimensions, CASE WHEN count(*) > 3 THEN min(l_discount + 0.0) * 10 END AS compression FROM lineitem GROUP BY 1),
held AS (SELECT DISTINCT identity_id, family_id FROM docs WHERE family_id IS NOT NULL AND identity_id IS NOT NULL),
cluster AS (SELECT a.identity_id, b.identity_id AS member_id FROM held a JOIN held b USING (family_id) UNION SELECT c_custkey, c_custkey FROM customer),
alerts AS (SELECT c.identity_id, count(DISTINCT checkpoint) AS total_checkpoints, count(e.event_id) AS total_appearances,
    count(DISTINCT checkpoint) >= 4 AND coalesce(bool_or(risk_level IN ('MEDIUM', 'HIGH')), false) AS alert FROM cluster c LEFT JOIN ev e ON e.identity_id = c.member_id GROUP BY 1),
matches AS (SELECT a.document_number, b.document_number AS sibling, round((1 - list_avg(list_filter([abs(p.font - q.font), abs(p.layout - q.layout), abs(p.dimensions - q.dimensions), abs(p.compression - q.compression)], lambda x: x IS NOT NULL))) * 100, 6) AS match
    FROM docs a JOIN docs b ON a.family_id = b.family_id AND a.document_number <> b.document_number JOIN prints p ON p.document_number = a.document_number JOIN prints q ON q.document_number = b.document_number),
real AS (SELECT DISTINCT identity_id, family_id, common_pattern FROM docs JOIN fam USING (family_id)),
cases AS (SELECT identity_id, count(*) AS connected_cases FROM (SELECT identity_id, document_number FROM docs UNION SELECT r.identity_id, d.document_number FROM real r JOIN docs d USING (family_id)) GROUP BY 1),
vec AS (SELECT vec_id AS identity_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
found AS (SELECT query_id, rank, identity_id, round(greatest(s, 0.0), 4) AS similarity, s >= 0.40 AS requires_review FROM (
    SELECT q.identity_id AS query_id, c.identity_id, list_cosine_similarity(q.v, c.v) AS s, row_number() OVER (PARTITION BY q.identity_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.identity_id) AS rank
    FROM vec q JOIN vec c ON q.identity_id <> c.identity_id) WHERE rank <= 3 AND s >= 0.30)"""

BYTES = "list_transform(range(32), lambda i: CAST(('0x' || substr(sha256({x}), CAST(i * 2 + 1 AS BIGINT), 2)) AS INTEGER) / 127.5 - 1)"
FACES = ",\nfaces AS (SELECT c_custkey AS identity_id, " + BYTES.format(x="c_name") + " AS v, " + BYTES.format(x="n_name") + " AS w FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),\nface AS (SELECT identity_id, v, greatest(0.0, least(0.999, 0.5 + 0.5 * list_cosine_similarity(v, w))) AS s FROM faces)"

_TD2 = CARDS + f""",
t0 AS (SELECT key, rpad('I<UTO' || surname || '<<' || given_names, 36, '<') AS l1, substr(mrz2, 1, 28) || '<<<<<<<' AS body FROM cards),
lines AS (SELECT key, l1, body || {digit("(substr(body,1,10) || substr(body,14,7) || substr(body,22,14))")} AS l2, NULL AS l3 FROM t0)"""
_TD1 = CARDS + f""",
t0 AS (SELECT key, rpad('I<UTO' || substr(mrz2, 1, 10), 30, '<') AS l1, substr(mrz2, 14, 15) || 'UTO<<<<<<<<<<<' AS body, rpad(surname || '<<' || given_names, 30, '<') AS l3 FROM cards),
lines AS (SELECT key, l1, body || CASE WHEN key % 11 = 0 THEN '<' ELSE CAST({digit("(substr(l1,6,25) || substr(body,1,7) || substr(body,9,7) || substr(body,19,11))")} AS VARCHAR) END AS l2, l3 FROM t0)"""

_BLOCK = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{f}' AS fmt, line_no, {r} AS relaxed, rpad(l1, {w}, '<') AS l1, rpad(l2, {w}, '<') AS l2 FROM w WHERE " + " AND ".join((f"length(l{i}) BETWEEN {w - 12} AND {w}" if r == "true" else f"length(l{i}) = {w}") + f" AND regexp_full_match(l{i}, '[A-Z0-9<]+')" for i in range(1, n + 1))
    for r in ("false", "true") for k, (f, n, w) in enumerate((("TD3", 2, 44), ("TD2", 2, 36), ("TD1", 3, 30))))



def _same(k: int, pattern: str, name: str) -> str:
    hit = f"regexp_extract(text, '{pattern}', 1)"
    value = f"regexp_replace({hit}, '[^A-Z0-9]', '', 'g')" if name == "document_number" else hit
    return f"SELECT doc_id, line_no, {k} AS p, '{name}' AS name, {value} AS value FROM lines WHERE {hit} <> ''"


SAME = "same AS (SELECT doc_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY line_no, p) AS r FROM (" + " UNION ALL ".join(_same(k, p, n) for k, (p, n) in enumerate(SAME_LINE)) + ")) WHERE r = 1)"
_ENDS = "(trim(text) = '' OR " + " OR ".join(f"regexp_matches(trim(text), '{p}')" for p, _, _ in LABELS) + ")"
# the lines after a label, one row for each pair, up to the first that ends the search
LATER = f"""ends AS (SELECT *, trim(text) AS t, {_ENDS} AS stop FROM lines),
pairs AS (SELECT a.doc_id, a.line_no, a.t AS label, b.line_no AS spot, b.t AS value FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND b.line_no > a.line_no
  AND NOT EXISTS (SELECT 1 FROM ends s WHERE s.doc_id = a.doc_id AND s.stop AND s.line_no > a.line_no AND s.line_no <= b.line_no)),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name, line_no, p ORDER BY spot) AS first FROM (""" + " UNION ALL ".join(
    f"SELECT doc_id, line_no, spot, {k} AS p, '{n}' AS name, value FROM pairs WHERE regexp_matches(label, '{p}')" + (f" AND regexp_matches(value, '{VALUE_SHAPES[n]}')" if n in VALUE_SHAPES else "") for k, (p, n, multi) in enumerate(LABELS) if not multi) + """)),
later AS (SELECT doc_id, name, line_no, p, value FROM cand WHERE first = 1)"""  # fmt: skip
_CONTEXT = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in UNLABELLED) + ")"
NAMES = f"""uid_docs AS (SELECT doc_id FROM lines GROUP BY 1 HAVING {_CONTEXT("string_agg(trim(text), ' ' ORDER BY line_no)")}),
loose AS (SELECT doc_id, arg_min(trim(text), line_no) AS value FROM lines WHERE doc_id IN (SELECT doc_id FROM uid_docs) AND NOT {_ENDS} AND NOT {_CONTEXT("text")} AND NOT regexp_matches(trim(text), '{NOT_A_NAME}')
  AND regexp_matches(trim(text), '^\\p{{Lu}}\\p{{L}}*(?:\\s+\\p{{L}}+){{1,5}}$') GROUP BY 1)"""

_HINTS = [("aadhaar", ["aadhaar", "unique identification", "uidai", "unique identification authority", "government of india"]), ("pan_card", ["permanent account number", "income tax", "pan card"]), ("driving_license", ["driving licence", "driving license", "motor vehicle"]), ("voter_id", ["elector", "voter id", "election commission"]), ("residence_permit", ["residence permit"]), ("national_id", ["national id", "civil registration"]), ("passport", ["passport", "ministry of external affairs"])]
_HINT_SQL = " UNION ALL ".join(f"SELECT doc_id, {k} AS o, '{t}' AS t, {' + '.join(f'CAST(contains(txt, {w!r}) AS INTEGER)' for w in ws)} AS hits FROM txt" for k, (t, ws) in enumerate(_HINTS))


def _words(x: str) -> str:
    return f"list_sort(list_filter(string_split(regexp_replace(upper({x}), '[^A-Z]+', ' ', 'g'), ' '), lambda w: w <> ''))"


def _gender(x: str) -> str:
    return f"(CASE upper(trim({x})) WHEN 'M' THEN 'MALE' WHEN 'MALE' THEN 'MALE' WHEN 'MAIL' THEN 'MALE' WHEN 'F' THEN 'FEMALE' WHEN 'FEMALE' THEN 'FEMALE' WHEN 'FMALE' THEN 'FEMALE' WHEN 'T' THEN 'TRANSGENDER' WHEN 'TRANS' THEN 'TRANSGENDER' WHEN 'TRANSGENDER' THEN 'TRANSGENDER' WHEN 'O' THEN 'OTHER' WHEN 'OTHER' THEN 'OTHER' END)"


_QR = CARDS + """,
q AS (SELECT key AS doc_id, key % 2 = 0 AS signed, uid AS qr_uid, strftime(birth, '%Y-%m-%d') AS qr_birth, given_names || ' ' || surname AS qr_name, CASE WHEN key % 3 = 0 THEN 'MALE' ELSE 'F' END AS qr_gender,
    substr(uid, 1, 4) || ' ' || substr(uid, 5, 4) || ' ' || CASE WHEN key % 6 = 0 THEN '0000' ELSE substr(uid, 9, 4) END AS number, birth + CASE WHEN key % 11 = 0 THEN 1 ELSE 0 END AS bd, birth,
    CASE WHEN key % 5 = 0 THEN 'SOMEONE' ELSE surname || ' ' || given_names END AS surname, sex FROM cards)"""

_ERRORS = [*((f"coalesce({c}, '') = ''" + ("" if k < 2 else " AND NOT few"), f"missing:{c}") for k, c in enumerate(("name", "document_number", "nationality", "date_of_birth", "issue_date", "expiry_date"))),
           ("coalesce(date_of_birth, '') <> '' AND b IS NULL", "format:date_of_birth"), ("coalesce(issue_date, '') <> '' AND i IS NULL", "format:issue_date"), ("coalesce(expiry_date, '') <> '' AND e IS NULL", "format:expiry_date"),
           (f"b > {REF}", "future:date_of_birth"), ("i >= e", "order:issue_expiry"), ("year(i) < year(b)", "order:birth_issue"),
           ("is_uid AND num <> '' AND NOT regexp_full_match(num, '[0-9]{12}')", "aadhaar:digits"), (f"is_uid AND regexp_full_match(num, '[0-9]{{12}}') AND NOT {valid('num')}", "aadhaar:checksum"), ("is_pan AND num <> '' AND NOT regexp_full_match(upper(num), '[A-Z]{5}[0-9]{4}[A-Z]')", "pan:format")]
_WARNINGS = [(f"e < {REF}", "expired"), ("is_pan AND regexp_full_match(upper(num), '[A-Z]{5}[0-9]{4}[A-Z]') AND NOT contains('CPHFATBLJG', substr(upper(num), 4, 1))", "pan:entity"),
             ("NOT (CASE document_type WHEN 'Passport' THEN regexp_full_match(upper(document_number), '[A-Z]-?[0-9]{6,9}') WHEN 'Visa' THEN regexp_full_match(upper(document_number), 'V-?[0-9]{4,9}') WHEN 'National ID' THEN regexp_full_match(upper(document_number), 'ID-?[0-9]{4,9}') WHEN 'Aadhaar' THEN regexp_full_match(upper(document_number), '[0-9]{4}\\s?[0-9]{4}\\s?[0-9]{4}') WHEN 'PAN' THEN regexp_full_match(upper(document_number), '[A-Z]{5}[0-9]{4}[A-Z]') ELSE true END)", "number:unusual")]


def _joined(listed) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in listed) + ")"


_VALIDATION = f"WITH {TEXTS}, v AS (SELECT c.key AS doc_id, ['Passport','Aadhaar','PAN','National ID','Visa'][CAST(key % 5 AS INTEGER) + 1] AS document_type, given_names AS name, CASE key % 5 WHEN 1 THEN substr(uid,1,4) || ' ' || substr(uid,5,4) || ' ' || substr(uid,9,4) WHEN 2 THEN pan WHEN 3 THEN 'ID-' || key ELSE number END AS document_number, CASE WHEN key % 6 <> 0 THEN 'UTO' END AS nationality, t.birth AS date_of_birth, t.issue AS issue_date, t.expiry AS expiry_date FROM cards c JOIN texts t ON t.doc_id = c.key), x AS (SELECT *, {day('date_of_birth', FIELDS)} AS b, {day('issue_date', FIELDS)} AS i, {day('expiry_date', FIELDS)} AS e, document_type IN ('Aadhaar', 'PAN') AS few, regexp_replace(document_number, '[ -]', '', 'g') AS num FROM v), y AS (SELECT *, document_type = 'Aadhaar' OR regexp_full_match(num, '[0-9]{{12}}') AS is_uid, document_type = 'PAN' OR regexp_full_match(upper(num), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS is_pan FROM x), z AS (SELECT doc_id, {_joined(_ERRORS)} AS errors, {_joined(_WARNINGS)} AS warnings FROM y) SELECT doc_id, errors = '' AS is_valid, errors, warnings FROM z"
_TAMPER = "WITH s AS (SELECT p_partkey AS image_id, (CASE WHEN p_partkey % 13 > 6 THEN 0.35 ELSE 0.0 END) + (CASE WHEN p_partkey % 7 < 2 THEN 0.2 ELSE 0.0 END) + (CASE WHEN p_partkey % 11 < 5 THEN 0.15 ELSE 0.0 END) AS s, (p_partkey % 50) / 50.0 AS bias FROM part), c AS (SELECT image_id, CAST(round_even(CAST(s AS DOUBLE), 2) AS DOUBLE) AS confidence, round_even(CAST(s AS DOUBLE) + bias * 0.3, 2) AS biased_confidence FROM s) SELECT image_id, confidence, CASE WHEN confidence >= 0.7 THEN 'TAMPERED' WHEN confidence >= 0.35 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS status, biased_confidence, CASE WHEN biased_confidence >= 0.7 THEN 'TAMPERED' WHEN biased_confidence >= 0.35 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS biased_status FROM c"
_FACTORS = "[{'k': 'compression', 'v': p.compression}, {'k': 'dimensions', 'v': p.dimensions}, {'k': 'font', 'v': p.font}, {'k': 'layout', 'v': p.layout}]"
PROFILE = f"""profile AS (SELECT d.document_number, CASE WHEN p.document_number IS NULL THEN 0.0 ELSE round_even(round(list_avg([x.v for x in {_FACTORS} if x.v IS NOT NULL]) * 100, 6), 1) END AS similarity_score,
    CASE WHEN p.document_number IS NULL THEN '' ELSE array_to_string([x.k || ' ' || CAST(CAST(round_even(round(x.v * 100, 6), 1) AS DECIMAL(6,1)) AS VARCHAR) for x in {_FACTORS} if x.v IS NOT NULL], ', ') END AS factors, coalesce(n, 0) AS n_related,
    CASE WHEN p.document_number IS NULL THEN 'No structural fingerprint.' WHEN n > 0 THEN 'Structural pattern shared with documents: ' || n || '.' ELSE 'No document shares the structural pattern.' END AS summary
  FROM docs d LEFT JOIN prints p ON p.document_number = d.document_number LEFT JOIN (SELECT document_number, count(*) AS n FROM matches GROUP BY 1) m ON m.document_number = d.document_number)"""

def _risk(faces: bool) -> str:
    """The risk rows; with ``faces`` their face factor is that of the pseudo-embeddings of name and nationality, else it is null."""
    similarity, match = ("round(s, 6)", "round(s, 6) >= 0.72") if faces else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)")
    return REGISTRY + (FACES if faces else "") + f""",
st0 AS (SELECT identity_id, document_number, status, row_number() OVER (PARTITION BY identity_id ORDER BY CASE status WHEN 'BLACKLISTED' THEN 3 WHEN 'EXPIRED' THEN 2 ELSE 1 END DESC, document_number DESC) AS r FROM docs),
{PROFILE},
st AS (SELECT identity_id, document_number, status, n_related AS dna_related, similarity_score AS dna_score FROM st0 JOIN profile USING (document_number) WHERE r = 1),
val AS ({_VALIDATION}),
tam AS ({_TAMPER}),
own AS (SELECT * FROM vec WHERE identity_id IN (SELECT c_custkey FROM customer)),
best AS (SELECT q.identity_id AS query_id, c.identity_id AS other, list_cosine_similarity(q.v, c.v) AS s, row_number() OVER (PARTITION BY q.identity_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.identity_id) AS rank
    FROM own q JOIN own c ON q.identity_id <> c.identity_id),
idm AS (SELECT query_id AS identity_id, count(*) AS identity_matches, string_agg('Similar identity ' || other || ' (' || CAST(round_even(round(greatest(s, 0.0), 4) * 100, 0) AS INTEGER) || '%): for review.', ' ' ORDER BY rank) AS notes
    FROM best WHERE rank <= 3 AND s >= 0.30 GROUP BY 1),
r0 AS (SELECT c_custkey AS identity_id, {similarity} AS face_similarity, {match} AS face_match, coalesce(st.status, 'UNKNOWN') AS status, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END AS n_warnings, is_valid, errors,
    confidence AS tamper_confidence, tam.status AS tamper_status, coalesce(identity_matches, 0) AS identity_matches, notes, coalesce(dna_related, 0) AS dna_related, coalesce(dna_score, 0.0) AS dna_score, coalesce(alert, false) AS checkpoint_alert,
    coalesce(connected_cases, 0) AS connected_cases, common_pattern, st.document_number AS screened, (SELECT p_partkey FROM part WHERE p_partkey = c_custkey) AS image
  FROM customer {"JOIN face ON face.identity_id = c_custkey " if faces else ""}LEFT JOIN st ON st.identity_id = c_custkey LEFT JOIN idm ON idm.identity_id = c_custkey LEFT JOIN val ON val.doc_id = c_custkey LEFT JOIN tam ON tam.image_id = c_custkey
    LEFT JOIN alerts ON alerts.identity_id = c_custkey LEFT JOIN cases ON cases.identity_id = c_custkey LEFT JOIN (SELECT identity_id, arg_max(common_pattern, family_id) AS common_pattern FROM real GROUP BY 1) pat ON pat.identity_id = c_custkey),
risk AS (SELECT *, round(least(10.0, (CASE WHEN is_valid THEN 0.0 ELSE 10.0 END) + least(2.0 * n_warnings, 5.0)), 6) AS f_validation, round(tamper_confidence * 20, 6) AS f_tampering,
    CASE WHEN face_similarity IS NOT NULL THEN round(CASE WHEN face_match THEN 0.0 ELSE 10 * (1 - face_similarity) END, 6) END AS f_face,
    CASE WHEN identity_matches > 0 THEN 20.0 ELSE 0.0 END AS f_identity,
    CASE WHEN status IS NOT NULL THEN round(15 * CASE status WHEN 'BLACKLISTED' THEN 1 WHEN 'EXPIRED' THEN 0.4 WHEN 'VALID' THEN 0 ELSE 0.3 END, 6) END AS f_status,
    round(CASE WHEN dna_related > 0 THEN dna_score / 10 ELSE 0.0 END, 6) AS f_dna, CASE WHEN checkpoint_alert THEN 5.0 ELSE 0.0 END AS f_checkpoint,
    CASE WHEN connected_cases > 1 THEN least(1.5 * connected_cases, 10.0) ELSE 0.0 END AS f_network FROM r0),
scored AS (SELECT *, CAST(round_even(least(100.0, round(coalesce(f_validation, 0) + coalesce(f_tampering, 0) + coalesce(f_face, 0) + coalesce(f_identity, 0) + coalesce(f_status, 0) + coalesce(f_dna, 0) + coalesce(f_checkpoint, 0) + coalesce(f_network, 0), 6)), 0) AS INTEGER) AS risk_score,
    concat_ws(' ', CASE WHEN tamper_status <> 'CLEAN' AND identity_id % 13 > 6 THEN 'Compression differs across the image.' END, CASE WHEN tamper_status <> 'CLEAN' AND identity_id % 7 < 2 THEN 'Few edges: smoothed or spliced.' END,
      CASE WHEN tamper_status <> 'CLEAN' AND identity_id % 11 < 5 THEN 'Little local sharpness: a region may be pasted in.' END, CASE WHEN NOT face_match THEN 'Face similarity is below the threshold.' END,
      CASE image % 9 WHEN 1 THEN 'No face detected in the document image.' WHEN 2 THEN 'Faces detected in the document image: ' || (image % 3 + 2) || '.' WHEN 3 THEN 'Face image of insufficient quality: LOW_QUALITY.' WHEN 5 THEN 'Face image of insufficient quality: INVALID_IMAGE.' WHEN 6 THEN 'The detected face could not be aligned.' END, notes,
      CASE status WHEN 'BLACKLISTED' THEN 'Document is blacklisted (listed: ' || screened || ').' WHEN 'EXPIRED' THEN 'Document has expired.' END, CASE WHEN dna_related > 0 THEN 'Structural pattern shared with documents: ' || dna_related || '.' END,
      CASE WHEN connected_cases > 1 THEN 'Connected documents: ' || connected_cases || coalesce(' (pattern ' || common_pattern || ')', '') || '.' END, CASE WHEN checkpoint_alert THEN 'Pattern seen at several checkpoints.' END,
      CASE WHEN errors <> '' THEN array_to_string(list_transform(string_split(errors, ','), lambda e: 'Validation error: ' || e || '.'), ' ') END) AS said FROM risk),
final AS (SELECT *, CASE WHEN risk_score <= 39 THEN 'LOW' WHEN risk_score <= 74 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, CASE WHEN said = '' THEN 'No significant risk indicators detected.' ELSE said END AS reasons FROM scored)"""


RISK, FACED_RISK = _risk(False), _risk(True)


ORACLES = {
    "mrz_check_digits": f"WITH {CARDS} SELECT key, CAST({digit('number')} AS INTEGER) AS number_digit, CAST({digit('b')} AS INTEGER) AS birth_digit, CAST({digit('e')} AS INTEGER) AS expiry_digit FROM c1",
    "mrz_parse_td3": f"WITH {CARDS}{TD3_LINES} SELECT * FROM zone",
    "mrz_parse_td2": f"WITH {_TD2} {_zone('TD2')}",
    "mrz_parse_td1": f"WITH {_TD1} {_zone('TD1')}",
    "mrz_century_dates": f"WITH {CARDS}, x AS (SELECT key, CASE WHEN key % 13 = 0 THEN '990231' ELSE substr(mrz2, 14, 6) END AS bb, substr(mrz2, 22, 6) AS ee FROM cards) SELECT key, {iso('bb', True)} AS birth, {iso('ee', False)} AS expiry FROM x",
    # blank lines are dropped; windows by format, exact ones first, and only then by line
    "mrz_find_block": f"""WITH first AS (SELECT key, l1 AS a1, l2 AS a2 FROM (WITH {_TD2} SELECT * FROM lines)), three AS (SELECT doc_id, line_no * 2 AS line_no, text FROM (WITH {LINES} SELECT * FROM lines)),
        every AS (SELECT * FROM three UNION ALL SELECT doc_id, 15, ' ' FROM three WHERE line_no = 14 AND doc_id % 6 = 1 UNION ALL SELECT key, -2, a1 FROM first WHERE key % 10 IN (0, 2) UNION ALL SELECT key, -1, a2 FROM first WHERE key % 10 IN (0, 2)),
        g AS (SELECT doc_id, line_no, upper(regexp_replace(text, '\\s', '', 'g')) AS l1 FROM every), w AS (SELECT *, lead(l1, 1) OVER o AS l2, lead(l1, 2) OVER o AS l3 FROM g WHERE l1 <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
        SELECT doc_id, fmt, CAST(line_no AS INTEGER) AS line_no, relaxed, l1, l2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relaxed, k, line_no) AS r FROM ({_BLOCK})) WHERE r = 1""",
    "verhoeff_verify": f"WITH {CARDS} SELECT key, {valid('uid')} AS valid, false AS junk FROM cards",
    "verhoeff_generate": f"WITH s AS (SELECT c_custkey AS key, lpad(CAST(c_custkey * 6007 % 100000000 AS VARCHAR), 11, '0') AS stem FROM customer) SELECT key, stem || {INVERSES}[{verhoeff('stem', 1)} + 1] AS number FROM s",
    "pan_structure": f"WITH {CARDS}, p AS (SELECT key AS doc_id, CASE WHEN key % 17 = 0 THEN substr(pan, 1, 8) ELSE pan END AS n, CASE WHEN key % 4 = 0 THEN ['Q'] ELSE ['C', 'P'] END AS ini FROM cards), s AS (SELECT *, regexp_full_match(n, '[A-Z]{{3}}.[A-Z][0-9]{{4}}[A-Z]') AS shape FROM p) " + rules("s", [("NOT shape", "pan_structure_invalid", "warning", "document_number"), ("shape AND NOT contains('CPHFATBLJG', substr(n, 4, 1))", "pan_status_code_invalid", "warning", "document_number"), ("shape AND NOT list_contains(ini, substr(n, 5, 1))", "pan_name_char_mismatch", "warning", "document_number"), ("shape AND list_contains(ini, substr(n, 5, 1))", "pan_name_char_match", "info", "document_number"), (f"shape AND {char36('n')} = substr(n, 10, 1)", "pan_checksum_ok", "info", "document_number"), (f"shape AND {char36('n')} <> substr(n, 10, 1)", "pan_checksum_failed", "warning", "document_number")]),
    "doc_number_format": f"WITH {CARDS}, n AS (SELECT key AS doc_id, {KIND.format(k='key')} AS t, replace(CASE key % 4 WHEN 0 THEN uid WHEN 1 THEN pan WHEN 2 THEN number || '<<' ELSE '?' END, '<', '') AS v FROM cards) SELECT doc_id, 'document_number_format' AS code, 'warning' AS severity, 'document_number' AS field FROM n WHERE NOT CASE t WHEN 'aadhaar' THEN regexp_full_match(v, '[0-9]{{12}}') WHEN 'pan_card' THEN regexp_full_match(v, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') WHEN 'passport' THEN regexp_full_match(v, '[A-Z]{{1,3}}[A-Z0-9]{{5,8}}') WHEN 'voter_id' THEN regexp_full_match(v, '[A-Z]{{3}}[0-9]{{7}}|[A-Z0-9]{{10}}') WHEN 'driving_license' THEN regexp_full_match(v, '[A-Z]{{2}}[0-9]{{2}}[0-9]{{7,11}}') WHEN 'unknown' THEN true ELSE regexp_full_match(v, '[A-Z0-9]{{4,20}}') END",
    "date_parse_multi": f"WITH {TEXTS} SELECT doc_id, strftime({day('birth')}, '%Y-%m-%d') AS visual, strftime({day('birth', LOGICAL)}, '%Y-%m-%d') AS logical, strftime({day('issue', FIELDS)}, '%Y-%m-%d') AS field FROM texts",
    "date_logic_flags": f"WITH {TEXTS}{DD} {DATE_FLAGS}",
    "required_field_flags": f"WITH {CARDS}{FIELD_ROWS} {REQUIRED_FLAGS}",
    "mrz_compliance_flags": f"WITH {CARDS}{TD3_LINES} {MRZ_FLAGS}",
    "visual_extract_labels": f"WITH {LINES}, {SAME} SELECT * FROM same",
    "visual_next_line_value": f"WITH {LINES}, {LATER} SELECT doc_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY line_no, p) AS r FROM later) WHERE r = 1",
    "visual_recogniser": f"WITH {LINES}, {SAME}, {LATER}, {NAMES}, u AS (SELECT doc_id, name, value, 0 AS way, 0 AS line_no, 0 AS p FROM same UNION ALL SELECT doc_id, name, value, 1, line_no, p FROM later UNION ALL SELECT doc_id, 'surname', value, 2, 0, 0 FROM loose) SELECT doc_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY way, line_no, p) AS r FROM u) WHERE r = 1",
    "number_fragments": f"WITH {CARDS} SELECT key AS doc_id, substr(uid, 1, 4) || substr(uid, 5, 4) || CASE WHEN key % 3 <> 0 THEN substr(uid, 9, 4) ELSE '' END AS value FROM cards",
    "name_words_match": f"WITH {CARDS}, n AS (SELECT key, surname || ' ' || given_names AS a, CASE WHEN key % 2 = 0 THEN given_names || ', ' || lower(surname) ELSE surname || '-X' END AS o FROM cards) SELECT key, array_to_string({_words('a')}, ' ') AS words, {_words('a')} = {_words('o')} AS same FROM n",
    "gender_normalise": f"WITH g AS (SELECT c_custkey AS key, [' male','F','fmale','Trans','o','x',''][CAST(c_custkey % 7 AS INTEGER) + 1] AS g FROM customer) SELECT key, {_gender('g')} AS gender FROM g",
    "type_hints_classify": f"WITH {LINES}, txt AS (SELECT doc_id, lower(string_agg(text, ' ' ORDER BY line_no)) AS txt FROM lines GROUP BY 1), h AS ({_HINT_SQL}), b AS (SELECT doc_id, arg_max(t, least(0.7, 0.3 + 0.15 * hits) * 1000 - o) AS t, max(least(0.7, 0.3 + 0.15 * hits)) AS s FROM h WHERE hits > 0 GROUP BY 1) SELECT x.doc_id, CASE WHEN x.doc_id % 3 = 0 THEN 'passport' ELSE coalesce(t, 'unknown') END AS document_type, CASE WHEN x.doc_id % 3 = 0 THEN 0.98 ELSE coalesce(round(least(0.8, s + 0.3), 6), 0.0) END AS confidence FROM txt x LEFT JOIN b ON b.doc_id = x.doc_id",
    "cross_source_mismatch": f"WITH {CARDS}, x AS (SELECT key AS doc_id, {iso('substr(mrz2, 14, 6)', True)} AS mb, {iso('substr(mrz2, 22, 6)', False)} AS me, substr(mrz2, 1, 9) AS mn, strftime(CASE WHEN key % 9 = 0 THEN birth + 1 ELSE birth END, '%Y-%m-%d') AS vb, CASE WHEN key % 8 <> 0 THEN strftime(expiry, '%Y-%m-%d') END AS ve, number AS vn, key % 10 = 0 AS tpl FROM cards) " + rules("x", [("mb <> vb", "cross_source_date_mismatch", "warning", "date_of_birth"), ("me <> ve", "cross_source_date_mismatch", "warning", "date_of_expiry"), ("NOT tpl AND mn <> vn", "cross_source_number_mismatch", "warning", "document_number")]),
    "barcode_reconcile": f"WITH {_QR} " + rules("q", [("signed", "aadhaar_qr_signed_payload", "info", "machine_readable_zone"), (valid("qr_uid"), "aadhaar_qr_checksum_ok", "info", "document_number"), (f"NOT {valid('qr_uid')}", "aadhaar_qr_checksum_failed", "high", "document_number"), ("qr_uid <> replace(number, ' ', '')", "aadhaar_qr_number_mismatch", "high", "document_number"), ("birth <> bd", "aadhaar_qr_dob_mismatch", "warning", "date_of_birth"), (f"{_words('surname')} = {_words('qr_name')}", "aadhaar_qr_name_match", "info", "surname"), (f"{_words('surname')} <> {_words('qr_name')}", "aadhaar_qr_name_mismatch", "warning", "surname"), (f"{_gender('sex')} = {_gender('qr_gender')}", "aadhaar_qr_gender_match", "info", "sex"), (f"{_gender('sex')} <> {_gender('qr_gender')}", "aadhaar_qr_gender_mismatch", "warning", "sex")]),
    "licence_reconcile": "SELECT c_custkey AS doc_id, 'dl_barcode_number_mismatch' AS code, 'high' AS severity, 'document_number' AS field FROM customer WHERE c_custkey % 7 = 0 AND c_custkey <> 0 UNION ALL SELECT c_custkey, 'dl_barcode_number_mismatch', 'high', 'document_number' FROM customer WHERE c_custkey = 0 UNION ALL SELECT c_custkey, 'dl_barcode_dob_mismatch', 'warning', 'date_of_birth' FROM customer WHERE c_custkey % 4 = 0",
    "checksum_flags": f"WITH {CARDS} " + rules("(SELECT key AS doc_id, uid FROM cards WHERE key % 9 <> 0)", [(valid("uid"), "aadhaar_checksum_ok", "info", "document_number"), (f"NOT {valid('uid')}", "aadhaar_checksum_failed", "high", "document_number")]),
    "template_best_read": f"WITH {CARDS}{FIELD_ROWS} SELECT doc_id, name, CASE WHEN t THEN value || ' b' ELSE value END AS value, CASE WHEN t THEN 'template' ELSE 'visual' END AS source FROM (SELECT *, name = 'given_names' OR (name IN ('document_number','date_of_birth','date_of_expiry','issue_date','sex') AND confidence < 0.7) AS t FROM fields)",
    "template_box_fields": f"""WITH {LINES}, b AS (SELECT doc_id, line_no, trim(text) AS value, 0.5::DOUBLE + 0.05::DOUBLE * ((doc_id + 3 * line_no) % 10) AS confidence, 0.05::DOUBLE + 0.09::DOUBLE * ((doc_id + line_no) % 7) AS x, 0.02::DOUBLE + 0.095::DOUBLE * line_no + 0.01::DOUBLE * (doc_id % 5) AS y, 0.15::DOUBLE + 0.05::DOUBLE * (doc_id % 4) AS wide FROM lines),
        t AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{t}', '{n}', {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)" for k, (t, fields) in enumerate(TEMPLATES.items()) for n, x0, y0, x1, y1 in fields)}) v(k, document_type, name, x0, y0, x1, y1)),
        j AS (SELECT doc_id, line_no, document_type, name, value, confidence, round((least(x + wide, x1) - greatest(x, x0)) * (least(y + 0.03::DOUBLE, y1) - greatest(y, y0)) / (wide * 0.03::DOUBLE), 9) AS share FROM b JOIN t ON t.k IN (doc_id % 3, (doc_id + 1) % 3) WHERE value <> '' AND x < x1 AND x + wide > x0 AND y < y1 AND y + 0.03 > y0),
        w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, document_type, name ORDER BY confidence DESC, share DESC, line_no) AS r FROM j WHERE share >= 0.5)
        SELECT doc_id, document_type, name, confidence, CASE WHEN name = 'document_number' THEN regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') WHEN name IN ('date_of_birth', 'date_of_expiry', 'issue_date') THEN coalesce(nullif(regexp_extract(value, '[0-9]{{1,4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}', 0), ''), regexp_replace(value, '\\s+', '', 'g'))
            WHEN name = 'sex' THEN coalesce(nullif(upper(regexp_extract(value, '(?i)(male|female|M|F)', 1)), ''), trim(value)) ELSE value END AS value FROM w WHERE r = 1 AND CASE WHEN name = 'document_number' THEN regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') <> '' ELSE true END""",
    "secure_anchor_flags": f"WITH {CARDS}{FIELD_ROWS}, a AS (SELECT *, CASE WHEN document_type IN ('passport','id_card','residence_permit') THEN 'mrz' WHEN document_type = 'aadhaar' THEN 'aadhaar_qr' WHEN document_type = 'driving_license' THEN 'dl_barcode' END AS anchor, ['mrz','aadhaar_qr','dl_barcode','other'][CAST(doc_id % 4 AS INTEGER) + 1] AS channel FROM docs) SELECT doc_id, CASE WHEN document_type = 'aadhaar' AND side = 'front' THEN 'anchor_not_verifiable' ELSE 'secure_anchor_missing' END AS code, CASE WHEN document_type = 'aadhaar' AND side = 'front' THEN 'info' ELSE 'warning' END AS severity, 'machine_readable_zone' AS field FROM a WHERE anchor IS NOT NULL AND anchor <> channel",
    "blacklist_tristate": "SELECT c_custkey AS doc_id, c AS code, CASE WHEN c IN ('blacklist_hit','blacklist_number_listed','blacklist_lookup_failed') THEN 'warning' ELSE 'info' END AS severity FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'blacklist_no_identifiers' WHEN c_custkey % 24 = 12 THEN 'blacklist_number_listed' WHEN c_custkey % 12 = 0 THEN 'blacklist_hit' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'blacklist_lookup_failed' ELSE 'blacklist_clear' END AS c FROM customer)",
    "flag_ledger_running": f"{ALL_FLAGS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, code, severity, least(60.0, cum) - least(60.0, cum - points) AS deduction, 100 - least(60.0, cum) AS balance FROM (SELECT *, sum(points) OVER (PARTITION BY doc_id ORDER BY seq) AS cum FROM flags)",
    "coherence_score": f"{ALL_FLAGS}, f AS (SELECT doc_id, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i, sum(points) AS p FROM flags GROUP BY 1), u AS (SELECT doc_id, count(*) AS u FROM fields WHERE confidence < 0.6 GROUP BY 1), s AS (SELECT d.doc_id, coalesce(h, 0) AS n_high, coalesce(w, 0) AS n_warning, coalesce(i, 0) AS n_info, CAST(least(60.0, coalesce(p, 0)) AS DOUBLE) AS flag_deductions, CAST(least(10.0, 2.0 * coalesce(u, 0)) AS DOUBLE) AS confidence_deductions, CAST(CASE WHEN document_type = 'unknown' THEN 25.0 ELSE 0.0 END AS DOUBLE) AS unknown_penalty FROM docs d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id) SELECT *, CAST(greatest(0.0, 100 - flag_deductions - confidence_deductions - unknown_penalty) AS INTEGER) AS score FROM s",
    "field_validation": _VALIDATION,
    "field_validation_ingest": f"""WITH v AS ({_VALIDATION}), g AS (SELECT * FROM (WITH {TEXTS}{DD} {DATE_FLAGS})), f AS (SELECT doc_id, string_agg('ocr:' || code, ',' ORDER BY k, code, field) FILTER (severity = 'high') AS high, string_agg('ocr:' || code, ',' ORDER BY k, code, field) FILTER (severity = 'warning') AS low FROM g GROUP BY 1),
        j AS (SELECT doc_id, concat_ws(',', nullif(errors, ''), high) AS errors, concat_ws(',', nullif(warnings, ''), low) AS warnings FROM v LEFT JOIN f USING (doc_id)) SELECT doc_id, errors = '' AS is_valid, errors, warnings FROM j""",
    "self_test_recent": "SELECT split_part(p_type, ' ', 1) AS manipulation_type, (p_partkey * 37 % 600) / 10 + 40 AS confidence, ((p_partkey * 37 % 600) / 10 + 40 >= 70) = (p_size % 5 <> 0) AS correct, strftime(TIMESTAMP '2026-01-01' + to_minutes(p_partkey * 7919 % 500000), '%Y-%m-%d %H:%M:%S') AS at, p_partkey AS test_id FROM part ORDER BY p_partkey * 7919 % 500000 DESC, p_partkey LIMIT 20",
    "document_status": f"WITH {REGISTRY}, k AS (SELECT DISTINCT o_orderkey * 2 AS document_number FROM orders) SELECT k.document_number, coalesce(status, 'UNKNOWN') AS status, CASE WHEN status = 'BLACKLISTED' THEN 'listed: ' || k.document_number END AS detail FROM k LEFT JOIN docs d ON d.document_number = k.document_number",
    "family_members": f"WITH {REGISTRY}, m AS (SELECT family_id, count(*) AS n_members, string_agg(CAST(document_number AS VARCHAR), ',' ORDER BY document_number) AS members FROM docs WHERE family_id IS NOT NULL GROUP BY 1) SELECT document_number, family_id, common_pattern, n_members, members FROM docs JOIN fam USING (family_id) JOIN m USING (family_id)",
    "family_of_document": f"WITH {REGISTRY}, m AS (SELECT family_id, count(*) AS n_members FROM docs WHERE family_id IS NOT NULL GROUP BY 1) SELECT document_number, family_id, common_pattern, n_members FROM docs JOIN fam USING (family_id) JOIN m USING (family_id)",
    "members_of_blacklisted": f"WITH {REGISTRY} SELECT a.document_number, b.document_number AS member FROM docs a JOIN docs b USING (family_id) WHERE a.status = 'BLACKLISTED'",
    "fingerprint_similarity": f"WITH {REGISTRY} SELECT * FROM matches WHERE match IS NOT NULL",
    "cluster_expand": f"WITH {REGISTRY} SELECT * FROM cluster",
    "cross_checkpoint_alert": f"WITH {REGISTRY} SELECT * FROM alerts",
    "checkpoint_history": f"WITH {REGISTRY} SELECT c.identity_id, event_id, checkpoint, risk_level, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(row_number() OVER (PARTITION BY c.identity_id ORDER BY ts, event_id) AS INTEGER) AS position FROM cluster c JOIN ev ON ev.identity_id = c.member_id",
    "graph_nodes": f"WITH {REGISTRY} SELECT 'person:' || c_custkey AS id, c_name AS label, 'person' AS type FROM customer UNION SELECT 'document:' || document_number, 'Document ' || document_number, 'document' FROM docs UNION SELECT 'pattern:' || family_id, 'Pattern ' || family_id, 'pattern' FROM fam WHERE family_id IN (SELECT family_id FROM docs) UNION SELECT 'checkpoint:' || checkpoint, checkpoint, 'checkpoint' FROM ev",
    "graph_edges": f"WITH {REGISTRY}, e AS (SELECT 'person:' || identity_id AS a, 'document:' || document_number AS b FROM docs WHERE identity_id IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'document:' || document_number, 'pattern:' || family_id FROM docs WHERE family_id IN (SELECT family_id FROM fam) UNION ALL SELECT 'person:' || identity_id, 'checkpoint:' || checkpoint FROM ev WHERE identity_id IN (SELECT c_custkey FROM customer)) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM e",
    "graph_connected_cases": f"WITH {REGISTRY} SELECT c.identity_id, connected_cases, common_pattern FROM cases c LEFT JOIN (SELECT identity_id, arg_max(common_pattern, family_id) AS common_pattern FROM real GROUP BY 1) p ON p.identity_id = c.identity_id",
    "identity_topk": f"WITH {REGISTRY} SELECT query_id, CAST(rank AS INTEGER) AS rank, identity_id, similarity, requires_review FROM found",
    "face_threshold_match": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT p.vec_id AS probe_id, coalesce(CAST(k.vec_id AS VARCHAR), 'unknown') AS known_id, round(list_distance(p.v, k.v), 6) AS distance FROM (SELECT * FROM v WHERE vec_id % 10 = 0) p LEFT JOIN v k ON k.vec_id % 10 <> 0 AND list_distance(p.v, k.v) <= 1.25",
    "face_best_match": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT p.vec_id AS probe_id, k.vec_id, list_distance(p.v, k.v) AS d FROM v p JOIN v k ON p.vec_id % 10 = 0 AND k.vec_id % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS r FROM d) SELECT probe_id, CASE WHEN d <= 1.25 THEN CAST(vec_id AS VARCHAR) ELSE 'unknown' END AS known_id, round(d, 6) AS distance FROM r WHERE r = 1",
    "hash_pseudo_embedding": f"WITH {FACES[2:]} SELECT identity_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total, round(s, 6) AS score, s >= 0.72 AS match FROM face",
    "fingerprint_profile": f"WITH {REGISTRY}, {PROFILE} SELECT * FROM profile",
    "risk_factors": f"WITH {FACED_RISK} SELECT identity_id, f_validation, f_tampering, f_face, f_identity, f_status, f_dna, f_checkpoint, f_network FROM risk",
    "risk_score_band": f"WITH {FACED_RISK} SELECT identity_id, risk_score, risk_level FROM final",
    "reasons_list": f"WITH {RISK} SELECT identity_id, reasons FROM final",
    "screen_pipeline": f"WITH {RISK} SELECT identity_id, risk_score, risk_level, reasons, upper(sha256(identity_id || ':' || risk_level)) AS document_hash FROM final",
    "audit_hash_log": f"WITH {RISK} SELECT identity_id AS verification_id, upper(sha256(identity_id || ':' || risk_level)) AS document_hash, 'CONFIRMED' AS status FROM final",
    "audit_recent": "SELECT event_id, user_id AS identity_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "officer_decision_latest": "WITH d AS (SELECT user_id, ['CLEARED','SECONDARY_INSPECTION','DENIED'][CAST(event_id % 3 AS INTEGER) + 1] AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT c_custkey AS verification_id, decision, coalesce(n, 0) AS n_decisions FROM customer LEFT JOIN d ON user_id = c_custkey AND r = 1",
    "self_test_accuracy": "WITH t AS (SELECT string_split(p_type, ' ')[1] AS manipulation_type, (p_partkey * 37 % 600) / 10 + 40 AS confidence, p_size % 5 <> 0 AS expected FROM part) SELECT manipulation_type, count(*) AS n, count(*) FILTER (expected = (confidence >= 70)) AS n_correct, round(avg(confidence), 6) AS mean_confidence FROM t GROUP BY 1",
    "tamper_status": _TAMPER,
    "kpi_rollup": f"WITH {REGISTRY} SELECT CAST(year(issue_date) AS INTEGER) AS year, status, count(*) AS n, count(family_id) AS n_in_family FROM docs GROUP BY ROLLUP (year(issue_date), status)",
    "kpi_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS checkpoint, count(*) AS n, count(*) FILTER (value >= 60) AS n_risky FROM events GROUP BY 1, 2",
    "session_activity": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n_events FROM h GROUP BY user_id, k",
    "frontal_confidence": "SELECT vec_id, round(greatest(0.40, least(0.99, 1 - list_stddev_pop(CAST(embedding AS DOUBLE[])) / 0.14)), 3) AS confidence FROM embeddings",
    "upload_verdicts": "WITH f AS (SELECT p_partkey AS file_id, p_partkey % 4 AS h, 'in/' || replace(p_name, ' ', '.') || ['.JPG','.png','.gif'][CAST(p_partkey % 3 AS INTEGER) + 1] AS path, p_partkey * 104729 % 12000000 * (p_partkey % 5) AS length FROM part) SELECT file_id, CASE h WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' END AS media_type, CASE WHEN length = 0 THEN 'empty' WHEN length > 10485760 THEN 'too_large' WHEN h = 3 OR file_id % 3 = 2 THEN 'unsupported' ELSE 'ok' END AS verdict, substr(regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g'), 1, 24) AS crop FROM f",
    "box_convert": "SELECT p_partkey AS box_id, CAST(greatest(p_partkey % 50 - 10, 0) AS BIGINT) AS top, CAST(least(p_partkey % 700, 640) AS BIGINT) AS right, CAST(least(p_partkey % 500, 480) AS BIGINT) AS bottom, CAST(greatest(p_partkey % 90 - 20, 0) AS BIGINT) AS left, least(1.0, least(p_partkey % 640, p_partkey % 320 * 2) / 640.0) AS x0, least(1.0, least(p_partkey % 480, p_partkey % 960) / 480.0) AS y0, least(1.0, greatest(p_partkey % 640, p_partkey % 320 * 2) / 640.0) AS x1, least(1.0, greatest(p_partkey % 480, p_partkey % 960) / 480.0) AS y1 FROM part",
}

ORACLES |= {
    "field_resolution": f"WITH {CARDS} SELECT key AS doc_id, CASE WHEN key % 2 = 0 THEN number ELSE uid END AS document_number, trim(given_names || ' ' || CASE WHEN key % 3 = 0 THEN '' ELSE surname END) AS full_name, CASE WHEN key % 4 = 0 THEN 'UTO' END AS nationality, CAST(NULL AS VARCHAR) AS date_of_birth, CAST(NULL AS VARCHAR) AS issue_date, strftime(expiry, '%Y-%m-%d') AS expiry_date, CASE sex WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' END AS gender, round(CAST((CASE WHEN key % 2 = 0 THEN 0.9 ELSE 0 END) + 0.99 + 0.99 + 0.5 + (CASE WHEN key % 3 = 0 THEN 0 ELSE 0.5 END) + 0.7 + 0.8 AS DOUBLE) / ((CASE WHEN key % 2 = 0 THEN 1 ELSE 0 END) + 5 + (CASE WHEN key % 3 = 0 THEN 0 ELSE 1 END)), 6) AS confidence FROM cards",
    "candidate_types": f"WITH {CARDS}{FIELD_ROWS}, h AS (SELECT doc_id, t, j, (doc_id + j) % 3 / 10.0 AS s FROM docs, (VALUES (0, 'aadhaar'), (1, 'pan_card'), (2, 'passport'), (3, 'voter_id')) AS v(j, t)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, j) AS r FROM h WHERE s > 0), l AS (SELECT doc_id, list(t ORDER BY r) AS l FROM r WHERE r <= 2 GROUP BY 1), a AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 AND document_type <> 'unknown' THEN document_type END AS f, CASE WHEN d.doc_id % 3 = 0 THEN ['passport'] ELSE l END AS l FROM docs d JOIN l ON l.doc_id = d.doc_id) SELECT doc_id, array_to_string(CASE WHEN f IS NULL THEN l ELSE list_concat([f], list_filter(l, lambda x: x <> f)) END, ',') AS candidates FROM a",
    "degraded_results": f"WITH {CARDS}{FIELD_ROWS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE document_type END AS document_type, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 101 END AS INTEGER) AS score, CAST(CASE WHEN doc_id % 5 = 0 THEN 25 ELSE 0 END AS DOUBLE) AS unknown_penalty, doc_id % 5 = 0 AS degraded FROM docs",
    "channel_modes": f"WITH {CARDS}{FIELD_ROWS}, m AS (SELECT doc_id, side, ['auto','passport','aadhaar','pan_card','driving_license','other'][CAST(doc_id % 6 AS INTEGER) + 1] AS mode FROM docs) SELECT doc_id, mode, CASE WHEN mode NOT IN ('auto', 'other') THEN mode END AS forced_type, mode IN ('aadhaar','pan_card','driving_license') AS skip_mrz, mode IN ('passport','pan_card') AS skip_barcodes, NOT (mode = 'aadhaar' AND side = 'back') AS accepted FROM m",
    "score_report": f"WITH {TEXTS}{DD}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS seq, CASE severity WHEN 'high' THEN 22 WHEN 'warning' THEN 8 ELSE 0 END AS points FROM ({DATE_FLAGS})), g AS (SELECT *, sum(points) OVER (PARTITION BY doc_id ORDER BY seq) AS cum FROM f) SELECT c_custkey AS doc_id, 0 AS line_no, 'document ' || c_custkey || ': ' || CAST(100 - least(60, coalesce((SELECT sum(points) FROM f WHERE f.doc_id = c_custkey), 0)) AS INTEGER) || ' points' AS line FROM customer UNION ALL SELECT doc_id, CAST(seq AS INTEGER), '  -' || CAST(least(60, cum) - least(60, cum - points) AS INTEGER) || ' ' || code || ' (' || severity || '), ' || CAST(100 - least(60, cum) AS INTEGER) || ' left' FROM g WHERE least(60, cum) > least(60, cum - points)",
    "verification_records": f"""WITH {FACED_RISK}, j AS (SELECT identity_id, '{{"identity_id":' || identity_id || ',"risk_level":"' || risk_level || '","risk_score":' || risk_score || '}}' AS j FROM final) SELECT CAST(identity_id AS VARCHAR) AS subject, 'VER-' || upper(sha256(j || '@2026-01-01')) AS verification_id, j AS result_json FROM j""",
}


def _as_doubles(name: str, columns: list[str]) -> None:
    """Number literals are decimals in this dialect; the named columns become doubles."""
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({ORACLES[name]})"


_as_doubles("type_hints_classify", ["confidence"])
_as_doubles("flag_ledger_running", ["deduction", "balance"])
_as_doubles("risk_factors", ["f_validation", "f_tampering", "f_face", "f_identity", "f_status", "f_dna", "f_checkpoint", "f_network"])


for _name in ("barcode_reconcile", "checksum_flags", "cross_source_mismatch", "date_logic_flags", "mrz_compliance_flags", "pan_structure", "required_field_flags"):
    ORACLES[_name] = f"SELECT * EXCLUDE (k) FROM ({ORACLES[_name]})"
