"""From text lines (doc_id, line_no, text, confidence) to fields: machine-readable blocks, labels, next lines, type hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Same-line patterns and the field each gives, in order; the first that matches on the first line wins.
SAME_LINE = [
    (r"(?i)\b([0-9]{12})\b", "document_number"),
    (r"(?i)document\s*no\.?\s*[:#-]*\s*([A-Z0-9]{5,20})", "document_number"),
    (r"(?i)\b([0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4})\b", "document_number"),
    (r"(?i)aadhaar(?:\s*(?:number|no\.?|uid))?\s*[:#-]*\s*([0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4})", "document_number"),
    (r"(?i)permanent\s+account\s+(?:number|no\.?)\s*[:#-]*\s*([A-Z]{5}\d{4}[A-Z])", "document_number"),
    (r"(?i)\b([A-Z]{5}\d{4}[A-Z])\b", "document_number"),
    (r"(?i)(?:licence|license)\s*(?:no\.?|number)?\s*[:#-]*\s*([A-Z]{2}\d{2}\d{7,11})", "document_number"),
    (r"(?i)\b([A-Z]{2}\d{2}\d{7,11})\b", "document_number"),
    (r"(?i)(?:date\s*[o0]\s*f\s*birth|dob|d0b)\s*[:#-]*\s*([0-9-./]{8,10})", "date_of_birth"),
    (r"(?i)(?:date\s*of\s*(?:expiry|expiration)|valid\s*(?:till|until|through))\s*[:#-]*\s*([0-9-./]{8,10})", "date_of_expiry"),
    (r"(?i)(?:issue(?:d|date)?|date\s*of\s*issue)\s*[:#-]*\s*([0-9-./]{8,10})", "issue_date"),
    (r"(?im)^\s*(?:name|full\s*name)\s*[:#-]*\s*([A-Z][A-Z\s.]{2,40})", "surname"),
    (r"(?i)(?:sex|gender)\s*[:#-]*\s*(male|female|M|F)\b", "sex"),
    (r"(?i)^\s*((?:male|female))\b", "sex"),
]
# Labels whose value follows on a later line, the field, and whether it comes in fragments.
LABELS = [
    (r"(?im)^\s*(?:name|full\s*name)\b", "surname", False),
    (r"(?im)^\s*(?:dob|date\s*[o0]\s*f\s*birth)\b", "date_of_birth", False),
    (r"(?im)^\s*(?:sex|gender)\b", "sex", False),
    (r"(?im)^\s*(?:your\s+aadhaar\s*number|aadhaar(?:\s*(?:number|no\.?|uid))?)\b", "document_number", True),
    (r"(?im)^\s*document\s*no\.?\b", "document_number", False),
    (r"(?im)^\s*(?:date\s*of\s*(?:expiry|expiration)|valid\s*(?:till|until|through))\b", "date_of_expiry", False),
]
# What a following line must look like for a field; any line will do for the others.
VALUE_SHAPES = {
    "date_of_birth": r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|^\s*\d{4}\s*$",
    "date_of_expiry": r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}",
    "sex": r"(?i)^(?:male|female|transgender)$",
    "document_number": r"(?:[A-Z0-9][^A-Z0-9]*){4}",
}
# Words of the one kind of document that prints a name without a label, and how lines begin that are none.
UNLABELLED = ("aadhaar", "uidai", "unique identification")
NOT_A_NAME = r"(?i)^(?:aadhaar|it|or|authentication|and|government|unique|date|this|proof)"
# Keywords that hint at a document type, in the order that settles ties.
HINTS = {
    "aadhaar": ["aadhaar", "unique identification", "uidai", "unique identification authority", "government of india"],
    "pan_card": ["permanent account number", "income tax", "pan card"],
    "driving_license": ["driving licence", "driving license", "motor vehicle"],
    "voter_id": ["elector", "voter id", "election commission"],
    "residence_permit": ["residence permit"],
    "national_id": ["national id", "civil registration"],
    "passport": ["passport", "ministry of external affairs"],
}
#: Most filler characters that the relaxed reading adds to a line's end.
MAX_PADDING = 12


def mrz_block(lines: DataFrame) -> DataFrame:
    """doc_id, fmt, line_no, relaxed, l1, l2, l3: the first window of lines that can be a machine-readable zone.

    Blank lines don't count: windows are runs of the others, in upper case and without white space. All windows are tried for
    TD3, then for TD2, then for TD1; only then come, in the same order, windows whose lines lack up to ``MAX_PADDING`` fillers at
    their ends, which are added. A window with a line of other characters is none.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", F.upper(F.regexp_replace("text", r"\s", "")).alias("l1")).where("l1 <> ''")
    rows = rows.withColumns({"l2": F.lead("l1", 1).over(order), "l3": F.lead("l1", 2).over(order)})
    fits, zone = [], "^[A-Z0-9<]+$"
    for relaxed in (False, True):
        for fmt, n, width in (("TD3", 2, 44), ("TD2", 2, 36), ("TD1", 3, 30)):
            used = ["l1", "l2", "l3"][:n]
            ok = F.lit(True)
            for c in used:
                ok = ok & (F.length(c).between(width - MAX_PADDING, width) if relaxed else F.length(c) == width) & F.col(c).rlike(zone)
            padded = [F.rpad(c, width, "<") if c in used else F.lit(None).cast("string") for c in ("l1", "l2", "l3")]
            window = F.struct(F.lit(len(fits)).alias("rank"), "line_no", F.lit(fmt).alias("fmt"), F.lit(relaxed).alias("relaxed"), *(x.alias(c) for x, c in zip(padded, ("l1", "l2", "l3"), strict=True)))
            fits.append(F.when(F.coalesce(ok, F.lit(False)), window))
    best = rows.select("doc_id", F.coalesce(*fits).alias("b")).where("b IS NOT NULL").groupBy("doc_id").agg(F.min("b").alias("b"))
    return best.select("doc_id", "b.fmt", "b.line_no", "b.relaxed", "b.l1", "b.l2", "b.l3")


def _sure(lines: DataFrame) -> DataFrame:
    """``lines`` with text, confidence (1 unless given) and x (0 unless given)."""
    given = lambda c, x: F.coalesce(F.col(c).cast("double"), F.lit(x)) if c in lines.columns else F.lit(x)
    return lines.select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("text"), given("confidence", 1.0).alias("confidence"), given("x", 0.0).alias("x"))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Z0-9]", "")


def same_line_fields(lines: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence: for each field the first match by line, then pattern; numbers without separators."""
    tries = []
    for k, (p, name) in enumerate(SAME_LINE):
        found = F.regexp_extract("text", p, 1)
        value = _bare(found) if name == "document_number" else found
        tries.append(F.when(found != "", F.struct(F.lit(k).alias("pattern_no"), F.lit(name).alias("name"), value.alias("value"))))
    found = _sure(lines).select("doc_id", "line_no", "confidence", F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("m"))
    first = found.groupBy("doc_id", "m.name").agg(F.min(F.struct("line_no", "m.pattern_no", "m.value", "confidence")).alias("b"))
    return first.select("doc_id", "name", "b.value", "b.confidence")


def _is_label(text: Column) -> Column:
    """Whether a line begins with any label, in one search."""
    begins = r"(?im)^\s*"
    return text.rlike(f"{begins}(?:{'|'.join(label.removeprefix(begins) for label, _, _ in LABELS)})")


def _followed(lines: DataFrame) -> DataFrame:
    """Lines with stop_at, the next line that is blank or a label, and next_<field>, the next one with that field's shape.

    Lines are gone through from the last to the first, so that each adds to what follows the one before it.
    """
    after = Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = _sure(lines).withColumn("text", F.trim("text"))
    fits = {name: F.col("text").rlike(VALUE_SHAPES[name]) if name in VALUE_SHAPES else F.lit(True) for _, name, multi in LABELS if not multi}
    here = F.struct("line_no", F.col("text").alias("value"), "confidence")
    ends = (F.col("text") == "") | _is_label(F.col("text"))
    rows = rows.withColumn("stop_at", F.min(F.when(ends, F.col("line_no"))).over(after))
    return rows.withColumns({f"next_{name}": F.min(F.when(ok, here)).over(after) for name, ok in fits.items()} | {"ends": ends})


def _label_candidates(lines: DataFrame) -> DataFrame:
    """doc_id, name, line_no and pattern_no of the label, value, confidence."""
    near = lambda name: F.col(f"next_{name}.line_no") < F.coalesce("stop_at", F.lit(2**31 - 1))
    tries = [F.when(F.col("text").rlike(label) & near(name), F.struct(F.lit(k).alias("pattern_no"), F.lit(name).alias("name"), F.col(f"next_{name}.value").alias("value"), F.col(f"next_{name}.confidence").alias("confidence"))) for k, (label, name, multi) in enumerate(LABELS) if not multi]
    found = _followed(lines).select("doc_id", "line_no", F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("m"))
    return found.select("doc_id", "m.name", "line_no", "m.pattern_no", "m.value", "m.confidence")


def next_line_fields(lines: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence: of each field's first label that has one, the first later line of the right shape.

    Other tokens beside the value are passed over; a blank line or another label ends the search.
    """
    first = _label_candidates(lines).groupBy("doc_id", "name").agg(F.min(F.struct("line_no", "pattern_no", "value", "confidence")).alias("b"))
    return first.select("doc_id", "name", "b.value", "b.confidence")


def number_fragments(lines: DataFrame, pattern_no: int = 3) -> DataFrame:
    """doc_id, line_no (of the label), value, confidence: a number in fragments on the lines after its label, by their left edge ``x``.

    The line after the label must have digits; lines are taken until they have 12 together, a blank line or another
    label comes.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    doc = Window.partitionBy("doc_id")
    rows = _sure(lines).withColumn("text", F.trim("text"))
    rows = rows.withColumns({"digits": F.length(F.regexp_replace("text", "[^0-9]", "")), "ends": (F.col("text") == "") | _is_label(F.col("text"))})
    begins = F.col("text").rlike(LABELS[pattern_no][0]) & (F.lead("digits").over(order) > 0) & ~F.lead("ends").over(order)
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)))
    rows = rows.withColumn("start", F.min(F.when(F.col("begins"), F.struct("line_no", "confidence"))).over(doc)).where(F.col("line_no") > F.col("start.line_no"))
    rows = rows.withColumns({"ended": F.max(F.col("ends").cast("int")).over(order), "before": F.sum("digits").over(order) - F.col("digits")}).where("ended = 0 AND before < 12")
    out = rows.groupBy("doc_id", F.col("start.line_no").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("x", "line_no", "text"))).alias("parts"), F.least(F.min("confidence"), F.min("start.confidence")).alias("confidence"))
    return out.select("doc_id", "line_no", F.array_join(F.transform("parts", lambda p: _bare(p["text"])), "").alias("value"), "confidence")


def unlabelled_names(lines: DataFrame) -> DataFrame:
    """doc_id, name (surname), value, confidence: the first line of two to six words that can be a name, where no label is printed."""
    text = F.trim("text")
    word = lambda t: F.exists(F.array(*(F.lit(w) for w in UNLABELLED)), lambda w: F.contains(F.lower(t), w))
    rows = _sure(lines).select("doc_id", "line_no", text.alias("value"), "confidence", word(F.col("text")).alias("context"))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), " ").alias("t"))
    of = whole.where(word(F.col("t"))).select("doc_id")
    v = F.col("value")
    fits = v.rlike(r"^\p{Lu}\p{L}*(?:\s+\p{L}+){1,5}$") & ~v.rlike(NOT_A_NAME) & ~_is_label(v) & ~F.col("context")
    first = rows.where(fits).join(of, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("line_no", "value", "confidence")).alias("b"))
    return first.select("doc_id", F.lit("surname").alias("name"), "b.value", "b.confidence")


def recognise(lines: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence: values beside their label first, then on later lines, then names without a label."""
    same = same_line_fields(lines)
    fragments = number_fragments(lines).select("doc_id", F.lit("document_number").alias("name"), "line_no", F.lit(3).alias("pattern_no"), "value", "confidence")
    later = _label_candidates(lines).unionByName(fragments).groupBy("doc_id", "name").agg(F.min(F.struct("line_no", "pattern_no", "value", "confidence")).alias("b"))
    later = later.select("doc_id", "name", "b.value", "b.confidence")
    ranked = same.withColumn("way", F.lit(0)).unionByName(later.withColumn("way", F.lit(1))).unionByName(unlabelled_names(lines).withColumn("way", F.lit(2)))
    return ranked.groupBy("doc_id", "name").agg(F.min(F.struct("way", "value", "confidence")).alias("b")).select("doc_id", "name", "b.value", "b.confidence")


def classify(lines: DataFrame, mrz_types: DataFrame | None = None) -> DataFrame:
    """doc_id, document_type, confidence: the zone's type letter first, else the strongest hint, else unknown."""
    text = F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " "))
    docs = lines.groupBy("doc_id").agg(text.alias("t"))
    hits = lambda words: sum(((F.instr("t", w) > 0).cast("int") for w in words), F.lit(0))
    counted = F.array(*(F.struct(hits(words).alias("hits"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, (t, words) in enumerate(HINTS.items())))
    hinted = docs.select("doc_id", F.explode(counted).alias("h")).where("h.hits > 0")
    score = F.least(F.lit(0.7), 0.3 + 0.15 * F.col("h.hits"))
    best = hinted.groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), "h.order", "h.type")).alias("best"))
    out = lines.select("doc_id").distinct().join(best, "doc_id", "left")
    kind, sure = F.coalesce(F.col("best.type"), F.lit("unknown")), F.coalesce(F.round(F.least(F.lit(0.8), F.col("best.score") + 0.3), 6), F.lit(0.0))
    if mrz_types is not None:
        out = out.join(mrz_types, "doc_id", "left")
        letter = F.replace(F.col("mrz_type"), F.lit("<"), F.lit(""))
        kind = F.when(letter.isNull(), kind).when(letter == "P", "passport").when(letter.isin("I", "ID"), "id_card").otherwise("unknown")
        sure = F.when(letter.isNull(), sure).when(letter == "P", 0.98).when(letter.isin("I", "ID"), 0.9).otherwise(0.5)
    return out.select("doc_id", kind.alias("document_type"), sure.alias("confidence"))


# Fields that a better template reading may replace; others are only filled in.
REPLACEABLE = ["document_number", "date_of_birth", "date_of_expiry", "issue_date", "sex"]


def merge_template(visual: DataFrame, template: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence, source: visual readings, with the best template reading where it may and does win.

    Both: doc_id, name, value, confidence, seq; the best template reading is the surest, the first of equals.
    """
    best = template.groupBy("doc_id", "name").agg(F.max(F.struct("confidence", (-F.col("seq")).alias("order"), "value")).alias("t"))
    both = visual.join(best, ["doc_id", "name"], "full_outer")
    wins = F.col("value").isNull() | (F.col("name").isin(*REPLACEABLE) & (F.col("t.confidence") > F.col("confidence")))
    wins = F.coalesce(wins & F.col("t").isNotNull(), F.lit(False))
    won = lambda c: F.when(wins, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("doc_id", "name", won("value"), won("confidence"), F.when(wins, "template").otherwise("visual").alias("source"))
