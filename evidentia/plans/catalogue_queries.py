"""One query for each operator over the driver's tables; ``evidentia.plans.oracle`` has each in DuckDB's SQL."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import boxes, checkdigits, dates, mrz, payloads, text, vectors
from evidentia.functions.barrier import once, settled
from evidentia.operators import assemble, extract, intake, layout, registry, rules, scoring, similarity, validate
from evidentia.plans import inputs, screening
from evidentia.sources import domain, sinks
from evidentia.streaming import checkpoints

REF = domain.REFERENCE_DATE
YEAR = int(REF[:4])
#: Thresholds for the driver's vectors, whose cosines stay far below those of faces.
SHOW, REVIEW, TOLERANCE = 0.30, 0.40, 1.25


def _cards(spark, sf_dir):
    return domain.cards(spark, sf_dir)


def mrz_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.card_base(spark, sf_dir)
    d = checkdigits.mrz_check_digit
    return c.select("key", d(F.col("number")).alias("number_digit"), d(F.date_format("birth", "yyMMdd")).alias("birth_digit"), d(F.date_format("expiry", "yyMMdd")).alias("expiry_digit"))


def _parsed(rows: DataFrame, fmt: str, lines: list) -> DataFrame:
    return once(rows.select("key", *(c.alias(n) for n, c in mrz.parse(fmt, lines).items())))


def mrz_parse_td3(spark, sf_dir):
    return _parsed(_cards(spark, sf_dir), "TD3", [F.col("mrz1"), F.col("mrz2")])


def _td2(spark, sf_dir):
    """TD2 lines from the same cards: number, check, state, birth, sex and expiry, 7 optional fillers, composite."""
    c = _cards(spark, sf_dir)
    body = F.concat(F.substring("mrz2", 1, 28), F.lit("<<<<<<<"))
    composite = checkdigits.mrz_check_digit(F.concat(F.substring(body, 1, 10), F.substring(body, 14, 7), F.substring(body, 22, 14)))
    line1 = F.rpad(F.concat(F.lit("I<UTO"), F.col("surname"), F.lit("<<"), F.col("given_names")), 36, "<")
    return once(c.select("key", line1.alias("a1"), F.concat(body, composite).alias("a2")))


def mrz_parse_td2(spark, sf_dir):
    return _parsed(_td2(spark, sf_dir), "TD2", [F.col("a1"), F.col("a2")])


def _td1(spark, sf_dir):
    c = _cards(spark, sf_dir)
    one = F.rpad(F.concat(F.lit("I<UTO"), F.substring("mrz2", 1, 10)), 30, "<")
    two = F.concat(F.substring("mrz2", 14, 15), F.lit("UTO"), F.lit("<<<<<<<<<<<"))
    composite = checkdigits.mrz_check_digit(F.concat(F.substring(one, 6, 25), F.substring(two, 1, 7), F.substring(two, 9, 7), F.substring(two, 19, 11)))
    digit = F.when(F.col("key") % 11 == 0, "<").otherwise(composite.cast("string"))
    three = F.rpad(F.concat("surname", F.lit("<<"), "given_names"), 30, "<")
    return once(c.select("key", one.alias("a1"), F.concat(two, digit).alias("a2"), three.alias("a3")))


def mrz_parse_td1(spark, sf_dir):
    return _parsed(_td1(spark, sf_dir), "TD1", [F.col("a1"), F.col("a2"), F.col("a3")])


def mrz_century_dates(spark, sf_dir):
    c = _cards(spark, sf_dir)
    # every 13th card has a day that no calendar has
    b = F.when(F.col("key") % 13 == 0, F.lit("990231")).otherwise(F.substring("mrz2", 14, 6))
    return c.select("key", mrz.iso_date(b, YEAR, True).alias("birth"), mrz.iso_date(F.substring("mrz2", 22, 6), YEAR, False).alias("expiry"))


def _lines(spark, sf_dir, cards: DataFrame | None = None) -> DataFrame:
    """Lines of each card as a reader gives them: noise, labels and values, and the machine-readable lines."""
    c = domain.cards(spark, sf_dir, numbers=False) if cards is None else cards
    birth = F.date_format("birth", "dd/MM/yyyy")
    second = F.when(F.col("key") % 5 == 0, F.substring("mrz2", 1, 42)).otherwise(F.col("mrz2"))
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("PASSPORT", "UIDAI AADHAAR", "INCOME TAX PAN CARD", "SPECIMEN", "ELECTOR VOTER ID"))), (F.col("key") % 5 + 1).cast("int"))
    texts = F.array(kinds, F.concat(F.lit("Name: CUSTOMER "), F.col("given_names")), F.when(F.col("key") % 2 == 0, F.concat(F.lit("DOB: "), birth)).otherwise("DOB"), birth, F.when(F.col("key") % 3 == 0, "SEX: MALE").otherwise("Gender"), F.when(F.col("key") % 3 == 1, "female").otherwise("photo"), F.concat(F.lit("Document No: "), F.col("number")), F.col("mrz1"), second, F.lit("END OF DOCUMENT"))
    return c.select(F.col("key").alias("doc_id"), F.posexplode(texts).alias("line_no", "text"))


def mrz_find_block(spark, sf_dir):
    """The cards' lines with a blank line inside some zones, and the zone of another format before some."""
    lines = _lines(spark, sf_dir).select("doc_id", (F.col("line_no") * 2).alias("line_no"), "text")
    blank = lines.where("line_no = 14 AND doc_id % 6 = 1").select("doc_id", F.lit(15).alias("line_no"), F.lit(" ").alias("text"))
    first = _td2(spark, sf_dir).where("key % 10 IN (0, 2)").select(F.col("key").alias("doc_id"), F.posexplode(F.array("a1", "a2")).alias("n", "text"))
    return extract.mrz_block(lines.unionByName(blank).unionByName(first.select("doc_id", (F.col("n") - 2).alias("line_no"), "text"))).drop("l3")


def verhoeff_verify(spark, sf_dir):
    return _cards(spark, sf_dir).select("key", checkdigits.verhoeff_valid(F.col("uid")).alias("valid"), checkdigits.verhoeff_valid(F.concat(F.col("uid"), F.lit("x"))).alias("junk"))


def verhoeff_generate(spark, sf_dir):
    stem = F.lpad((F.col("c_custkey") * 6007 % 100000000).cast("string"), 11, "0")
    return domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(stem, checkdigits.verhoeff_check_digit(stem)).alias("number"))


def pan_structure(spark, sf_dir):
    c = _cards(spark, sf_dir).select(F.col("key").alias("doc_id"), F.when(F.col("key") % 17 == 0, F.substring("pan", 1, 8)).otherwise(F.col("pan")).alias("number"), F.when(F.col("key") % 4 == 0, "quartz").otherwise("Customer Person").alias("surname"))
    return rules.pan_structure(c).drop("seq")


_KINDS = ("passport", "aadhaar", "pan_card", "driving_license", "voter_id", "id_card", "national_id", "residence_permit", "unknown")


def _kind(key="key"):
    return F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col(key) % len(_KINDS) + 1).cast("int"))


def doc_number_format(spark, sf_dir):
    number = F.when(F.col("key") % 4 == 0, F.col("uid")).when(F.col("key") % 4 == 1, F.col("pan")).when(F.col("key") % 4 == 2, F.concat(F.col("number"), F.lit("<<"))).otherwise("?")
    return rules.number_format(_cards(spark, sf_dir).select(F.col("key").alias("doc_id"), _kind().alias("document_type"), number.alias("number"))).drop("seq")


def date_parse_multi(spark, sf_dir):
    out = lambda c, layouts: F.date_format(dates.parse(F.col(c), layouts), "yyyy-MM-dd")
    return inputs.date_texts(spark, sf_dir).select("doc_id", out("birth", dates.VISUAL).alias("visual"), out("birth", dates.LOGICAL).alias("logical"), out("issue", dates.FIELDS).alias("field"))


def date_logic_flags(spark, sf_dir):
    return rules.date_logic(inputs.date_texts(spark, sf_dir), REF).drop("seq")


def _fields(spark, sf_dir):
    """Long-form fields of each card; some are blank or missing, some read with little confidence."""
    c = domain.card_base(spark, sf_dir)
    k = F.col("key")
    values = {"document_number": F.col("number"), "surname": F.when(k % 6 != 0, F.col("surname")), "given_names": F.when(k % 4 == 0, " ").otherwise(F.col("given_names")), "date_of_birth": F.date_format("birth", "dd/MM/yyyy"), "date_of_expiry": F.when(k % 5 != 0, F.date_format("expiry", "yyyy-MM-dd")), "nationality": F.lit("UTO")}
    rows = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), F.when((k + j) % 4 == 0, 0.4).otherwise(0.9).alias("confidence")) for j, (n, v) in enumerate(values.items())))
    return c.select(k.alias("doc_id"), F.explode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("f")).select("doc_id", "f.*")


def _docs(spark, sf_dir):
    side = F.when(F.col("c_custkey") % 2 == 0, "back").otherwise("front")
    return domain.customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), _kind("c_custkey").alias("document_type"), side.alias("side"))


def required_field_flags(spark, sf_dir):
    return rules.required_fields(_docs(spark, sf_dir), _fields(spark, sf_dir)).drop("seq")


def visual_extract_labels(spark, sf_dir):
    return extract.same_line_fields(_lines(spark, sf_dir)).drop("confidence")


def visual_next_line_value(spark, sf_dir):
    return extract.next_line_fields(_lines(spark, sf_dir)).drop("confidence")


def visual_recogniser(spark, sf_dir):
    made = settled(domain.cards(spark, sf_dir, numbers=False))  # lines are gone through five times
    return extract.recognise(_lines(spark, sf_dir, made)).drop("confidence")


def number_fragments(spark, sf_dir):
    c = _cards(spark, sf_dir)
    uid = F.col("uid")
    parts = F.array(F.struct(F.lit("Aadhaar number").alias("text"), F.lit(0.0).alias("x")), *(F.struct(t.alias("text"), F.lit(x).alias("x")) for t, x in ((F.substring(uid, 5, 4), 0.5), (F.substring(uid, 1, 4), 0.1), (F.when(F.col("key") % 3 == 0, "photo").otherwise(F.substring(uid, 9, 4)), 0.9))))
    rows = c.select(F.col("key").alias("doc_id"), F.posexplode(parts).alias("line_no", "p")).select("doc_id", "line_no", "p.text", "p.x")
    return extract.number_fragments(rows).select("doc_id", "value")


def name_words_match(spark, sf_dir):
    c = domain.card_base(spark, sf_dir)
    other = F.when(F.col("key") % 2 == 0, F.concat(F.col("given_names"), F.lit(", "), F.lower("surname"))).otherwise(F.concat(F.col("surname"), F.lit("-X")))
    mine = text.name_words(F.concat_ws(" ", "surname", "given_names"))
    return c.select("key", F.array_join(mine, " ").alias("words"), (mine == text.name_words(other)).alias("same"))


def gender_normalise(spark, sf_dir):
    given = F.element_at(F.array(*(F.lit(x) for x in (" male", "F", "fmale", "Trans", "o", "x", ""))), (F.col("key") % 7 + 1).cast("int"))
    return domain.card_base(spark, sf_dir).select("key", text.gender(given).alias("gender"))


def type_hints_classify(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    kinds = mrz_parse_td3(spark, sf_dir).select(F.col("key").alias("doc_id"), F.when(F.col("key") % 3 == 0, F.col("document_type")).alias("mrz_type"))
    return extract.classify(lines, kinds)


def cross_source_mismatch(spark, sf_dir):
    c = _cards(spark, sf_dir)
    k = F.col("key")
    rows = c.select(k.alias("doc_id"), mrz.iso_date(F.substring("mrz2", 14, 6), YEAR, True).alias("mrz_birth"), mrz.iso_date(F.substring("mrz2", 22, 6), YEAR, False).alias("mrz_expiry"), F.substring("mrz2", 1, 9).alias("mrz_number"), F.date_format(F.when(k % 9 == 0, F.date_add("birth", 1)).otherwise(F.col("birth")), "dd.MM.yyyy").alias("birth"), F.when(k % 8 == 0, "soon").otherwise(F.date_format("expiry", "d/M/yyyy")).alias("expiry"), F.lower("number").alias("number"), F.when(k % 10 == 0, "template").otherwise("visual").alias("number_source"))
    return rules.cross_source(rows).drop("seq")


def _qr_rows(spark, sf_dir):
    c = _cards(spark, sf_dir)
    k = F.col("key")
    return c.select(k.alias("doc_id"), (k % 2 == 0).alias("signed"), F.col("uid").alias("qr_uid"), F.date_format("birth", "yyyy-MM-dd").alias("qr_birth"), F.concat_ws(" ", "given_names", "surname").alias("qr_name"), F.when(k % 3 == 0, "MALE").otherwise("F").alias("qr_gender"), F.concat_ws(" ", F.substring("uid", 1, 4), F.substring("uid", 5, 4), F.when(k % 6 == 0, "0000").otherwise(F.substring("uid", 9, 4))).alias("number"), F.date_format(F.date_add("birth", F.when(k % 11 == 0, 1).otherwise(0)), "d-M-yyyy").alias("birth"), F.when(k % 5 == 0, "SOMEONE").otherwise(F.concat_ws(" ", "surname", "given_names")).alias("surname"), F.col("sex").alias("sex"))


def barcode_reconcile(spark, sf_dir):
    return rules.qr_consistency(_qr_rows(spark, sf_dir)).drop("seq")


def licence_reconcile(spark, sf_dir):
    k = F.col("key")
    c = _cards(spark, sf_dir)
    number = F.concat(F.lit("UT012019"), F.lpad(k.cast("string"), 9, "0"))
    birth = F.date_format("birth", "dd-MM-yyyy")
    payload = F.when(k % 2 == 0, F.concat(F.lit('{"DL_No":"'), number, F.lit('","DOB":"'), birth, F.lit('"}'))).otherwise(F.concat(F.lit("LIC "), number, F.lit("; NAME: SOME ONE; DOB: "), birth))
    rows = c.select(k.alias("doc_id"), payload.alias("payload"), F.when(k % 7 == 0, "UT992019000000001").otherwise(F.concat(F.lit("UT01 2019"), F.lpad(k.cast("string"), 9, "0"))).alias("number"), F.date_format(F.date_add("birth", F.when(k % 4 == 0, 1).otherwise(0)), "yyyy-MM-dd").alias("birth"))
    parts = payloads.decode_licence(F.col("payload"))
    return rules.licence_barcode(rows.select("doc_id", parts["number"].alias("code_number"), parts["birth"].alias("code_birth"), "number", "birth")).drop("seq")


def checksum_flags(spark, sf_dir):
    return rules.number_checksum(_cards(spark, sf_dir).select(F.col("key").alias("doc_id"), F.when(F.col("key") % 9 == 0, "1234").otherwise(F.col("uid")).alias("number"))).drop("seq")


def mrz_compliance_flags(spark, sf_dir):
    rows = mrz_parse_td3(spark, sf_dir).withColumnRenamed("key", "doc_id")
    return rules.mrz_compliance(rows, ["document_number", "birth", "expiry", "optional"]).drop("seq")


def template_best_read(spark, sf_dir):
    f = _fields(spark, sf_dir)
    visual = f.where("name <> 'given_names'").select("doc_id", "name", "value", "confidence")
    read = lambda j, c, v: f.select("doc_id", "name", F.concat("value", F.lit(v)).alias("value"), F.lit(c).alias("confidence"), F.lit(j).alias("seq"))
    return extract.merge_template(visual, read(0, 0.5, " a").unionByName(read(1, 0.7, " b")).unionByName(read(2, 0.7, " c"))).drop("confidence")


def _boxed(lines):
    """``lines`` with boxes: line after line down the page, the left edge and the height by document and line."""
    k, n = F.col("doc_id"), F.col("line_no")
    x, y = 0.05 + 0.09 * ((k + n) % 7), 0.02 + 0.095 * n + 0.01 * (k % 5)
    return lines.withColumns({"x0": x, "y0": y, "x1": x + 0.15 + 0.05 * (k % 4), "y1": y + 0.03, "confidence": 0.5 + 0.05 * ((k + 3 * n) % 10)})


def template_box_fields(spark, sf_dir):
    """The cards' lines by where they stand, for two types that each card may be."""
    lines = _boxed(_lines(spark, sf_dir))
    kinds = F.array(F.element_at(F.array(*(F.lit(t) for t in layout.TEMPLATES)), (F.col("c_custkey") % 3 + 1).cast("int")), F.element_at(F.array(*(F.lit(t) for t in layout.TEMPLATES)), ((F.col("c_custkey") + 1) % 3 + 1).cast("int")))
    types = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(kinds).alias("document_type"))
    return layout.template_reads(lines, types, layout.templates(spark)).drop("seq")


def secure_anchor_flags(spark, sf_dir):
    channels = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(F.lit("mrz"), F.lit("aadhaar_qr"), F.lit("dl_barcode"), F.lit("other")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("channel"))
    return rules.secure_anchor(_docs(spark, sf_dir), channels).drop("seq")


def blacklist_tristate(spark, sf_dir):
    c = domain.card_base(spark, sf_dir)
    k = F.col("key")
    rows = c.select(k.alias("doc_id"), F.when(k % 10 == 0, "").otherwise(F.col("number")).alias("number"), F.when(k % 10 == 0, F.lit(None)).when(k % 24 == 12, "CUST0MER").otherwise(F.col("surname")).alias("surname"))
    listing = c.where(k % 3 == 0).select("number", "surname", F.when(k % 2 == 0, k % 4 == 0).alias("listed"))
    return rules.blacklist(rows, listing)


def _flags(spark, sf_dir):
    """All flags of the date, required-field and zone rules, in the order of the rules."""
    zone = mrz_parse_td3(spark, sf_dir).withColumnRenamed("key", "doc_id")
    return rules.in_order([rules.date_logic(inputs.date_texts(spark, sf_dir), REF), rules.required_fields(_docs(spark, sf_dir), _fields(spark, sf_dir)), rules.mrz_compliance(zone, ["document_number", "birth", "expiry", "optional"])])


def flag_ledger_running(spark, sf_dir):
    return scoring.ledger(_flags(spark, sf_dir))


def coherence_score(spark, sf_dir):
    return scoring.coherence(_docs(spark, sf_dir), _flags(spark, sf_dir), _fields(spark, sf_dir))


def field_validation(spark, sf_dir):
    return rules.field_validation(inputs.validation_rows(spark, sf_dir), REF)


def field_validation_ingest(spark, sf_dir):
    """The validator's verdicts with the findings of the date rules."""
    return rules.field_validation(inputs.validation_rows(spark, sf_dir), REF, rules.date_logic(inputs.date_texts(spark, sf_dir), REF))


def _decodes(spark, sf_dir):
    """Decodes of each card, read at two scales, so every one comes twice: an identity payload, a licence, other codes."""
    c = _cards(spark, sf_dir)
    k = F.col("key")
    markup = F.concat(F.lit('<PrintLetterBarcodeData uid="'), F.col("uid"), F.lit('" name="'), F.when(k % 4 == 0, "").otherwise(F.col("given_names")), F.lit('" gender="'), F.when(k % 3 == 0, "M").otherwise("F"), F.lit('"/>'))
    licence = F.concat(F.when(k % 3 == 0, "lic ut01 2019 ").otherwise("LIC UT012019"), F.lpad(k.cast("string"), 9, "0"), F.lit("; NAME: SOME ONE; "), F.date_format("birth", "dd-MM-yyyy"))
    code = lambda fmt, t: F.struct(F.lit(fmt).alias("format"), t.alias("text"))
    once_read = F.array(code("QRCODE", F.when(k % 2 == 0, markup).otherwise("no payload")), code("PDF417", licence), code("CODE128", licence), code("QRCODE", F.when(k % 5 == 0, F.replace(markup, F.lit('uid="'), F.lit('uid="9'))).otherwise(F.lit(None))))
    return c.select(k.alias("doc_id"), F.posexplode(F.concat(once_read, once_read)).alias("seq", "c")).select("doc_id", "seq", "c.format", "c.text", F.lit(None).cast("binary").alias("raw"))


def _validated(spark, sf_dir):
    """Both sides of the cards with their codes: the zone on the back, the licence and every second card's payload as codes."""
    lines, k = _lines(spark, sf_dir), F.col("doc_id")
    pooled = intake.pool_sides(lines.where("line_no < 7"), lines.where("line_no >= 7"))
    codes = intake.barcode_parts(intake.barcode_channels(_decodes(spark, sf_dir).where(k % 3 != 1)))
    states = _docs(spark, sf_dir).select("doc_id", "side", F.when(k % 10 == 3, "pan_card").when(k % 10 == 4, "driving_license").alias("forced_type"), (k % 50 == 7).alias("unreadable"), (k % 50 == 8).alias("companion_unreadable"))
    return validate.validate_lines(_boxed(pooled), REF, states, codes)


def document_validation(spark, sf_dir):
    return _validated(spark, sf_dir).results


def document_ledger(spark, sf_dir):
    return _validated(spark, sf_dir).ledger


def document_status(spark, sf_dir):
    keys = domain.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("document_number")).distinct()
    return registry.document_status(keys, domain.documents(spark, sf_dir))


def family_members(spark, sf_dir):
    return registry.members_by_document(domain.documents(spark, sf_dir), domain.families(spark, sf_dir))


def family_of_document(spark, sf_dir):
    return registry.family_of_document(domain.documents(spark, sf_dir), domain.families(spark, sf_dir))


def members_of_blacklisted(spark, sf_dir):
    """The family members of the blacklisted documents."""
    documents = domain.documents(spark, sf_dir)
    return registry.members_of(documents.where("status = 'BLACKLISTED'"), documents)


def fingerprint_similarity(spark, sf_dir):
    return similarity.fingerprint_matches(domain.documents(spark, sf_dir), domain.fingerprints(spark, sf_dir))


def fingerprint_profile(spark, sf_dir):
    return similarity.fingerprint_profile(domain.documents(spark, sf_dir), domain.fingerprints(spark, sf_dir))


def _cluster(spark, sf_dir):
    return registry.clusters(domain.identities(spark, sf_dir).select("identity_id"), domain.documents(spark, sf_dir))


def cluster_expand(spark, sf_dir):
    return _cluster(spark, sf_dir)


def cross_checkpoint_alert(spark, sf_dir):
    people = domain.identities(spark, sf_dir).select("identity_id")
    return registry.cluster_alerts(people, domain.documents(spark, sf_dir), domain.events(spark, sf_dir), least_checkpoints=4)


def checkpoint_history(spark, sf_dir):
    return registry.checkpoint_history(_cluster(spark, sf_dir), domain.events(spark, sf_dir))


def _graph(spark, sf_dir):
    return domain.identities(spark, sf_dir).select("identity_id", "name"), domain.documents(spark, sf_dir), domain.families(spark, sf_dir), domain.events(spark, sf_dir)


def graph_nodes(spark, sf_dir):
    return registry.graph_nodes(*_graph(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return registry.graph_edges(*_graph(spark, sf_dir))


def graph_connected_cases(spark, sf_dir):
    return registry.connected_cases(domain.documents(spark, sf_dir), domain.families(spark, sf_dir))


def _vectors(spark, sf_dir):
    v = domain.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("identity_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return v.select(F.col("identity_id").alias("query_id"), F.col("vec").alias("query_vec")), v


def identity_topk(spark, sf_dir):
    queries, candidates = _vectors(spark, sf_dir)
    return similarity.identity_search(queries, candidates, 3, SHOW, REVIEW)


def face_threshold_match(spark, sf_dir):
    queries, candidates = _vectors(spark, sf_dir)
    return similarity.threshold_matches(queries.where("query_id % 10 = 0"), candidates.where("identity_id % 10 <> 0"), TOLERANCE)


def face_best_match(spark, sf_dir):
    queries, candidates = _vectors(spark, sf_dir)
    return similarity.best_match(queries.where("query_id % 10 = 0"), candidates.where("identity_id % 10 <> 0"), TOLERANCE)


def hash_pseudo_embedding(spark, sf_dir):
    v = vectors.pseudo_embedding(F.col("name"))
    w = vectors.pseudo_embedding(F.col("nationality"))
    score = vectors.face_score(vectors.cosine(v, w))
    rows = domain.identities(spark, sf_dir).select("identity_id", v.alias("v"), score.alias("s"))
    return rows.select("identity_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round("s", 6).alias("score"), (F.col("s") >= 0.72).alias("match"))


def risk_factors(spark, sf_dir):
    return screening.risk_rows(spark, sf_dir, screening.faces(spark, sf_dir)).select("identity_id", *(f"f_{n}" for n in scoring.WEIGHTS))


def _scored(spark, sf_dir, faces=None):
    rows = screening.risk_rows(spark, sf_dir, faces).withColumn("risk_score", scoring.risk_total())
    return rows.select("identity_id", "risk_score", scoring.band(F.col("risk_score")).alias("risk_level"))


def risk_score_band(spark, sf_dir):
    return _scored(spark, sf_dir, screening.faces(spark, sf_dir))


def reasons_list(spark, sf_dir):
    return screening.risk_rows(spark, sf_dir).select("identity_id", scoring.reasons().alias("reasons"))


def screen_pipeline(spark, sf_dir):
    return screening.screen(spark, sf_dir)


def audit_hash_log(spark, sf_dir):
    return registry.audit_rows(_scored(spark, sf_dir), "identity_id", "risk_level")


def audit_recent(spark, sf_dir):
    """The report's 20 latest events."""
    e = domain.events(spark, sf_dir)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "identity_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def officer_decision_latest(spark, sf_dir):
    records = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("verification_id"))
    e = domain.table(spark, sf_dir, "events")
    said = F.element_at(F.array(F.lit("CLEARED"), F.lit("SECONDARY_INSPECTION"), F.lit("DENIED")), (F.col("event_id") % 3 + 1).cast("int"))
    decisions = e.select(F.col("user_id").alias("verification_id"), said.alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("decision_id"))
    return registry.latest_decisions(records, decisions)


def self_test_accuracy(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    confidence = (F.col("p_partkey") * 37 % 600) / 10 + 40
    rows = p.select(F.element_at(F.split("p_type", " "), 1).alias("manipulation_type"), confidence.alias("confidence"), (F.col("p_size") % 5 != 0).alias("expected"))
    rows = rows.withColumn("predicted", F.col("confidence") >= 70)
    return rows.groupBy("manipulation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("n_correct"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def self_test_recent(spark, sf_dir):
    """The report's 20 latest self-tests."""
    p, k = domain.table(spark, sf_dir, "part"), F.col("p_partkey")
    confidence, minutes = (k * 37 % 600) / 10 + 40, (k * 7919 % 500000).cast("long")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + minutes * 60), "yyyy-MM-dd HH:mm:ss")
    rows = p.select(F.element_at(F.split("p_type", " "), 1).alias("manipulation_type"), confidence.alias("confidence"), ((confidence >= 70) == (F.col("p_size") % 5 != 0)).alias("correct"), at.alias("at"), k.alias("test_id"), minutes.alias("m"))
    return rows.orderBy(F.desc("m"), "test_id").limit(20).drop("m")


def tamper_status(spark, sf_dir):
    rows = inputs.signals(spark, sf_dir)
    plain = scoring.forensic_status(rows).select("image_id", "confidence", "status")
    return plain.join(scoring.forensic_status(rows, True).select("image_id", F.col("confidence").alias("biased_confidence"), F.col("status").alias("biased_status")), "image_id")


def kpi_rollup(spark, sf_dir):
    d = domain.documents(spark, sf_dir).withColumn("year", F.year("issue_date"))
    return d.rollup("year", "status").agg(F.count(F.lit(1)).alias("n"), F.count("family_id").alias("n_in_family"))


def kpi_daily(spark, sf_dir):
    rows = checkpoints.daily_risk(domain.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "checkpoint", "n", "n_risky")


def session_activity(spark, sf_dir):
    rows = checkpoints.sessions(domain.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.date_format("begins", "yyyy-MM-dd HH:mm:ss").alias("begins"), F.date_format("ends", "yyyy-MM-dd HH:mm:ss").alias("ends"), "n_events")


def frontal_confidence(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return domain.table(spark, sf_dir, "embeddings").select("vec_id", boxes.frontal_confidence(v).alias("confidence"))


def upload_verdicts(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    head = F.unhex(F.element_at(F.array(F.lit("FFD8FFE0"), F.lit("89504E47"), F.lit("25504446"), F.lit("00000000")), (k % 4 + 1).cast("int")))
    path = F.concat(F.lit("in/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.element_at(F.array(F.lit(".JPG"), F.lit(".png"), F.lit(".gif")), (k % 3 + 1).cast("int")))
    files = p.select("p_partkey", path.alias("path"), (k * 104729 % 12000000 * (k % 5)).alias("length"), head.alias("head"))
    return boxes.upload_gate(files).select(F.col("p_partkey").alias("file_id"), "media_type", "verdict", boxes.crop_name("path").alias("crop"))


def box_convert(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    css = boxes.css_box(k % 50 - 10, k % 700, k % 500, k % 90 - 20, F.lit(480), F.lit(640))
    xs, ys = F.array((k % 640 * 1.0), (k % 320 * 2.0)), F.array((k % 480 * 1.0), (k % 960 * 1.0))
    frac = boxes.fractional_box(xs, ys, F.lit(640), F.lit(480))
    return p.select(k.alias("box_id"), css.alias("c"), frac.alias("f")).select("box_id", "c.*", "f.*")


def field_resolution(spark, sf_dir):
    c = _cards(spark, sf_dir)
    k = F.col("key")
    read = lambda name, value, source, confidence: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    rows = F.array(read("Passport_Number", F.when(k % 2 == 0, F.col("number")), "visual", 0.9), read("document_number", F.concat(F.lit("Z"), "number"), "mrz", 0.99), read("uid", F.col("uid"), "barcode", 0.99), read("given_names", F.col("given_names"), "mrz", 0.5), read("surname", F.when(k % 3 == 0, " ").otherwise(F.col("surname")), "mrz", 0.5), read("country", F.when(k % 4 == 0, "UTO"), "visual", 0.0), read("date_of_expiry", F.date_format("expiry", "yyyy-MM-dd"), "visual", 0.7), read("sex", F.col("sex"), "mrz", 0.8))
    return assemble.resolve(c.select(k.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*"))


def candidate_types(spark, sf_dir):
    d = _docs(spark, sf_dir)
    k = F.col("doc_id")
    docs = d.select("doc_id", F.when(k % 4 == 0, F.col("document_type")).alias("forced"), F.when(k % 3 == 0, "passport").alias("zone_type"))
    hint = lambda j, t: F.struct(F.lit(t).alias("document_type"), ((k + j) % 3 / 10.0).alias("score"), F.lit(j).alias("order"))
    hints = d.select("doc_id", F.explode(F.array(hint(0, "aadhaar"), hint(1, "pan_card"), hint(2, "passport"), hint(3, "voter_id"))).alias("h")).select("doc_id", "h.*").where("score > 0")
    return assemble.candidate_types(docs, hints)


def degraded_results(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return assemble.with_degraded(d, d.where("doc_id % 5 <> 0").select("doc_id", "document_type", (F.col("doc_id") % 101).cast("int").alias("score")))


def channel_modes(spark, sf_dir):
    modes = F.array(*(F.lit(m[0]) for m in assemble.MODES), F.lit("other"))
    return assemble.channel_modes(_docs(spark, sf_dir).select("doc_id", F.element_at(modes, (F.col("doc_id") % 6 + 1).cast("int")).alias("mode"), "side"))


def score_report(spark, sf_dir):
    flags = rules.in_order([rules.date_logic(inputs.date_texts(spark, sf_dir), REF)])
    scored = scoring.coherence(_docs(spark, sf_dir).select("doc_id", F.lit("passport").alias("document_type")), flags, spark.createDataFrame([], "doc_id long, confidence double"))
    return sinks.report_lines(scored, scoring.ledger(flags))


def verification_records(spark, sf_dir):
    rows = risk_score_band(spark, sf_dir)
    return sinks.verification_records(rows, "identity_id", REF).select("subject", "verification_id", "result_json")


def qr_payload_inflate(spark, sf_dir):
    """Payloads plain, deflated and in base64, made from the cards; decoding gives their numbers back."""
    c = _cards(spark, sf_dir)
    markup = F.concat(F.lit('<PrintLetterBarcodeData uid="'), F.col("uid"), F.lit('" name="'), F.col("given_names"), F.lit('" signature="s"/>'))

    @F.pandas_udf("binary")
    def packed(texts):
        def one(i, t):
            raw = t.encode()
            return raw if i % 3 == 0 else zlib.compress(raw) if i % 3 == 1 else base64.b64encode(zlib.compress(raw))

        return texts.map(lambda t: one(sum(t.encode()), t))

    rows = payloads.decode_identity(c.select("key", F.col("uid").alias("expected"), packed(markup).alias("raw")))
    return rows.select("key", (F.col("uid") == F.col("expected")).alias("same"), F.col("name"), "signature_present", "decoded")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
