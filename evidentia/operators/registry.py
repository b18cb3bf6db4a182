"""Registry look-ups, family members, clusters, checkpoint history and alerts, link graphs, decisions and audit rows.

Each operator answers for all keys at once with joins and grouped aggregates; nothing is looked up key by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import skew
from evidentia.functions.barrier import settled


def document_status(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """document_number, status (UNKNOWN if not registered), detail (of blacklisted documents only)."""
    found = keys.join(documents.select("document_number", "status", F.lit(True).alias("known")), "document_number", "left")
    status = F.coalesce(F.col("status"), F.lit("UNKNOWN"))
    detail = F.when(status == "BLACKLISTED", F.concat(F.lit("listed: "), F.col("document_number").cast("string")))
    return found.select("document_number", status.alias("status"), detail.alias("detail"))


def family_of_document(documents: DataFrame, families: DataFrame) -> DataFrame:
    """document_number, family_id, common_pattern, n_members, of documents in a family that exists: one row a document, however large its family."""
    own = documents.where("family_id IS NOT NULL").select("document_number", "family_id")
    sizes = own.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_members")).join(families.select("family_id", "common_pattern"), "family_id")
    return skew.spread_join(own, sizes, "family_id").select("document_number", "family_id", "common_pattern", "n_members")


def family_members(documents: DataFrame, families: DataFrame, page_rows: int = 1000) -> DataFrame:
    """family_id, common_pattern, n_members, page, members (numbers in order, by commas), of families that exist and have documents.

    A family's members stand once, in pages of about ``page_rows`` by ranges of their numbers, so that neither a member nor a
    row carries a whole family; ``members_of`` has the members of given documents.
    """
    own = documents.where("family_id IS NOT NULL").select("document_number", "family_id")
    sizes = own.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("document_number").alias("low"), F.max("document_number").alias("high"))
    sizes = sizes.join(families.select("family_id", "common_pattern"), "family_id")
    page = F.floor((F.col("document_number") - F.col("low")) * F.ceil(F.col("n_members") / page_rows) / (F.col("high") - F.col("low") + 1))
    paged = skew.spread_join(own, sizes, "family_id").withColumn("page", page.cast("int"))
    return paged.groupBy("family_id", "common_pattern", "n_members", "page").agg(F.array_join(F.sort_array(F.collect_list("document_number")), ",").alias("members"))


def members_by_document(documents: DataFrame, families: DataFrame) -> DataFrame:
    """document_number, family_id, common_pattern, n_members, members (numbers in order, by commas), for each document in a family that exists.

    The lists are put together from the pages of ``family_members``, once for each family; the result has a family's list once
    for each of its documents, so it is the sum of squares of the families.
    """
    pages = family_members(documents, families)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "members"))), lambda p: p["members"]), ",")
    lists = pages.groupBy("family_id", "common_pattern", "n_members").agg(joined.alias("members"))
    own = documents.where("family_id IS NOT NULL").select("document_number", "family_id")
    return skew.spread_join(own, lists, "family_id").select("document_number", "family_id", "common_pattern", "n_members", "members")


def members_of(given: DataFrame, documents: DataFrame) -> DataFrame:
    """document_number, member: the members of each given document's family, itself among them; the result has one row a member and document."""
    own = documents.where("family_id IS NOT NULL").select("document_number", "family_id")
    asked = own.join(given.select("document_number").distinct(), "document_number", "left_semi")
    return skew.spread_join(own.withColumnRenamed("document_number", "member"), asked, "family_id").select("document_number", "member")


def _held(documents: DataFrame) -> DataFrame:
    """identity_id, family_id, each once: the factors of all clusters."""
    return documents.where("family_id IS NOT NULL AND identity_id IS NOT NULL").select("identity_id", "family_id").distinct()


def clusters(identities: DataFrame, documents: DataFrame) -> DataFrame:
    """identity_id, member_id: each given identity, and those with a document in a family that it has a document in.

    Rows are the result itself, a member and identity each: give the identities in question where families are large.
    Totals of clusters don't need them: ``cluster_alerts``.
    """
    held, people = _held(documents), identities.select("identity_id")
    asked = held.join(people, "identity_id", "left_semi")
    linked = skew.spread_join(asked, held.withColumnRenamed("identity_id", "member_id"), "family_id").select("identity_id", "member_id")
    return linked.unionByName(people.withColumn("member_id", F.col("identity_id"))).distinct()


#: Families of an identity up to which its cluster's total is taken by inclusion and exclusion.
SUBSETS = 6


def _cluster_sums(held: DataFrame, own: DataFrame, subsets: int, n: int) -> DataFrame:
    """identity_id, total: the sum of ``own`` (identity_id, n) over each cluster's distinct members, of identities in a shared family.

    The members that share a family with an identity are counted by the sets of its families: a set's sum is over the
    identities that have all of it, and sets add up with alternating signs. An identity of more than ``subsets`` families
    meets the members of its families one by one, in both directions. ``n``: rows of ``held``.
    """
    shared = held.groupBy("family_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family_id")
    sets = skew.spread_join(held, shared, "family_id", at_most=n).groupBy("identity_id").agg(F.sort_array(F.collect_list("family_id")).alias("families"))
    light, heavy = sets.where(F.size("families") <= subsets), sets.where(F.size("families") > subsets)
    chosen = lambda m: F.filter("families", lambda x, i: F.getbit(m, i) == 1)
    masks = F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(families)) - 1"))
    parts = light.select("identity_id", F.explode(F.transform(masks, chosen)).alias("part"))
    sums = parts.join(own, "identity_id").groupBy("part").agg(F.sum("n").alias("n"))
    signed = F.when(F.size("part") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    between = skew.spread_join(parts, sums, "part", at_most=n << subsets).select("identity_id", signed.alias("n"))
    big = heavy.select(F.col("identity_id").alias("big"), F.explode("families").alias("family_id"))
    pairs = skew.spread_join(held, big, "family_id", at_most=n).select("identity_id", "big").distinct()
    to_big = pairs.join(own, "identity_id").select(F.col("big").alias("identity_id"), "n")
    from_big = pairs.join(light.select("identity_id"), "identity_id", "left_semi").join(own.withColumnRenamed("identity_id", "big"), "big").select("identity_id", "n")
    return between.unionByName(to_big).unionByName(from_big).groupBy("identity_id").agg(F.sum("n").alias("total"))


def cluster_alerts(identities: DataFrame, documents: DataFrame, events: DataFrame, least_checkpoints: int = 2, since: str | None = None, subsets: int = SUBSETS) -> DataFrame:
    """identity_id, total_checkpoints, total_appearances, alert, over the events of each identity's cluster (see ``clusters``).

    An alert takes at least ``least_checkpoints`` checkpoints and an event of medium or high risk. ``since`` is an
    optional lower bound of event times; by default every event counts. Identities meet their families and families their
    sums, so a family's members never meet each other.
    """
    seen = events if since is None else events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    per = settled(seen.groupBy("identity_id", "checkpoint").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("risk_level").isin("MEDIUM", "HIGH")).alias("risky")))
    held = settled(_held(documents))
    own = per.groupBy("identity_id").agg(F.sum("n").alias("n"))
    n_held = held.count()
    sums = _cluster_sums(held, own, subsets, n_held)
    passed = held.join(per, "identity_id").groupBy("family_id", "checkpoint").agg(F.max("risky").alias("risky"))
    every = skew.spread_join(held, passed, "family_id", at_most=n_held).select("identity_id", "checkpoint", "risky").unionByName(per.select("identity_id", "checkpoint", "risky"))
    found = every.groupBy("identity_id", "checkpoint").agg(F.max("risky").alias("risky")).groupBy("identity_id").agg(F.count(F.lit(1)).alias("points"), F.max("risky").alias("risky"))
    out = identities.select("identity_id").join(found, "identity_id", "left").join(own, "identity_id", "left").join(sums, "identity_id", "left")
    out = out.select("identity_id", F.coalesce("points", F.lit(0)).alias("total_checkpoints"), F.coalesce("total", "n", F.lit(0)).alias("total_appearances"), F.coalesce("risky", F.lit(False)).alias("risky"))
    return out.select("identity_id", "total_checkpoints", "total_appearances", ((F.col("total_checkpoints") >= least_checkpoints) & F.col("risky")).alias("alert"))


def checkpoint_history(cluster: DataFrame, events: DataFrame) -> DataFrame:
    """Every event of each identity's cluster in order of time, numbered."""
    hits = cluster.join(events.withColumnRenamed("identity_id", "member_id"), "member_id")
    order = Window.partitionBy("identity_id").orderBy("ts", "event_id")
    return hits.select("identity_id", "event_id", "checkpoint", "risk_level", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.row_number().over(order).alias("position"))


def graph_edges(identities: DataFrame, documents: DataFrame, families: DataFrame, events: DataFrame) -> DataFrame:
    """src, dst: the undirected links of the whole corpus, each once, by typed node names (person:, document:, ...)."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    known = documents.join(identities.select("identity_id"), "identity_id", "left_semi")
    owned = known.select(name("person", "identity_id").alias("a"), name("document", "document_number").alias("b"))
    in_family = documents.join(families.select("family_id"), "family_id", "left_semi").select(name("document", "document_number").alias("a"), name("pattern", "family_id").alias("b"))
    passed = events.select("identity_id", "checkpoint").distinct().join(identities.select("identity_id"), "identity_id", "left_semi")
    passed = passed.select(name("person", "identity_id").alias("a"), name("checkpoint", "checkpoint").alias("b"))
    every = owned.unionByName(in_family).unionByName(passed)
    return every.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def graph_nodes(identities: DataFrame, documents: DataFrame, families: DataFrame, events: DataFrame) -> DataFrame:
    """id, label, type of every node; families without documents and checkpoints without events have none."""
    person = identities.select(F.concat(F.lit("person:"), F.col("identity_id").cast("string")).alias("id"), F.col("name").alias("label"), F.lit("person").alias("type"))
    number = F.col("document_number").cast("string")
    document = documents.select(F.concat(F.lit("document:"), number).alias("id"), F.concat(F.lit("Document "), number).alias("label"), F.lit("document").alias("type"))
    used = families.join(documents.select("family_id"), "family_id", "left_semi")
    pattern = used.select(F.concat(F.lit("pattern:"), F.col("family_id").cast("string")).alias("id"), F.concat(F.lit("Pattern "), F.col("family_id").cast("string")).alias("label"), F.lit("pattern").alias("type"))
    point = events.select(F.concat(F.lit("checkpoint:"), F.col("checkpoint")).alias("id"), F.col("checkpoint").alias("label"), F.lit("checkpoint").alias("type"))
    return person.unionByName(document).unionByName(pattern).unionByName(point).distinct()


def connected_cases(documents: DataFrame, families: DataFrame) -> DataFrame:
    """identity_id, connected_cases (documents of its own and of its families), common_pattern (of its largest family id)."""
    own = documents.select("identity_id", "document_number", "family_id").distinct().join(families, "family_id", "left")
    known = F.col("common_pattern").isNotNull()
    sizes = own.where(known).groupBy("family_id").agg(F.count_distinct("document_number").alias("n"))
    # a document is in one family, so the counts of an identity's families add up
    per = own.groupBy("identity_id", F.when(known, F.col("family_id")).alias("family_id")).agg(F.count_distinct("document_number").alias("own"), F.max("common_pattern").alias("common_pattern"))
    per = per.join(sizes, "family_id", "left")
    return per.groupBy("identity_id").agg(F.sum(F.coalesce("n", "own")).alias("connected_cases"), F.max_by("common_pattern", "family_id").alias("common_pattern"))


def audit_rows(results: DataFrame, id_col: str, outcome_col: str) -> DataFrame:
    """verification_id, document_hash: upper-case SHA-256 of id and outcome, nothing else of the record."""
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.col(outcome_col).cast("string"))
    return results.select(F.col(id_col).alias("verification_id"), F.upper(F.sha2(text.cast("binary"), 256)).alias("document_hash"), F.lit("CONFIRMED").alias("status"))


def latest_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each record with the last decision appended for it (null if none); decisions are only ever appended."""
    last = decisions.groupBy("verification_id").agg(F.max_by("decision", F.struct("at", "decision_id")).alias("decision"), F.count(F.lit(1)).alias("n_decisions"))
    return records.select("verification_id").join(last, "verification_id", "left").withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0)))


def graph_neighbourhood(given: DataFrame, identities: DataFrame, documents: DataFrame, families: DataFrame, events: DataFrame) -> DataFrame:
    """identity_id, src, dst: the links of each given identity's own graph, each once, by the names of ``graph_edges``.

    That graph has its documents, their families, the families' documents with their owners, and its checkpoints. A
    given identity that doesn't exist has no rows. Rows are the result itself, one a link: give the identities in
    question, not a whole registry, where families are large.
    """
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    people = identities.select("identity_id")
    asked = given.select("identity_id").distinct().join(people, "identity_id", "left_semi")
    own = asked.join(documents.select("identity_id", "document_number", "family_id"), "identity_id")
    known = documents.join(families.select("family_id"), "family_id", "left_semi")
    owner = people.withColumnRenamed("identity_id", "owner_id")
    members = known.select("family_id", "document_number", F.col("identity_id").alias("owner_id")).join(owner.withColumn("real", F.lit(True)), "owner_id", "left")
    around = own.select("identity_id", "family_id").distinct().join(members, "family_id")
    parts = [
        own.select("identity_id", name("person", "identity_id").alias("a"), name("document", "document_number").alias("b")),
        around.select("identity_id", name("document", "document_number").alias("a"), name("pattern", "family_id").alias("b")),
        around.where("real").select("identity_id", name("person", "owner_id").alias("a"), name("document", "document_number").alias("b")),
        asked.join(events.select("identity_id", "checkpoint").distinct(), "identity_id").select("identity_id", name("person", "identity_id").alias("a"), name("checkpoint", "checkpoint").alias("b")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select("identity_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def network_report(identities: DataFrame, documents: DataFrame, families: DataFrame, events: DataFrame) -> DataFrame:
    """identity_id, connected_cases, common_pattern, checkpoints_involved (names in order, by commas) of every identity."""
    points = events.select("identity_id", "checkpoint").distinct().groupBy("identity_id").agg(F.array_join(F.array_sort(F.collect_list("checkpoint")), ",").alias("checkpoints_involved"))
    rows = identities.select("identity_id").join(connected_cases(documents, families), "identity_id", "left").join(points, "identity_id", "left")
    return rows.select("identity_id", F.coalesce("connected_cases", F.lit(0)).alias("connected_cases"), "common_pattern", F.coalesce("checkpoints_involved", F.lit("")).alias("checkpoints_involved"))


def log_lines(results: DataFrame, officer_id: str) -> DataFrame:
    """verification_id, line: one structured line for each result (verification_id, document_number, risk_score, risk_level)."""
    text = F.format_string("event=screening_complete verification_id=%s document=%s risk_score=%d risk_level=%s officer=%s", F.col("verification_id").cast("string"), F.col("document_number").cast("string"), F.col("risk_score").cast("int"), "risk_level", F.lit(officer_id))
    return results.select("verification_id", text.alias("line"))
