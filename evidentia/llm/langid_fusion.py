"""Operator 5, language of web pages: Bayesian fusion of the text with what the markup and the address say.

* Text: smoothed likelihoods of hashed grams of 1 to 3 bytes, learned from a bounded sample of the documents whose
  language is known. Neighbouring grams aren't independent, so a text counts as ``EVIDENCE`` grams at most.
* Markup: the primary part of the root element's lang attribute. How often each declared value goes with each
  language is counted over all pages, by what their texts say.
* Address: a prior for each host, shrunk to that of its registered domain, this to its suffix, this to all pages. The
  counts are grouped sums of the texts' posteriors over all pages, and a page's own share is taken out of each.

Defined results: a null or empty page has no text evidence and gets its prior; without a host it gets the prior of
all hosts without one; repeated rows get one result each and count each; without documents of known language each
result is null; null ids are results like any other; other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, url_cascade

#: The bounded sample of the text likelihoods: documents of each language, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 5_000
#: Languages whose samples are collected at once; more take more passes.
PASS_LANGUAGES = 64
#: Languages that the table of likelihoods can have, 256 KB each; more stop with an error, none is left out.
MOST_LANGUAGES = 1_000
BUCKETS = 1 << 15
EVIDENCE = 30.0
#: Pages' worth of weight of the level above, and of each declared value's share.
KAPPA, ALPHA = 4.0, 1.0

_HIDDEN = re.compile(rb"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>|&[a-z0-9#]{1,8};")
_LANG = re.compile(rb"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""")


def visible(html: bytes) -> bytes:
    return _HIDDEN.sub(b" ", html)


def declared(html: bytes) -> str:
    """The lang attribute's primary part, of two or three letters; empty if none: a bounded set of values."""
    m = _LANG.search(html)
    return m[1].decode().lower() if m else ""


def grams(text: bytes) -> np.ndarray:
    """Hashed grams of 1 to 3 bytes of the lower-cased words."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    keep = ~((data < 0x61) & (data != 0x20)) & ~((data > 0x7A) & (data < 0x80))
    data = data[keep]
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    one, two = data, data[:-1] * 256 + data[1:] + (1 << 16)
    three = data[:-2] * 65536 + data[1:-1] * 256 + data[2:] + (1 << 25)
    return ((np.concatenate([one, two, three]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.uint32)


class Likelihoods:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table  # log P(gram | language), a language a row

    def of(self, text: bytes) -> tuple[np.ndarray, int]:
        """Log-likelihood of each language, tempered, and the grams counted."""
        g = grams(text)
        if not len(g):
            return np.zeros(len(self.languages)), 0
        return self.table[:, g].mean(1) * min(len(g), EVIDENCE * 3), len(g)


def _counts(rows: list) -> dict[str, np.ndarray]:
    """The smoothed gram counts of each language of (text, lang) rows."""
    out = {}
    for r in rows:
        counts = out.setdefault(r["lang"], np.full(BUCKETS, 0.2))
        np.add.at(counts, grams((r["text"] or "").encode("utf-8", "replace")), 1)
    return out


def _likelihoods(counts: dict[str, np.ndarray]) -> Likelihoods:
    languages = sorted(counts)
    table = np.array([counts[x] for x in languages]).reshape(-1, BUCKETS)
    return Likelihoods(languages, np.log(table / table.sum(1, keepdims=True)))


def fit(rows: list) -> Likelihoods:
    """The likelihoods of (text, lang) rows."""
    return _likelihoods(_counts(rows))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Likelihoods:
    """From ``max_chars`` characters of ``rows`` documents of each language, the first by a hash of their ids.

    Every language with a document of any letters is in it: a text counts from its first letter on. The ids are
    ranked without their texts.
    """
    text = F.substring(F.regexp_replace("text", r"^[\x00-@\[-`{-\x7F]++", ""), 1, max_chars)
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("lang", "doc_id", text.alias("text")).where("text <> ''")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    ids = common.checkpointed(ids.select("lang", "doc_id"))
    languages = [r["lang"] for r in ids.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = {}
    for group in (sorted(languages)[k : k + PASS_LANGUAGES] for k in range(0, len(languages), PASS_LANGUAGES)):
        # at most ``rows`` ids of each of these languages, one text each: of equal ids the first text by a hash
        found = known.join(F.broadcast(ids.where(F.col("lang").isin(group))), ["lang", "doc_id"], "left_semi")
        found = found.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("b"))
        counts |= _counts(found.select("lang", "b.text").collect())
    return _likelihoods(counts)


def _read(pages: DataFrame, model: Likelihoods) -> DataFrame:
    """(page_id, host, domain, suffix, declared, n_grams, text_ll, text_post) of each page."""
    host, _ = url_cascade.parts(F.col("url"))
    host = F.regexp_replace(host, r"^.*@|:\d*$", "")
    labels = F.split("host", r"\.")
    rows = pages.select("page_id", host.alias("host"), "html")
    rows = rows.select("page_id", "host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"), "html")
    more = [T.StructField("declared", T.StringType()), T.StructField("n_grams", T.LongType()), T.StructField("text_ll", T.ArrayType(T.DoubleType())), T.StructField("text_post", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "html"), *more])
    at = rows.columns.index("html")

    def run(batches):
        for batch in (whole.slice(k, 200) for whole in batches for k in range(0, whole.num_rows, 200)):
            said, n, ll, post = [], [], [], []
            for html in batch.column(at).cast(pa.large_binary()).to_pylist():
                html = html or b""
                l, k = model.of(visible(html))
                e = np.exp(l - l.max()) if len(l) else l
                said.append(declared(html))
                n.append(k)
                ll.append(l - l.max() if len(l) else l)
                post.append(e / e.sum() if k else np.zeros(len(l)))  # a page without text counts for nothing
            floats = pa.list_(pa.float64())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(n, pa.int64()), pa.array(ll, floats), pa.array(post, floats)], names=schema.names)

    return common.mapped(rows, run, schema)


def _sums(rows: DataFrame, by: list[str], values: str, k: int, name: str) -> DataFrame:
    """``rows`` by ``by``, with the sums of the k values as the array ``name``; combined before any shuffle."""
    return rows.groupBy(*by).agg(F.array(*(F.sum(F.get(values, F.lit(i))) for i in range(k))).alias(name))


def identify(pages: DataFrame, model: Likelihoods) -> DataFrame:
    """page_id, host, lang, confidence, text_lang, declared, n_grams and posteriors (a map)."""
    k, read = len(model.languages), common.checkpointed(_read(pages, model))
    if not k:
        nothing = F.lit(None)
        return read.select("page_id", "host", nothing.cast("string").alias("lang"), nothing.cast("double").alias("confidence"), nothing.cast("string").alias("text_lang"), "declared", "n_grams", nothing.cast("map<string,double>").alias("posteriors"))
    hosts = common.checkpointed(_sums(read, ["host", "domain", "suffix"], "text_post", k, "n_host"))
    domains = _sums(hosts, ["domain", "suffix"], "n_host", k, "n_domain")
    suffixes = _sums(domains, ["suffix"], "n_domain", k, "n_suffix")
    whole = [float(x or 0) for x in (_sums(suffixes, [], "n_suffix", k, "n").first() or [[0] * k])[0]]
    tree = hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix").select("host", "n_host", "n_domain", "n_suffix")
    said = _sums(read, ["declared"], "text_post", k, "n_declared")  # at most 26^2 + 26^3 + 1 values
    rows = read.join(tree, "host").join(F.broadcast(said), "declared")

    def shrunk(count: str | Column, above: Column) -> Column:
        own = F.zip_with(F.col(count) if isinstance(count, str) else count, F.col("text_post"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(own, above, lambda n, p: (n + KAPPA * p) / (total + KAPPA))

    even = F.array(*(F.lit(1.0 / k) for _ in range(k)))
    counts = F.array(*(F.lit(x) for x in whole))
    rows = rows.withColumn("prior", shrunk(counts, even))
    for level in ("n_suffix", "n_domain", "n_host"):
        rows = rows.withColumn("prior", shrunk(level, F.col("prior")))
    values = said.count()
    rates = F.zip_with(F.zip_with("n_declared", F.col("text_post"), lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with(counts, F.col("text_post"), lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda n, t: (n + ALPHA) / (t + ALPHA * values))
    logs = F.zip_with(F.zip_with("text_ll", F.col("prior"), lambda a, p: a + F.ln(p)), rates, lambda a, r: a + F.ln(r))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    rows = rows.withColumn("e", F.transform("logs", lambda x: F.exp(x - F.col("top")))).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    names = F.array(*(F.lit(x) for x in model.languages))
    best = F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1)
    by_text = F.when(F.col("n_grams") > 0, F.get(names, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1))
    shares = F.transform("e", lambda x: x / F.col("sum"))
    return rows.select("page_id", "host", best.alias("lang"), (1 / F.col("sum")).alias("confidence"), by_text.alias("text_lang"), "declared", "n_grams", F.map_from_arrays(names, shares).alias("posteriors"))


def query(spark, sf_dir: str) -> DataFrame:
    model = train(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), model).drop("posteriors")
