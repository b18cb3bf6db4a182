"""Spans and labels of the license scan against a plain alignment of every text with every template."""

import random
import re

from evidentia.llm import license_diagonals as ld


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text))


def brute(text, templates=ld.TEMPLATES):
    """(labels without base ones, spans): hits are compared words; of all fitting spans the best is taken out with what overlaps it, and so on."""
    w, fits = words(text), []
    for k, (label, template) in enumerate(templates):
        t = words(template)
        hits = sorted((i - j, i, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3])
        groups, before = [], None
        for d, i, j in hits:
            if before is None or d - before > ld.NEAR:
                groups.append([])
            groups[-1].append((i, j))
            before = d
        for g in groups:
            theirs, ours = {j + x for _, j in g for x in range(3)}, {i + x for i, _ in g for x in range(3)}
            low, end = min(ours), max(ours) + 1
            if len(theirs) >= ld.COVERAGE * len(t) and len(ours) >= ld.DENSITY * (end - low):
                fits.append((-len(theirs), -len(theirs) / len(t), k, low, end, label))
    kept, left = [], sorted(fits)
    while left:
        best = left[0]
        kept.append((best[3], best[4], best[5], round(-best[1], 9)))
        left = [f for f in left[1:] if f[4] <= best[3] or f[3] >= best[4]]
    return {f[2] for f in kept}, sorted(kept)


def scanned(spark, texts, templates):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in ld.scan(docs, templates).collect()}


def test_a_bridge_between_two_licenses(spark):
    """B overlaps A and C, which don't overlap each other: A and C stay, or B alone where it has most words."""
    w = [f"word{k}" for k in range(30)]
    cut = lambda a, b: " ".join(w[a:b])
    got = scanned(spark, [cut(0, 20), cut(8, 14)], [("A", cut(0, 10)), ("B", cut(8, 14)), ("C", cut(12, 20))])
    assert got[0].labels == "A,C" and got[1].labels == "B" and [(s.start, s.end) for s in got[0].spans] == [(0, 10), (12, 20)]
    assert scanned(spark, [cut(0, 30)], [("A", cut(0, 8)), ("B", cut(5, 25)), ("C", cut(22, 30))])[0].labels == "B"


def test_chains_of_overlapping_templates(spark):
    rng = random.Random(11)
    w = [f"word{k}" for k in range(80)]
    for _ in range(3):
        templates = []
        for k in range(12):
            a = rng.randrange(70)
            templates.append((f"L{k:02}", " ".join(w[a : a + rng.randrange(4, 16)])))
        texts = [" ".join(w[rng.randrange(20) :]) for _ in range(4)] + [" ".join(x for x in w if rng.random() < 0.9) for _ in range(8)] + [" ".join(w * 2)]
        got = scanned(spark, texts, templates)
        for i, text in enumerate(texts):
            labels, spans = brute(text, templates)
            assert [(s.start, s.end, s.label, round(s.coverage, 9)) for s in got[i].spans] == spans
            assert set(filter(None, got[i].labels.split(","))) == labels


def test_against_alignment(spark):
    rng, texts = random.Random(4), ["", "the the the the the the", "under the mit license " * 30]
    for label, template in ld.TEMPLATES:
        t = template.split()
        texts += [template, "before it " + template + " after it " + template, " ".join(t[: len(t) * 3 // 4]), " ".join(t[: len(t) // 2])]
        for _ in range(6):
            edited = [x for w in t for x in (rng.choice([[w]] * 8 + [[], ["other"], [w, "new"]]))]
            texts.append("some text " + " ".join(edited) + " and more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ld.scan(docs).collect()}
    found = set()
    for i, text in enumerate(texts):
        labels, spans = brute(text)
        found |= labels
        assert [(s.start, s.end, s.label, round(s.coverage, 9)) for s in got[i].spans] == spans, text
        assert set(filter(None, got[i].labels.split(","))) == labels | set(filter(None, got[i].base_labels.split(",")))
    assert found == {label for label, _ in ld.TEMPLATES}


def test_like_licenses_are_told_apart(spark):
    texts = [t for label, t in ld.TEMPLATES if label in ("cc-by", "cc-by-sa", "cc-by-nc") and t.startswith("This")]
    got = {r.doc_id: r.labels for r in ld.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sorted(got.values()) == ["cc-by", "cc-by-nc", "cc-by-sa"]
