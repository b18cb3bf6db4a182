"""Cards are dealt to tasks, however small their table is."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import extract
from evidentia.plans import catalogue_queries as queries
from evidentia.plans import inputs, screening
from evidentia.sources import domain

from test_catalogue import SF


@pytest.mark.parametrize("rows", [domain.cards, domain.card_base, queries._docs, queries._fields, queries._lines, queries._decodes])
def test_no_task_has_all_cards(spark, rows):
    counts = [r["count"] for r in rows(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 4 and max(counts) < sum(counts) / 2


def test_no_task_has_all_identities(spark):
    """Faces are computed of every identity, so identities are dealt as cards are."""
    counts = [r["count"] for r in screening.faces(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 4 and max(counts) < sum(counts) / 2


def test_validated_cards_are_read_once(spark, capsys):
    """The texts of dates are made beside the card, not joined to it, and zones that aren't looked at aren't made."""
    inputs.validation_rows(spark, SF).explain("extended")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "mrz1" not in plan


def test_later_lines_are_met_once(spark, capsys):
    """A window that ends with the document would be summed anew for each line, so a long document took its square."""
    rows = [(1, n, "DOB" if n % 1000 == 0 else "01/02/1990" if n == 2500 else "photo", 1.0) for n in range(4000)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string, confidence double")
    found = extract.next_line_fields(lines)
    assert [tuple(r) for r in found.collect()] == [(1, "date_of_birth", "01/02/1990", 1.0)]
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
