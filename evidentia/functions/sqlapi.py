"""The column functions and the field recogniser from SQL text: temporary SQL functions of a session, without Python on the rows.

``register`` makes scalar functions; ``register_lines`` makes the table function recognised(doc_id), over the fields that
``extract.recognise`` finds in the given lines, so that SQL has them by a lateral join or for one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.functions import checkdigits
from evidentia.functions.text import GENDERS
from evidentia.operators import extract

_numbers = lambda values: "array(" + ", ".join(map(str, values)) + ")"
_A, _U, _N = checkdigits._ALPHABET, checkdigits._UNITS, checkdigits.LONGEST

#: Name and arguments, result type, body: each has the values of the column function of its name.
FUNCTIONS = [
    ("mrz_check_digit(t STRING)", "INT", f"CASE WHEN translate(t, '{_A}', '') = '' AND length(t) <= {_N} THEN aggregate(sequence(1, {_N}), 0, (s, i) -> s + CAST(substr(rpad(translate(t, '{_A}', '{_U}'), {_N}, '0'), i, 1) AS INT) * element_at(array(7, 3, 1), (i - 1) % 3 + 1)) % 10 END"),
    ("verhoeff_valid(t STRING)", "BOOLEAN", f"CASE WHEN t IS NOT NULL THEN translate(t, '0123456789', '') = '' AND length(t) BETWEEN 1 AND {checkdigits.LONGEST_NUMBER} AND aggregate(sequence(1, greatest(length(t), 1)), 0, (c, i) -> element_at({_numbers(checkdigits.PRODUCTS)}, c * 10 + element_at({_numbers(checkdigits.POWERS)}, (i - 1) % 8 * 10 + coalesce(try_cast(substr(t, length(t) - i + 1, 1) AS INT), 0) + 1) + 1)) = 0 END"),
    ("digits(t STRING)", "STRING", "regexp_replace(t, '[^0-9]', '')"),
    ("cleaned_number(t STRING)", "STRING", "replace(trim(t), '<', '')"),
    ("alphanumeric(t STRING)", "STRING", "regexp_replace(upper(t), '[^A-Z0-9]', '')"),
    ("name_words(t STRING)", "ARRAY<STRING>", "array_sort(array_remove(split(regexp_replace(upper(t), '[^A-Z]+', ' '), ' '), ''))"),
    ("gender(t STRING)", "STRING", "try_element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in GENDERS.items()) + "), upper(trim(t)))"),
    ("century(yy INT, reference INT, past BOOLEAN)", "INT", "CASE WHEN past THEN CASE WHEN yy > reference % 100 THEN yy + 1900 ELSE yy + 2000 END WHEN abs(yy + 2000 - reference) < abs(yy + 1900 - reference) THEN yy + 2000 ELSE yy + 1900 END"),
    ("iso_date(t STRING, reference INT, past BOOLEAN)", "STRING", "CASE WHEN t RLIKE '^[0-9]{6}$' THEN date_format(try_to_timestamp(concat_ws('-', CAST(century(try_cast(substr(t, 1, 2) AS INT), reference, past) AS STRING), substr(t, 3, 2), substr(t, 5, 2)), 'yyyy-MM-dd'), 'yyyy-MM-dd') END"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar functions in the session; their names."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in FUNCTIONS]


def register_lines(lines: DataFrame, name: str = "recognised") -> None:
    """The table function <name>(doc_id) and the view <name>_fields over the lines' fields."""
    spark, kind = lines.sparkSession, lines.schema["doc_id"].dataType.simpleString()
    extract.recognise(lines).createOrReplaceTempView(f"{name}_fields")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(id {kind}) RETURNS TABLE (name STRING, value STRING, confidence DOUBLE) RETURN SELECT name, value, confidence FROM {name}_fields WHERE doc_id = id")
