"""Markdown units and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts above this size are no units.
UNIT_BYTES = 262_144


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, columns in alphabetical order, nulls kept."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines; a damaged line gives a row with its text in ``_damaged`` and nulls elsewhere."""
    reader = spark.read.schema(f"{schema}, _damaged string").option("columnNameOfCorruptRecord", "_damaged")
    return reader.json(path)


def unit_markdown(units: DataFrame) -> DataFrame:
    """id, markdown: a front matter of ``key: value`` lines, values as JSON, and the body."""
    keys = [c for c in sorted(units.columns) if c != "body"]
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.struct(F.col(k).alias("v")), {"ignoreNullFields": "false"})) for k in keys]
    text = F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return units.select("id", text.alias("markdown"))


def parse_markdown(texts: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Units out of a column ``markdown``: the columns of ``schema`` (name -> type), body, and ``error`` where it is no unit.

    A text without front matter, with a repeated key, or above ``UNIT_BYTES`` is an error; a missing key is null.
    """
    head = F.regexp_extract("markdown", r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.split(head, "\n")
    keys = F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z_]+): ", 1))
    error = (
        F.when(F.octet_length("markdown") > UNIT_BYTES, "too large")
        .when(~F.col("markdown").rlike(r"(?s)\A---\n.*?\n---\n"), "no front matter")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated key")
    )

    def value(name: str, kind: str):
        line = F.element_at(F.filter(lines, lambda x: x.startswith(f"{name}: ")), 1)
        return F.from_json(F.substring(line, len(name) + 3, 1 << 30), f"v {kind}")["v"].alias(name)

    staged = texts.select("markdown", error.alias("error")).select(
        "markdown", "error", *[F.when(F.col("error").isNull() & (F.size(lines) > 0), value(k, t)).alias(k) for k, t in schema.items()]
    )
    body = F.when(F.col("error").isNull(), F.regexp_replace("markdown", r"(?s)\A---\n.*?\n---\n", ""))
    return staged.select(*schema, body.alias("body"), "error")
