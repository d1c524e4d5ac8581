"""Parameterised feature-pull templates, and the feature names listed in a template's text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity_spark.operators.customer360 import cohort_limits
from propensity_spark.sources.readers import preview

# The mark of the cohort's condition, the alias of the customer table in a template, the names a list
# of features goes by, the characters of a feature's name, and words that are never one.
PLACEHOLDER = "{{COHORT_FILTERS}}"
ALIAS = "d"
LIST_NAMES = ["selected_columns", "selected_features", "columns", "features"]
NAME_CHARACTERS = "a-zA-Z0-9_-"
IGNORED_WORDS = [
    "pyspark.sql", "SparkSession", "col", "table", "pyspark", "input_table", "select", "credit_card",
    "mutual_funds", "loans", "defaulter",
]


def cohort_clause(request: dict) -> tuple[str, dict]:
    """The limits of a cohort request as a condition with named markers, and the values to bind."""
    limits, parts, args = cohort_limits(request), [], {}
    for kind, sign in (("minimum", ">="), ("maximum", "<="), ("equals", "=")):
        for column, value in limits[kind].items():
            if value not in (None, "All"):
                parts.append(f"{ALIAS}.{column} {sign} :{kind}_{column}")
                args[f"{kind}_{column}"] = value
    return " AND ".join(parts) or "TRUE", args


def compile_template(template: str, request: dict) -> tuple[str, dict]:
    """The text of a template with its cohort condition, and the values to bind."""
    clause, args = cohort_clause(request)
    return template.replace(PLACEHOLDER, clause), args


def template_query(
    spark: SparkSession, template: str, filters: dict, columns: list[str] | None = None, **frames: DataFrame
) -> DataFrame:
    """Run a SQL template with the cohort filters bound as parameters, over frames named like its tables.

    The frames are common table expressions over views with names of their own, so views of the session keep theirs.
    """
    text, args = compile_template(template, filters)
    views = {name: f"_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, view in views.items():
        frames[name].createOrReplaceTempView(view)
    try:
        tables = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        body = text.strip().rstrip(";")
        if tables:
            own = body[:4].lower() == "with" and body[4:5].isspace()
            body = f"WITH {tables}, {body[4:].lstrip()}" if own else f"WITH {tables} {body}"
        out = spark.sql(body, args=args)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return out.select(*columns) if columns else out


def template_preview(
    spark: SparkSession, template: str, filters: dict, rows: int = 10, with_count: bool = False, **frames: DataFrame
) -> dict:
    """A look at a template: the compiled text, the bound values, column names, a few rows, and the count if asked."""
    text, args = compile_template(template, filters)
    names, head, total = preview(template_query(spark, template, filters, **frames), rows, with_count)
    return {"sql": text, "values": args, "columns": names, "rows": head, "total": total}


def template_features(templates: DataFrame, code: str = "code") -> DataFrame:
    """Add `features`: distinct quoted names of the first feature list, else of the whole text.

    Without a list, ignored words and one-letter words are left out.
    """
    text = F.col(code)
    listed = F.regexp_extract(text, rf"(?i)({'|'.join(LIST_NAMES)})\s*=\s*\[([^\]]*)\]", 2)

    def quoted(part):
        return F.array_distinct(F.regexp_extract_all(part, F.lit(f"[\"']([{NAME_CHARACTERS}]+)[\"']"), F.lit(1)))

    words = F.array_except(quoted(text), F.array(*[F.lit(w) for w in IGNORED_WORDS]))
    words = F.filter(words, lambda w: F.length(w) > 1)
    return templates.withColumn("features", F.when(F.size(quoted(listed)) > 0, quoted(listed)).otherwise(words))
