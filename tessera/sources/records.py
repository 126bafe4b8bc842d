"""Rows of source files to document texts: ordered columns, conversations, questions with answers, and document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut

BLANK_LINE = "\n\n"


def _present(text: Column) -> Column:
    """text without white space at its ends, null when nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def first_text(*columns: str) -> Column:
    """The first of the columns that isn't blank; empty when all are."""
    return F.coalesce(*[_present(F.col(c)) for c in columns], F.lit(""))


def conversation_text(turns: Column, body: str = "content") -> Column:
    """turns: an array of structs, or of strings when body is empty; blank turns are left out, the roles too."""
    each = F.transform(turns, lambda t: _present(t[body] if body else t))
    return F.coalesce(F.array_join(F.filter(each, lambda t: t.isNotNull()), BLANK_LINE), F.lit(""))


def turn_count(turns: Column) -> Column:
    """All turns, blank ones too, but one at least."""
    return F.greatest(F.coalesce(F.array_size(turns), F.lit(0)), F.lit(1))


def question_text(question: Column, answers: Column, body: str = "text") -> Column:
    """The question and each answer's body."""
    parts = F.concat(F.array(_present(question)), F.coalesce(F.transform(answers, lambda a: _present(a[body])), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), BLANK_LINE)


def numbered(docs: DataFrame, corpus: str, order: str) -> DataFrame:
    """docs with an id `corpus-0000000`: ordinals in the order of a column. Rows are numbered within ranges of the order
    column, and a range's first ordinal is the running count of the ranges before: no task holds the whole corpus."""
    ranged = docs.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)  # range bounds come from a sample: they must not be drawn twice
    ranged = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_first())) - 1)
    sizes = docs.sparkSession.createDataFrame(ranged.groupBy("__part").count().collect(), "__part int, n long")  # one row a partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn("id", F.format_string(f"{corpus}-%07d", F.col("__before") + F.col("__at"))).drop("__part", "__at", "__before")
