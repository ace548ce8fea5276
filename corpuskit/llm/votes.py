"""Answers of annotators as both problem 5 and problem 7 count them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.operators.lineage import clean_key

CHOICES = ("left", "right", "tie", "both_bad")


def latest_answers(preferences: DataFrame) -> DataFrame:
    """(comparisonId, dimension, annotator, k): the answer that holds, k its place in CHOICES.

    Per comparison, annotator and dimension the highest revision holds, of equal ones
    the last saved, then the last choice in CHOICES. If its choice is null, cannot_judge
    or unknown there is no answer; an older revision does not come back. Rows without a
    comparison, annotator or dimension are dropped. Revision, second and choice are packed
    in one long, so that the aggregate stays a hash aggregate with map-side combining.
    """
    code = F.lit(0)
    choice = clean_key("choice")
    for i, name in enumerate(CHOICES, 1):
        code = F.when(choice == name, i).otherwise(code)
    second = F.greatest(F.lit(0), F.least(F.lit((1 << 33) - 1), F.coalesce(F.unix_timestamp("savedAt"), F.lit(0))))
    packed = F.shiftleft(F.coalesce(F.col("revision"), F.lit(0)).cast("long"), 36) + F.shiftleft(second, 3) + code
    return (
        preferences.select(
            "comparisonId", "dimension", clean_key("annotatorId").alias("annotator"), packed.alias("packed")
        )
        .filter("comparisonId is not null and dimension is not null and annotator is not null")
        .groupBy("comparisonId", "dimension", "annotator")
        .agg(F.max("packed").alias("packed"))
        .select("comparisonId", "dimension", "annotator", (F.col("packed").bitwiseAND(F.lit(7)) - 1).cast("int").alias("k"))
        .filter("k >= 0")
    )
