"""Words that are a few letters apart, found by what is left of them when letters are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of at least so many letters may differ, by at most so many edits.
LEAST, EDITS = 5, 2


def deletions(word: Column, edits: int = EDITS) -> Column:
    """What dropping up to so many letters leaves of a word of at least so many letters and one more; its own self first."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    found = [F.array(word)]
    for _ in range(edits):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], once))))
    return F.array_distinct(F.flatten(F.array(*found)))


def close_words(words: DataFrame, others: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of words (w of both sides, each once) that are equal, or both of five letters and more and two edits apart at most.

    Two words so close leave a common rest when each drops two letters at most, so pairs meet in an equi-join of rests; a word of n
    letters has n * n / 2 of them. Of shorter words only equal ones meet.
    """
    keys = lambda df, name: df.select(F.col("w").alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("rest", F.explode(F.when(F.length(name) >= LEAST, deletions(F.col(name))).otherwise(F.array(name))))
    pairs = keys(words, "a").join(keys(others, "b"), "rest").select("a", "b").distinct()
    long = F.least(F.length("a"), F.length("b")) >= LEAST
    return pairs.where((F.col("a") == F.col("b")) | (long & (F.levenshtein("a", "b", EDITS) >= 0)))
