"""The table of street names as a dimension, and names looked up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import text

ENTRY = "struct<ru:string,en:string,src:string,tier:string>"


def read_names(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """key, ru, en, src, tier of the documents at a path, one a file or one a line, each with a ``names`` map by street.

    Empty translations are null. Of a key in several documents the first by its values.
    """
    rows = spark.read.schema(f"names map<string,{ENTRY}>").option("multiLine", whole_files).json(path).select(F.explode("names").alias("key", "e"))
    filled = lambda c: F.nullif(F.trim(f"e.{c}"), F.lit("")).alias(c)
    each = rows.select(text.table_key(F.col("key")).alias("key"), *map(filled, ("ru", "en", "src", "tier")))
    return each.groupBy("key").agg(F.min(F.struct("ru", "en", "src", "tier")).alias("e")).select("key", "e.*")


def numbered(name: Column, number: Column) -> Column:
    """A translated name with its house number, if it hasn't got it; no name stays none."""
    return F.when(number.isNull() | F.contains(name, number), name).otherwise(F.concat(name, F.lit(" №"), number))


def looked_up(rows: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """Adds ``ru`` and ``en``: of the very name, else of the name without its house number, which is put back in the reader's letters; else null.

    names: key, ru, en. An entry without a translation gives none. Two joins on the key, of which the names' side is the small one.
    """
    whole = text.table_key(F.col(name))
    base, number = text.house_number(whole)
    keyed = rows.withColumns({"_whole": whole, "_base": F.when(number.isNotNull(), base), "_number": number})
    own = names.select(F.col("key").alias("_whole"), F.struct("ru", "en").alias("_own"))
    street = names.select(F.col("key").alias("_base"), F.struct("ru", "en").alias("_street"))
    both = keyed.join(own, "_whole", "left").join(street, "_base", "left")
    found = {
        "ru": F.when(F.col("_own").isNotNull(), F.col("_own.ru")).otherwise(numbered(F.col("_street.ru"), text.to_cyrillic(F.col("_number")))),
        "en": F.when(F.col("_own").isNotNull(), F.col("_own.en")).otherwise(numbered(F.col("_street.en"), F.translate("_number", text.POLE_GEORGIAN, text.POLE_LATIN))),
    }
    return both.select(*rows.columns, *(c.alias(n) for n, c in found.items()))


def first_filled(*names: Column) -> Column:
    """The first name that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in names))


def latin_only(name: Column) -> Column:
    """The name if it has a Latin letter and no Georgian one, else null."""
    return F.when(name.rlike("[A-Za-z]") & ~name.rlike(text.GEORGIAN_SCRIPT), name)
