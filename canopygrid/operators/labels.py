"""Colours as labels: dense dictionary encoding, and the look-ups around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours that a dictionary may have; a label has 8 bits.
MOST_LABELS = 256


def parsed_color(text: Column) -> Column:
    """``"R,G,B"`` as a struct, null if it isn't three numbers from 0 to 255."""
    parts = F.split(text, ",")
    digit = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^[0-9]{1,9}$"), F.get(parts, F.lit(i)).cast("int"))
    ok = (F.size(parts) == 3) & digit(0).between(0, 255) & digit(1).between(0, 255) & digit(2).between(0, 255)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(digit(0).alias("r"), digit(1).alias("g"), digit(2).alias("b")))


def color_or_fail(text: Column) -> Column:
    parsed = parsed_color(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("illegal colour: "), F.coalesce(text, F.lit("null")))).cast("struct<r:int,g:int,b:int>"))


def color_text(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.concat_ws(",", r, g, b)


def padding_color(ignored: list[str]) -> str:
    """The first ignored colour, else black; it gets label 0."""
    return ignored[0] if ignored else "0,0,0"


def color_dictionary(pixels: DataFrame, order: list[str], first: tuple[int, int, int] | None = None) -> DataFrame:
    """``label``, ``r``, ``g``, ``b``: labels in the order in which colours are first seen, ``first`` before all.

    Only distinct colours, at most ``MOST_LABELS``, reach the one task that numbers them; more fail.
    """
    seen = pixels.groupBy("r", "g", "b").agg(F.min(F.struct(*order)).alias("at"))
    is_first = (F.col("r") == first[0]) & (F.col("g") == first[1]) & (F.col("b") == first[2]) if first else F.lit(False)
    if first:
        extra = pixels.sparkSession.createDataFrame([first], "r int, g int, b int").join(seen.select("r", "g", "b"), ["r", "g", "b"], "left_anti")
        seen = seen.unionByName(extra.select(*[F.col(c).cast(seen.schema[c].dataType) for c in "rgb"], F.lit(None).cast(seen.schema["at"].dataType).alias("at")))
    number = F.row_number().over(Window.orderBy(F.when(is_first, 0).otherwise(1), "at")) - 1
    fits = F.when(number < MOST_LABELS, number).otherwise(F.raise_error(F.lit("more colours than labels")).cast("int"))
    return seen.select(fits.alias("label"), "r", "g", "b")


def encoded(pixels: DataFrame, colors: DataFrame, where: list[str] = ()) -> DataFrame:
    """``pixels`` with ``label``; an unknown colour fails, naming the columns ``where``. The dictionary is at most ``MOST_LABELS`` rows."""
    joined = pixels.join(F.broadcast(colors.select("label", "r", "g", "b")), ["r", "g", "b"], "left")
    said = F.concat_ws(" ", F.lit("unknown colour"), color_text(), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in where])
    return joined.withColumn("label", F.coalesce("label", F.raise_error(said).cast("int")))


def dictionary_of(spark, named: dict[int, str]) -> DataFrame:
    """The dictionary of colours as text by label."""
    return spark.createDataFrame([(k, *map(int, v.split(","))) for k, v in sorted(named.items())], "label int, r int, g int, b int")


def decoded(labels: DataFrame, colors: DataFrame) -> DataFrame:
    """``labels`` with ``r``, ``g``, ``b``; an unknown label fails."""
    joined = labels.join(F.broadcast(colors.select("label", "r", "g", "b")), "label", "left")
    return joined.withColumn("r", F.coalesce("r", F.raise_error(F.lit("unknown label")).cast("int")))


def merged_dictionary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both dictionaries as one; a colour with two labels, or a label with two colours, fails."""
    both = a.unionByName(b).distinct()
    once = F.count(F.lit(1)).over(Window.partitionBy("label")) + F.count(F.lit(1)).over(Window.partitionBy("r", "g", "b"))
    return both.withColumn("label", F.when(once == 2, F.col("label")).otherwise(F.raise_error(F.lit("colours conflict")).cast("int")))


def label_colors(labels: DataFrame, colors: DataFrame) -> DataFrame:
    """``label`` and its colour as text, for each label that occurs."""
    return labels.select("label").distinct().join(F.broadcast(colors), "label").select("label", color_text().alias("color"))


def mapped_classes(names: DataFrame, classes: DataFrame, colors: DataFrame, name: str = "name") -> DataFrame:
    """Object names as structure classes and their colours; a name without a class fails.

    ``classes``: ``name``, ``class``; ``colors``: ``class``, ``color``. Both are parameters, tables of names, not data.
    """
    joined = names.join(classes, name, "left").join(F.broadcast(colors), "class", "left")
    return joined.withColumn("class", F.coalesce("class", F.raise_error(F.concat(F.lit("no class for "), F.col(name))))).withColumn("color", F.coalesce("color", F.raise_error(F.lit("no colour for a class"))))


def without_labels(rows: DataFrame, ignored: list[int], label: str = "label") -> DataFrame:
    return rows.where(~F.col(label).isin(*ignored)) if ignored else rows


def ignored_labels(colors: DataFrame, ignored: list[str]) -> DataFrame:
    """Labels of the ignored colours."""
    return colors.where(color_text().isin(*ignored)) if ignored else colors.limit(0)
