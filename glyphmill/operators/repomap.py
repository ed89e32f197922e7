"""Repository maps: modules with their files and symbols, and hints on what they depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.paths import file_name, module_name, module_path, under
from glyphmill.functions.text import identifiers


def located(units: DataFrame, root_name: str, prefix: str | None = None) -> DataFrame:
    """``units`` under the prefix, with module (path), label and file."""
    module = module_path(F.col("file_path"))
    return units.where(under(F.col("file_path"), prefix)).withColumn("module", module).withColumn("label", module_name(module, root_name)).withColumn("file", file_name(F.col("file_path")))


def symbol_locations(units: DataFrame) -> DataFrame:
    """Distinct symbol names with the modules that define them."""
    return units.select("name", "module", "label").distinct()


def dependency_hints(units: DataFrame) -> DataFrame:
    """module and dep (the label of another module that defines an identifier used there), distinct."""
    text = F.concat_ws(" ", "signature", "content")
    used = units.select("module", F.explode(identifiers(text)).alias("word")).distinct()
    defined = symbol_locations(units).select(F.col("name").alias("word"), F.col("module").alias("home"), F.col("label").alias("dep"))
    return used.join(defined, "word").where("home <> module").select("module", "dep").distinct()


def modules(units: DataFrame) -> DataFrame:
    """module, name, files, symbols and depends_on, one row a module, ordered within."""
    symbol: Column = F.struct(F.col("file_path"), F.col("line_start").alias("line"), "name", "kind", "signature", "doc", "file")
    base = units.groupBy("module").agg(F.first("label").alias("name"), F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_list(symbol)).alias("symbols"))
    hints = dependency_hints(units).groupBy("module").agg(F.array_sort(F.collect_set("dep")).alias("depends_on"))
    joined = base.join(hints, "module", "left")
    return joined.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
