"""File names: one safe and unique name for each chapter of an output."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import NAME_BYTES, name_key, numbered, safe_filename


def allocate(chapters: DataFrame, *, output: str, index: str = "idx", title: str = "title", order: list[str] | None = None, suffix: str = ".txt", max_bytes: int = NAME_BYTES) -> DataFrame:
    """Adds name and collided_with: `NNN - Title.ext`, with ` (2)`, ` (3)` and so on where an earlier chapter of the output
    has the same name but for case.

    Names that nobody else wants, nearly all, come from expressions. Only outputs where a name repeats or a title itself
    ends in a number in brackets go through the ordered allocation, one task for each such output.
    """
    order = order or [index]
    prefix = F.concat(numbered(F.col(index)), F.lit(" - "))
    reserved = F.octet_length(prefix) + len(suffix.encode())
    base = safe_filename(F.col(title), max_bytes=F.greatest(F.lit(1), F.lit(max_bytes) - reserved))
    named = chapters.withColumns({"_prefix": prefix, "_base": base})
    named = named.withColumn("_first", F.concat("_prefix", "_base", F.lit(suffix))).withColumn("_key", name_key("_first"))
    same = F.count(F.lit(1)).over(Window.partitionBy(output, "_key"))
    named = named.withColumn("_same", same)
    clash = F.max(((F.col("_same") > 1)).cast("int")).over(Window.partitionBy(output)) == 1
    named = named.withColumn("_clash", clash)
    columns = [*chapters.columns, "name", "collided_with"]
    free = named.where(~F.col("_clash")).withColumns({"name": F.col("_first"), "collided_with": F.lit(None).cast("string")}).select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema) + ", name string, collided_with string"
    kept = chapters.columns

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, str] = {}
        names, others = [], []
        group = group.sort_values(order, kind="stable")
        for first, key, start, stem in zip(group["_first"], group["_key"], group["_prefix"], group["_base"]):
            name, holder, n = first, taken.get(key), 1
            while key in taken:
                n += 1
                mark = f" ({n})"
                room = max_bytes - len(start.encode()) - len(suffix.encode()) - len(mark)
                name = start + stem.encode()[: max(1, room)].decode(errors="ignore") + mark + suffix
                key = folded(name)
            taken[key] = name
            names.append(name)
            others.append(holder)
        return group[kept].assign(name=names, collided_with=others)

    settled = named.where("_clash").groupBy(output).applyInPandas(in_order, schema)
    return free.unionByName(settled)


def folded(name: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", name).casefold()


