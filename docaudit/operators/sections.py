"""The path of headings above each paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "正文"


def section_paths(paragraphs: DataFrame, default: str = DEFAULT, levels: int = 9) -> DataFrame:
    """paragraphs(document, ord, heading_level, text) with section: a heading counts until one of its level or a higher one."""
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names, places = {}, {}
    for k in range(1, levels + 1):
        here = F.col("heading_level") == k
        names[k] = F.last(F.when(here, F.col("text")), True).over(upto)
        places[k] = F.max(F.when(here, F.col("ord"))).over(upto)
    out = paragraphs.select("*", *[names[k].alias(f"_n{k}") for k in names], *[places[k].alias(f"_p{k}") for k in places])
    parts, above = [], F.lit(None).cast("int")
    for k in range(1, levels + 1):
        parts.append(F.when(F.col(f"_p{k}") > F.coalesce(above, F.lit(-1)), F.col(f"_n{k}")))
        above = F.greatest(above, F.col(f"_p{k}")) if k > 1 else F.col("_p1")
    path = F.concat_ws(" / ", *parts)
    return out.withColumn("section", F.when(F.length(path) > 0, path).otherwise(default)).drop(*[f"_{x}{k}" for x in "np" for k in names])
