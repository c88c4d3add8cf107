"""Requests for an analysis: file names, who asks, and a fingerprint that tells a repeated request from another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the version that is part of a fingerprint.
VERSION = "1.0.0"


def safe_filename(name: Column) -> Column:
    """The last part of a path without white space at its ends; null if nothing, "." or ".." is left."""
    last = F.trim(F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"(/\.?)+$", ""), r"[^/]*$", 0))
    return F.when(~last.isin("", ".", ".."), last)


def actor_id(token: Column) -> Column:
    """Stands for a key without holding it."""
    return F.concat(F.lit("api-key:"), F.substring(F.sha2(token, 256), 1, 16))


def fingerprints(files: DataFrame, keys: list[str], version: str = VERSION) -> DataFrame:
    """One fingerprint for the files(keys, ord, filename, file_type, size_bytes, sha256) of each request, in their order."""
    fields = ("file_type", "filename", "sha256", "size_bytes")
    records = F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    body = F.to_json(F.struct(F.lit(version).alias("api_version"), F.col("records").alias("files")))
    return files.groupBy(*keys).agg(records.alias("records")).select(*keys, F.size("records").alias("n_files"), F.sha2(body, 256).alias("request_fingerprint"))
