"""From archive files to the staged nodes of the unified tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_COLUMNS = ["archive", "local_id", "kind", "slug", "parent_local_id", "dimension_code", "body", "source_path", "attrs"]


def classified(files: DataFrame) -> DataFrame:
    """Content files (archive, path, body) with dimension_code and function_slug; manifests are left out."""
    p = F.col("path")
    content = files.filter(p.isNotNull() & (X.basename(p) != X.MANIFEST_FILE))
    return content.withColumns({"dimension_code": X.dimension(p), "function_slug": X.business_function(p)})


def unreached(files: DataFrame) -> DataFrame:
    """archive, path of the files that no dimension claims."""
    return classified(files).filter("dimension_code IS NULL").select("archive", "path")


def build_nodes(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Staged nodes: a capability an archive, its business functions, its leaves.

    Parents are named by local_id within the archive; attrs come from the
    manifest for capabilities and from attribute lines for ``.adoc`` leaves.
    """
    none = F.lit(None).cast("string")
    no_attrs = F.create_map().cast("map<string,string>")
    reached = classified(files).filter("dimension_code IS NOT NULL")
    top = manifests.select(
        "archive", F.lit("cap").alias("local_id"), F.lit("capability").alias("kind"), F.col("capability_slug").alias("slug"), none.alias("parent_local_id"), none.alias("dimension_code"), none.alias("body"), none.alias("source_path"),
        F.create_map(F.lit("category"), "category", F.lit("domain"), "domain").alias("attrs"),
    )
    functions = reached.filter("function_slug IS NOT NULL").select("archive", F.col("function_slug").alias("slug")).distinct()
    functions = functions.select("archive", F.concat(F.lit("bf:"), "slug").alias("local_id"), F.lit("business_function").alias("kind"), "slug", F.lit("cap").alias("parent_local_id"), none.alias("dimension_code"), none.alias("body"), none.alias("source_path"), no_attrs.alias("attrs"))
    leaves = reached.select(
        "archive", F.concat(F.lit("doc:"), "path").alias("local_id"), X.kind(F.col("path")).alias("kind"), X.slug(F.col("path")).alias("slug"),
        F.coalesce(F.concat(F.lit("bf:"), "function_slug"), F.lit("cap")).alias("parent_local_id"), "dimension_code", "body", F.col("path").alias("source_path"),
        F.when(F.col("path").endswith(".adoc"), X.attributes(F.col("body"))).otherwise(no_attrs).alias("attrs"),
    )
    return top.unionByName(functions).unionByName(leaves).select(_COLUMNS)
