"""The library's functions for SQL: native ones as SQL functions, the others as Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Native functions: name -> (parameters, result, expression). They stay visible to the optimizer.
NATIVE = {
    "norm_title": ("x STRING", "STRING", r"trim(regexp_replace(replace(lower(coalesce(x, '')), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' '))"),
    "norm_space": ("x STRING", "STRING", r"trim(regexp_replace(coalesce(x, ''), '\\s+', ' '))"),
    "rank_score": ("place DOUBLE, most DOUBLE", "DOUBLE", "bround(greatest(0.0D, 1 - place / most), 5)"),
    "rrf": ("place BIGINT", "DOUBLE", "1.0D / (60 + place)"),
    "quota": ("budget BIGINT, n BIGINT, place BIGINT", "BIGINT", "budget div n + CASE WHEN place <= budget % n THEN 1 ELSE 0 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    from pyspark.sql.functions import pandas_udf

    from scholion.functions import normalize as n
    from scholion.operators import shredding
    from scholion.sources import replay

    for name, (parameters, result, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    arrow = {"exact_title": n.exact_title, "strip_tags": shredding.strip_tags}
    for name, function in arrow.items():
        spark.udf.register(name, pandas_udf(function.function, "string"))
    replay.register(spark)
    return [*NATIVE, *arrow]
