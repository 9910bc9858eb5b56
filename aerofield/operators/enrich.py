"""Completing a loaded flight: identity, core field, map value, compensated field."""
from pyspark.sql import DataFrame, functions as F

from aerofield.functions import compensation as comp
from aerofield.operators import maps, select
from aerofield.operators.sequence import number_rows, with_group_stats


def enrich(df: DataFrame, identity: dict | None = None, core: DataFrame | None = None,
           cells: DataFrame | None = None, map_id: str | None = None, coef: list[float] | None = None,
           terms=comp.DEFAULT_TERMS, force_core: bool = False, force_comp: bool = False) -> DataFrame:
    """Override flight/line/year/doy; take the core field (``core``: flight, rn, f, or rn
    and f for a table whose ``rn`` is unique) where a flight has none or only zeros; add the map value at each position; fill a
    missing compensated field from coefficients, else from the map; other missing
    columns become 0."""
    out = df.withColumns({k: F.lit(v) for k, v in (identity or {}).items() if k in df.columns})
    lacking = lambda c: F.max(F.abs(F.coalesce(F.col(c), F.lit(0.0)))) == 0
    for c in ("igrf", "mag_1_c"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = with_group_stats(out, {"_no_core": lacking("igrf"), "_no_comp": lacking("mag_1_c"),
                                 "_null_comp": F.count("mag_1_c") == 0}, ["flight"])
    if core is not None:
        keys = [k for k in ("flight", "rn") if k in core.columns]
        out = out.join(core.select(*keys, F.col("f").alias("_f")), keys, "left").withColumn(
            "igrf", F.when(F.col("_no_core") | F.lit(force_core), F.col("_f")).otherwise(F.col("igrf"))).drop("_f")
    if cells is not None and "mag_map" not in out.columns:
        out = maps.lookup(out.withColumns({"map_id": F.lit(map_id), "x": F.col("lon"), "y": F.col("lat")}),
                          cells, into=("mag_map",)).drop("map_id", "x", "y")
    if coef is not None:
        design, names = select.with_design(number_rows(out), terms=terms)
        earth = F.col("mag_1_uc") - comp.weighted_sum([F.col(n) for n in names], coef)
        out = design.withColumn("mag_1_c", F.when(F.col("_no_comp") | F.lit(force_comp), earth)
                                .otherwise(F.col("mag_1_c"))).drop(*names)
    elif "mag_map" in out.columns:
        out = out.withColumn("mag_1_c", F.when(F.col("_null_comp"), F.col("mag_map")).otherwise(F.col("mag_1_c")))
    for c in ("line", "year", "doy", "diurnal", "igrf", "mag_1_c", "mag_1_uc"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("igrf", "mag_1_c")}).drop(
        "_no_core", "_no_comp", "_null_comp")
