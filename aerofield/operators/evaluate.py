"""Navigation results against the true trajectory."""
from pyspark.sql import Column, DataFrame, functions as F

from aerofield.functions.attitude import elements, product, transpose
from aerofield.functions.geodesy import lat_to_north, lon_to_east
from aerofield.operators.stats import drms

# fixed values: state order of the filters, 17 states and an optional last one
STATES = ["lat", "lon", "alt", "vn", "ve", "vd", "tn", "te", "td", "ha", "ah",
          "ax", "ay", "az", "gx", "gy", "gz", "fogm"]
MOTION = STATES[:6]
KEY = ["flight", "line", "rn"]


def deviations(diag: Column, size: Column) -> dict[str, Column]:
    """Standard deviation per state from a covariance diagonal; 0 for an absent
    last state."""
    out = {f"{s}_std": F.sqrt(diag[i]) for i, s in enumerate(STATES[:17])}
    out["fogm_std"] = F.when(size > 17, F.sqrt(F.get(diag, F.lit(17)))).otherwise(F.lit(0.0))
    return out


def ins_errors(samples: DataFrame) -> DataFrame:
    """Inertial position against truth, in states and metres."""
    out = samples.withColumns({f"{s}_err": F.col(f"ins_{s}") - F.col(s) for s in ("lat", "lon", "alt")})
    return out.withColumns({"n_err": lat_to_north(F.col("lat_err"), F.col("ins_lat")),
                            "e_err": lon_to_east(F.col("lon_err"), F.col("ins_lat"))})


def bound_deviations(samples: DataFrame, bound: DataFrame) -> DataFrame:
    """Accuracy bound (a covariance diagonal ``p_diag`` per row) in metres."""
    df = samples.select(*KEY, "lat").join(bound, KEY)
    return df.select(*KEY, lat_to_north(F.sqrt(F.col("p_diag")[0]), F.col("lat")).alias("n_std"),
                     lon_to_east(F.sqrt(F.col("p_diag")[1]), F.col("lat")).alias("e_std"))


def filter_errors(samples: DataFrame, filter_out: DataFrame) -> DataFrame:
    """Corrected states (inertial plus estimate), their deviations, and errors
    against truth; tilt errors are taken about the inertial attitude error."""
    j = filter_out.join(samples, KEY)
    x, n = F.col("x"), F.size("x")
    state = {s: F.col(f"ins_{s}") + x[i] for i, s in enumerate(MOTION)}
    state.update({s: x[6 + i] for i, s in enumerate(STATES[6:17])})
    state["fogm"] = F.when(n > 17, F.get(x, F.lit(17))).otherwise(F.lit(0.0))
    wrong = product(elements(F.col("ins_cnb")), transpose(elements(F.col("cnb"))))
    err = {f"{s}_err": state[s] - F.col(s) for s in MOTION}
    err.update({"tn_err": state["tn"] - wrong[7], "te_err": state["te"] - wrong[2],
                "td_err": state["td"] - wrong[3]})
    out = j.select("filter", *KEY, *[c.alias(f"est_{s}") for s, c in state.items()],
                   *[c.alias(k) for k, c in deviations(F.col("p_diag"), F.size("p_diag")).items()],
                   *[c.alias(k) for k, c in err.items()])
    lat = F.col("est_lat")
    return out.withColumns({"n_std": lat_to_north(F.col("lat_std"), lat),
                            "e_std": lon_to_east(F.col("lon_std"), lat),
                            "n_err": lat_to_north(F.col("lat_err"), lat),
                            "e_err": lon_to_east(F.col("lon_err"), lat)})


def drms_by(df: DataFrame, keys: list[str], north: str = "n_err", east: str = "e_err") -> DataFrame:
    return df.groupBy(*keys).agg(drms(F.col(north), F.col(east)).alias("drms"))
