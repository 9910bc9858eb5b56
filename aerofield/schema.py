"""Table layouts."""
from pyspark.sql import types as T

VECTOR = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "t")])
MATRIX = T.ArrayType(T.DoubleType())

SCALAR_MAGS = [f"mag_{i}_{k}" for k in ("c", "uc") for i in range(1, 7)]
VECTOR_MAGS = ["flux_a", "flux_b", "flux_c", "flux_d"]
MOTION = ["lat", "lon", "alt", "vn", "ve", "vd", "fn", "fe", "fd"]
INS = ["ins_lat", "ins_lon", "ins_alt", "ins_vn", "ins_ve", "ins_vd"]


def samples_schema(currents: tuple[str, ...] = (), voltages: tuple[str, ...] = ()) -> T.StructType:
    """One row per time step; absent sensors are null, so every flight kind fits."""
    num = lambda names: [T.StructField(n, T.DoubleType()) for n in names]
    return T.StructType([
        T.StructField("flight", T.StringType()), T.StructField("line", T.DoubleType()),
        T.StructField("rn", T.LongType()), *num(["tt", *MOTION]), T.StructField("cnb", MATRIX),
        *num(INS), T.StructField("ins_cnb", MATRIX), T.StructField("year", T.IntegerType()),
        T.StructField("doy", T.IntegerType()), *num(["diurnal", "igrf", *SCALAR_MAGS]),
        *[T.StructField(v, VECTOR) for v in VECTOR_MAGS],
        *num([f"cur_{c}" for c in currents]), *num([f"vol_{v}" for v in voltages])])


MAP_CELLS = T.StructType([
    T.StructField("map_id", T.StringType()), T.StructField("iz", T.LongType()),
    T.StructField("iy", T.LongType()), T.StructField("ix", T.LongType()),
    T.StructField("xx", T.DoubleType()), T.StructField("yy", T.DoubleType()),
    T.StructField("alt", T.DoubleType()), T.StructField("val", T.DoubleType()),
    T.StructField("mask", T.BooleanType())])

COEF = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("idx", T.IntegerType()), T.StructField("value", T.DoubleType()),
    T.StructField("bias", T.DoubleType()), T.StructField("scale", T.DoubleType())])
