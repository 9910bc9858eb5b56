"""Registry of named queries with their SQL counterparts."""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``covers`` lists inventory ids."""
    def add(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(fn, sql, covers)
        return fn
    return add


def rounded(digits: int = 6, **cols: Column) -> list[Column]:
    """Named Columns rounded for comparison with another engine."""
    return [F.round(c, digits).alias(n) for n, c in cols.items()]


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL text rounding an expression; adding zero turns -0.0 into 0.0."""
    out = f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"{out} AS {name}" if name else out


# Shared subqueries of the oracles, in dependency order.
VIEWS = {
    "samples": """SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS ft, radians(yy + 30.0) AS lat,
        radians(xx - 100.0) AS lon FROM (SELECT event_id AS rn,
        'F' || CAST(event_id // 2500 AS VARCHAR) AS flight,
        (event_id // 2500) * 100 + (event_id // 100) % 10 AS line,
        (epoch_us(ts) - 1704067200000000) / 1e6 AS tt,
        CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS doy,
        user_id, event_type, value AS mag_1_uc, value * 0.9 + k / 100.0 AS mag_1_c,
        value * 1.1 + event_id % 5 AS mag_2_uc, value * 0.95 AS mag_2_c,
        (event_id % 7) / 10.0 AS diurnal, (event_id % 11) / 10.0 + 50.0 AS igrf,
        k / 10.0 AS cur_strb, value AS fx, k AS fy, CAST(event_id % 97 + 1 AS DOUBLE) AS fz,
        (event_id * 37 % 4900) / 100.0 + 1.0 AS xx, (event_id * 53 % 2400) / 100.0 + 1.0 AS yy,
        (event_id % 61 - 30) / 100.0 AS roll, (event_id % 41 - 20) / 100.0 AS pitch,
        (event_id % 628) / 100.0 - 3.14 AS yaw,
        CAST(event_id % 97 + 300 AS DOUBLE) AS alt, CAST(event_id % 19 - 9 AS DOUBLE) AS vn,
        CAST(event_id % 23 - 11 AS DOUBLE) AS ve, CAST(event_id % 3 - 1 AS DOUBLE) AS vd
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY flight, line ORDER BY rn) - 1 AS pos,
        count(*) OVER (PARTITION BY flight, line) AS n_line FROM samples""",
    "lines": """SELECT flight, line, min(tt) + (max(tt) - min(tt)) * 0.02 AS t_start,
        max(tt) - (max(tt) - min(tt)) * 0.02 AS t_end, 'parts' AS map_name
        FROM samples GROUP BY flight, line""",
    "flight_events": """SELECT flight, tt, 'Error in leg ' || CAST(line AS VARCHAR) AS event
        FROM samples WHERE event_type = 'error'""",
}


def _cells(map_id: str, level: str) -> str:
    return f"""SELECT map_id, iz, iy, ix, CAST(ix AS DOUBLE) AS xx, CAST(iy AS DOUBLE) AS yy,
        iz * 100.0 + 300.0 AS alt, val FROM (SELECT {map_id} AS map_id, CAST({level} AS BIGINT) AS iz,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS iy, CAST(p_size AS BIGINT) AS ix,
        round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS val
        FROM part GROUP BY 1, 2, 3, 4)"""


_PARITY = "CASE WHEN p_partkey % 2 = 1 THEN 'odd' ELSE 'even' END"
VIEWS["cells"] = _cells("'parts'", "0")
VIEWS["cells_parity"] = _cells(_PARITY, "0")
VIEWS["cells_type"] = _cells("p_type", "0")
VIEWS["cells_levels"] = _cells("'deep'", "p_partkey % 2")
VIEWS["tiles"] = """SELECT 't' || CAST(vec_id AS VARCHAR) AS map_id, CAST(i // 8 AS BIGINT) AS iy,
    CAST(i % 8 AS BIGINT) AS ix, CAST(embedding[i + 1] AS DOUBLE) AS val, label
    FROM embeddings, generate_series(0, 63) AS g(i)"""


NEEDS = {"numbered": ["samples"], "lines": ["samples"], "flight_events": ["samples"]}


def sql(body: str, *views: str) -> str:
    """An oracle: the needed shared subqueries, then ``body``.  A body that starts
    with a comma continues the WITH list."""
    wanted = [v for v in VIEWS if v in views or any(v in NEEDS.get(w, []) for w in views)]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {head}{body if body.lstrip().startswith(',') else chr(10) + body}"


def least_squares(view: str, xs: list[str], y: str, ridge: float = 0.0) -> str:
    """CTEs that follow ``view``: ``coef(term, value)``, the least-squares coefficients of a
    full-rank design by successive orthogonalisation.  Step k takes column k out of all
    later ones; the coefficients follow from the last backwards.  A ridge is a row per
    column below the design."""
    n = len(xs)
    cols = [*[f"c{i}" for i in range(n)], "y"]
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {name}" for c, name in zip([*xs, y], cols))
    out = [f"q0 AS MATERIALIZED (SELECT {first} FROM {view}"]
    for i in range(n if ridge else 0):
        out[0] += " UNION ALL SELECT " + ", ".join(f"{ridge ** 0.5!r}::DOUBLE" if j == i else "0.0::DOUBLE" for j in range(n + 1))
    out[0] += ")"
    for k in range(n):
        later = cols[k + 1:]
        out.append(f"p{k} AS MATERIALIZED (SELECT " + ", ".join(f"sum(c{k} * {c}) / sum(c{k} * c{k}) AS s{k}_{c}" for c in later) + f" FROM q{k})")
        out.append(f"q{k + 1} AS MATERIALIZED (SELECT " + ", ".join(f"{c} - s{k}_{c} * c{k} AS {c}" for c in later) + f" FROM q{k}, p{k})")
    steps = "all_steps AS (SELECT * FROM " + ", ".join(f"p{k}" for k in range(n)) + ")"
    out.append(steps)
    name = "all_steps"
    for k in reversed(range(n)):
        rest = "".join(f" - s{k}_c{j} * b{j}" for j in range(k + 1, n))
        out.append(f"b_{k} AS (SELECT *, s{k}_y{rest} AS b{k} FROM {name})")
        name = f"b_{k}"
    terms = " UNION ALL ".join(f"SELECT {i} AS idx, '{x}' AS term, b{i} AS value FROM {name}" for i, x in enumerate(xs))
    out.append(f"coef AS MATERIALIZED ({terms})")
    return ", " + ", ".join(out) + " "
