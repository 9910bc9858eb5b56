"""Source mixing to target weights by Pareto order sampling."""
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerofield.llm.common import WORD, fresh, uniform
from aerofield.session import materialized

# Fixed values of the mix: weights by source order, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BIN_ROWS = 2_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``.

    Sources in code point order (null last) weigh ``weights``, repeating.  A target
    stops at ``most`` times its source; what is over goes to the others by weight, in
    rounds over the source table until none is above.  Only four sums come back."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0][0], x[0][1], weights[x[1] % len(weights)]))
    table = materialized(sizes.sparkSession.createDataFrame(
        numbered, f"source {sizes.schema['source'].dataType.simpleString()}, source_size long, weight long"), "sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > most * F.col("source_size") if capped >= 0 else F.lit(False)
        n, whole, held, free = table.agg(
            F.count(F.when(over, 1)), F.sum("source_size"), F.sum(F.when(over, most * F.col("source_size"))),
            F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * whole - (held or 0)) / free
    return table.select("source", "source_size", F.least(
        F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")).alias("target"))


def _columns(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> list[Column]:
    return [words_in(F.col(text)).alias("size"), F.col(source).alias("source"), uniform(seed, F.col(doc_id)).alias("u")]


def _order(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, mapped to (0, 1) without changing their order."""
    q = (u / (1 - u)) / F.nullif(p / (1 - p), F.lit(0.0))
    return q / (1 + q)


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 6) -> DataFrame:
    """One row per source: source, source_size, target, whole (certain copies of each
    of its documents), p (inclusion probability beyond them) and cut (a document is
    taken once more if its order value is at most this; null: none is).

    The sample ends at the document that brings the source's words nearest to its
    target, so its size is fixed by words instead of by rows.  The cut is found in two
    steps: sums over bins of the order value, then a running sum inside the one bin
    that the target falls in.  Documents of equal draw stand or fall together."""
    rows = materialized(docs.select(*_columns(docs, doc_id, source, text, seed)), "sizes")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = materialized(
        targets(rows).withColumn("whole", F.floor(share).cast("long")).withColumn("p", share - F.col("whole"))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    bins = max(1, math.ceil(rows.count() / BIN_ROWS))
    drawn = (rows.where("size > 0").join(goals.where("p > 0").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
             .select("source", "size", "quota", _order(F.col("u"), F.col("p")).alias("z"))
             .withColumn("bin", F.floor(F.col("z") * bins).cast("long")))
    sums = materialized(drawn.groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.max("z").alias("top"), F.first("quota").alias("quota")), "bins")
    order = Window.partitionBy("source").orderBy("bin")
    steps = sums.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    hit = materialized(steps.where("before < quota AND upto >= quota").select(
        F.col("source").alias("of"), F.col("bin").alias("at"), "before"), "hits")
    full = steps.where("upto < quota").groupBy("source").agg(F.max("top").alias("cut"))
    inside = drawn.join(hit, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")))
    run = Window.partitionBy("source").orderBy("z").rangeBetween(Window.unboundedPreceding, 0)
    tie = Window.partitionBy("source", "z")
    near = (inside.withColumn("upto", F.col("before") + F.sum("size").over(run))
            .withColumn("less", F.col("upto") - F.sum("size").over(tie))
            .where("upto + less <= 2 * quota").groupBy("source").agg(F.max("z").alias("cut")))
    cuts = full.unionByName(near).groupBy("source").agg(F.max("cut").alias("cut")).withColumnRenamed("source", "of")
    return materialized(goals.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "whole", "p", "cut"), "mix")


def copies() -> Column:
    """How often a document is taken, given its draw ``u`` and its source's plan."""
    more = (F.col("p") > 0) & (_order(F.col("u"), F.col("p")) <= F.col("cut"))
    return F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def taken(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take nothing; null sources are one source of
    their own; rows of one doc_id have one draw.  An empty table gives an empty mix."""
    goal = plan(docs, doc_id, source, text, seed).withColumnRenamed("source", "of")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_columns(docs, doc_id, source, text, seed))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies()).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 6) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say."""
    goal = plan(docs, doc_id, source, text, seed)
    own = {c: fresh(docs.columns, f"mix_{c}") for c in ("source", "source_size", "target", "whole", "p", "cut")}
    goal = goal.select(*[F.col(c).alias(n) for c, n in own.items()])
    draw = uniform(seed, F.col(doc_id))
    more = (F.col(own["p"]) > 0) & (_order(draw, F.col(own["p"])) <= F.col(own["cut"]))
    times = F.col(own["whole"]) + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    copy = fresh([*docs.columns, *own.values()], "copy")
    return (docs.join(goal, F.col(source).eqNullSafe(F.col(own["source"])))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns))


SQL = """WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS size,
    (CAST('0x' || substr(md5('6:' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio, (SELECT sum(source_size) FROM w) AS whole FROM w),
c AS (SELECT ratio, (CAST(1.5 * whole AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
l AS (SELECT min_by(level, ratio) AS level FROM c WHERE level <= ratio),
t AS (SELECT source, source_size, least(weight * CAST(level AS DOUBLE), CAST(2 * source_size AS DOUBLE)) AS target FROM w, l),
g AS (SELECT *, CAST(floor(target / source_size) AS BIGINT) AS n, target / source_size - floor(target / source_size) AS p,
    target - floor(target / source_size) * source_size AS quota FROM t WHERE source_size > 0),
z AS (SELECT d.doc_id, d.source, d.size, g.quota, g.p,
    ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) AS z
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE p > 0 AND size > 0),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY z RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY source, z) AS tie FROM z),
x AS (SELECT source, max(z) AS cut FROM k WHERE 2 * upto - tie <= 2 * quota GROUP BY source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
  CAST(d.size * (coalesce(g.n, 0) + CASE WHEN g.p > 0 AND ((d.u / (1 - d.u)) / (g.p / (1 - g.p))) / (1 + (d.u / (1 - d.u)) / (g.p / (1 - g.p))) <= x.cut
    THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
  LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source"""


def query(docs: DataFrame) -> DataFrame:
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken")
