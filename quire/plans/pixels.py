"""Queries on small rasters: one of 24 by 40 pixels for each web page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import pixels as X
from quire.plans.catalog import query
from quire.sources.bridge import table

RASTER = """WITH px AS (SELECT page_id, y, x, CASE WHEN (x // 4 + y // 6 + page_id) % 3 = 0 THEN 20 + (page_id * 7 + x * 3 + y * 5) % 50 ELSE 190 + (page_id * 11 + x * 5 + y * 3) % 60 END AS v FROM pages, range(0, 24) a(y), range(0, 40) b(x)),
patch AS (SELECT page_id, seq, y, x, (seq * 40 + x) % 256 AS v FROM pages, range(1, 4) s(seq), range(0, 24) a(y), range(0, 40) b(x) WHERE x >= 4 * seq AND x < 4 * seq + 9 AND y >= 2 * seq AND y < 2 * seq + 7 AND (page_id + seq) % 2 = 0),
done AS (SELECT px.page_id, px.y, px.x, coalesce(l.v, px.v) AS v FROM px LEFT JOIN (SELECT page_id, y, x, arg_max(v, seq) AS v FROM patch GROUP BY ALL) l USING (page_id, y, x))"""


def _raster(spark, d):
    p = table(spark, d, "pages").select("page_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39))))
    y, x, k = F.col("y").cast("long"), F.col("x").cast("long"), F.col("page_id")
    dark = (F.floor(x / 4) + F.floor(y / 6) + k) % 3 == 0
    v = F.when(dark, (k * 7 + x * 3 + y * 5) % 50 + 20).otherwise((k * 11 + x * 5 + y * 3) % 60 + 190)
    return p.select("page_id", y.alias("y"), x.alias("x"), v.alias("v"))


def _patches(spark, d):
    s = _raster(spark, d).drop("v").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("seq", F.col("seq").cast("long"))
    q = F.col("seq")
    inside = (F.col("x") >= q * 4) & (F.col("x") < q * 4 + 9) & (F.col("y") >= q * 2) & (F.col("y") < q * 2 + 7) & ((F.col("page_id") + q) % 2 == 0)
    return s.where(inside).withColumn("v", (q * 40 + F.col("x")) % 256)


def _done(spark, d):
    return X.composite(_raster(spark, d), _patches(spark, d), ["page_id"])


@query(RASTER + ", h AS (SELECT page_id, v AS level, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER a AS w0, sum(n * level) OVER a AS s0, sum(n) OVER b AS w, sum(n * level) OVER b AS s FROM h WINDOW a AS (PARTITION BY page_id ORDER BY level ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY page_id)), t AS (SELECT page_id, level, ((w * s0 - w0 * s)::DOUBLE * (w * s0 - w0 * s)::DOUBLE) / (w0 * (w - w0))::DOUBLE AS between_ FROM c WHERE w > w0) SELECT page_id, level AS threshold FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY between_ DESC, level) = 1")
def otsu_threshold(spark, d):
    """A23, R1."""
    return X.otsu(_raster(spark, d), ["page_id"])


@query(RASTER + ", m AS (SELECT page_id, median(v) AS m FROM px GROUP BY page_id) SELECT page_id, median(abs(v - m)) * 1.4826::DOUBLE AS sigma FROM px JOIN m USING (page_id) GROUP BY page_id")
def median_mad_noise(spark, d):
    """A21."""
    return X.noise(_raster(spark, d), ["page_id"])


@query(RASTER + " SELECT page_id, x, count_if(v < 120)::BIGINT AS ink, sum(v)::BIGINT AS total FROM px GROUP BY page_id, x")
def column_profile(spark, d):
    """A24."""
    return _raster(spark, d).groupBy("page_id", "x").agg(F.count_if(F.col("v") < 120).alias("ink"), F.sum("v").alias("total"))


@query(RASTER + ", a AS (SELECT page_id, x, sum(v) AS v FROM px WHERE y < 12 GROUP BY ALL), b AS (SELECT page_id, x, sum(v) AS u FROM px WHERE y >= 12 GROUP BY ALL) SELECT page_id, round(corr(v, u), 6) AS r FROM a JOIN b USING (page_id, x) GROUP BY page_id")
def profile_corr(spark, d):
    """Do the upper and the lower profile agree."""
    half = F.col("y") < 12
    p = _raster(spark, d).groupBy("page_id", "x").agg(F.sum(F.when(half, F.col("v"))).alias("v"), F.sum(F.when(~half, F.col("v"))).alias("u"))
    return p.groupBy("page_id").agg(F.round(F.corr("v", "u"), 6).alias("r"))


@query(RASTER + ", i AS (SELECT page_id, y, v < 120 AS i, lag(v < 120) OVER (PARTITION BY page_id, y ORDER BY x) AS was FROM px) SELECT page_id, y, count_if(was IS NOT NULL AND i <> was)::BIGINT AS transitions, count_if(i AND NOT coalesce(was, false))::BIGINT AS runs FROM i GROUP BY ALL")
def scanline_transitions(spark, d):
    """W14, W6."""
    return X.transitions(_raster(spark, d), ["page_id", "y"], "x", F.col("v") < 120)


@query(RASTER + " SELECT page_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS ink FROM px WHERE v < 120 GROUP BY page_id")
def tight_ink_box(spark, d):
    """R17, A2 on pixels."""
    return _raster(spark, d).where("v < 120").groupBy("page_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("ink"))


@query(RASTER + ", c AS (SELECT page_id, x, min(y) AS top, max(y) AS bottom FROM px WHERE v < 120 GROUP BY ALL) SELECT page_id, quantile_cont(top, 0.05) AS top5, median(bottom) + 1 AS baseline FROM c GROUP BY page_id")
def ink_geometry(spark, d):
    """Where the ink of the columns begins and ends."""
    c = _raster(spark, d).where("v < 120").groupBy("page_id", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    return c.groupBy("page_id").agg(F.percentile("top", 0.05).alias("top5"), (F.median("bottom") + 1).alias("baseline"))


@query(RASTER + " SELECT page_id, y, x, v FROM done")
def patch_composite(spark, d):
    """The last patch wins."""
    return _done(spark, d).select("page_id", "y", "x", "v")


@query(RASTER + ", c AS (SELECT page_id, y, x FROM px JOIN done USING (page_id, y, x) WHERE px.v <> done.v) SELECT p.page_id, count(c.y) AS changed, count(c.y) / 960 AS fraction, count_if(NOT (c.x >= 8 AND c.x < 17))::BIGINT AS outside, min(c.x) AS x0, min(c.y) AS y0, max(c.x) + 1 AS x1, max(c.y) + 1 AS y1 FROM pages p LEFT JOIN c USING (page_id) GROUP BY p.page_id")
def pixel_fidelity(spark, d):
    """What changed, how much, where, and how much of it outside the allowed columns."""
    c = X.changed(_raster(spark, d), _done(spark, d), ["page_id"]).select("page_id", "y", "x")
    j = table(spark, d, "pages").select("page_id").join(c, "page_id", "left")
    n = F.count("y")
    return j.groupBy("page_id").agg(n.alias("changed"), (n / 960).alias("fraction"), F.count_if(~((F.col("x") >= 8) & (F.col("x") < 17))).alias("outside"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


@query(RASTER + " SELECT page_id, y, x, v FROM done EXCEPT ALL SELECT page_id, y, x, v FROM px")
def pixel_difference(spark, d):
    """U4."""
    return _done(spark, d).select("page_id", "y", "x", "v").exceptAll(_raster(spark, d).select("page_id", "y", "x", "v"))


@query(RASTER + ", r AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM px WHERE v < 120) SELECT page_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM r GROUP BY page_id, y, g HAVING count(*) >= 4")
def ruling_runs(spark, d):
    """Dark runs of four pixels or more along a row."""
    r = _raster(spark, d).where("v < 120").withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("page_id", "y").orderBy("x")))
    return r.groupBy("page_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.count(F.lit(1)).alias("n")).where("n >= 4").select("page_id", "y", "x0", "x1")


@query(RASTER + ", f AS (SELECT page_id, quantile_cont(v, 0.9) AS p90 FROM px GROUP BY page_id) SELECT page_id, count(*) AS faint FROM px JOIN f USING (page_id) WHERE v < least(p90 - 28, 235) GROUP BY page_id")
def faint_mask(spark, d):
    """R2: pixels darker than the paper by 28."""
    return X.faint(_raster(spark, d), ["page_id"])


@query(RASTER + " SELECT page_id, sum(v * x)::DOUBLE / sum(x * x) AS amplitude FROM px WHERE x > 0 GROUP BY page_id")
def least_squares_amplitude(spark, d):
    """A26."""
    return _raster(spark, d).where("x > 0").groupBy("page_id").agg((F.sum(F.col("v") * F.col("x")).cast("double") / F.sum(F.col("x") * F.col("x"))).alias("amplitude"))
