"""Queries on ordered runs: words of a line, events of a user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import segments as S
from quire.plans.catalog import query
from quire.sources.bridge import WORDS_SQL, table, words

EVENTS = "e AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


@query(f"""WITH {EVENTS}, i AS (SELECT user_id, event_id, t, t + 3600 + event_id % 7200 AS t1 FROM e),
g AS (SELECT *, max(t1) OVER w AS reach FROM i WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR t - reach >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seg FROM g)
SELECT user_id, seg, min(t) AS t, max(t1) AS t1, count(*) AS n FROM s GROUP BY ALL""")
def interval_coalesce(spark, d):
    """W2."""
    i = _events(spark, d).select("user_id", "event_id", "t", (F.col("t") + 3600 + F.col("event_id") % 7200).alias("t1"))
    return S.coalesce_intervals(i, ["user_id"], "t", "t1", 1, ["event_id"])


@query(WORDS_SQL + """, a AS (SELECT *, x0 + (doc_id + word_no * 5) % 7 * 4 AS a0, x1 + (doc_id + word_no * 5) % 7 * 4 - 4 AS a1 FROM words),
g AS (SELECT *, a0 - max(a1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM a),
m AS (SELECT doc_id, line_no, median(gap) AS med FROM g GROUP BY ALL),
p AS (SELECT g.*, sum(CASE WHEN gap >= greatest(5.4, 2.5 * med) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM g JOIN m USING (doc_id, line_no))
SELECT doc_id, line_no, part, count(*) AS n, min(a0) AS a0, max(a1) AS a1 FROM p GROUP BY ALL""")
def gap_split_words(spark, d):
    """Parts of a line where the gap is wide for the line."""
    jitter = (F.col("doc_id") + F.col("word_no") * 5) % 7 * 4
    a = words(spark, d).select("doc_id", "line_no", "word_no", (F.col("x0") + jitter).alias("a0"), (F.col("x1") + jitter - 4).alias("a1"))
    g = S.gaps(a, ["doc_id", "line_no"], "a0", "a1", ["word_no"])
    med = F.median("gap").over(Window.partitionBy("doc_id", "line_no"))
    g = g.withColumn("med", med)
    p = S.split_at(g, ["doc_id", "line_no"], ["word_no"], F.col("gap") >= F.greatest(F.lit(5.4), F.col("med") * 2.5), "part")
    return p.groupBy("doc_id", "line_no", "part").agg(F.count(F.lit(1)).alias("n"), F.min("a0").alias("a0"), F.max("a1").alias("a1"))


@query(WORDS_SQL + """, x AS (SELECT DISTINCT doc_id, x0 FROM words), g AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0) AS gap FROM x),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0 ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
SELECT doc_id, cluster, min(x0) AS lo, max(x0) AS hi, count(*) AS n FROM c GROUP BY ALL""")
def cluster_1d(spark, d):
    """Values no farther apart than a tolerance from the last member."""
    x = words(spark, d).select("doc_id", "x0").distinct()
    g = S.gaps(x, ["doc_id"], "x0", "x0", ["x0"])
    c = S.split_at(g, ["doc_id"], ["x0"], F.col("gap").isNull() | (F.col("gap") > 10), "cluster")
    return c.groupBy("doc_id", "cluster").agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, t, event_id, value > 50 AS up, lag(value > 50) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM e)
SELECT user_id, count_if(up AND NOT coalesce(was, false))::BIGINT AS runs, count_if(was IS NOT NULL AND up <> was)::BIGINT AS transitions FROM f GROUP BY user_id""")
def run_count(spark, d):
    """Rising edges and transitions."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = _events(spark, d).select("user_id", (F.col("value") > 50).alias("up"), F.lag(F.col("value") > 50).over(w).alias("was"))
    return f.groupBy("user_id").agg(F.count_if(F.col("up") & ~F.coalesce("was", F.lit(False))).alias("runs"), F.count_if(F.col("was").isNotNull() & (F.col("up") != F.col("was"))).alias("transitions"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_type, event_id * 37 % 100 AS c, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM e),
g AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS was FROM o),
r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g)
SELECT user_id, run, any_value(event_type) AS event_type, max(c) AS conf, min(step)::BIGINT AS at FROM r WHERE event_type <> 'view' GROUP BY ALL""")
def ctc_collapse(spark, d):
    """Runs of equal symbols with their most confidence, the blank ('view') left out."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    o = _events(spark, d).select("user_id", "event_type", F.row_number().over(w).cast("long").alias("step"), (F.col("event_id") * 37 % 100).alias("conf"))
    return S.collapse_runs(o, ["user_id"], "step", "event_type", "conf", "view")


@query(WORDS_SQL + """, k AS (SELECT doc_id, line_no, word_no, CASE WHEN (doc_id + line_no + word_no) % 3 <> 1 THEN x0 END AS v FROM words),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN word_no END IGNORE NULLS) OVER p AS bi, last_value(v IGNORE NULLS) OVER p AS bv, first_value(CASE WHEN v IS NOT NULL THEN word_no END IGNORE NULLS) OVER f AS ai, first_value(v IGNORE NULLS) OVER f AS av FROM k
 WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc_id, line_no, word_no, CASE WHEN v IS NOT NULL THEN v::DOUBLE WHEN bi IS NULL THEN av::DOUBLE WHEN ai IS NULL THEN bv::DOUBLE ELSE bv + ((av - bv) * (word_no - bi))::DOUBLE / (ai - bi) END AS filled FROM b""")
def interp_positions(spark, d):
    """W10."""
    k = words(spark, d).select("doc_id", "line_no", "word_no", F.when((F.col("doc_id") + F.col("line_no") + F.col("word_no")) % 3 != 1, F.col("x0")).alias("v"))
    return S.interpolate(k, ["doc_id", "line_no"], "word_no", "v").select("doc_id", "line_no", "word_no", F.col("filled").cast("double").alias("filled"))


@query(WORDS_SQL + " SELECT doc_id, line_no, word_no, off AS start, off + length(word) AS \"end\" FROM wo")
def text_offsets(spark, d):
    """W11."""
    return S.spans(words(spark, d), ["doc_id", "line_no"], ["word_no"], "word").select("doc_id", "line_no", "word_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(WORDS_SQL + """, c AS (SELECT DISTINCT doc_id, y0, y1 FROM words), g AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id ORDER BY y0) AS next FROM c)
SELECT doc_id, y1 AS band0, next AS band1 FROM g WHERE next - y1 > 54""")
def whitespace_bands(spark, d):
    """Empty bands higher than three text lines."""
    c = words(spark, d).select("doc_id", "y0", "y1").distinct()
    g = c.withColumn("next", F.lead("y0").over(Window.partitionBy("doc_id").orderBy("y0")))
    return g.where(F.col("next") - F.col("y1") > 54).select("doc_id", F.col("y1").alias("band0"), F.col("next").alias("band1"))


@query(WORDS_SQL + """, i AS (SELECT doc_id, line_no // 1000 AS page, x0, x1, line_no, word_no FROM words WHERE word_no % 3 = 0),
g AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, line_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach >= 18 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, line_no, word_no ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seg FROM g)
SELECT doc_id, page, seg, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY ALL""")
def column_ranges(spark, d):
    """Coverage runs of a page, gaps below an em bridged."""
    i = words(spark, d).where("word_no % 3 = 0").select("doc_id", F.floor(F.col("line_no") / 1000).alias("page"), "x0", "x1", "line_no", "word_no")
    return S.coalesce_intervals(i, ["doc_id", "page"], "x0", "x1", 18, ["line_no", "word_no"])


@query(f"WITH {EVENTS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e) SELECT user_id, event_id, 'p' || user_id || '-l' || (k - 1) AS line_id FROM r")
def row_ids(spark, d):
    """W12."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return _events(spark, d).select("user_id", "event_id", F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("-l"), (F.row_number().over(w) - 1).cast("string")).alias("line_id"))
