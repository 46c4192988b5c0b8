"""Queries on rules with constants: acceptance tests, limits, lists, neighbours of bars and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import lines as L
from quire.operators import spatial
from quire.plans.catalog import query
from quire.plans.edits import EDITS, _edits
from quire.plans.layout import BARS, _bars, _boxed
from quire.plans.lines import LINES_SQL
from quire.sources.bridge import WORDS_SQL, table, words

# Names an archive of a project may hold.
MEMBERS = ("manifest.json", "source.bin", "meta.json", "edits.json", "analysis.json", "canvas.png", "original.png", "ocr_input.png")


@query(LINES_SQL + ", q AS (SELECT doc_id, line_no, x0 + 0.25::DOUBLE AS a, x1 - 0.25::DOUBLE AS b, y0 + line_no % 4 * 0.5::DOUBLE AS c, y1 + line_no % 3 * 0.5::DOUBLE AS d FROM lines) SELECT doc_id, line_no, floor(least(a, b))::BIGINT AS x0, floor(least(c, d))::BIGINT AS y0, ceil(greatest(a, b))::BIGINT AS x1, ceil(greatest(c, d))::BIGINT AS y1 FROM q")
def quad_boxes(spark, d):
    """Boxes of quads, whose points are put in order first."""
    a, b = F.col("x0") + 0.25, F.col("x1") - 0.25
    c, e = F.col("y0") + F.col("line_no") % 4 * 0.5, F.col("y1") + F.col("line_no") % 3 * 0.5
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(b, e), point(a, c), point(a, e), point(b, c))
    t = L.lines(words(spark, d)).select("doc_id", "line_no", G.of_points(G.order_quad(quad)).alias("q"))
    return t.select("doc_id", "line_no", "q.x0", "q.y0", "q.x1", "q.y1")


@query(LINES_SQL + BARS + " SELECT l.doc_id, l.line_no, l.text FROM lines l JOIN bars USING (doc_id) WHERE n_words <= 3 AND 2 * (least(x1, bx1) - greatest(x0, bx0)) > x1 - x0 AND (y0 - by1 BETWEEN 0 AND 54 OR by0 - y1 BETWEEN 0 AND 54)")
def barcode_captions(spark, d):
    """Short lines just above or below a bar that lie to more than half beside it."""
    band = F.col("b")
    # the bar grown by 0.6 of its height meets every line that can qualify
    near = _bars(spark, d).withColumn("bar", band).withColumn("b", G.box(band["x0"], band["y0"] - 55, band["x1"], band["y1"] + 55))
    p = spatial.overlap_join(_boxed(L.lines(words(spark, d))).where("n_words <= 3"), near, ["doc_id"])
    bar, a = F.col("bar"), F.col("a")
    side = (F.least(a["x1"], bar["x1"]) - F.greatest(a["x0"], bar["x0"])) * 2 > G.width(a)
    return p.where(side & ((a["y0"] - bar["y1"]).between(0, 54) | (bar["y0"] - a["y1"]).between(0, 54))).select("doc_id", "line_no", "text")


@query(LINES_SQL + ", r AS (SELECT doc_id, line_no AS rule_no, x0 AS rx0, x0 + 400 AS rx1, y0 + line_no % 30 AS ry FROM lines WHERE line_no % 6 = 0) SELECT doc_id, rule_no FROM r WHERE rx1 - rx0 < 1164 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = r.doc_id AND w.x0 < rx1 AND rx0 < w.x1 AND ry >= w.y0 + 5 AND ry < w.y1 - 5)")
def faint_rulings(spark, d):
    """rules that do not run through the middle half of a word."""
    w = words(spark, d)
    y = F.col("y0") + F.col("line_no") % 30
    r = L.lines(w).where("line_no % 6 = 0").select("doc_id", F.col("line_no").alias("rule_no"), G.box(F.col("x0"), y, F.col("x0") + 400, y + 1).alias("a"))
    core = w.select("doc_id", G.box(F.col("x0"), F.col("y0") + 5, F.col("x1"), F.col("y1") - 5).alias("b"))
    hit = spatial.overlap_join(r, core, ["doc_id"]).select("doc_id", "rule_no")
    return r.where(G.width(F.col("a")) < 1164).join(hit, ["doc_id", "rule_no"], "left_anti").select("doc_id", "rule_no")


@query("WITH l AS (SELECT user_id, event_type, max(ts) AS ts, max(event_id) AS event_id FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::BIGINT AS place FROM l) SELECT user_id, event_type, place, place <= 6 AS shown FROM k WHERE place <= 10")
def recent_list(spark, d):
    """Distinct, newest first, ten kept and six shown."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")
    return last.withColumn("place", place).where("place <= 10").select("user_id", "event_type", "place", (F.col("place") <= 6).alias("shown"))


@query(LINES_SQL + " SELECT doc_id, line_no FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 500")
def rulings_limit(spark, d):
    """T5."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return L.lines(words(spark, d)).withColumn("k", k).where("k <= 500").select("doc_id", "line_no")


@query(LINES_SQL + " SELECT DISTINCT doc_id, line_no // 1000 AS page FROM lines WHERE line_no // 1000 < 60")
def first_pages(spark, d):
    """60 pages at most."""
    return words(spark, d).select("doc_id", F.floor(F.col("line_no") / 1000).alias("page")).distinct().where("page < 60")


@query(LINES_SQL + ", k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY x1 - x0, line_no) - 1 AS k FROM lines) SELECT doc_id, line_no, (k // 8)::BIGINT AS batch FROM k")
def length_batches(spark, d):
    """Batches of eight lines of about the same width."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("x1") - F.col("x0"), "line_no")) - 1
    return L.lines(words(spark, d)).select("doc_id", "line_no", F.floor(k / 8).alias("batch"))


@query(WORDS_SQL + EDITS + ", touched AS (SELECT DISTINCT doc_id, line_no FROM edits WHERE NOT disabled) SELECT doc_id, line_no, word_no, x0 + s AS x0, x1 + s AS x1, y0, y1, s > 0 AS moved FROM words JOIN touched USING (doc_id, line_no), (VALUES (0), (1)) v(k), LATERAL (SELECT k * (10 + word_no % 3 * 5) AS s)")
def moved_words(spark, d):
    """Words of the lines that edits change, at their old and new places."""
    w = words(spark, d)
    w = w.join(_edits(w).where("not disabled").select("doc_id", "line_no").distinct(), ["doc_id", "line_no"])
    s = w.withColumn("s", F.explode(F.array(F.lit(0).cast("long"), F.col("word_no") % 3 * 5 + 10)))
    return s.select("doc_id", "line_no", "word_no", (F.col("x0") + F.col("s")).alias("x0"), (F.col("x1") + F.col("s")).alias("x1"), "y0", "y1", (F.col("s") > 0).alias("moved"))


@query(LINES_SQL + " SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) // 2 // 6, x0, line_no)::BIGINT - 1 AS position FROM lines WHERE x1 - x0 >= 3 AND y1 - y0 >= 3")
def drawn_regions(spark, d):
    """Regions of three pixels or more, by rows of a third of their height, then from the left."""
    row = F.floor(F.floor((F.col("y0") + F.col("y1")) / 2) / 6)
    t = L.lines(words(spark, d)).where("x1 - x0 >= 3 and y1 - y0 >= 3")
    return t.select("doc_id", "line_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy(row, "x0", "line_no")).cast("long") - 1).alias("position"))


QUADS = "q AS (SELECT page_id, page_id * 13 % 100 AS area_pct, page_id * 7 % 5 AS near_edge FROM pages)"


@query(f"WITH {QUADS} SELECT page_id, area_pct >= 15 AND NOT (area_pct > 93) AND near_edge < 3 AS accepted, CASE WHEN area_pct < 15 OR near_edge >= 3 THEN 0.4::DOUBLE WHEN area_pct > 93 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM q")
def page_quad_acceptance(spark, d):
    """a page outline that is large enough, not the whole image, and with corners inside."""
    q = table(spark, d, "pages").select("page_id", (F.col("page_id") * 13 % 100).alias("area"), (F.col("page_id") * 7 % 5).alias("edge"))
    small = (F.col("area") < 15) | (F.col("edge") >= 3)
    whole = F.col("area") > 93
    return q.select("page_id", (~small & ~whole).alias("accepted"), F.when(small, 0.4).when(whole, 0.5).otherwise(0.9).alias("confidence"))


@query(LINES_SQL + ", a AS (SELECT doc_id, (x1 * 31 + line_no * 7) % 900 - 450 AS angle FROM lines WHERE x1 - x0 >= 36) SELECT doc_id, count(*) AS n, median(angle) / 100 AS skew, count(*) >= 3 AND abs(median(angle)) > 25 AS turned FROM a GROUP BY doc_id")
def skew_angles(spark, d):
    """The median angle of lines that are long for their height, used from three lines and a quarter of a degree on."""
    a = L.lines(words(spark, d)).where("x1 - x0 >= 36").select("doc_id", ((F.col("x1") * 31 + F.col("line_no") * 7) % 900 - 450).alias("angle"))
    n, m = F.count(F.lit(1)), F.median("angle")
    return a.groupBy("doc_id").agg(n.alias("n"), (m / 100).alias("skew"), ((n >= 3) & (F.abs(m) > 25)).alias("turned"))


@query(LINES_SQL + ", p AS (SELECT doc_id, line_no, y0 % 2000 AS y FROM lines) SELECT doc_id, line_no, round(12 / (1 + exp(-(y - 1000) / 90.0::DOUBLE)) + 3 * sin(y / 200.0::DOUBLE), 6) AS shift FROM p")
def fold_displacement(spark, d):
    """How far a fold moves a row of pixels."""
    y = F.col("y0") % 2000
    return L.lines(words(spark, d)).select("doc_id", "line_no", F.round(F.lit(12) / (F.lit(1) + F.exp(-(y - 1000) / 90.0)) + F.sin(y / 200.0) * 3, 6).alias("shift"))


@query("WITH n AS (SELECT page_id, [" + ", ".join(f"'{m}'" for m in (*MEMBERS, "../../etc/passwd", "notes.txt")) + "][1 + page_id % 10] AS name FROM pages) SELECT page_id, name FROM n WHERE name IN (" + ", ".join(f"'{m}'" for m in MEMBERS) + ")")
def archive_members(spark, d):
    """The members of an archive that may be read."""
    names = F.array(*[F.lit(m) for m in (*MEMBERS, "../../etc/passwd", "notes.txt")])
    n = table(spark, d, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 10 + 1).cast("int")).alias("name"))
    return n.join(F.broadcast(spark.createDataFrame([(m,) for m in MEMBERS], "name string")), "name", "left_semi").select("page_id", "name")


@query(LINES_SQL + ", t AS (SELECT doc_id, min(y0) + 100 AS rule FROM lines GROUP BY doc_id) SELECT w.doc_id, w.line_no, w.word_no, w.y1 <= rule AS header FROM words w JOIN t USING (doc_id) WHERE w.y1 <= rule AND w.y1 > rule - 40 OR w.y0 >= rule AND w.y0 < rule + 200")
def table_words(spark, d):
    """Words just above a table's first rule, and inside it."""
    w = words(spark, d)
    t = w.groupBy("doc_id").agg((F.min("y0") + 100).alias("rule"))
    above = (F.col("y1") <= F.col("rule")) & (F.col("y1") > F.col("rule") - 40)
    inside = (F.col("y0") >= F.col("rule")) & (F.col("y0") < F.col("rule") + 200)
    return w.join(t, "doc_id").where(above | inside).select("doc_id", "line_no", "word_no", (F.col("y1") <= F.col("rule")).alias("header"))
