"""Queries on detections, cells, bars, graphics, look-ups by id, style candidates, exports and the undo history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import detections as D
from quire.operators import lines as L
from quire.operators import pixels as X
from quire.operators import spatial
from quire.plans.catalog import query
from quire.plans.edits import EDITS, _edits
from quire.plans.layout import BARS, _bars, _boxed
from quire.plans.lines import LINES_SQL
from quire.plans.pixels import RASTER, _done, _raster
from quire.sources.bridge import WORDS_SQL, table, words

# Fixed values.
MODES, FORMATS = ("full", "fast", "manual"), ("pdf", "png", "jpg", "project")


@query("WITH p AS (SELECT page_id, lower(lpad(to_hex(page_id * 7919), 12, '0')) AS id, url FROM pages), r AS (SELECT page_id % 4 AS k, CASE page_id % 4 WHEN 0 THEN id WHEN 1 THEN '../' || id WHEN 2 THEN upper(id) || 'X' ELSE 'ffffffffffff' END AS asked FROM p) SELECT r.asked, p.page_id, CASE WHEN NOT regexp_matches(asked, '^[0-9a-f]{12}$') THEN 'bad_id' WHEN p.page_id IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM r LEFT JOIN p ON r.asked = p.id AND regexp_matches(asked, '^[0-9a-f]{12}$')")
def point_lookups(spark, d):
    """Projects by ids that have the form of one."""
    ident = F.lower(F.lpad(F.hex(F.col("page_id") * 7919), 12, "0"))
    p = table(spark, d, "pages").select("page_id", ident.alias("id"))
    k = F.col("page_id") % 4
    r = p.select(F.when(k == 0, F.col("id")).when(k == 1, F.concat(F.lit("../"), F.col("id"))).when(k == 2, F.concat(F.upper("id"), F.lit("X"))).otherwise("ffffffffffff").alias("asked"))
    form = F.col("asked").rlike("^[0-9a-f]{12}$")
    j = r.withColumn("id", F.when(form, F.col("asked"))).join(p, "id", "left")
    return j.select("asked", "page_id", F.when(~form, "bad_id").when(F.col("page_id").isNull(), "not_found").otherwise("ok").alias("status"))


@query(LINES_SQL + EDITS + ", w AS (SELECT 'p' || doc_id || '-l' || line_no || '-w' || word_no AS id, 'p' || doc_id || '-l' || line_no AS line_id, word FROM words), l AS (SELECT 'p' || doc_id || '-l' || line_no AS line_id, text FROM lines), t AS (SELECT edit_id, 'p' || substr(edit_id, 2, strpos(edit_id, '-') - 2) || '-l' || line_no || '-w' || (word_no + k) AS id FROM edits, (VALUES (0), (1)) v(k)) SELECT t.edit_id, t.id, w.word, w.line_id, l.text FROM t LEFT JOIN w USING (id) LEFT JOIN l USING (line_id)")
def id_lookups(spark, d):
    """The words that edits name by id, and the lines these are in; null where there is none."""
    ident = lambda *c: F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("-l"), F.col("line_no").cast("string"), *c)
    w = words(spark, d)
    named = w.select(ident(F.lit("-w"), F.col("word_no").cast("string")).alias("id"), ident().alias("line_id"), "word")
    lines = L.lines(w).select(ident().alias("line_id"), "text")
    e = _edits(w).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    t = e.select("edit_id", ident(F.lit("-w"), (F.col("word_no") + F.col("k")).cast("string")).alias("id"))
    return t.join(named, "id", "left").join(lines, "line_id", "left").select("edit_id", "id", "word", "line_id", "text")


@query(WORDS_SQL + EDITS + ", e AS (SELECT doc_id, edit_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no)::BIGINT AS seq FROM edits WHERE NOT disabled), p AS (SELECT doc_id, seq, edit_id AS by_id, 'patch-' || edit_id AS patch FROM e WHERE seq % 3 > 0) SELECT e.edit_id, p.patch, q.patch AS by_id FROM e LEFT JOIN p ON e.doc_id = p.doc_id AND e.seq = p.seq LEFT JOIN p q ON q.by_id = e.edit_id")
def edit_patches(spark, d):
    """The patch of an edit, by its place in the page's list and by the edit's id."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "word_no")).cast("long")
    e = _edits(words(spark, d)).where("not disabled").select("doc_id", "edit_id", seq.alias("seq"))
    p = e.where("seq % 3 > 0").select("doc_id", "seq", F.concat(F.lit("patch-"), F.col("edit_id")).alias("patch"))
    q = e.where("seq % 3 > 0").select("edit_id", F.concat(F.lit("patch-"), F.col("edit_id")).alias("by_id"))
    return e.join(p, ["doc_id", "seq"], "left").join(q, "edit_id", "left").select("edit_id", "patch", "by_id")


@query(WORDS_SQL + ", c AS (SELECT doc_id, line_no, word_no, (conf_pct / 100.0)::DOUBLE AS score, 3 + word_no % 4 AS points, (x1 - x0) // 10 AS w, 1 + (line_no + word_no) % 18 AS h FROM words) SELECT doc_id, line_no, word_no FROM c WHERE points >= 4 AND least(w, h) >= 2 AND score >= 0.55::DOUBLE AND least(w, h) + 2 * (w * h * 1.6::DOUBLE / (2 * (w + h))) >= 5")
def detection_filter(spark, d):
    """F1."""
    c = words(spark, d).select("doc_id", "line_no", "word_no", (F.col("conf_pct") / 100.0).alias("score"), (F.col("word_no") % 4 + 3).alias("points"), F.floor((F.col("x1") - F.col("x0")) / 10).alias("w"), ((F.col("line_no") + F.col("word_no")) % 18 + 1).alias("h"))
    return c.where(D.is_text(F.col("score"), F.col("points"), F.col("w"), F.col("h"))).select("doc_id", "line_no", "word_no")


def _scales(spark, d):
    """Every second word as found at the full size, every third, moved, as found at the small one; neither overlap among themselves."""
    w = words(spark, d).select("doc_id", (F.col("line_no") * 12 + F.col("word_no")).alias("ord"), "word_no", "x0", "y0", "x1", "y1")
    box = ["doc_id", "ord", "x0", "y0", "x1", "y1"]
    s = F.col("word_no") % 5 * 2
    return w.where("word_no % 2 = 0").select(*box), w.where("word_no % 3 = 0").select("doc_id", "ord", (F.col("x0") - s).alias("x0"), "y0", (F.col("x1") - s).alias("x1"), "y1")


@query(WORDS_SQL + ", a AS (SELECT doc_id, line_no, line_no * 12 + word_no AS ord, x0, x1 FROM words WHERE word_no % 2 = 0), b AS (SELECT doc_id, line_no, line_no * 12 + word_no AS ord, x0 - word_no % 5 * 2 AS x0, x1 - word_no % 5 * 2 AS x1 FROM words WHERE word_no % 3 = 0), hit AS (SELECT DISTINCT b.doc_id, b.ord FROM a JOIN b USING (doc_id, line_no) WHERE 4 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= least(a.x1 - a.x0, b.x1 - b.x0)) SELECT doc_id, 0::BIGINT AS scale, ord FROM a UNION ALL SELECT doc_id, 1, ord FROM b WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = b.doc_id AND hit.ord = b.ord)")
def two_scale_detections(spark, d):
    """J2."""
    return D.two_scales(*_scales(spark, d), "doc_id")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), i AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM l) SELECT doc_id, n::BIGINT AS text_line FROM i WHERE regexp_matches(line, '\\S')")
def filled_lines(spark, d):
    """lines with a character."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return t.where(F.col("line").rlike("\\S")).select("doc_id", F.col("n").cast("long").alias("text_line"))


@query("WITH r AS (SELECT event_id, ['full', 'fast', 'manual', 'slow'][1 + event_id % 4] AS mode, ['pdf', 'png', 'jpg', 'project', 'gif'][1 + event_id % 5] AS format, event_id % 7 <> 0 AS ready FROM events) SELECT CASE WHEN mode NOT IN ('full', 'fast', 'manual') THEN 'bad_mode' ELSE 'ok' END AS analyze, CASE WHEN NOT ready THEN 'not_ready' WHEN format NOT IN ('pdf', 'png', 'jpg', 'project') THEN 'bad_format' ELSE 'ok' END AS export, count(*) AS n FROM r GROUP BY ALL")
def request_guards(spark, d):
    """modes and formats there are, and no export before a document is ready."""
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    r = table(spark, d, "events").select(pick(4, *MODES, "slow").alias("mode"), pick(5, *FORMATS, "gif").alias("format"), (F.col("event_id") % 7 != 0).alias("ready"))
    return r.groupBy(F.when(F.col("mode").isin(*MODES), "ok").otherwise("bad_mode").alias("analyze"), F.when(~F.col("ready"), "not_ready").when(F.col("format").isin(*FORMATS), "ok").otherwise("bad_format").alias("export")).agg(F.count(F.lit(1)).alias("n"))


@query(WORDS_SQL + EDITS + ", whole AS (SELECT DISTINCT doc_id, line_no FROM words WHERE line_no % 11 = 5), t AS (SELECT doc_id, line_no, word_no, word FROM words w WHERE line_no % 6 <> 1 AND NOT EXISTS (SELECT 1 FROM whole x WHERE x.doc_id = w.doc_id AND x.line_no = w.line_no) AND NOT EXISTS (SELECT 1 FROM edits e WHERE e.doc_id = w.doc_id AND e.line_no = w.line_no AND e.word_no = w.word_no)) SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY word_no) AS text FROM t GROUP BY ALL")
def replaceable_lines(spark, d):
    """what find and replace may search: lines neither locked (every sixth) nor edited as a whole, without their edited words."""
    w = words(spark, d)
    whole = w.where("line_no % 11 = 5").select("doc_id", "line_no").distinct()
    t = w.where("line_no % 6 <> 1").join(whole, ["doc_id", "line_no"], "left_anti").join(_edits(w).select("doc_id", "line_no", "word_no"), ["doc_id", "line_no", "word_no"], "left_anti")
    return L.lines(t).select("doc_id", "line_no", "text")


SHAKEN = "k AS (SELECT DISTINCT doc_id FROM documents), c AS (SELECT doc_id, r * 4 + c AS cell, c * 250 + (doc_id + r * 3) % 5 AS x0, r * 72 + (doc_id + c * 2) % 5 AS y0 FROM k, range(0, 10) a(r), range(0, 4) b(c))"


@query(f"""WITH {SHAKEN},
gx AS (SELECT doc_id, x0 AS v, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0) <= 6 THEN 0 ELSE 1 END AS n FROM c), gy AS (SELECT doc_id, y0 AS v, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0) <= 6 THEN 0 ELSE 1 END AS n FROM c),
nx AS (SELECT doc_id, v, sum(n) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) - 1 AS k FROM gx), ny AS (SELECT doc_id, v, sum(n) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) - 1 AS k FROM gy),
cx AS (SELECT doc_id, k, avg(v) AS m FROM nx GROUP BY ALL), cy AS (SELECT doc_id, k, avg(v) AS m FROM ny GROUP BY ALL),
bx AS (SELECT c.doc_id, cell, cx.k FROM c JOIN cx USING (doc_id) QUALIFY row_number() OVER (PARTITION BY c.doc_id, cell ORDER BY abs(m - x0), cx.k) = 1), by_ AS (SELECT c.doc_id, cell, cy.k FROM c JOIN cy USING (doc_id) QUALIFY row_number() OVER (PARTITION BY c.doc_id, cell ORDER BY abs(m - y0), cy.k) = 1)
SELECT doc_id, cell, by_.k::BIGINT AS r, bx.k::BIGINT AS col, (row_number() OVER (PARTITION BY doc_id ORDER BY by_.k, bx.k, cell) - 1)::BIGINT AS place FROM bx JOIN by_ USING (doc_id, cell)""")
def cell_indices(spark, d):
    """Row and column of cells whose edges are not quite in line, and their order."""
    rc = table(spark, d, "documents").select("doc_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    r, c, k = F.col("r").cast("long"), F.col("c").cast("long"), F.col("doc_id")
    cells = rc.select("doc_id", (r * 4 + c).alias("cell"), (c * 250 + (k + r * 3) % 5).alias("x0"), (r * 72 + (k + c * 2) % 5).alias("y0"))
    t = D.nearest_centre(D.nearest_centre(cells, ["doc_id"], "y0", "r"), ["doc_id"], "x0", "col")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "col", "cell")) - 1
    return t.select("doc_id", "cell", "r", "col", place.cast("long").alias("place"))


GRIDS = "g AS (SELECT page_id, 60 + page_id % 9 * 10 AS w, 30 + page_id % 5 * 10 AS h, 1 + page_id % 3 AS rows, 1 + page_id % 4 AS cols FROM pages), p AS (SELECT g.*, k, k * 25 AS cx0, 1 + k % 2 * 4 AS cy0, k * 25 + 10 + (page_id + k) % 14 AS cx1, 1 + k % 2 * 4 + 20 AS cy1, (page_id * 3 + k) % 10 * 40 AS area FROM g, range(0, 4) t(k))"


@query(f"WITH {GRIDS}, ok AS (SELECT * FROM p WHERE cx1 - cx0 >= 12 AND cy1 - cy0 >= 12 AND cx0 > 0 AND cy0 > 0 AND cx1 < w AND cy1 < h AND area >= 0.7::DOUBLE * (cx1 - cx0) * (cy1 - cy0)) SELECT page_id, count(*) AS cells FROM ok WHERE w >= 80 AND h >= 40 AND rows >= 2 AND cols >= 2 GROUP BY page_id HAVING count(*) >= 2")
def table_components(spark, d):
    """grids with rules both ways and two cells or more that are full and off the edge."""
    k = F.col("page_id")
    g = table(spark, d, "pages").select("page_id", G.box(F.lit(0).cast("long"), F.lit(0).cast("long"), k % 9 * 10 + 60, k % 5 * 10 + 30).alias("outer"), (k % 3 + 1).alias("rows"), (k % 4 + 1).alias("cols")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    i = F.col("k").cast("long")
    top = i % 2 * 4 + 1
    p = g.select("*", G.box(i * 25, top, i * 25 + 10 + (k + i) % 14, top + 20).alias("cell"), ((k * 3 + i) % 10 * 40).alias("area"))
    cells = p.where(D.cell_holds(F.col("cell"), F.col("outer"), F.col("area"))).groupBy("page_id", "outer", "rows", "cols").agg(F.count(F.lit(1)).alias("cells"))
    return cells.where(D.is_table(F.col("outer"), F.col("rows"), F.col("cols"), F.col("cells"))).select("page_id", "cells")


@query(RASTER + ", i AS (SELECT page_id, y, v < 120 AS i, lag(v < 120) OVER (PARTITION BY page_id, y ORDER BY x) AS was FROM px WHERE y IN (6, 12, 18)), t AS (SELECT page_id, y, count_if(was IS NOT NULL AND i <> was) AS n FROM i GROUP BY ALL), m AS (SELECT page_id, min(n)::BIGINT AS transitions FROM t GROUP BY page_id), q AS (SELECT page_id, x, sum(CASE WHEN y < 8 THEN v END) AS a, sum(CASE WHEN y >= 16 THEN v END) AS b FROM px GROUP BY ALL), c AS (SELECT page_id, corr(a, b) AS r FROM q GROUP BY page_id) SELECT page_id, transitions, round(r, 6) AS r FROM m JOIN c USING (page_id) WHERE transitions >= 6 AND r >= 0.2::DOUBLE")
def barcode_filter(spark, d):
    """F7 on small rasters, with limits to their size."""
    px = _raster(spark, d)
    t = X.transitions(px.where("y in (6, 12, 18)"), ["page_id", "y"], "x", F.col("v") < 120).groupBy("page_id").agg(F.min("transitions").alias("transitions"))
    q = px.groupBy("page_id", "x").agg(F.sum(F.when(F.col("y") < 8, F.col("v"))).alias("a"), F.sum(F.when(F.col("y") >= 16, F.col("v"))).alias("b"))
    c = q.groupBy("page_id").agg(F.corr("a", "b").alias("r"))
    return t.join(c, "page_id").where(D.is_bar(F.lit(40), F.lit(24), F.col("transitions"), F.col("r"), (40, 20, 6, 0.2))).select("page_id", "transitions", F.round("r", 6).alias("r"))


@query(LINES_SQL + BARS + """, g AS (SELECT doc_id, line_no, x0 + line_no % 7 * 20 AS gx0, y0 AS gy0, x0 + line_no % 7 * 20 + 30 + line_no % 3 * 12 AS gx1, y0 + 36 + line_no % 4 * 8 AS gy1, (line_no * 7 + doc_id) % 10 AS tenth FROM lines WHERE line_no % 5 = 0),
l AS (SELECT *, (gx1 - gx0) * (gy1 - gy0) AS whole FROM g WHERE (gx1 - gx0) >= 39.6::DOUBLE AND (gy1 - gy0) >= 39.6::DOUBLE AND tenth >= 3)
SELECT doc_id, line_no FROM l WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.doc_id = l.doc_id AND greatest(least(gx1, bx1) - greatest(gx0, bx0), 0) * greatest(least(gy1, by1) - greatest(gy0, by0), 0) * 2 > whole)""")
def graphic_filter(spark, d):
    """F8: components 2.2 text lines high and wide that are filled and neither in a bar nor in a word (a word is too small here)."""
    w = words(spark, d)
    n = F.col("line_no")
    x, y = F.col("x0") + n % 7 * 20, F.col("y0")
    box = G.box(x, y, x + 30 + n % 3 * 12, y + 36 + n % 4 * 8)
    found = L.lines(w).where("line_no % 5 = 0").select("doc_id", "line_no", box.alias("a"), ((n * 7 + F.col("doc_id")) % 10 * G.area(box) / 10).alias("area"))
    return D.graphics(found, _bars(spark, d), _boxed(w, "b").select("doc_id", "b"), ["doc_id"], F.lit(18)).select("doc_id", "line_no")


@query(LINES_SQL + ", t AS (SELECT doc_id, line_no, x0 AS rx0, y0 AS ry0, x0 + 300 AS rx1, y0 + 60 AS ry1 FROM lines WHERE line_no % 4 = 1), s AS (SELECT DISTINCT doc_id, 0 AS sx0, doc_id % 6 * 24 AS sy0, 250 AS sx1, doc_id % 6 * 24 + 90 AS sy1 FROM documents) SELECT doc_id, line_no FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = t.doc_id AND greatest(least(rx1, sx1) - greatest(rx0, sx0), 0) * greatest(least(ry1, sy1) - greatest(ry0, sy0), 0) > 0.3::DOUBLE * (rx1 - rx0) * (ry1 - ry0))")
def new_rule_tables(spark, d):
    """Tables made of rules that do not lie in a table there is."""
    x, y = F.col("x0"), F.col("y0")
    t = L.lines(words(spark, d)).where("line_no % 4 = 1").select("doc_id", "line_no", G.box(x, y, x + 300, y + 60).alias("a"))
    top, zero = F.col("doc_id") % 6 * 24, F.lit(0).cast("long")
    s = table(spark, d, "documents").select("doc_id").distinct().select("doc_id", G.box(zero, top, zero + 250, top + 90).alias("b"))
    hit = spatial.overlap_join(t, s, ["doc_id"]).where(G.overlap_fraction(F.col("a"), F.col("b")) > 0.3).select("doc_id", "line_no")
    return t.join(hit, ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no")


@query(LINES_SQL + " SELECT doc_id, line_no, n_words FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, line_no) = 1")
def first_longest_line(spark, d):
    """The largest, the first of equal ones."""
    best = F.max(F.struct("n_words", (-F.col("line_no")).alias("back")))
    return L.lines(words(spark, d)).groupBy("doc_id").agg(best.alias("m")).select("doc_id", (-F.col("m.back")).alias("line_no"), F.col("m.n_words").alias("n_words"))


@query(WORDS_SQL + EDITS + ", f AS (SELECT e.edit_id, e.doc_id % 2 = 1 AS to_right, w.word_no, w.x0, w.x1 FROM edits e JOIN words w USING (doc_id, line_no) WHERE w.word_no <> e.word_no AND CASE WHEN e.doc_id % 2 = 1 THEN w.x1 <= e.x0 + 1 ELSE w.x0 >= e.x1 - 1 END) SELECT edit_id, word_no, (row_number() OVER (PARTITION BY edit_id ORDER BY CASE WHEN to_right THEN -x1 ELSE x0 END) - 1)::BIGINT AS place FROM f")
def followers(spark, d):
    """The words that move with an edit, nearest first; to the left of one that is aligned right."""
    w = words(spark, d)
    e = _edits(w).select("doc_id", "line_no", "edit_id", F.col("word_no").alias("k"), F.col("x0").alias("e0"), F.col("x1").alias("e1"))
    right = F.col("doc_id") % 2 == 1
    side = F.when(right, F.col("x1") <= F.col("e0") + 1).otherwise(F.col("x0") >= F.col("e1") - 1)
    f = e.join(w.select("doc_id", "line_no", "word_no", "x0", "x1"), ["doc_id", "line_no"]).where((F.col("word_no") != F.col("k")) & side)
    place = F.row_number().over(Window.partitionBy("edit_id").orderBy(F.when(right, -F.col("x1")).otherwise(F.col("x0")))) - 1
    return f.select("edit_id", "word_no", place.cast("long").alias("place"))


@query(LINES_SQL + ", c AS (SELECT doc_id, line_no, k AS ord, 'font' || k // 2 AS family, k % 2 = 1 AS bold, (doc_id * 7 + line_no * 5 + k * 11) % 97 AS score FROM lines, range(0, 12) t(k) WHERE line_no % 10 = 0), r AS (SELECT *, row_number() OVER w AS place, first_value(family) OVER w AS f1, first_value(bold) OVER w AS b1 FROM c WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY score, ord)) SELECT doc_id, line_no, ord, family, bold, score, place::BIGINT AS place, place <= 4 AS shown FROM r WHERE place <= 6 OR family = f1 AND bold <> b1")
def style_candidates(spark, d):
    """T6, T7."""
    k = F.col("ord")
    c = L.lines(words(spark, d)).where("line_no % 10 = 0").select("doc_id", "line_no", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ord")).withColumn("ord", k.cast("long"))
    c = c.select("doc_id", "line_no", "ord", F.concat(F.lit("font"), F.floor(k / 2).cast("string")).alias("family"), (k % 2 == 1).alias("bold"), ((F.col("doc_id") * 7 + F.col("line_no") * 5 + k * 11) % 97).alias("score"))
    return D.candidates(c, ["doc_id", "line_no"])


@query("WITH p AS (SELECT page_id, 600 + page_id % 90 AS w, 700 + page_id % 70 AS h, page_id % 4 * 90 AS rot, page_id % 50 AS x, page_id % 60 AS y FROM pages) SELECT page_id, CASE rot WHEN 90 THEN h - 1 - y WHEN 180 THEN w - 1 - x WHEN 270 THEN y ELSE x END AS px, CASE rot WHEN 90 THEN x WHEN 180 THEN h - 1 - y WHEN 270 THEN w - 1 - x ELSE y END AS py, CASE WHEN rot IN (90, 270) THEN h ELSE w END AS pw, CASE WHEN rot IN (90, 270) THEN w ELSE h END AS ph FROM p")
def quarter_turns(spark, d):
    """P20: a point and the size of a page after a quarter, half or three-quarter turn, by the turn's matrix."""
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", (k % 90 + 600).alias("w"), (k % 70 + 700).alias("h"), (k % 4 * 90).alias("rot"), (k % 50).alias("x"), (k % 60).alias("y"))
    m, size = G.quarter_turn(F.col("rot"), F.col("w"), F.col("h"))
    at = lambda r: m[r][0] * F.col("x") + m[r][1] * F.col("y") + m[r][2]
    return p.select("page_id", at(0).alias("px"), at(1).alias("py"), size[0].alias("pw"), size[1].alias("ph"))


@query("SELECT page_id, '{\"page_id\":' || page_id || ',\"name\":\"' || regexp_extract(url, '([^/]*)$', 1) || '\",\"files\":[\"manifest.json\",\"source.bin\"]}' AS manifest FROM pages")
def project_export(spark, d):
    """K6: the manifest of a project's archive."""
    t = table(spark, d, "pages")
    files = F.array(F.lit("manifest.json"), F.lit("source.bin"))
    return t.select("page_id", F.to_json(F.struct("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name"), files.alias("files"))).alias("manifest"))


@query(WORDS_SQL + EDITS + """, j AS (SELECT edit_id, '{"bbox": [' || x0 || ', ' || y0 || ', ' || x1 || ', ' || y1 || '], "erase_box": null, "id": "' || edit_id || '", "original_text": "' || word || '", "source": "ocr", "style": null, "target_ids": ["w' || word_no || '"], "text": "' || new_text || '"}' AS canonical FROM edits WHERE regexp_matches(word, '^[A-Za-z]*$')) SELECT edit_id, canonical, sha1(canonical) AS edit_key FROM j""")
def edit_keys(spark, d):
    """The digest of an edit's fields as JSON with sorted keys."""
    e = _edits(words(spark, d)).where(F.col("word").rlike("^[A-Za-z]*$"))
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)  # noqa: E731  a JSON string
    box = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")]), F.lit("]"))
    target = F.concat(F.lit("["), text(F.concat(F.lit("w"), F.col("word_no").cast("string"))), F.lit("]"))
    fields = {"text": text(F.col("new_text")), "id": text(F.col("edit_id")), "bbox": box, "style": F.lit("null"), "target_ids": target, "source": text(F.lit("ocr")), "original_text": text(F.col("word")), "erase_box": F.lit("null")}
    canonical = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]), F.lit("}"))
    return e.select("edit_id", canonical.alias("canonical")).withColumn("edit_key", F.sha1("canonical"))


@query(r"WITH n AS (SELECT regexp_extract(url, '([^/]*)$', 1) || CASE WHEN page_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS name FROM pages) SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS place FROM (SELECT DISTINCT name FROM n) WHERE ends_with(name, '.jpg')")
def sample_listing(spark, d):
    """The samples there are, by name; a folder's few names."""
    k = F.col("page_id") % 3 == 0
    n = table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.when(k, ".jpg").otherwise(".png")).alias("name")).where(F.endswith("name", F.lit(".jpg"))).distinct()
    return n.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long") - 1)


@query(RASTER + ", h AS (SELECT page_id, v AS level, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER a AS w0, sum(n * level) OVER a AS s0, sum(n) OVER b AS w, sum(n * level) OVER b AS s FROM h WINDOW a AS (PARTITION BY page_id ORDER BY level ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY page_id)), t AS (SELECT page_id, level, ((w * s0 - w0 * s)::DOUBLE * (w * s0 - w0 * s)::DOUBLE) / (w0 * (w - w0))::DOUBLE AS between_ FROM c WHERE w > w0), o AS (SELECT page_id, least(greatest(level, 110), 200) AS used FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY between_ DESC, level) = 1) SELECT page_id, y, x FROM px JOIN o USING (page_id) WHERE v <= used")
def ink_mask(spark, d):
    """Pixels up to the threshold, which stays between 110 and 200."""
    px = _raster(spark, d)
    used = X.otsu(px, ["page_id"]).select("page_id", F.least(F.greatest("threshold", F.lit(110)), F.lit(200)).alias("used"))
    return px.join(used, "page_id").where("v <= used").select("page_id", "y", "x")


@query(RASTER + ", c AS (SELECT page_id, y, x FROM px JOIN done USING (page_id, y, x) WHERE px.v <> done.v), allowed AS (SELECT page_id, y, x FROM px WHERE x >= 8 AND x < 17) SELECT * FROM c EXCEPT SELECT * FROM allowed")
def pixels_outside(spark, d):
    """U4: changed pixels that are not allowed to change."""
    keys = ["page_id", "y", "x"]
    px = _raster(spark, d)
    return X.changed(px, _done(spark, d), ["page_id"]).select(*keys).join(px.where("x >= 8 and x < 17").select(*keys), keys, "left_anti")


@query()
def undo_history(spark, d):
    """A project's events as changes, undos and redos."""
    kind = F.when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "click", "redo").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return D.history(table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("op")), "user_id", ["ts", "event_id"])
