"""Queries on edits: validation, versions, text layer, room and reflow, find and replace, the ordered fold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import kernels
from quire.operators import lines as L
from quire.operators import pages as P
from quire.operators import segments as S
from quire.plans.catalog import query
from quire.plans.lines import LINES_SQL
from quire.sources.bridge import WORDS_SQL, words

# an edit of every seventh word: a longer text, or none
EDITS = """, edits AS (SELECT doc_id, line_no, word_no, 'e' || doc_id || '-' || line_no || '-' || word_no AS edit_id, CASE WHEN (doc_id + word_no) % 3 = 0 THEN '' ELSE upper(substr(word, 1, 1)) || 'x' || length(word) || 'yz' END AS new_text, word, x0, y0, x1, y1, (doc_id + line_no) % 10 = 9 AS disabled
 FROM words WHERE (doc_id + line_no + word_no) % 7 = 0 AND regexp_matches(word, '^[A-Za-z]'))"""


def _edits(w):
    e = w.where(((F.col("doc_id") + F.col("line_no") + F.col("word_no")) % 7 == 0) & F.col("word").rlike("^[A-Za-z]"))
    new = F.when((F.col("doc_id") + F.col("word_no")) % 3 == 0, "").otherwise(F.concat(F.upper(F.substring("word", 1, 1)), F.lit("x"), F.length("word").cast("string"), F.lit("yz")))
    ident = F.concat(F.lit("e"), F.col("doc_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"), F.lit("-"), F.col("word_no").cast("string"))
    return e.select("doc_id", "line_no", "word_no", ident.alias("edit_id"), new.alias("new_text"), "word", "x0", "y0", "x1", "y1", ((F.col("doc_id") + F.col("line_no")) % 10 == 9).alias("disabled"))


@query(WORDS_SQL + EDITS + """, b AS (SELECT edit_id, CASE WHEN word_no % 5 = 4 THEN NULL ELSE x0 - 40 END AS a, y0 AS b, CASE WHEN word_no % 4 = 1 THEN x0 - 40 ELSE x1 - 40 END AS c, y1 AS d, repeat('a', (line_no % 600)::INT) AS t FROM edits)
SELECT edit_id, CASE WHEN a IS NULL THEN 'needs_box' WHEN NOT (c > a AND d > b) THEN 'empty_region' WHEN c <= 0 OR d <= 0 OR a >= 600 OR b >= 100000 THEN 'outside_page' WHEN length(t) > 500 THEN 'text_too_long' ELSE 'ok' END AS status FROM b""")
def edit_validation(spark, d):
    """F10."""
    e = _edits(words(spark, d))
    a = F.when(F.col("word_no") % 5 != 4, F.col("x0") - 40)
    c = F.when(F.col("word_no") % 4 == 1, F.col("x0") - 40).otherwise(F.col("x1") - 40)
    text = F.repeat(F.lit("a"), (F.col("line_no") % 600).cast("int"))
    return e.select("edit_id", P.edit_error(a, F.col("y0"), c, F.col("y1"), text, F.lit(600), F.lit(100000)).alias("status"))


@query(WORDS_SQL + EDITS + " SELECT doc_id, count(*) AS n, count_if(new_text = '')::BIGINT AS deleted FROM edits WHERE NOT disabled GROUP BY doc_id")
def page_edits(spark, d):
    """F9, A19."""
    return _edits(words(spark, d)).where(~F.col("disabled")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_text") == "").alias("deleted"))


@query("WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS version FROM events) SELECT user_id, event_id, value, version FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC) = 1")
def edits_latest_version(spark, d):
    """K8: every write gets the next version, the last one holds."""
    e = spark.read.parquet(f"{d}/events.parquet")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    v = e.select("user_id", "event_id", "value", version.alias("version"))
    return v.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "version").alias("m"), F.max("version").alias("version")).select("user_id", "m.event_id", "m.value", "version")


@query(WORDS_SQL + EDITS + " SELECT w.doc_id, w.line_no, w.word_no, w.word AS text FROM words w WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE NOT disabled AND e.doc_id = w.doc_id AND e.line_no = w.line_no AND e.word_no = w.word_no) UNION ALL SELECT doc_id, line_no, word_no, new_text FROM edits WHERE NOT disabled AND new_text <> ''")
def text_layer_words(spark, d):
    """The words that no edit replaces, and the edits' texts."""
    w = words(spark, d)
    e = _edits(w).where(~F.col("disabled"))
    keys = ["doc_id", "line_no", "word_no"]
    return w.join(e, keys, "left_anti").select(*keys, F.col("word").alias("text")).union(e.where("new_text <> ''").select(*keys, "new_text"))


@query(WORDS_SQL + EDITS + """, o AS (SELECT e.edit_id, e.x0, e.x1, max(CASE WHEN w.x1 <= e.x0 + 1 THEN w.x1 + 6.25::DOUBLE END) AS l, min(CASE WHEN w.x0 >= e.x1 - 1 THEN w.x0 - 6.25::DOUBLE END) AS r FROM edits e LEFT JOIN words w ON w.doc_id = e.doc_id AND w.line_no = e.line_no AND w.word_no <> e.word_no GROUP BY ALL)
SELECT edit_id, least(coalesce(l, 0), x0)::DOUBLE AS room0, greatest(coalesce(r, 1200), x1)::DOUBLE AS room1 FROM o""")
def edit_room(spark, d):
    """How far an edit may reach before the next words of its line."""
    w = words(spark, d)
    e = _edits(w).select("doc_id", "line_no", F.col("word_no").alias("k"), "edit_id", F.col("x0").alias("e0"), F.col("x1").alias("e1"))
    j = e.join(w.select("doc_id", "line_no", "word_no", "x0", "x1"), ["doc_id", "line_no"])
    other = F.col("word_no") != F.col("k")
    left, right = F.max(F.when(other & (F.col("x1") <= F.col("e0") + 1), F.col("x1") + 6.25)), F.min(F.when(other & (F.col("x0") >= F.col("e1") - 1), F.col("x0") - 6.25))
    o = j.groupBy("edit_id", "e0", "e1").agg(left.alias("l"), right.alias("r"))
    return o.select("edit_id", F.least(F.coalesce("l", F.lit(0.0)), F.col("e0").cast("double")).alias("room0"), F.greatest(F.coalesce("r", F.lit(1200.0)), F.col("e1").cast("double")).alias("room1"))


@query(WORDS_SQL + EDITS + """, f AS (SELECT e.edit_id, e.x0, e.x1, e.new_text, min(w.x0) AS nx, max(w.x1) AS last FROM edits e JOIN words w ON w.doc_id = e.doc_id AND w.line_no = e.line_no AND w.word_no > e.word_no GROUP BY ALL),
s AS (SELECT edit_id, least(CASE WHEN new_text = '' THEN x0 - nx ELSE x0 + 10 * length(new_text) + (nx - x1) - nx END, 1200 - last) AS want FROM f)
SELECT edit_id, CASE WHEN abs(want) < 2 THEN 0 ELSE want END AS shift FROM s""")
def reflow_shift(spark, d):
    """How the words behind an edit move, within the line's room; small moves are none."""
    w = words(spark, d)
    e = _edits(w).select("doc_id", "line_no", F.col("word_no").alias("k"), "edit_id", "new_text", F.col("x0").alias("e0"), F.col("x1").alias("e1"))
    f = e.join(w.select("doc_id", "line_no", "word_no", "x0", "x1"), ["doc_id", "line_no"]).where(F.col("word_no") > F.col("k")).groupBy("edit_id", "new_text", "e0", "e1").agg(F.min("x0").alias("nx"), F.max("x1").alias("last"))
    want = F.when(F.col("new_text") == "", F.col("e0") - F.col("nx")).otherwise(F.col("e0") + F.length("new_text") * 10 - F.col("e1"))
    want = F.least(want, F.lit(1200) - F.col("last"))
    return f.select("edit_id", F.when(F.abs(want) < 2, F.lit(0)).otherwise(want).cast("long").alias("shift"))


@query(LINES_SQL + ", c AS (SELECT doc_id, line_no, lower(text) AS t FROM lines WHERE contains(lower(text), 'the')), h AS (SELECT doc_id, line_no, unnest(string_split(t, 'the')) AS gap, generate_subscripts(string_split(t, 'the'), 1) AS k, len(string_split(t, 'the')) AS n FROM c) SELECT doc_id, line_no, (k - 1)::BIGINT AS hit, (sum(length(gap)) OVER (PARTITION BY doc_id, line_no ORDER BY k) + 3 * (k - 1))::BIGINT AS at FROM h QUALIFY k < n")
def find_hits(spark, d):
    """Every place of a text in a line, without overlaps, capitals or not."""
    c = L.lines(words(spark, d)).where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", "line_no", F.split(F.lower("text"), "the", -1).alias("gaps"))
    h = c.select("doc_id", "line_no", F.size("gaps").alias("n"), F.posexplode("gaps").alias("k", "gap"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("gap")).over(w) + F.col("k") * 3
    return h.withColumn("at", at).where(F.col("k") < F.col("n") - 1).select("doc_id", "line_no", F.col("k").cast("long").alias("hit"), F.col("at").cast("long").alias("at"))


@query(WORDS_SQL + ", s AS (SELECT doc_id, line_no, word_no, off AS a, off + length(word) AS b, word FROM wo), l AS (SELECT doc_id, line_no, strpos(lower(string_agg(word, ' ' ORDER BY word_no)), 'e o') - 1 AS p FROM s GROUP BY ALL) SELECT s.doc_id, s.line_no, word_no FROM s JOIN l USING (doc_id, line_no) WHERE p >= 0 AND a < p + 3 AND b > p")
def hit_words(spark, d):
    """The words that the first match of a phrase touches."""
    s = S.spans(words(spark, d), ["doc_id", "line_no"], ["word_no"], "word")
    p = L.lines(words(spark, d)).select("doc_id", "line_no", (F.locate("e o", F.lower("text")) - 1).alias("p")).where("p >= 0")
    return s.join(p, ["doc_id", "line_no"]).where((F.col("start") < F.col("p") + 3) & (F.col("end") > F.col("p"))).select("doc_id", "line_no", "word_no")


@query(LINES_SQL + ", p AS (SELECT doc_id, line_no, text, strpos(text, 'th') AS k FROM lines) SELECT doc_id, line_no, trim(regexp_replace(substr(text, 1, k - 1) || 'Q ' || substr(text, k + 2), '\\s+', ' ', 'g')) AS replaced FROM p WHERE k > 0")
def replace_splice(spark, d):
    """P27."""
    p = L.lines(words(spark, d)).withColumn("k", F.locate("th", F.col("text"))).where("k > 0")
    return p.select("doc_id", "line_no", T.splice(F.col("text"), F.col("k") - 1, F.lit(2), F.lit("Q ")).alias("replaced"))


@query(LINES_SQL + ", g AS (SELECT doc_id, line_no // 4 AS g, string_agg('w' || line_no, '|' ORDER BY 'w' || line_no) AS ids FROM lines GROUP BY ALL) SELECT doc_id, g, ids, sha1(ids) AS edit_key FROM g")
def edit_key_lookup(spark, d):
    """Edits by the sorted set of their targets."""
    g = L.lines(words(spark, d)).groupBy("doc_id", F.floor(F.col("line_no") / 4).alias("g")).agg(F.concat_ws("|", F.array_sort(F.collect_set(F.concat(F.lit("w"), F.col("line_no").cast("string"))))).alias("ids"))
    return g.withColumn("edit_key", F.sha1("ids"))


@query(WORDS_SQL + EDITS + ", p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no)::BIGINT AS seq FROM edits) SELECT a.edit_id, b.edit_id AS depends_on FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.seq < a.seq WHERE b.x0 < a.x1 + 600 AND a.x0 - 600 < b.x1")
def patch_dependency(spark, d):
    """Earlier edits whose box meets the grown box of an edit."""
    p = _edits(words(spark, d)).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "word_no")))
    b = p.select("doc_id", "line_no", F.col("edit_id").alias("depends_on"), F.col("seq").alias("s2"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return p.join(b, ["doc_id", "line_no"]).where((F.col("s2") < F.col("seq")) & (F.col("b0") < F.col("x1") + 600) & (F.col("x0") - 600 < F.col("b1"))).select("edit_id", "depends_on")


@query(LINES_SQL + ", m AS (SELECT doc_id, line_no + 500 AS line_no, 'manual' AS text, 'manual' AS source FROM lines WHERE line_no % 13 = 0) SELECT doc_id, line_no, text, 'ocr' AS source FROM lines UNION ALL SELECT * FROM m")
def manual_regions(spark, d):
    """J24, U1."""
    t = L.lines(words(spark, d)).select("doc_id", "line_no", "text", F.lit("ocr").alias("source"))
    return t.unionByName(t.where("line_no % 13 = 0").select("doc_id", (F.col("line_no") + 500).alias("line_no"), F.lit("manual").alias("text"), F.lit("manual").alias("source")))


@query(WORDS_SQL + EDITS + ", t AS (SELECT doc_id, line_no, word_no FROM edits UNION SELECT doc_id, line_no, word_no + 1 FROM edits WHERE new_text = '') SELECT doc_id, line_no, word_no FROM t INTERSECT SELECT doc_id, line_no, word_no FROM words")
def touched_words(spark, d):
    """The words an edit replaces, and those behind a deleted one."""
    w = words(spark, d)
    e = _edits(w)
    keys = ["doc_id", "line_no", "word_no"]
    t = e.select(*keys).union(e.where("new_text = ''").select("doc_id", "line_no", F.col("word_no") + 1)).distinct()
    return t.join(w.select(*keys), keys, "left_semi")


@query()
def edit_fold(spark, d):
    """X5."""
    w = words(spark, d)
    e = _edits(w).where(~F.col("disabled")).select("doc_id", (F.col("line_no") * 12 + F.col("word_no")).alias("seq"), "line_no", "word_no", "new_text", F.lit(10).cast("long").alias("px"))
    return kernels.fold_edits(w, e)
