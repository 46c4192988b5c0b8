"""Queries on pages, files and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pages as P
from quire.plans.catalog import query
from quire.sources.bridge import table

HEADS = ("255044462D312E37", "FFD8FFE000104A46", "89504E470D0A1A0A00", "000000186674797068656963", "000000206674797061766966", "52494646AAAAAAAA57454250", "49492A0008000000", "4D4D002A00000008", "424D36000000", "6E6F7465733A")
HEADS_SQL = "h AS (SELECT page_id, length(html) * 9000 AS n, [" + ", ".join(f"'{h}'" for h in HEADS) + "][1 + page_id % 10] AS head FROM pages)"
MIME_SQL = """m AS (SELECT *, CASE WHEN regexp_matches(head, '^(?:..)*?25504446') THEN 'application/pdf' WHEN starts_with(head, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(head, '89504E470D0A1A0A') THEN 'image/png'
 WHEN substr(head, 9, 8) = '66747970' AND substr(head, 17, 8) IN ('68656963', '68656978', '68657663', '68657678', '6D696631', '6D736631', '6865696D', '68656973') THEN 'image/heic' WHEN substr(head, 9, 8) = '66747970' AND substr(head, 17, 8) = '61766966' THEN 'image/avif'
 WHEN starts_with(head, '52494646') AND substr(head, 17, 8) = '57454250' THEN 'image/webp' WHEN starts_with(head, '49492A00') OR starts_with(head, '4D4D002A') THEN 'image/tiff' WHEN starts_with(head, '424D') THEN 'image/bmp' END AS mime FROM h)"""


def _heads(spark, d):
    heads = F.array(*[F.lit(h) for h in HEADS])
    return table(spark, d, "pages").select("page_id", (F.length("html") * 9000).cast("long").alias("n"), F.element_at(heads, (F.col("page_id") % 10 + 1).cast("int")).alias("head"))


@query(f"WITH {HEADS_SQL}, {MIME_SQL} SELECT page_id, mime FROM m")
def mime_sniff(spark, d):
    """S1."""
    return _heads(spark, d).select("page_id", P.mime(F.col("head")).alias("mime"))


@query(f"WITH {HEADS_SQL}, {MIME_SQL} SELECT CASE WHEN n = 0 THEN 'empty_file' WHEN n > 83886080 THEN 'too_large' WHEN mime IS NULL THEN 'unsupported_type' ELSE 'ok' END AS status, count(*) AS n FROM m GROUP BY 1")
def upload_status(spark, d):
    """S2."""
    h = _heads(spark, d).withColumn("mime", P.mime(F.col("head")))
    return h.groupBy(P.upload_status(F.col("n"), F.col("mime")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


SIZES_SQL = "s AS (SELECT page_id, 600 + page_id * 37 % 900 AS w, 700 + page_id * 53 % 1100 AS h, CASE WHEN page_id % 5 = 0 THEN 612.0::DOUBLE END AS pdf_w, CASE WHEN page_id % 5 = 0 THEN 792.0::DOUBLE END AS pdf_h, CASE WHEN page_id % 5 = 1 THEN ['letter', 'a4', 'legal', 'a5', 'b9'][1 + page_id % 3] END AS paper, page_id * 11 % 400 AS dpi, page_id % 4 = 0 AS rectified FROM pages)"


def _sizes(spark, d):
    p = F.col("page_id")
    papers = F.array(*[F.lit(x) for x in ("letter", "a4", "legal", "a5", "b9")])
    pdf = lambda v: F.when(p % 5 == 0, F.lit(v))
    return table(spark, d, "pages").select("page_id", (p * 37 % 900 + 600).alias("w"), (p * 53 % 1100 + 700).alias("h"), pdf(612.0).alias("pdf_w"), pdf(792.0).alias("pdf_h"), F.when(p % 5 == 1, F.element_at(papers, (p % 3 + 1).cast("int"))).alias("paper"), (p * 11 % 400).alias("dpi"), (p % 4 == 0).alias("rectified"))


@query(f"""WITH {SIZES_SQL}, a AS (SELECT page_id, greatest(w, h) / least(w, h) AS r FROM s)
SELECT page_id, CASE WHEN abs(r - 11 / 8.5::DOUBLE) / (11 / 8.5::DOUBLE) < 0.06 THEN 'letter' WHEN abs(r - 297 / 210) / (297 / 210) < 0.06 THEN 'a4' WHEN abs(r - 14 / 8.5::DOUBLE) / (14 / 8.5::DOUBLE) < 0.06 THEN 'legal' WHEN abs(r - 210 / 148) / (210 / 148) < 0.06 THEN 'a5' END AS paper FROM a""")
def paper_snap(spark, d):
    """P21."""
    return _sizes(spark, d).select("page_id", P.snap_paper(F.col("w"), F.col("h")).alias("paper"))


@query(f"""WITH {SIZES_SQL}, p(paper, pw, ph) AS (VALUES ('letter', 612.0::DOUBLE, 792.0::DOUBLE), ('a4', 595.28, 841.89), ('legal', 612.0, 1008.0), ('a5', 419.53, 595.28)),
j AS (SELECT *, CASE WHEN dpi < 150 OR rectified THEN 200 ELSE dpi END AS used FROM s LEFT JOIN p USING (paper))
SELECT page_id, CASE WHEN pdf_w IS NOT NULL THEN 'pdf' WHEN pw IS NOT NULL THEN 'paper:' || paper ELSE 'dpi:' || used END AS size_rule,
 CASE WHEN pdf_w IS NOT NULL THEN pdf_w WHEN pw IS NOT NULL THEN CASE WHEN h >= w THEN pw ELSE ph END ELSE w * 72.0::DOUBLE / used END AS w_pt,
 CASE WHEN pdf_h IS NOT NULL THEN pdf_h WHEN pw IS NOT NULL THEN CASE WHEN h >= w THEN ph ELSE pw END ELSE h * 72.0::DOUBLE / used END AS h_pt FROM j""")
def page_size_rule(spark, d):
    """K12."""
    return P.page_size(_sizes(spark, d)).select("page_id", "size_rule", "w_pt", "h_pt")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def status_latest(spark, d):
    """The last state of each project."""
    return P.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


ERRORS_SQL = "e AS (SELECT event_id, ['timeout', 'ocr_failed', 'ocr_unavailable', 'ok'][1 + event_id % 4] AS code FROM events)"


@query(f"WITH {ERRORS_SQL}, r(code, ord, action) AS (VALUES " + ", ".join(f"('{c}', {k}, '{a}')" for k, (c, a) in enumerate(P.RECOVERY)) + ") SELECT event_id, code, string_agg(action, ',' ORDER BY ord) AS actions FROM e LEFT JOIN r USING (code) GROUP BY ALL")
def recovery_lookup(spark, d):
    """X11."""
    codes = F.array(*[F.lit(x) for x in ("timeout", "ocr_failed", "ocr_unavailable", "ok")])
    e = table(spark, d, "events").select("event_id", F.element_at(codes, (F.col("event_id") % 4 + 1).cast("int")).alias("code"))
    r = P.recovery(spark).groupBy("code").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ord", "action"))), lambda x: x["action"])).alias("actions"))
    return e.join(F.broadcast(r), "code", "left").select("event_id", "code", "actions")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') || '-edited.pdf' AS name FROM pages")
def export_names(spark, d):
    """P30."""
    return table(spark, d, "pages").select("page_id", F.concat(T.base_name(F.col("url")), F.lit("-edited.pdf")).alias("name"))


@query("SELECT page_id, '#' || lpad(lower(to_hex(page_id * 7 % 256)), 2, '0') || lpad(lower(to_hex(page_id * 5 % 256)), 2, '0') || lpad(lower(to_hex(page_id * 3 % 256)), 2, '0') AS colour, 114 * (page_id * 3 % 256) + 587 * (page_id * 5 % 256) + 299 * (page_id * 7 % 256) AS luminance, page_id * 7 % 256 AS red FROM pages")
def colour_hex(spark, d):
    """P14, P15."""
    p = F.col("page_id")
    b, g, r = p * 3 % 256, p * 5 % 256, p * 7 % 256
    t = table(spark, d, "pages").select("page_id", T.bgr_hex(b, g, r).alias("colour"), T.luminance_milli(b, g, r).alias("luminance"))
    return t.withColumn("red", T.hex_part(F.col("colour"), 0))


@query("SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def json_fields(spark, d):
    """JSON with an explicit schema."""
    return table(spark, d, "events").where("props is not null").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'purchase' AND e.value > 100)")
def projects_not_deleted(spark, d):
    """Tombstones as an anti-join."""
    e = table(spark, d, "events")
    return e.select("user_id").distinct().join(e.where("event_type = 'purchase' and value > 100").select("user_id").distinct(), "user_id", "left_anti")


@query("SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stale_projects(spark, d):
    """Untouched for two hours before the newest."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts")).join(F.broadcast(newest)).where(F.col("last_ts") < F.col("newest") - F.expr("INTERVAL 2 HOURS")).select("user_id", "last_ts")


@query("WITH p AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, greatest(4.0::DOUBLE, CASE WHEN n % 2 = 0 THEN (100 + n % 50 - n % 13) / 0.72::DOUBLE ELSE (100 + n % 50 - n % 17) / 0.53::DOUBLE END) AS size FROM p")
def font_sizes(spark, d):
    """P16."""
    n = F.length("text")
    size = T.font_size(F.lit(100) + n % 50, n % 13, n % 17, n % 2 == 0)
    return table(spark, d, "conversations").select("conv_id", "turn", size.alias("size"))
