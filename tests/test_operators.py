"""Small cases of operators whose steps depend on order, and of functions at their edges."""

import random

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import detections as D
from quire.operators import kernels, segments, spatial
from quire.operators import lines as L
from quire.operators import pages as P
from quire.operators import pixels as X
from quire.plans import catalog


def test_transfer_spaces():
    assert kernels.transfer_spaces("helloworld", "hello world") == "hello world"
    assert kernels.transfer_spaces("a b", "ab") == "a b"
    assert kernels.transfer_spaces("totaldue", "t0tal due") == "total due"
    assert kernels.transfer_spaces("", "x y") == ""


def test_nested_boxes(spark):
    rows = [(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 20, 20), (1, 2, 90, 90, 200, 200), (1, 3, 0, 0, 100, 100)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(r["ord"] for r in kernels.largest_unnested(df).collect()) == [0, 2]


def test_fixed_point_grows(spark):
    regions = [(1, k, 100 + 25 * k, 0, 120 + 25 * k, 10) for k in range(6)]
    schema = "doc_id long, ord long, x0 long, y0 long, x1 long, y1 long"
    seeds = spark.createDataFrame([(1, 0, 0, 0, 92, 10), (1, 1, 0, 0, 500, 10)], schema)
    out = kernels.grow_groups(seeds, spark.createDataFrame(regions, schema)).collect()
    # gaps of 5 are below the height of 10, but the first reaches only as far as its chain
    assert {(r.seed_ord, r.region_ord) for r in out} == {(0, k) for k in range(6)}


def test_edit_fold_is_identity_without_edits(spark):
    w = spark.createDataFrame([(1, 0, k, "abc", 40 * k, 0, 40 * k + 30, 18, 90) for k in range(3)], "doc_id long, line_no long, word_no long, word string, x0 long, y0 long, x1 long, y1 long, conf_pct long")
    e = spark.createDataFrame([], "doc_id long, seq long, line_no long, word_no long, new_text string, px long")
    out = {r.word_no: (r.word, r.x0, r.x1) for r in kernels.fold_edits(w, e).collect()}
    assert out == {k: ("abc", 40 * k, 40 * k + 30) for k in range(3)}
    e = spark.createDataFrame([(1, 1, 0, 0, "abcde", 10), (1, 2, 0, 1, "", 10)], e.schema)
    out = {r.word_no: (r.word, r.x0, r.x1) for r in kernels.fold_edits(w, e).collect()}
    assert out == {0: ("abcde", 0, 50), 1: ("", 60, 60), 2: ("abc", 60, 90)}


def test_grid_join_equals_nested_loop(spark):
    a = spark.range(60).select((F.col("id") % 2).alias("k"), "id", G.box(F.col("id") * 17 % 300 - 50, F.col("id") * 31 % 200, F.col("id") * 17 % 300 + 40, F.col("id") * 31 % 200 + 25).alias("a"))
    b = a.select("k", F.col("id").alias("j"), F.col("a").alias("b"))
    grid = {(r.id, r.j) for r in spatial.overlap_join(a, b, ["k"], cell=32).collect()}
    loop = {(r.id, r.j) for r in a.join(b, "k").where(G.intersects(F.col("a"), F.col("b"))).collect()}
    assert grid == loop and len(spatial.overlap_join(a, b, ["k"], cell=32).collect()) == len(loop)
    assert spatial.overlap_join(a, b.where("j > 1000"), ["k"], how="left_anti").count() == 60


def test_geometry(spark):
    row = spark.range(1).select(G.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("a"), G.box(F.lit(10), F.lit(0), F.lit(20), F.lit(10)).alias("b"), G.box(F.lit(5), F.lit(5), F.lit(5), F.lit(9)).alias("e"))
    r = row.select(G.intersects(F.col("a"), F.col("b")).alias("touch"), G.iou(F.col("a"), F.col("a")).alias("same"), G.iou(F.col("e"), F.col("e")).alias("empty"), G.overlap_fraction(F.col("e"), F.col("a")).alias("part")).first()
    assert (r.touch, r.same, r.empty, r.part) == (False, 1.0, 0.0, 0.0)
    q = spark.createDataFrame([([(10.0, 0.0), (0.0, 0.0), (10.0, 10.0), (0.0, 10.0)],)], "p array<struct<x double, y double>>")
    assert [tuple(p) for p in q.select(G.order_quad(F.col("p")).alias("o")).first().o] == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("12.50",), ("l2",), ("",), (None,), (" 7 a",), ("(12)",)], "t string")
    got = {r.t: (r.n, r.f) for r in df.select("t", T.numeric_like(F.col("t")).alias("n"), T.number_format(F.col("t")).alias("f")).collect()}
    assert got == {"12.50": (True, True), "l2": (True, False), "": (False, False), None: (None, None), " 7 a": (True, False), "(12)": (True, True)}


def test_reconcile_verdicts(spark):
    rows = [("abc", 90, "a bc", 80, "abd", 70), ("abc", 90, "abd", 80, "abd", 70), ("1O", 90, "10", 80, "1Q", 99), ("abc", 90, None, 80, "", 70), ("abc", 90, "abd", 80, "abe", 70)]
    df = spark.createDataFrame(rows, "t0 string, c0 long, t1 string, c1 long, t2 string, c2 long")
    got = {(r.verdict, r.text, r.conf, r.n_alternatives) for r in L.reconcile(df).collect()}
    assert got == {("confirmed", "abc", 90, 1), ("corrected", "abd", 70, 1), ("numeric_context", "10", 80, 2), ("single", "abc", 90, 0), ("disagreement", "abc", 90, 2)}


def test_coalesce_of_nested_intervals(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 10, 20), (1, 50, 60), (1, 101, 110)], "k long, a long, b long")
    assert sorted((r.a, r.b, r.n) for r in segments.coalesce_intervals(df, ["k"], "a", "b").collect()) == [(0, 100, 3), (101, 110, 1)]


def test_collapse_and_interpolate(spark):
    df = spark.createDataFrame([(1, k, c, k) for k, c in enumerate("aa-ab--b")], "k long, i long, c string, p long")
    out = sorted((r.at, r.c, r.p) for r in segments.collapse_runs(df, ["k"], "i", "c", "p", "-").collect())
    assert out == [(0, "a", 1), (3, "a", 3), (4, "b", 4), (7, "b", 7)]
    df = spark.createDataFrame([(1, 0, None), (1, 1, 10), (1, 2, None), (1, 3, 30), (1, 4, None)], "k long, i long, v long")
    assert [r.filled for r in segments.interpolate(df, ["k"], "i", "v").orderBy("i").collect()] == [10, 10, 20, 30, 30]


def test_mime(spark):
    heads = [b"%PDF-1.7", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"\0\0\0\x18ftypmif1", b"RIFF1234WEBP", b"MM\0*", b"BM", b"text", b""]
    df = spark.createDataFrame([(k, h.hex().upper()) for k, h in enumerate(heads)], "k int, h string").select("k", P.mime(F.col("h")).alias("m")).orderBy("k")
    assert [r.m for r in df.collect()] == ["application/pdf", "image/jpeg", "image/png", "image/heic", "image/webp", "image/tiff", "image/bmp", None, None]


BOXED = "doc_id long, ord long, x0 long, y0 long, x1 long, y1 long"


def some_boxes(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randrange(200), r.randrange(200)
        out.append((1, k, x, y, x + r.randint(5, 60), y + r.randint(5, 30)))
    return out


def part(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return max(w, 0) * max(h, 0) / max((a[4] - a[2]) * (a[5] - a[3]), 1)


def test_kernels_equal_plain_loops(spark):
    """Unnested boxes, blocks, stacks and two scales against loops over all pairs."""
    for seed in range(3):
        rows = some_boxes(seed)
        df = spark.createDataFrame(rows, BOXED)
        kept = []
        for a in sorted(rows, key=lambda a: (-(a[4] - a[2]) * (a[5] - a[3]), a[1])):
            if all(part(a, b) <= 0.8 for b in kept):
                kept.append(a)
        assert sorted(tuple(r) for r in kernels.largest_unnested(df).collect()) == sorted(kept)
        union = list(rows[:25])
        for a in rows[25:]:
            if all(part(a, b) < 0.25 and part(b, a) < 0.25 for b in union):
                union.append(a)
        got = D.two_scales(df.where("ord < 25"), df.where("ord >= 25"), "doc_id").collect()
        assert {(r.scale, r.ord) for r in got} == {(int(a[1] >= 25), a[1]) for a in union}
        block, lines = {}, sorted(rows, key=lambda a: (a[3], a[2], a[1]))
        for k, a in enumerate(lines):
            h = a[5] - a[3]
            near = [b for b in lines[:k] if -0.3 * h <= a[3] - b[5] <= 0.9 * h and abs(a[2] - b[2]) < 1.5 * h and a[1] % 2 == b[1] % 2]
            block[a[1]] = block[near[0][1]] if near else len(set(block.values()))
        celled = df.withColumnRenamed("ord", "line_no").withColumn("cell", F.col("line_no") % 2)
        assert {r.line_no: r.block for r in kernels.paragraphs(celled).collect()} == block
        last, want = [], []
        for a in sorted(rows, key=lambda a: (a[3], a[2], a[4])):
            k = next((k for k, b in enumerate(last) if abs(a[2] - b[2]) < 40 and abs(a[4] - b[4]) < 40 and 0 < a[3] - b[3] < 80), len(last))
            last[k : k + 1] = [a]
            want.append((a[2], a[4], a[3], k))
        rules = df.select("doc_id", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("y0").cast("double").alias("y"))
        assert sorted((r.x0, r.x1, r.y, r.stack) for r in kernels.stack_rules(rules).collect()) == sorted(want)


def test_history(spark):
    """Versions, undos and redos against two lists."""
    r = random.Random(3)
    ops = [r.choice(["undo", "redo", "undo", f"v{k}", f"w{k}"]) for k in range(120)]
    now, undo, redo = None, [], []
    for op in ops:
        if op == "undo":
            if undo:
                redo.append(now)
                now = undo.pop()
        elif op == "redo":
            if redo:
                undo.append(now)
                now = redo.pop()
        else:
            undo, now, redo = [*undo, now][-9:], op, []
    got = D.history(spark.createDataFrame([(1, k, op) for k, op in enumerate(ops)], "p long, k long, op string"), "p", ["k"], limit=9).first()
    assert (got.current, got.n_undo, got.n_redo) == (now, len(undo), len(redo))


def test_types_at_whole_bytes(spark):
    """The mark of a PDF may stand later in the first bytes, but not between two bytes."""
    heads = ["00255044462D", "A2550444" + "6B00", "25504446"]
    got = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h string").select("k", P.mime(F.col("h")).alias("m")).orderBy("k").collect()
    assert [r.m for r in got] == ["application/pdf", None, "application/pdf"]


def test_faint_pixels_meet_no_join(spark):
    """Spark takes a raster for as small as its page ids, so once it ran, a join of its pixels could broadcast all of them."""
    plan = catalog.QUERIES["faint_mask"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    r = random.Random(5)
    pages = {k: [r.choice([r.randint(0, 255), 240]) for _ in range(r.choice([1, 7, 64]))] for k in range(40)} | {40: [250] * 20}
    px = spark.createDataFrame([(k, v) for k, vs in pages.items() for v in [*vs, None]], "page_id long, v long")
    want = {}
    for k, vs in pages.items():
        at, s = (len(vs) - 1) * 0.9, sorted(vs)
        lo, hi = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
        paper = lo + (hi - lo) * (at - int(at))
        if n := sum(v < min(paper - 28, 235) for v in vs):
            want[k] = n
    assert {row.page_id: row.faint for row in X.faint(px, ["page_id"]).collect()} == want


def test_quantile_rounds_as_sql(spark, duck):
    """Peers whose percentile decides a ratio of just 1.3, and others at random: the same doubles, so the same verdicts."""
    r = random.Random(7)
    edge = [(7, 116, 156), (13, 107, 122), (19, 104, 124), (27, 116, 156), (33, 107, 122), (39, 107, 117)]
    sets = [[low] * ((n - 1) * 35 // 100 + 1) + [high] * (n - (n - 1) * 35 // 100 - 1) for n, low, high in edge]
    sets += [[r.randint(100, 160) for _ in range(r.randint(1, 60))] for _ in range(300)]
    rows = [(k, v) for k, vs in enumerate(sets) for v in vs]
    counts = spark.createDataFrame(rows, "k long, value long").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    mine = counts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("c")).select("k", N.weighted_quantile(F.col("c"), 0.35).alias("q"))
    values = ", ".join(map(str, rows))
    theirs = dict(duck.execute(f"SELECT k, quantile_cont(v, 0.35) FROM (VALUES {values}) t(k, v) GROUP BY k").fetchall())
    assert {row.k: row.q for row in mine.collect()} == theirs


def test_weight_peers_at_the_bound(spark, duck, tmp_path):
    """A page whose percentile is 110 but for its last bit, with ratios of 143, against the SQL."""
    ratio = lambda line, word: (13 + line * 7 + word * 29) % 61 + 100
    n, low, high, bound = 13, 107, 122, 143
    want = [low] * 5 + [high] * (n - 6) + [bound]
    lines = []
    for v in want:  # one word of three letters on a line of its own, at the next line that gives it its ratio
        at = len(lines)
        while ratio(at * 1000, 0) != v:
            at += 1
        lines += [""] * (at - len(lines)) + ["abc"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(catalog.ORACLE["weight_peers"]).fetchall()
    mine = [tuple(row) for row in catalog.QUERIES["weight_peers"](spark, str(tmp_path)).collect()]
    assert sorted(mine) == sorted(theirs) and any(row[3] for row in mine)


def test_silent_errors_move_no_words(spark):
    """Words and their readings lie in one line, so there is nothing to shuffle but small inputs dealt over the cores."""
    plan = catalog.QUERIES["silent_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_overlap_pairs_across_blocks(spark, duck, tmp_path):
    """Lines at the edges of blocks, and a text line that runs into the next one's numbers, against the SQL; lines are moved once."""
    text = " ".join("abcdefg"[: 1 + k * k % 7] for k in range(12100)) + "\nab cde f\n\nx yz"
    spark.createDataFrame([(1, text), (2, "a b c"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = catalog.QUERIES["flag_overlap_pairs"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    # in the SQL, words of lines that share a number have no order; those lines are left out of the comparison
    shared = lambda row: row[0] == 1 and (row[1] in (999, *range(1000, 1010)) or row[3] in range(1000, 1010))
    mine, theirs = ([tuple(row) for row in rows if not shared(tuple(row))] for rows in (df.collect(), con.execute(catalog.ORACLE["flag_overlap_pairs"]).fetchall()))
    assert sorted(mine) == sorted(theirs) and any(row[1] % 50 == 24 and row[3] == row[1] + 1 for row in mine)
