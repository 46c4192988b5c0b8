"""Filters of what detectors find: text boxes, cells of tables, bars, graphics, style candidates; and the undo history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import spatial
from quire.operators.kernels import BOXES

# Fixed values.
BOX_SCORE, UNCLIP, LEAST_SIDE, LEAST_GROWN, LEAST_POINTS = 0.55, 1.6, 2, 5, 4
TABLE_W, TABLE_H, CELL_FILL, LEAST_CELL = 80, 40, 0.7, 12
BAR_W, BAR_H, BAR_TRANSITIONS, BAR_CORR = 60, 20, 30, 0.8
GRAPHIC_SIDE, GRAPHIC_FILL, IN_BAR, IN_WORD = 2.2, 0.3, 0.5, 0.6


def is_text(score: Column, points: Column, w: Column, h: Column) -> Column:
    """Whether a contour is a text box: its score, its points, its sides, and its sides once grown by area over outline (F1)."""
    grow = w * h * UNCLIP / ((w + h) * 2)
    side = F.least(w, h)
    return (points >= LEAST_POINTS) & (side >= LEAST_SIDE) & (score >= BOX_SCORE) & (side + grow * 2 >= LEAST_GROWN)


def two_scales(large: DataFrame, small: DataFrame, key: str, most: float = 0.25) -> DataFrame:
    """(key, scale, ord) of all boxes of the first scale, and of those of the second that lie beside all kept so far, in order."""

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        first, second = a[BOXES].to_numpy(float), b.sort_values("ord")
        both = np.concatenate([first, second[BOXES].to_numpy(float)])
        area = np.maximum((both[:, 2] - both[:, 0]) * (both[:, 3] - both[:, 1]), 1)
        # only boxes of the same bands of the page can overlap
        band = max(float((both[:, 3] - both[:, 1]).max(initial=1)), 1.0)
        spans = np.floor(both[:, [1, 3]] / band).astype(int).tolist()
        rows: dict[int, list[int]] = {}

        def keep(k: int) -> None:
            for r in range(spans[k][0], spans[k][1] + 1):
                rows.setdefault(r, []).append(k)

        for k in range(len(first)):
            keep(k)
        out = [(k, 0, o) for k, o in zip(a[key], a["ord"])]
        for n, (k, o) in enumerate(zip(second[key], second["ord"]), len(first)):
            near = [x for r in range(spans[n][0], spans[n][1] + 1) for x in rows.get(r, ())]
            sides = np.minimum(both[n, 2:], both[near, 2:]) - np.maximum(both[n, :2], both[near, :2])
            if (np.clip(sides, 0, None).prod(1) < most * np.minimum(area[n], area[near])).all():
                keep(n)
                out.append((k, 1, o))
        return pd.DataFrame(out, columns=[key, "scale", "ord"])

    return large.groupBy(key).cogroup(small.groupBy(key)).applyInPandas(run, f"{key} long, scale long, ord long")


def centres(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, k, centre: means of clusters of values no farther apart than the tolerance from the last."""
    w = Window.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(w)
    marked = df.select(*keys, value).withColumn("_new", (gap.isNull() | (gap > tolerance)).cast("long"))
    numbered = marked.withColumn("k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "k").agg(F.avg(F.col(value).cast("double")).alias("centre"))


def nearest_centre(df: DataFrame, keys: list[str], value: str, name: str, tolerance: float = 6) -> DataFrame:
    """df with `name`: the number of the nearest cluster centre of a value, the first of equally near ones."""
    cs = centres(df, keys, value, tolerance).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "centre"))).alias("_cs"))
    best = F.array_min(F.transform("_cs", lambda c: F.struct(F.abs(c["centre"] - F.col(value)).alias("d"), c["k"].alias("k"))))
    return df.join(cs, keys).withColumn(name, best["k"]).drop("_cs")


def cell_holds(cell: Column, outer: Column, area: Column) -> Column:
    """Whether a part of a grid is a cell: large enough, off the outer edge, and full."""
    w, h = G.width(cell), G.height(cell)
    inside = (cell["x0"] > outer["x0"]) & (cell["y0"] > outer["y0"]) & (cell["x1"] < outer["x1"]) & (cell["y1"] < outer["y1"])
    return (w >= LEAST_CELL) & (h >= LEAST_CELL) & inside & (area >= w * h * CELL_FILL)


def is_table(outer: Column, row_rules: Column, column_rules: Column, cells: Column) -> Column:
    """Whether a grid is a table or a frame of cells."""
    return (G.width(outer) >= TABLE_W) & (G.height(outer) >= TABLE_H) & (row_rules >= 2) & (column_rules >= 2) & (cells >= 2)


def is_bar(w: Column, h: Column, transitions: Column, corr: Column, least: tuple[float, ...] = (BAR_W, BAR_H, BAR_TRANSITIONS, BAR_CORR)) -> Column:
    """Whether a region is a barcode: its size, the fewest transitions of its scan lines, and profiles that agree."""
    return (w >= least[0]) & (h >= least[1]) & (transitions >= least[2]) & (F.coalesce(corr, F.lit(-1.0)) >= least[3])


def graphics(found: DataFrame, bars: DataFrame, words: DataFrame, keys: list[str], text_height: Column) -> DataFrame:
    """Components (box a, area) that are graphics: large, filled, and neither in a bar nor in a word, both with box b (F8)."""
    a, b = F.col("a"), F.col("b")
    large = found.where((G.width(a) >= text_height * GRAPHIC_SIDE) & (G.height(a) >= text_height * GRAPHIC_SIDE) & (F.col("area") >= G.area(a) * GRAPHIC_FILL))
    own = [c for c in found.columns if c not in ("a", "area")]
    out = large
    for other, most in ((bars, IN_BAR), (words, IN_WORD)):
        hit = spatial.overlap_join(large, other, keys).where(G.overlap_fraction(a, b) > most).select(*own).distinct()
        out = out.join(hit, own, "left_anti")
    return out


def candidates(df: DataFrame, keys: list[str], pool: int = 6, shown: int = 4) -> DataFrame:
    """Candidates (family, bold, score, ord) to look at again: the best few, and the other weight of the best family.

    place is that by score; shown holds for the first few (T7).
    """
    w = Window.partitionBy(*keys).orderBy("score", "ord")
    ranked = df.withColumn("place", F.row_number().over(w).cast("long")).withColumn("_family", F.first("family").over(w)).withColumn("_bold", F.first("bold").over(w))
    other = (F.col("family") == F.col("_family")) & (F.col("bold") != F.col("_bold"))
    first = F.row_number().over(Window.partitionBy(*keys, "family", "bold").orderBy("place"))
    out = ranked.withColumn("_first", first).where((F.col("place") <= pool) | (other & (F.col("_first") == 1)))
    return out.withColumn("shown", F.col("place") <= shown).drop("_family", "_bold", "_first")


def history(ops: DataFrame, key: str, order: list[str], limit: int = 200) -> DataFrame:
    """key, current, n_undo, n_redo after an ordered log of ops: a version (text), `undo`, or `redo`.

    A change puts the version before it on the undo stack, of which the last `limit` stay, and clears the redo stack.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("now"), empty.alias("undo"), empty.alias("redo"))
    top = lambda s: F.element_at(s, -1)
    rest = lambda s: F.slice(s, F.lit(1), F.size(s) - 1)

    def step(s: Column, op: Column) -> Column:
        made = lambda now, undo, redo: F.struct(now.alias("now"), undo.alias("undo"), redo.alias("redo"))
        grown = F.concat(s["undo"], F.array(s["now"]))
        kept = F.slice(grown, F.greatest(F.size(grown) - limit, F.lit(0)) + 1, F.lit(limit))
        back = F.when(F.size(s["undo"]) > 0, made(top(s["undo"]), rest(s["undo"]), F.concat(s["redo"], F.array(s["now"])))).otherwise(s)
        ahead = F.when(F.size(s["redo"]) > 0, made(top(s["redo"]), F.concat(s["undo"], F.array(s["now"])), rest(s["redo"]))).otherwise(s)
        return F.when(op == "undo", back).when(op == "redo", ahead).otherwise(made(op, kept, empty))

    log = ops.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "op"))), lambda x: x["op"]).alias("log"))
    s = F.aggregate("log", start, step)
    return log.select(key, s.alias("s")).select(key, F.col("s.now").alias("current"), F.size("s.undo").cast("long").alias("n_undo"), F.size("s.redo").cast("long").alias("n_redo"))
