"""MinHash near-duplicates from bottom-k sketches of one hash function; every link at the threshold is found.

1. Every text becomes its set of hashed word shingles; texts with equal sets are one class from here on, so exact copies
   cost one row each and are never paired. A class keeps its `RETAINED` smallest hashes, its sketch. Two alike sets share many
   of them (`shared_values`): in small sets at least so many as the threshold asks, in others so many that fewer would be
   `SLACK` standard deviations off.
2. Inverted lists: class by retained value. Classes with too few values in lists of two or more have no link.
   Of the others each list pairs its members with its first member and with the member that shares most; the union of the
   two sketches estimates the similarity, and exact Jaccard decides.
3. Components. A list whose members are in one component is done. Classes with enough values in lists of several components
   are looked at with their full sets: their values in such lists, rarest first, are their order, and two alike sets share a
   value early in both: one so late that fewer values follow than must be shared speaks for no pair. Members of long
   lists are compared in blocks. These pairs are estimated and verified in the same way, and join components.

Step 2 only saves work in step 3, which tries every pair of different components that can reach the threshold: no list is cut
and no class has a bound on its partners. What can still be missed is a pair whose sketches are off by more than eight standard
deviations. Work: a family of many texts from one template whose pairs are all near the threshold, and not linked through
others, takes as many comparisons as it has pairs.

Scale: all joins are on hashes of values or classes, a list's size comes from partial counts, long lists are dealt in blocks.
A sketch is a few hundred bytes; texts are shuffled once, to read the full sets of the classes that step 2 leaves. Nothing of
the corpus is collected.

Defined cases: null texts and texts without words have no shingles, their own id as component, and are linked with nothing;
texts with fewer words than a shingle are one shingle; a row with a null id is grouped by its text, and its component is the
smallest id there or null; repeated rows are equal texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm import scratch
from quire.llm.words import Texts, U, grams, lean, mix, pieces

RETAINED = 64
SLACK = 8.0
BLOCK = 256


def shingles(t: Texts, n: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted as signed 64-bit values."""
    h = t.word_hashes()
    g = grams(h, n).view(np.int64)
    out = []
    for first, count in zip(t.first.tolist(), t.count.tolist()):
        if count >= n:
            out.append(np.unique(g[first : first + count - n + 1]))
        elif count:
            out.append(grams(h[first : first + count], count).view(np.int64))
        else:
            out.append(g[:0])
    return out


def _key(s: np.ndarray) -> bytes:
    """A set's key: two sums of its mixed hashes."""
    u = s.view(U)
    return np.array([mix(u).sum(dtype=U), mix(u ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _each(batch: pa.RecordBatch, text: str, n: int):
    for a, b in pieces(batch, text):
        yield a, b, shingles(Texts(batch.column(text).slice(a, b - a), lower=True), n)


def shared_values(percent: int) -> int:
    """How many retained values two alike sets share at least, if neither is whole in its sketch.

    With the share p of its values in common, the l-th common one has the place l / p in a set, give or take SLACK times
    the square root of l (1 - p) / p^2; as long as that is within the sketch, all l are in it.
    """
    p = percent / 100
    return max([1, *(k for k in range(1, RETAINED + 1) if k / p + SLACK * (k * (1 - p)) ** 0.5 / p <= RETAINED)])


def _least(n: Column, percent: int) -> Column:
    """How many of its n values a set shares at least with any that is alike, whatever the other's size."""
    return F.floor((percent * n + 99) / 100)


def sketches(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """given, look (a hash of the text), n_shingles, key (null without shingles), low (the retained hashes, in order)."""
    slim = docs.select(F.col(id_col).alias("given"), F.xxhash64(text).alias("look"), F.col(text).alias("measured"))

    def run(batches):
        for batch in batches:
            for a, b, sets in _each(batch, "measured", n):
                low = [s[:RETAINED] for s in sets]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("given"), part.column("look"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.binary()), _lists(low)], names=schema.names)

    schema = StructType([slim.schema["given"], *StructType.fromDDL("look long, n_shingles long, key binary, low array<long>").fields])
    return slim.mapInArrow(lean(run), schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """node, full: the whole set of each wanted class (node, given, look, key), from a row with that id and text."""
    slim = docs.select(F.col(id_col).alias("given"), F.xxhash64(text).alias("look"), F.col(text).alias("measured"))
    same = (F.col("look") == F.col("_look")) & F.col("given").eqNullSafe(F.col("_given"))
    rows = slim.join(wanted.select("node", "key", F.col("given").alias("_given"), F.col("look").alias("_look")), same).select("node", "key", "measured")

    def run(batches):
        for batch in batches:
            for a, b, sets in _each(batch, "measured", n):
                part = batch.slice(a, b - a)
                own = [k for k, (x, s) in enumerate(zip(part.column("key").to_pylist(), sets)) if _key(s) == x]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own, pa.int64())), _lists([sets[k] for k in own])], names=["node", "full"])

    return rows.mapInArrow(lean(run), "node long, full array<long>").groupBy("node").agg(F.first("full").alias("full"))


def _compare(percent: int):
    """Marks pairs of full sets that are alike: first by the estimate from their sketches' union, then exactly."""
    least = max(percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / RETAINED) ** 0.5, 0.0)

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.concatenate([x, y])
        both.sort()
        return both, both[1:] == both[:-1]

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        if max(len(x), len(y)) > RETAINED:
            both, twice = shared(x[:RETAINED], y[:RETAINED])
            place = np.arange(len(twice)) - np.cumsum(twice) + twice  # of each value in the union
            if (twice & (place < RETAINED)).sum() < least * RETAINED:
                return False
        inter = int(shared(x, y)[1].sum())
        return 100 * inter >= percent * (len(x) + len(y) - inter)

    def run(batches):
        for batch in batches:
            left, right = batch.column("full_a"), batch.column("full_b")
            x, y = left.flatten().to_numpy(), right.flatten().to_numpy()
            xo, yo = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]).tolist() for c in (left, right))
            keep = [k for k in range(batch.num_rows) if alike(x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]])]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of the written links (a, b)."""
    both = scratch.write(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), label)
    state = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), label)
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = state.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        far = state.select(F.col("node").alias("at"), F.col("label").alias("ahead"))
        jumped = scratch.write(step.join(far, F.col("next") == F.col("at")).select("node", F.least("next", "ahead").alias("label"), (F.least("next", "ahead") != F.col("old")).alias("moved")), label)
        changed = jumped.where("moved").limit(1).count()
        scratch.drop(state)
        state = jumped
        if not changed:
            scratch.drop(both)
            return state.select("node", "label")


class Finder:
    """The steps over one corpus, with its written sketches."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, n: int, percent: int):
        self.percent = percent
        self.rows = scratch.write(sketches(docs, id_col, text, n), "sketches")
        found = self.rows.where(F.col("key").isNotNull())
        first = F.min(F.struct(F.col("given").isNull().alias("none"), "given", "look"))
        classes = found.groupBy("key").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("low").alias("low"))
        # numbers of written rows, so they stay as they are
        self.nodes = scratch.write(classes.select(F.monotonically_increasing_id().alias("node"), "key", "first.given", "first.look", "n", "low"), "classes")
        self.members = scratch.write(self.open_members(), "members")
        able = self.members.select("node").distinct()
        wanted = self.nodes.join(able, "node", "left_semi").select("node", "key", "given", "look")
        self.sets = scratch.write(_full_sets(docs, wanted, id_col, text, n), "sets")

    def fit(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def enough(self, n: Column) -> Column:
        """How many retained values a class shares at least with any alike, whose own must_share may be less."""
        return F.least(F.lit(shared_values(self.percent)), _least(_least(n, self.percent), self.percent))

    def open_members(self) -> DataFrame:
        """value, node, n, shares of the classes with enough values in lists of two members or more.

        shares: the sum of the sizes of a class's lists.
        """
        values = self.nodes.select("node", "n", F.explode("low").alias("value"))
        sizes = values.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        lists = scratch.write(values.join(sizes, "value").select("value", "node", "n", "size"), "lists")
        own = lists.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("shares"), F.first("n").alias("n")).where(F.col("c") >= self.enough(F.col("n")))
        return lists.select("value", "node").join(own.select("node", "n", "shares"), "node").select("value", "node", "n", "shares")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are alike, written."""
        side = lambda k: self.sets.select(F.col("node").alias(k), F.col("full").alias(f"full_{k}"))
        return scratch.write(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_compare(self.percent)), "a long, b long"), "links")

    def stars(self) -> DataFrame:
        """Candidate pairs: each list's first member, and the one that shares most, with all others of the list."""
        most = [F.max_by(c, "shares").alias(f"most_{c}") for c in ("node", "n")]
        heads = self.members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), *most).where("size > 1")
        each = F.explode(F.array(F.struct(F.col("head").alias("to"), F.col("head_n").alias("m")), F.struct(F.col("most_node").alias("to"), F.col("most_n").alias("m"))))
        pairs = self.members.join(heads, "value").select("node", "n", each.alias("x")).where((F.col("node") != F.col("x.to")) & self.fit("n", "x.m"))
        return pairs.select(F.least("node", "x.to").alias("a"), F.greatest("node", "x.to").alias("b")).distinct()

    def open_nodes(self, state: DataFrame) -> DataFrame:
        """node, n, label of the classes with enough values in lists of several components."""
        labelled = scratch.write(self.members.join(state, "node", "left").select("value", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
        # written, as Spark can only split a hot value's rows where both sides of the join are dealt for it
        mixed = scratch.write(labelled.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("value"), "mixed")
        own = labelled.join(mixed, "value", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("label").alias("label"))
        return own.where(F.col("c") >= self.enough(F.col("n"))).select("node", "n", "label")

    def entries(self, state: DataFrame) -> DataFrame:
        """Written rows (value, node, n, label, ahead, cap): the values by which a class can be alike to one of another component.

        ahead: how many values of its own the class can share from this one on; cap: the size of the largest set it can be
        alike to if they share none before.
        """
        full = self.sets.join(scratch.write(self.open_nodes(state), "nodes"), "node").select("node", "n", "label", F.explode("full").alias("value"))
        mixed = scratch.write(full.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("value", "size"), "mixed")
        held = full.join(mixed, "value")
        ahead = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), F.desc("value")))
        cap = F.floor(F.col("ahead") * (100 + self.percent) / self.percent + 1e-9) - F.col("n")
        ranked = held.select("value", "node", "n", "label", ahead.alias("ahead")).where(F.col("ahead") >= _least(F.col("n"), self.percent))
        rows = scratch.write(ranked.withColumn("cap", cap), "ranked")
        sizes = rows.groupBy("value").agg(F.min("n").alias("least"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("value", "least")
        return scratch.write(rows.join(sizes, "value").where("cap >= least").drop("least"), "entries")

    def across(self, state: DataFrame) -> DataFrame:
        """Candidate pairs: all of different components that can be alike."""
        rows = self.entries(state)
        each = rows.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"))
        lists = each.groupBy("value").agg(F.sum("c").alias("size"), F.max("c").alias("main_c"), F.max_by("label", "c").alias("main")).where("size > main_c")
        # of two members of different components one at least is outside the list's main component
        blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        dealt = rows.join(lists.select("value", "main", blocks(F.col("size") - F.col("main_c")).alias("across"), blocks(F.col("size")).alias("down")), "value")
        dealt = dealt.withColumn("other", F.col("label") != F.col("main")).withColumn("h", F.xxhash64("node", "value"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        named = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("n", "label", "cap")]
        left = dealt.where("other").select("value", F.pmod("h", "across").cast("int").alias("x"), every("down").alias("y"), F.col("node").alias("a"), *named("a"))
        right = dealt.select("value", every("across").alias("x"), F.pmod("h", "down").cast("int").alias("y"), F.col("node").alias("b"), "other", *named("b"))
        able = (F.col("n_b") <= F.col("cap_a")) & (F.col("n_a") <= F.col("cap_b")) & self.fit("n_a", "n_b")
        met = left.join(right, ["value", "x", "y"]).where((F.col("label_a") != F.col("label_b")) & (~F.col("other") | (F.col("a") < F.col("b"))) & able)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(state: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after more links: components of components."""
    at = lambda k: state.select(F.col("node").alias(k), F.col("label").alias(f"l_{k}"))
    named = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).distinct()
    over = components(scratch.write(named, "joins")).select(F.col("node").alias("old"), F.col("label").alias("new"))
    old = state.join(over, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return old.union(over.join(state, F.col("old") == F.col("node"), "left_anti").select("old", "new"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """The id, n_shingles, component_id (smallest id of the component) and kept of each row."""
    finder = Finder(docs, id_col, text, n, round(similarity * 100))
    state = scratch.write(components(finder.verified(finder.stars())), "state")
    more = finder.verified(finder.across(state))
    if more.limit(1).count():
        state = scratch.write(joined(state, more), "state")
    for t in (finder.members, finder.sets):
        scratch.drop(t)
    labelled = finder.nodes.select("node", "key", "given").join(state, "node", "left").select("key", "given", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("given").alias("component_id"))
    of_key = labelled.join(smallest, "label").select(F.col("key").alias("_key"), "component_id")
    rows = finder.rows.select("given", "n_shingles", "key").join(of_key, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("given")).otherwise(F.col("component_id"))
    return rows.select(F.col("given").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("given") == component, F.lit(False)).alias("kept"))
