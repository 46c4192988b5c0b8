"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas, counts kept even.

Documents that share a link (here: equal texts) are neighbours. All neighbours of one link that are in one shard see the
same, so they move as one block: the state is a table (link, shard, documents), never a list of pairs. In each round every
link looks for its strongest blocks in shards that have room (one, or as many as its size needs; documents without links give
way at no cost); its weaker blocks ask to move there; a shard admits requests up to its quota, in a fixed pseudo-random order, blocks being split where the
quota ends. Rounds end when nothing moves, or after `rounds` of them; `cut_edges` tells what is left between shards.

Then documents take the places of their link's blocks, at most a shard's quota of them, and all others fill up the shards:
counts differ by one at most (the law `rows`).

Scale: rounds work on blocks, at most 40 a link; places are found by ranks.ranked, so no link, however large, and no shard is
ever in one task. The driver holds one number per shard. Links here are cliques, so a link's sum over its blocks is all that a
document's neighbours say: rounds join links with their blocks, not documents with each neighbour.

Defined cases: null texts are like empty ones and linked with them; null or repeated ids are rows like others (each gets a
place; rows with equal ids and texts may change places with each other); how the rows are partitioned changes nothing; ties are broken by hashes; fewer rows than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import scratch
from quire.llm.ranks import ranked

SHARDS = 40
ROUNDS = 8
BUCKETS = 256
ROWS_A_BUCKET = 100_000


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast("array<long>"), shard.cast("int") + 1)


def _before(requests: DataFrame) -> DataFrame:
    """requests with `before`: the documents that ask for the same shard ahead of each request, by a fixed order."""
    dealt = requests.withColumn("b", F.pmod(F.xxhash64("link", "shard"), F.lit(BUCKETS)).cast("int"))
    own = Window.partitionBy("to", "b").orderBy("link", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = Window.partitionBy("to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("to", "b").agg(F.sum("n").alias("s")).select("to", "b", F.coalesce(F.sum("s").over(base), F.lit(0)).alias("base"))
    return dealt.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(sums, ["to", "b"]).withColumn("before", F.col("own") + F.col("base")).drop("b", "own", "base")


def _round(blocks: DataFrame, room: list[int], quota: int) -> DataFrame:
    """Blocks after one round, with `moved` documents that came to each."""
    strength = F.struct(F.col("n").alias("n"), F.xxhash64("link", "shard").alias("h"), F.col("shard").alias("shard"))
    # a link's blocks, strongest first: one for each shard at most
    of_link = blocks.groupBy("link").agg(F.sort_array(F.collect_list(strength), asc=False).alias("all"), F.sum("n").alias("total"))
    homes = F.ceil(F.col("total") / max(quota, 1)).cast("int")  # as many shards as the link needs
    roomy = lambda x: F.filter(x, lambda b: _by_shard(room, b["shard"]) > 0)
    near = roomy(F.slice("all", 1, F.col("homes")))
    goals = F.when(F.size(near) > 0, near).otherwise(F.slice(roomy(F.col("all")), 1, 1))
    asked = of_link.withColumn("homes", homes).withColumn("goals", goals).select("link", "homes", "goals", F.posexplode("all").alias("j", "b"))
    goal = F.when(F.size("goals") > 0, F.element_at("goals", F.col("j") % F.greatest(F.size("goals"), F.lit(1)) + 1))
    asked = asked.withColumn("goal", goal).withColumn("asks", F.coalesce((F.col("j") >= F.col("homes")) & (F.col("goal") > F.col("b")), F.lit(False)))
    asked = asked.select("link", "b.shard", "b.n", "asks", F.col("goal.shard").alias("to"))
    requests = _before(asked.where("asks").select("link", "shard", "n", "to"))
    admitted = F.greatest(F.lit(0), F.least(F.col("n"), _by_shard(room, F.col("to")) - F.col("before")))
    requests = requests.withColumn("m", admitted)
    stay = asked.where(~F.col("asks")).select("link", "shard", "n", F.lit(0).cast("long").alias("moved"))
    left = requests.select("link", "shard", (F.col("n") - F.col("m")).alias("n"), F.lit(0).cast("long").alias("moved"))
    come = requests.select("link", F.col("to").alias("shard"), F.col("m").alias("n"), F.col("m").alias("moved"))
    return stay.union(left).union(come).where("n > 0").groupBy("link", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"))


def _loads(blocks: DataFrame, shards: int) -> tuple[list[int], int]:
    got = blocks.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).collect()
    loads = [0] * shards
    for r in got:
        loads[r["shard"]] = int(r["n"])
    return loads, sum(int(r["moved"]) for r in got)


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Written blocks (link, shard, n) of links (link, n), each with two documents or more."""
    shards = len(quota)
    start = F.explode(F.sequence(F.lit(0), F.least("n", F.lit(shards)).cast("int") - 1))
    blocks = links.select("link", "n", start.alias("i")).select("link", F.pmod(F.xxhash64("link") + F.col("i"), F.lit(shards)).cast("int").alias("shard"), (F.floor(F.col("n") / shards) + (F.col("i") < F.col("n") % shards).cast("long")).cast("long").alias("n"), F.lit(0).cast("long").alias("moved"))
    blocks = scratch.write(blocks, "blocks")
    loads, _ = _loads(blocks, shards)
    for _ in range(rounds):
        after = scratch.write(_round(blocks, [max(q - x, 0) for q, x in zip(quota, loads)], max(quota)), "blocks")
        scratch.drop(blocks)
        blocks = after
        loads, moved = _loads(blocks, shards)
        if not moved:
            break
    return blocks.select("link", "shard", "n")


def place(rows: DataFrame, order: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (written, with column link; order tells rows apart, or they are alike) with shard and slot."""
    counts = rows.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    buckets = max(512, total // ROWS_A_BUCKET)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    blocks = propagate(counts.where("n > 1"), quota, rounds)
    first = Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.withColumn("start", F.coalesce(F.sum("n").over(first), F.lit(0))).groupBy("link").agg(F.sort_array(F.collect_list(F.struct("start", "shard"))).alias("ranges"))
    ranges = scratch.write(ranges, "ranges")
    # of a link's ranges the last that starts at or before a document's place
    mine = F.element_at(F.filter("ranges", lambda r: r["start"] <= F.col("_place")), -1)["shard"]
    tried = ranked(rows, ["link"], order, "_place", buckets).join(ranges, "link", "left").withColumn("_to", F.when(F.col("ranges").isNotNull(), mine)).drop("ranges", "_place")
    tried = scratch.write(tried, "tried")
    linked = scratch.write(ranked(tried.where("_to is not null"), ["_to"], order, "_place", buckets), "linked")
    full = _by_shard(quota, F.col("_to"))
    kept = linked.where(F.col("_place") < full)
    held = [0] * shards
    for r in kept.groupBy("_to").count().collect():
        held[r["_to"]] = r["count"]
    rest = tried.where("_to is null").unionByName(linked.where(F.col("_place") >= full).drop("_place")).withColumn("_all", F.lit(0))
    ends = list(accumulate(q - h for q, h in zip(quota, held)))
    starts = [e - (q - h) for e, q, h in zip(ends, quota, held)]
    # the shard whose free places hold a row's rank: as many shards as end at or before it precede
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<long>"), lambda e: e <= F.col("_place")))
    filled = ranked(rest, ["_all"], order, "_place", buckets).withColumn("shard", shard).withColumn("slot", F.col("_place") - _by_shard(starts, F.col("shard")) + _by_shard(held, F.col("shard")))
    own = [c for c in rows.columns]
    return kept.select(*own, F.col("_to").alias("shard"), F.col("_place").cast("long").alias("slot")).union(filled.select(*own, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")))


def cut_edges(placed: DataFrame, link: str = "text_crc32") -> DataFrame:
    """One row: edges between documents of one link, and those of them whose ends are in different shards."""
    pairs = lambda n: n * (n - 1) / 2
    of_shard = placed.groupBy(link, "shard").agg(F.count(F.lit(1)).alias("n"))
    of_link = of_shard.groupBy(link).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("inside"))
    sums = of_link.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("edges"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"))
    return sums.select(F.col("edges").cast("long").alias("edges"), (F.col("edges") - F.col("inside")).cast("long").alias("cut"))


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The id, size (bytes of the text and 16), text_crc32, law, shard, slot and grown_shard (null under this law) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("given"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("link"))
    placed = place(scratch.write(rows, "rows"), ["given", "link"], shards, rounds)
    return placed.select(F.col("given").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
