"""Sharding (operator 7): balanced label propagation over documents of equal text. Native: no Python on executors.

Law `rows`: the shards' row counts differ by one at most. Documents start in shards by rank, so
that every shard is full from the start. Documents of equal text are linked; the propagation works
on (group, shard) counts, so a group costs at most one row a shard however many documents it has.
In each round a join tells every group's rows the label that most of their neighbours have; rows
of a smaller label move there as far as the quotas go: full shards exchange linked rows (along
cycles of shards), and unlinked rows make room where a shard has them. Every move brings rows to
where at least as many of their group are, so the sum of the squares of the counts grows and the
rounds end. When nothing moves any more, groups that are still in several shards are laid anew into
the places that whole groups leave, those of up to SMALL rows by size, the largest first, as many
whole ones to a shard as fit; only what fits no shard is laid one after another and cut at the ends
of shards. Then linked documents take their group's places by rank, and unlinked ones fill what is left.

All ranks are two-level (counts of salts, then ranks within a salt) and large groups are joined by
broadcast (common.join_hot), so neither a hot group nor a shard meets in one task. Collected: a row
a shard or pair of shards, and the keys of large groups, at most four a partition.

Defined cases: a null text has size 1, the checksum of nothing and no links; an empty text links
with other empty texts; repeated rows are linked documents; a null doc_id takes its place as any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
SMALL = 1000  # rows of a group that is placed by its size


def stepped(value: Column, ends: list[int]) -> Column:
    """The index of the first end above the value."""
    return reduce(lambda rest, i: F.when(value < ends[i], F.lit(i)).otherwise(rest), range(len(ends) - 1, -1, -1), F.lit(len(ends) - 1)).cast("int")


def cycle(left: list[list[int]]) -> list[int] | None:
    """The nodes of a shortest cycle through a move between two shards; the last node is none of them."""
    n, best = len(left), None
    for s in range(n - 1):
        before, todo = {s: s}, [s]
        for a in todo:
            for b in range(n):
                if left[a][b] > 0 and b not in before and (a, b) != (s, n - 1):  # starts with a move to a shard
                    before[b] = a
                    todo.append(b)
        for t in todo[1:]:
            if left[t][s] > 0:
                path = [t]
                while path[-1] != s:
                    path.append(before[path[-1]])
                if best is None or len(path) < len(best):
                    best = path[::-1]
                break
    return best


def circulation(demand: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the rows that ask to move between two shards may: every shard stays at its quota."""
    n = len(room)
    # Node n stands for unlinked rows: room[t] of them can leave t, and any shard takes one for a linked row.
    left = [[*row, room[t]] for t, row in enumerate(demand)] + [[sum(map(sum, demand))] * n + [0]]
    flow = [[0] * (n + 1) for _ in range(n + 1)]
    while path := cycle(left):
        edges = list(zip(path, path[1:] + path[:1], strict=True))
        size = min(left[a][b] for a, b in edges)
        for a, b in edges:
            left[a][b] -= size
            flow[a][b] += size
    return flow


def running(rows: DataFrame, group: list[str], salts: int, what: str = "n") -> DataFrame:
    """Adds lo, the sum of `what` of the group's rows before each: by salt, then within the salt."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("g1", "g2", "n"), F.lit(salts)).cast("int"))
    ahead = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "salt").agg(F.sum(what).alias("sum")).select(*group, "salt", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*group, "salt").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mine", F.coalesce(F.sum(what).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), [*group, "salt"]).withColumn("lo", F.col("ahead") + F.col("mine")).drop("salt", "ahead", "mine")  # a row a group and salt: pairs of shards, or SMALL sizes


def propagated(state: DataFrame, quotas: list[int]) -> DataFrame:
    """state(g1, g2, shard, n) -> the same after label propagation."""
    spark = state.sparkSession
    salts, shards = 2 * common.partitions(spark), len(quotas)
    for i in itertools.count():
        # Equal counts fall to another label in each round, so that moves in both directions meet.
        label = state.groupBy("g1", "g2").agg(F.max(F.struct("n", F.xxhash64("g1", "g2", "shard", F.lit(i)).alias("h"), F.col("shard").alias("s"))).alias("m")).select("g1", "g2", F.col("m.s").alias("label"))
        wants = common.publish(state.join(label, ["g1", "g2"]).where("label <> shard"), "wants")
        demand = [[0] * shards for _ in range(shards)]
        for r in wants.groupBy("shard", "label").agg(F.sum("n").alias("n")).collect():  # a row a pair of shards
            demand[r["shard"]][r["label"]] = r["n"]
        used = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        flow = circulation(demand, [q - used.get(s, 0) for s, q in enumerate(quotas)])
        if not any(flow[s][t] for s in range(shards) for t in range(shards)):
            break
        most = F.element_at(F.array(*(F.lit(flow[s][t]) for s in range(shards) for t in range(shards))), (F.col("shard") * shards + F.col("label") + 1).cast("int"))
        moves = running(wants, ["shard", "label"], salts)
        moves = moves.withColumn("take", F.least(F.col("n"), most - F.col("lo"))).where("take > 0").select("g1", "g2", "shard", "label", "take")
        change = moves.select("g1", "g2", "shard", (-F.col("take")).alias("n")).union(moves.select("g1", "g2", F.col("label").alias("shard"), F.col("take").alias("n")))
        state = state.select("g1", "g2", "shard", "n").union(change).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        state = common.publish(state, "state")
    return state


def one_after_another(groups: DataFrame, free: dict[int, int]) -> DataFrame:
    """(g1, g2, n) -> (g1, g2, shard, n): groups in a row over the free places, cut where a shard ends."""
    places, end = [], 0
    for s, f in sorted(free.items(), key=lambda x: (-x[1], x[0])):
        places.append((s, end, end + f))
        end += f
    rows = running(groups.withColumn("all", F.lit(0)), ["all"], 2 * common.partitions(groups.sparkSession))
    size = lambda a, b: F.least(F.col("lo") + F.col("n"), F.lit(b)) - F.greatest(F.col("lo"), F.lit(a))
    parts = rows.select("g1", "g2", F.explode(F.array(*(F.struct(F.lit(s).alias("shard"), size(a, b).alias("n")) for s, a, b in places))).alias("p"))
    return parts.select("g1", "g2", "p.shard", F.col("p.n").cast("long").alias("n")).where("n > 0")


def laid(state: DataFrame, quotas: list[int]) -> DataFrame:
    """Lays groups in several shards anew into what whole groups leave, if that cuts less."""
    spark = state.sparkSession
    marked = common.publish(state.withColumn("shards", F.count(F.lit(1)).over(Window.partitionBy("g1", "g2"))), "marked")
    whole, cut = marked.where("shards = 1").drop("shards"), marked.where("shards > 1").drop("shards")
    before = cut.select("g1", "g2").distinct().count()
    if not before:
        return state
    used = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    free = {s: q - used.get(s, 0) for s, q in enumerate(quotas)}
    groups = common.publish(cut.groupBy("g1", "g2").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), "cut")
    large = groups.where(F.col("n") > SMALL)
    spare, fits = sum(free.values()) - (large.agg(F.sum("n").alias("n")).first()["n"] or 0), []
    for r in groups.where(F.col("n") <= SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n")).collect():  # SMALL rows
        at = 0
        for s in sorted(free, key=lambda s: (free[s] % r["n"], -free[s], s)):  # shards that such groups fill first
            take = min(r["groups"] - at, free[s] // r["n"], spare // r["n"])
            if take > 0:
                fits.append((r["n"], at, at + take, s))
                at, free[s], spare = at + take, free[s] - take * r["n"], spare - take * r["n"]
    table = F.broadcast(spark.createDataFrame(fits, "size long, a long, b long, shard int"))  # SMALL * shards rows
    numbered = running(groups.where(F.col("n") <= SMALL), ["n"], 2 * common.partitions(spark), "one")
    small = common.publish(numbered.join(table, (F.col("n") == F.col("size")) & (F.col("lo") >= F.col("a")) & (F.col("lo") < F.col("b")), "left").select("g1", "g2", "shard", "n"), "placed")
    rest = one_after_another(small.where("shard is null").select("g1", "g2", "n").union(large.select("g1", "g2", "n")), free)
    new = common.publish(small.where("shard is not null").union(rest), "laid")
    after = new.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("shards")).where("shards > 1").count()
    return common.publish(whole.select("g1", "g2", "shard", "n").union(new), "state") if after < before else state


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    bytes_ = F.coalesce(text, F.lit("")).cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("g1"),
        F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("g2"),
    )
    base = common.publish(base, "texts")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("g1"), F.col("g2")]
    base = common.publish(common.ranked(base, [], order, "rank").withColumn("init", F.pmod("rank", F.lit(shards)).cast("int")).drop("rank"), "started")

    counts = base.where("g1 is not null").groupBy("g1", "g2", F.col("init").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g1", "g2")
    state = counts.withColumn("all", F.sum("n").over(group)).where("all > 1").drop("all")
    state = laid(propagated(common.publish(state, "state"), quotas), quotas)

    before = group.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = state.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0))).select("g1", "g2", "shard", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    linked_groups = state.groupBy("g1", "g2").agg(F.sum("n").alias("linked"))
    marked = common.publish(common.join_hot(base, linked_groups, ["g1", "g2"], "left"), "marked")
    linked = common.publish(common.ranked(marked.where("linked is not null"), ["g1", "g2"], order, "rank"), "linked")
    linked = common.join_hot(linked, ranges, ["g1", "g2"]).where("rank >= lo and rank < hi").select("doc_id", "size", "text_crc32", "shard")
    used = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    ends, end = [], 0
    for s, q in enumerate(quotas):
        end += q - used.get(s, 0)
        ends.append(end)
    single = common.ranked(marked.where("linked is null"), [], order, "rank").select("doc_id", "size", "text_crc32", stepped(F.col("rank"), ends).alias("shard"))
    placed = common.publish(linked.union(single), "placed")
    out = common.ranked(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"))
