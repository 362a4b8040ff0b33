"""Sharding by balanced label propagation under the law ``rows``: counts at most one apart.

Linked documents (equal texts) are the members of a group, so a group's row stands for its links.
The state is (group, shard, n). In every round each group wants its members in the shard that holds
most of them; from the 8 x 8 table of wanted moves the driver takes quotas that no shard's capacity
is exceeded by, and the movers are joined with their place in the queue, largest groups first, and
cut at the quota. When nothing moves any more, what still exceeds a capacity is handed on, and
documents without links fill what room is left, so the counts come out exactly.

Only tables of shards x shards, and of queue blocks, reach the driver or a broadcast. A group of a
third of all rows is counted before the shuffle, its members are ranked in blocks, and it is spread
over as few shards as hold it.

Nulls: a null text has no bytes (size 1, crc32 0) and links with empty ones; null ids are kept.
Repeated rows are members like any other. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, documents, partitions, row_key

SHARDS, ROUNDS = 8, 6
#: While moving, a shard may exceed its capacity by one part in so many; what is over is handed on at the end.
SLACK = 10


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The moves allowed from shard to shard: at most ``wanted``, and net of what leaves at most ``room``."""
    flow = wanted.astype(float)
    for _ in range(200):
        over = flow.sum(0) - flow.sum(1) - room
        if (over <= 0.5).all():
            break
        into = flow.sum(0)
        flow *= np.where(over > 0, np.maximum(0, 1 - over / np.maximum(into, 1e-9)), 1)[None, :]
    flow = np.floor(flow + 1e-9).astype(np.int64)
    while ((over := flow.sum(0) - flow.sum(1) - room) > 0).any():
        b = int(over.argmax())
        if not flow[:, b].any():
            break
        s = int(flow[:, b].argmax())
        flow[s, b] -= min(flow[s, b], over[b])
    return flow


def queued(units: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """``units`` (g, n, ...) with ``before``: the sum of n ahead in the queue of its ``by``.

    The queue goes by size class, larger first, then by hash blocks; only the blocks' sums are summed
    in one place."""
    placed = units.withColumn("block", F.expr(f"(64 - length(bin(n))) * {blocks} + pmod(xxhash64(g), {blocks})"))
    part = ", ".join([*by, "block"])
    inner = placed.withColumn("inner", F.expr(f"sum(n) over (partition by {part} order by n desc, g rows between unbounded preceding and current row) - n"))
    sums = placed.groupBy(*by, "block").agg(F.sum("n").alias("m"))
    ahead = sums.select(*by, "block", F.expr(f"sum(m) over (partition by {', '.join(by)} order by block rows between unbounded preceding and current row) - m").alias("ahead"))
    return inner.join(Stored(ahead).small(), [*by, "block"]).withColumn("before", F.expr("inner + ahead")).drop("block", "inner", "ahead")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table of at most shards x shards rows."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _loads(state: DataFrame, shards: int) -> np.ndarray:
    held = np.zeros(shards, np.int64)
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        held[r.shard] = r.n
    return held


def propagate(state: DataFrame, room_of: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(g, shard, n) of linked groups after label propagation; no shard above its capacity."""
    spark, shards = state.sparkSession, len(room_of)
    blocks = 4 * partitions(spark)
    now, weight = Stored(state).df, np.ones(shards)
    for _ in range(rounds):
        weighed = f"n * element_at(array({', '.join(f'{x:.6f}D' for x in weight)}), shard + 1)"
        best = Stored(now.groupBy("g").agg(F.expr(f"max(struct({weighed} as w, xxhash64(g, shard) as tie, shard)).shard").alias("best"), F.sum("n").alias("all"))).df
        claimed = np.zeros(shards)
        for r in best.groupBy("best").agg(F.sum("all").alias("n")).collect():
            claimed[r.best] = r.n
        # shards that too many ask for weigh less in the next round, as far as there is no room for all
        weight = np.clip(weight * np.sqrt((room_of + 1) / np.maximum(claimed, room_of / 2 + 1)), 0.2, 5) if (claimed > room_of).any() else weight
        movers = Stored(now.join(best, "g").where("shard <> best")).df
        wanted = np.zeros((shards, shards), np.int64)
        for r in movers.groupBy("shard", "best").agg(F.sum("n").alias("n")).collect():
            wanted[r.shard, r.best] = r.n
        flow = quotas(wanted, np.maximum(room_of + room_of // SLACK - _loads(now, shards), 0))
        if not flow.any():
            break
        allowed = _table(spark, [(s, b, int(flow[s, b])) for s in range(shards) for b in range(shards) if flow[s, b] > 0], "shard int, best int, quota long")
        moved = queued(movers, ["shard", "best"], blocks).join(allowed, ["shard", "best"]).withColumn("amount", F.expr("greatest(0L, least(n, quota - before))")).where("amount > 0")
        moved = Stored(moved.select("g", "shard", "best", "amount")).df
        change = moved.select("g", "shard", F.expr("-amount as n")).union(moved.select("g", "best", "amount"))
        now = Stored(now.select("g", "shard", "n").union(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")).df
    held = _loads(now, shards)
    over = np.maximum(held - room_of, 0)
    if over.any():
        now = _hand_on(now, over, np.maximum(room_of - held, 0), blocks)
    return now


def _hand_on(state: DataFrame, over: np.ndarray, room: np.ndarray, blocks: int) -> DataFrame:
    """What exceeds capacities goes to shards with room: exact, cut from the end of each queue."""
    spark = state.sparkSession
    held = _loads(state, len(over))
    pieces, s_at, b_at = [], 0, 0
    left, free = over.copy(), room.copy()
    done = np.zeros_like(over)
    while s_at < len(over) and b_at < len(room):
        if not left[s_at]:
            s_at += 1
        elif not free[b_at]:
            b_at += 1
        else:
            n = min(left[s_at], free[b_at])
            lo = held[s_at] - over[s_at] + done[s_at]
            pieces.append((s_at, int(lo), int(lo + n), b_at))
            done[s_at] += n
            left[s_at] -= n
            free[b_at] -= n
    cuts = _table(spark, pieces, "shard int, lo long, hi long, target int")
    placed = queued(state, ["shard"], blocks)
    moved = Stored(placed.join(cuts, "shard").withColumn("amount", F.expr("greatest(0L, least(before + n, hi) - greatest(before, lo))")).where("amount > 0").select("g", "shard", "target", "amount")).df
    change = moved.select("g", "shard", F.expr("-amount as n")).union(moved.select("g", "target", "amount"))
    return Stored(state.select("g", "shard", "n").union(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")).df


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, k, rep, size, text_crc32, shard, slot) of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", row_key().alias("k"), F.unhex(F.md5(text)).alias("g"), F.expr("cast(coalesce(octet_length(text), 0) + 1 as bigint)").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "k", "g", "size", "text_crc32").agg(F.count("*").alias("m"))
    # members are counted and ranked in blocks, so that no task gets a whole group
    blocks = 4 * partitions(spark)
    members = Stored(counted.select("doc_id", "k", "g", "size", "text_crc32", F.expr("explode(sequence(1L, m))").alias("rep")).withColumn("h", F.expr("xxhash64(k, rep)")).withColumn("b", F.expr(f"cast(pmod(xxhash64(h), {blocks}) as int)"))).df
    held = Stored(members.groupBy("g", "b", F.expr(f"cast(pmod(h, {shards}) as int)").alias("shard")).agg(F.count("*").alias("n"))).df
    linked = held.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    start = Stored(held.groupBy("g", "shard").agg(F.sum("n").alias("n"))).df
    total = int(start.agg(F.sum("n")).first()[0] or 0)
    room_of = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    settled = propagate(start.join(linked, "g", "left_semi"), room_of)
    # documents without links are one group, named by the empty key, that fills the room left
    free = room_of - _loads(settled, shards)
    rest = spark.createDataFrame([(bytearray(), s, int(free[s])) for s in range(shards) if free[s] > 0], "g binary, shard int, n long")
    parts = settled.select("g", "shard", "n").union(rest)
    ranges = parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("p")).select(
        "g", F.expr("transform(p, (x, i) -> struct(x.shard as shard, aggregate(slice(p, 1, i + 1), 0L, (a, y) -> a + y.n) as upto))").alias("p"))
    of_linked = held.select("g", "b").distinct().join(linked, "g").withColumn("linked", F.lit(True))
    grouped = members.join(of_linked, ["g", "b"], "left").withColumn("g", F.expr("if(linked, g, cast('' as binary))")).drop("linked")
    grouped = Stored(grouped).df
    each = grouped.groupBy("g", "b").agg(F.count("*").alias("m"))
    ahead = each.select("g", "b", F.expr("sum(m) over (partition by g order by b rows between unbounded preceding and current row) - m").alias("ahead"))
    local = grouped.withColumn("r", F.expr("row_number() over (partition by g, b order by h, k, rep) - 1"))
    placed = local.join(ahead.join(ranges, "g"), ["g", "b"]).withColumn("r", F.expr("r + ahead"))
    placed = Stored(placed.select("doc_id", "k", "rep", "h", "size", "text_crc32", F.expr("element_at(filter(p, x -> r < x.upto), 1).shard").alias("shard"), "b")).df
    sums = placed.groupBy("shard", "b").agg(F.count("*").alias("m"))
    before = Stored(sums.select("shard", "b", F.expr("sum(m) over (partition by shard order by b rows between unbounded preceding and current row) - m").alias("ahead")))
    slotted = placed.withColumn("r", F.expr("row_number() over (partition by shard, b order by h, k, rep) - 1")).join(before.small(), ["shard", "b"])
    return slotted.select("doc_id", "k", "rep", "size", "text_crc32", "shard", F.expr("cast(r + ahead as bigint)").alias("slot"))


def sharded(docs: DataFrame) -> DataFrame:
    """The assignment with its law: counts at most one apart."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.expr("cast(null as int)").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents."""
    return sharded(documents(spark, sf_dir))
