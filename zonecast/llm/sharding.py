"""Balanced label propagation: linked documents move towards their neighbours' shards.

Documents of one group are linked to each other. Every linked document starts in a shard by
its number, which is balanced. In each round a group's members outside its fullest shard
want to join that one (while it has room; else the fullest one that has). Who moves is
decided under quotas for each pair of shards: as many as want to come back the other way,
and as many as the target has room for. When nobody moves any more, documents without links
fill the shards up, so counts are at most one apart whatever the groups are. A group larger
than a shard fills whole shards, one after the other.

Scale: rounds touch only linked documents, and of a group only its counts by shard. Numbers
within a key (who comes under a quota, slots) come from counts by hash bucket and a window
inside a bucket, so no shard and no group is sorted in one task. The driver sees a matrix of
shards by shards. Every round ends in a checkpoint.

Defined results for odd input: a null text counts as empty (size 1, checksum 0) and is equal
to an empty one; repeated rows are rows of their own; a null group has no links; an empty
table gives an empty result; columns named shard or slot are replaced, and names that start
with an underscore are internal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonecast.llm.batches import written

BUCKETS = 2048
MAX_ROUNDS = 32


def numbered(rows: DataFrame, keys: list[str], out: str = "_rank", uid: str = "_uid") -> DataFrame:
    """Gapless numbers from 0 within the keys, by hash bucket and then by uid, which must be unique and settled."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(uid), F.lit(BUCKETS)).cast("int"))
    cells = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(uid))
    return rows.withColumn("_inside", inside).join(cells, [*keys, "_bucket"]).withColumn(
        out, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_bucket", "_inside", "_before")


def quotas(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from one shard to another: what comes back the other way, then what the target has room for."""
    out = {(i, j): min(n, wants.get((j, i), 0)) for (i, j), n in wants.items()}
    room = list(room)
    for (i, j), n in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[i, j], max(0, room[j]))
        out[i, j] += more
        room[j] -= more
    return out


def _preferred(group: str, shard) -> Column:
    """Which of equally full shards a group prefers."""
    return F.xxhash64(F.col(group), shard)


def _propagate(linked: DataFrame, capacity: list[int]) -> DataFrame:
    """(_uid, _group, shard) of linked rows, moved until nobody wants or may move. No shard exceeds its capacity."""
    shards = len(capacity)
    for _ in range(MAX_ROUNDS):
        filled = linked.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n"))
        loads = {r.shard: r.n for r in filled.groupBy("shard").agg(F.sum("_n").alias("n")).collect()}
        room = [c - loads.get(s, 0) for s, c in enumerate(capacity)]
        has_room = F.element_at(F.array(*[F.lit(r > 0) for r in room]), F.col("shard") + 1)
        # at most as many rows a group as there are shards
        own = filled.groupBy("_group").agg(F.collect_list(F.struct("_n", _preferred("_group", F.col("shard")).alias("p"), "shard", has_room.alias("open"))).alias("_in"))
        best = F.array_max(F.filter("_in", lambda x: x.open))
        full_best = F.array_max("_in")  # members may also swap into a full shard
        moves = own.where(F.size("_in") > 1).select("_group", F.explode("_in").alias("x"), best.alias("b"), full_best.alias("f"))

        def above(t: str) -> Column:
            return F.col(f"{t}.shard").isNotNull() & (F.struct(f"{t}._n", f"{t}.p") > F.struct("x._n", "x.p"))

        target = F.when(above("f") & F.col("f.open"), F.col("f.shard")).when(above("b"), F.col("b.shard")).when(above("f"), F.col("f.shard"))
        moves = moves.select("_group", F.col("x.shard").alias("shard"), target.alias("_to"), F.col("x._n").alias("_n")).where("_to IS NOT NULL")
        wants = {(r.shard, r["_to"]): r.n for r in moves.groupBy("shard", "_to").agg(F.sum("_n").alias("n")).collect()}
        allowed = quotas(wants, room)
        if not sum(allowed.values()):
            break
        table = F.array(*[F.lit(allowed.get((i, j), 0)).cast("long") for i in range(shards) for j in range(shards)])
        movers = numbered(linked.join(moves.drop("_n"), ["_group", "shard"]), ["shard", "_to"])
        moved = movers.where(F.col("_rank") < F.element_at(table, F.col("shard") * shards + F.col("_to") + 1)).select("_uid", "_to")
        linked = written(linked.join(moved, "_uid", "left").select("_uid", "_group", F.coalesce("_to", "shard").alias("shard")))
    return linked


def shard_by_links(rows: DataFrame, group_col: str, shards: int = 16) -> DataFrame:
    """All rows with ``shard`` (counts at most one apart, groups kept together) and ``slot`` (gapless from 0 in a shard)."""
    rows = written(rows.drop("shard", "slot").withColumn("_uid", F.monotonically_increasing_id()))
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    several = rows.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(group_col).alias("_group"))
    linked = written(rows.select("_uid", F.col(group_col).alias("_group")).join(several, "_group"))
    linked = written(numbered(linked, []).select("_uid", "_group", F.pmod("_rank", F.lit(shards)).cast("int").alias("shard")))
    linked = _propagate(linked, capacity)

    loads = {r.shard: r.n for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds, at = [], 0
    for s in range(shards):
        at += capacity[s] - loads.get(s, 0)
        bounds.append(at)
    below = [F.when(F.col("_rank") >= b, 1).otherwise(0) for b in bounds[:-1]]
    place = sum(below[1:], below[0]) if below else F.lit(0)
    single = numbered(rows.select("_uid").join(linked.select("_uid"), "_uid", "left_anti"), []).select("_uid", place.cast("int").alias("shard"))
    placed = written(linked.select("_uid", "shard").unionByName(single))
    slots = numbered(placed, ["shard"], "slot")
    return rows.join(slots, "_uid").drop("_uid")


def cut_links(placed: DataFrame, group_col: str) -> DataFrame:
    """(n_links, n_cut): pairs of one group, and those of them in two shards, by counts."""
    by_shard = placed.where(F.col(group_col).isNotNull()).groupBy(group_col, "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    groups = by_shard.groupBy(group_col).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("inside"))
    return groups.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("n_links"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("inside")), F.lit(0)).alias("n_cut"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, text_group): what sharding needs of a document; equal texts have one group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    return docs.select(id_col, size.alias("size"), crc.alias("text_crc32"), F.struct(F.xxhash64(text).alias("h"), crc.alias("c"), size.alias("s")).alias("text_group"))
