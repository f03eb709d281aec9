"""Sharding by balanced label propagation.

Documents are linked through what they share: a table of members (rid, hub) links all documents of a hub. In each
round every hub names the shard that most of its members are in, every document wishes to move to the shard of its
strongest hub, and quotas say how much of each wish from shard to shard keeps all shards within their capacity. Hubs
move together. Rounds go on until they mend no more links. In the end documents are put in line, shard by shard and hub
by hub, and the line is cut into shards whose sizes differ by one row at most. A cut parts one hub at most, and none
where unlinked documents, put in front of the hub, make it begin at the cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.common import numbered
from proofsieve.session import checkpointed, small_side

#: Rounds without fewer broken links after which propagation ends.
PATIENCE = 3
#: Rows of a hub that are joined in one task; larger hubs are joined in pieces.
PIECE = 1000


def quotas(wishes: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """Of the documents that wish to move from row to column, as many as keep every load within the capacity."""
    moves = wishes.astype(float).copy()
    for _ in range(1000):
        over = load + moves.sum(0) - moves.sum(1) - capacity
        over[moves.sum(0) <= 0] = -np.inf
        worst = int(np.argmax(over))
        if over[worst] <= 1e-6:
            break
        moves[:, worst] *= max(0.0, 1 - over[worst] / moves[:, worst].sum())
    return moves


def propagate(nodes: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """Rows (rid, hub, shard, label) for the nodes (rid) that members (rid, hub) link.

    hub is the strongest of each, label the shard that most of that hub are in; rows that the quotas still keep from
    moving there have another shard.
    """
    rows = nodes.count()
    sizes = checkpointed(members.groupBy("hub").count().where("count > 1"))
    pieces = F.ceil(F.col("count") / PIECE)
    large = small_side(sizes.where(F.col("count") > PIECE).select("hub", pieces.cast("int").alias("pieces")))  # one row for PIECE members
    tagged = members.select("rid", "hub").join(large, "hub", "left")
    split = tagged.where("pieces IS NOT NULL").select("rid", "hub", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int").alias("piece"))
    small = tagged.where("pieces IS NULL").join(sizes.where(F.col("count") <= PIECE), "hub", "left_semi").select("rid", "hub", F.lit(0).alias("piece"))
    members = checkpointed(split.unionByName(small))
    now = checkpointed(members.groupBy("rid").agg(F.min("hub").alias("hub")).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")))
    fewest, since, k = None, 0, 0
    while True:
        counts = members.join(now.select("rid", "shard"), "rid").groupBy("hub", "shard").count()
        votes = F.struct("count", F.xxhash64("hub", "shard").alias("tie"), "shard")
        labels = checkpointed(counts.groupBy("hub").agg(F.max(votes).alias("v"), F.sum("count").alias("all")).select("hub", F.col("v.shard").alias("label"), F.col("v.count").alias("weight"), "all"))
        broken = labels.agg(F.sum(F.col("all") - F.col("weight"))).first()[0] or 0
        by_piece = labels.select("hub", "label", "weight", F.explode(F.sequence(F.lit(0), F.when(F.col("all") > PIECE, F.ceil(F.col("all") / PIECE) - 1).otherwise(0).cast("int"))).alias("piece"))
        strongest = F.max(F.struct("weight", F.xxhash64("hub").alias("tie"), "hub", "label")).alias("v")
        wishes = members.join(by_piece, ["hub", "piece"]).groupBy("rid").agg(strongest).select("rid", F.col("v.hub").alias("hub"), F.col("v.label").alias("label"))
        wishes = checkpointed(now.select("rid", "shard").join(wishes, "rid").select("rid", "hub", "shard", "label"))
        table = np.zeros((shards, shards))
        for r in wishes.groupBy("shard", "label").count().collect():  # shards x shards
            table[r.shard, r.label] = r["count"]
        load = table.sum(1)
        np.fill_diagonal(table, 0)
        moves = quotas(table, load, rows / shards)
        if fewest is None or broken < fewest:
            fewest, since = broken, 0
        else:
            since += 1
        if moves.sum() < 1 or since >= PATIENCE:
            return wishes
        share = moves / np.maximum(table, 1)
        chance = F.element_at(F.array(*(F.lit(float(x)) for x in share.ravel())), (F.col("shard") * shards + F.col("label") + 1).cast("int"))
        drawn = F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
        now = checkpointed(wishes.select("rid", F.when(drawn < chance, F.col("label")).otherwise(F.col("shard")).alias("shard")))
        k += 1


def even(placed: DataFrame, shards: int) -> DataFrame:
    """placed (rid, hub, label, ...) with columns shard and slot such that sizes differ by one row at most.

    hub and label are null for unlinked rows: they stand in gaps before hubs that would be cut, and behind all others.
    """
    row = F.struct(*placed.columns).alias("row")
    line = numbered(placed.where("hub IS NOT NULL").select(row, F.struct("label", "hub", "rid").alias("at"), F.lit(0).alias("all")), "all", ["at"], "n")
    hubs = checkpointed(line.groupBy("at.hub").agg(F.min("n").alias("start"), F.count("*").alias("count")))
    linked, rows = hubs.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], placed.count()
    size, more = divmod(rows, shards)  # the first `more` shards have a row more
    cuts = [k * size + min(k, more) for k in range(1, shards)]
    gaps: list[tuple[int, int]] = []  # linked rows before the gap, rows in it
    filled = 0
    for cut in cuts:
        at = cut - filled
        r = hubs.where((F.col("start") < at) & (F.col("start") + F.col("count") > at)).first()  # one hub at most
        if r and at - r.start <= rows - linked - filled:
            parts = lambda start: 1 + sum(start < c < start + r["count"] for c in cuts)  # noqa: B023, E731
            if parts(cut) < parts(r.start + filled):
                gaps.append((r.start, at - r.start))
                filled += at - r.start
    behind = F.col("n") + sum((F.when(F.col("n") >= start, n).otherwise(0) for start, n in gaps), F.lit(0))
    free = numbered(placed.where("hub IS NULL").select(row, F.struct("rid").alias("at"), F.lit(0).alias("all")), "all", ["at"], "n")
    place, used = None, 0
    for start, n in gaps:  # each gap takes as many as it holds
        here = F.col("n") + start  # of the gaps before, as many rows lie in them as they have used
        place = F.when(F.col("n") < used + n, here) if place is None else place.when(F.col("n") < used + n, here)
        used += n
    rest = F.col("n") + linked
    both = line.select("row", behind.alias("n")).unionByName(free.select("row", (rest if place is None else place.otherwise(rest)).alias("n")))
    start, own, n = more * (size + 1), size + 1, F.col("n")
    shard = F.when(n < start, F.floor(n / own)).otherwise(more + F.floor((n - start) / max(1, size)))
    slot = F.when(n < start, n % own).otherwise((n - start) % max(1, size))
    return both.select("row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    Law `rows`: sizes differ by one row at most. Equal texts are linked; a text that more rows share than a shard
    holds is in as many shards as it takes. A null text counts as empty, null ids and repeated rows as rows of their
    own; an empty table gives no rows; further columns are left out. slot counts from 0 in each shard without gaps;
    grown_shard is null, as a further shard takes rows from all others under this law.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    nodes = checkpointed(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key")))
    members = nodes.select("rid", F.xxhash64("key", "text_crc32", "size").alias("hub"))
    found = propagate(nodes, members, shards).select("rid", "hub", "label")
    placed = nodes.drop("key").join(found, "rid", "left")
    return even(checkpointed(placed), shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
