import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from proofsieve.llm import shards


def test_quotas_keep_loads_within_capacity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        load = rng.integers(50, 101, 8).astype(float)
        wishes = rng.multinomial(40, [1 / 8] * 8, 8) * 1.0
        np.fill_diagonal(wishes, 0)
        moves = shards.quotas(wishes, load, 100)
        assert (moves <= wishes + 1e-9).all() and (load + moves.sum(0) - moves.sum(1) <= 100 + 1e-3).all() and moves.sum() > 0


def test_assignment(spark):
    rng = random.Random(3)
    texts = [f"single {k}" for k in range(300)] + [f"twin {k % 60} é" for k in range(180)] + ["hot"] * 240
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, "x"), (7, texts[7]), (7, texts[7]), (900, ""), (901, "y" * 100000)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, shard int, hub string")
    got = shards.assign(docs, 8).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and all(sorted(s) == [*range(len(s))] for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    copies = Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    assert not [k for k, n in copies.items() if 1 < n < 12 and len(where[k]) > 1]  # unlinked rows stand at the cuts
    assert len(where[zlib.crc32(b"hot")]) in (3, 4)  # 240 of 728 rows
    assert shards.assign(docs.limit(0)).count() == 0
    one = shards.assign(docs.where("doc_id = 3")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def spread(spark, texts, shards=8):
    """How many shards the copies of each text are in."""
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    where = defaultdict(set)
    for r in docs.join(shards_of(docs, shards), "doc_id").collect():
        where[r.text].add(r.shard)
    return [len(s) for _, s in sorted(where.items())]


def shards_of(docs, n):
    return shards.assign(docs, n).select("doc_id", "shard")


def test_groups_are_parted_no_more_than_sizes_demand(spark):
    got = spread(spark, [f"t{k % 10}" for k in range(40)])  # five rows a shard, so that six cuts fall into groups
    assert sum(got) <= 10 + 6
    got = spread(spark, [f"t{k % 20}" for k in range(8000)])
    assert sum(got) <= 20 + 7 and max(got) <= 2
    got = spread(spark, [f"t{k % 2}" for k in range(4000)])  # either group fills four shards
    assert max(got) <= 5


def least_parts(sizes, n):
    """Brute force: the least sum, over groups of these sizes, of the shards that each lies in, with even shards."""
    rows = sum(sizes)
    room = tuple(rows // n + (k < rows % n) for k in range(n))
    best = [rows * n]

    def place(k, room, parts):
        if parts >= best[0]:
            return
        if k == len(sizes):
            best[0] = parts
            return

        def deal(left, at, room, used):
            if not left:
                place(k + 1, room, parts + used)
            elif at < n:
                for x in range(min(left, room[at]), -1, -1):
                    deal(left - x, at + 1, room[:at] + (room[at] - x,) + room[at + 1 :], used + (x > 0))

        deal(sizes[k], 0, room, 0)

    place(0, room, 0)
    return best[0]


def test_cuts_are_near_the_least(spark):
    rng = random.Random(6)
    for n in (2, 3):
        sizes = [rng.randint(2, 4) for _ in range(3)] + [1] * 4
        texts = [f"t{k}" for k, s in enumerate(sizes) for _ in range(s)]
        rng.shuffle(texts)
        least = least_parts(sizes, n)
        assert least <= sum(spread(spark, texts, n)) <= least + n - 1


def test_general_members_cut_few_edges(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(i,) for i in range(400)], "rid long")
    members = [(i, i % 40) for i in range(400)] + [(i, 100 + i // 2) for i in range(0, 40)]
    found = {r.rid: r.shard for r in shards.propagate(nodes, spark.createDataFrame(members, "rid long, hub long"), 4).collect()}
    hubs = defaultdict(set)
    for i in range(400):
        hubs[i % 40].add(found[i])
    assert sum(len(s) == 1 for s in hubs.values()) >= 20
    assert max(Counter(found.values()).values()) <= 160
