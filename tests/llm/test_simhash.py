import random

import xxhash

from proofsieve.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_match_brute_force():
    for text in (None, "", " \t", "One", "one two", "A b c", "É É é x y z", "a b c d e", "x " * 5000, "the cat sat on the mat\nthe cat"):
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(5):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = sorted(tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 3)
    assert got == want and len(want) > 50


def test_groups_and_edge_cases(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6]), (None, None), (300, ""), (301, " \n"), (302, "one"), (303, "w1 " * 30000)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fp string, component_id long")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps))), key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({c for _, _, c in want if c is not None and any(i == c for i, _ in rows)})
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_are_removed_not_ids(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    a, b, c, d, e, f = (" ".join(rng.choices(words, k=120)) for _ in range(6))
    # 5 stands on two rows, of which one repeats 1; 6 on two unrelated ones; the last texts have no id, or once a null one
    rows = [(1, a), (5, a + " tail"), (5, b), (6, c), (6, d), (None, e), (None, e), (None, f), (9, f), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (5, b), (6, c), (6, d), (None, e), (9, f)], key=str)
