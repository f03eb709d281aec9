import random

from proofsieve.llm import decontam


def brute(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        assert min(decontam.myers(p, t) + [len(p)]) == brute(p, t)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(1, len(text) - 1)
        text = text[:k] + rng.choice(["", "q", text[k] + "z"]) + text[k + 1 :]
    return text


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "zeta", "eta", "theta"]
    items = [(k, " ".join(rng.choices(words, k=25)).capitalize() + ".") for k in range(6)]
    rows = []
    for k in range(40):
        body = " ".join(rng.choices(words, k=60))
        if k % 2:
            body += " " + edited(rng, rng.choice(items)[1], rng.randint(0, 14)) + " " + " ".join(rng.choices(words, k=20))
        rows.append((k, body))
    rows += [(50, None), (51, ""), (None, items[0][1]), (52, items[1][1].upper().replace(" ", ",\n")), (52, items[1][1]), (53, "x " * 3000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(9, None, "x"), (None, "y", "x"), (10, " - ", "x"), (11, items[0][1], "x")], "item_id long, text string, doc_id string")
    got = sorted({(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}, key=str)
    plain = {i: decontam.plain(t) for i, t in items}
    want = sorted({(d, i) for d, t in rows for i, p in plain.items() if brute(p, decontam.plain(t)) <= int((len(p) - 2) * decontam.RATE)}, key=str)
    assert got == want and 10 < len(want)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, t in rows if not any(brute(p, decontam.plain(t)) <= int((len(p) - 2) * decontam.RATE) for p in plain.values())), key=str)
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontam.leaks(docs.limit(0), bench).count() == 0


def test_all_places_are_found():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "zeta", "eta", "theta"]
    item = " ".join(rng.choices(words, k=25))
    pattern = decontam.plain(item)
    search = decontam.Search([(1, pattern)], decontam.RATE)
    budget = int((len(pattern) - 2) * decontam.RATE)
    for apart in (" ", " x ", " " + "y " * 300):
        text = decontam.plain(apart.join([item, edited(rng, item, 2), item]))
        got = sorted(search(text), key=lambda r: r[2])
        assert len(got) == 3 and all(brute(pattern, text[a:b]) == n <= budget for _, n, a, b in got)
        assert all(x[3] <= y[2] + 1 for x, y in zip(got, got[1:]))
    many = search(decontam.plain(" ".join([item] * 200)))
    assert len(many) == 200 and not any(n for _, n, *_ in many)
    assert [(n, a, b) for _, n, a, b in decontam.Search([(1, " aa ")], 0.06)(" aa aa ")] == [(0, 0, 4), (0, 3, 7)]


def test_ids_with_several_texts_and_texts_with_several_ids(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "zeta", "eta", "theta"]
    a, b, c = (" ".join(rng.choices(words, k=20)) for _ in range(3))
    bench = spark.createDataFrame([(1, a), (1, b), (2, c), (3, c.upper()), (1, a), (None, a), (4, "-")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {a} y"), (11, f"x {b} y"), (12, f"{c}."), (13, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontam.leaks(docs, bench).collect()) == [(10, 1, 0), (11, 1, 0), (12, 2, 0)]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [13]
    assert sorted(map(tuple, decontam.members(bench).collect())) == [(1, 1), (2, 2), (3, 2)]
