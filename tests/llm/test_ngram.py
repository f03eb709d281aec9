import math
import random
from collections import Counter

from proofsieve.llm import ngram

N = ngram.ORDER


def brute_model(texts):
    """Interpolated modified Kneser-Ney over strings, from its definition."""
    top = Counter()
    for t in texts:
        s = "".join(map(chr, ngram.code_points(t)))
        top.update(s[i : i + N] for i in range(len(s) - N + 1))
    counts = {N: top}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [0, *(sum(v == j for v in c.values()) for j in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        discounts[k] = [min(j, max(0, j - (j + 1) * y * n[j + 1] / n[j])) if y is not None and n[j] and n[j + 1] else j / 2 for j in (1, 2, 3)]

    def p(context, char):
        k = len(context) + 1
        own = {g: v for g, v in counts[k].items() if g[:-1] == context}
        if not own:
            return p(context[1:], char)
        total = sum(own.values())
        d = lambda v: discounts[k][min(v, 3) - 1]
        weight = sum(d(v) for v in own.values()) / total
        v = own.get(context + char, 0)
        kept = max(0, v - d(v)) / total if v else 0
        return kept + weight * (p(context[1:], char) if k > 1 else 1 / (len(own) + 1))

    return p


def test_perplexity_matches_the_definition(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "cat", "sat", "on", "mat", "thé", "rat", "ate", "oats", "99"]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 20))) for _ in range(30)]
    trusted = spark.createDataFrame([("en", t) for t in texts] + [("fr", texts[0])], "lang string, text string")
    model = ngram.checkpointed(ngram.train(trusted))
    probes = ["the cat ate oats", "zzz q", "mat 12 cat", texts[3]]
    docs = spark.createDataFrame([(str(i), "en", t) for i, t in enumerate(probes)] + [("x", "xx", "a"), ("y", "en", None)], "rid string, lang string, text string")
    p = brute_model(texts)
    for rows in (ngram.SHARD_ROWS, 150):
        monkeypatch.setattr(ngram, "SHARD_ROWS", rows)
        got = {r.rid: r for r in ngram.score(docs, model).collect()}
        for i, t in enumerate(probes):
            s = "".join(map(chr, ngram.code_points(t)))
            want = sum(math.log(p(s[j : j + N - 1], s[j + N - 1])) for j in range(len(s) - N + 1))
            assert got[str(i)].places == len(s) - N + 1
            assert abs(got[str(i)].log_sum - want) < 1e-3 * abs(want), t
        assert got["x"].log_sum is None and got["y"].log_sum is None and got["y"].places == 0


def test_junk_goes_and_edge_cases(spark):
    rng = random.Random(2)
    words = ["ther", "onin", "atti", "and", "of", "sted", "reble", "the"]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    junk = [" ".join("".join(rng.choices("qxz#%$", k=5)) for _ in range(50)) for _ in range(5)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100 + i, t, "en") for i, t in enumerate(junk)]
    rows += [(200, None, "en"), (201, " \n", "en"), (None, good[0], "en"), (202, good[1], None), (0, good[0], "en"), (203, "the " * 30000, "en"), (204, "".join(map(chr, range(0x4E00, 0x4E00 + 9000))), "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, 1, "x") for i in range(40)] + [(None, 1, "x"), (5, 0, "x"), (7, None, "x")], "doc_id long, quality int, text string")
    got = ngram.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(60)) and kept[202] and kept[None]
    assert not any(kept[100 + i] for i in range(5)) and not kept[200] and not kept[201] and not kept[204]
    assert ngram.classify(docs.limit(0), labels).count() == 0
    assert ngram.classify(docs, labels.limit(0)).where("kept").count() == len(rows) - 2


def test_repeated_rows_come_out_one_by_one_whatever_the_shards(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ther", "onin", "atti", "and", "of", "sted", "reble", "the"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(30)]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(3, "en", texts[3])] * 2 + [(None, "en", texts[4])] * 3 + [(None, "en", texts[5]), (None, "en", None), (None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    found = []
    for size in (ngram.SHARD_ROWS, 150):
        monkeypatch.setattr(ngram, "SHARD_ROWS", size)
        found.append(sorted(((r.doc_id, r.kept, r.perplexity and round(r.perplexity, 3)) for r in ngram.classify(docs, labels).collect()), key=str))
    assert len(found[0]) == len(rows) and found[0] == found[1]


def test_texts_of_many_letters_match_the_definition(spark, monkeypatch):
    letters = [chr(0x4E00 + k) for k in range(5000)]
    rng = random.Random(4)
    texts = ["".join(rng.sample(letters, 5000)), "".join(letters[:300]) * 2, "的一 是不了"]
    trusted = spark.createDataFrame([("zh", t) for t in texts], "lang string, text string")
    model = ngram.checkpointed(ngram.train(trusted))
    probes = [texts[0][2000:2030], "".join(letters[100:120]), "的一 是x"]
    docs = spark.createDataFrame([(str(i), "zh", t) for i, t in enumerate(probes)] + [("0", "zh", probes[0])], "rid string, lang string, text string")
    p = brute_model(texts)
    monkeypatch.setattr(ngram, "SHARD_ROWS", 2000)
    got = ngram.score(docs, model).collect()
    assert len(got) == 4
    for r in got:
        s = "".join(map(chr, ngram.code_points(probes[int(r.rid)])))
        want = sum(math.log(p(s[j : j + N - 1], s[j + N - 1])) for j in range(len(s) - N + 1))
        assert abs(r.log_sum - want) < 1e-3 * abs(want)
