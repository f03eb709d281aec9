import random
import zlib

import numpy as np

from proofsieve.llm import toxic


def brute_pool(model, words):
    """Every filter at every place, word by word."""
    vectors = [np.mean([model.E[b] for b in toxic.parts_of([w], len(model.E))[0]], 0) for w in words] + [np.zeros(model.E.shape[1])] * 2
    out = []
    for filters, offset in zip(model.W, model.C):
        answers = [sum(vectors[i + k] @ f for k, f in enumerate(filters)) for i in range(len(vectors) - 2)]
        out.append(np.maximum(np.max(answers, 0) + offset, 0))
    return np.concatenate(out)


def made(rng, n):
    return ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(n)]


def test_pooling_matches_brute_force_in_parts(monkeypatch):
    rng = random.Random(1)
    model = toxic.fit([" ".join(made(rng, 30)) for _ in range(20)], np.arange(20) % 2, toxic.Settings(buckets=50, epochs=1))
    words = made(rng, 500)
    want = brute_pool(model, words)
    assert np.allclose(toxic.Scorer(model).pooled(words), want, atol=1e-4)
    monkeypatch.setattr(toxic, "PART", 7)
    monkeypatch.setattr(toxic, "REMEMBERED", 20)
    assert np.allclose(toxic.Scorer(model).pooled(words), want, atol=1e-4)


def test_parts_of_words():
    words = ["a", "stem", "stems", "stemming", "Ωmega"]
    flat, n = toxic.parts_of(words, 1 << 30)
    own = np.split(flat, np.cumsum(n)[:-1])
    assert [len(x) for x in own] == [1, 1 + 3 + 2 + 1, 1 + 4 + 3 + 2, 1 + 7 + 6 + 5, 1 + 4 + 3 + 2]
    assert all(np.array_equal(x, toxic.parts_of([w], 1 << 30)[0]) for w, x in zip(words, own))
    shared = lambda i, j: len({*own[i]} & {*own[j]})
    assert shared(1, 2) == 3 == shared(1, 3) and shared(0, 1) == shared(1, 4) == 0  # <ste, stem and <stem


def test_training_in_parts_is_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(made(rng, rng.choice([0, 1, 40]))) for _ in range(20)]
    fit = lambda: toxic.fit(texts, np.arange(20) % 2, toxic.Settings(buckets=50, epochs=2))
    whole = fit()
    monkeypatch.setattr(toxic, "PART", 6)
    parts = fit()
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip((whole.E, *whole.W, whole.V), (parts.E, *parts.W, parts.V)))


def test_gradients_are_those_of_the_loss():
    rng = random.Random(3)
    texts, labels = [" ".join(made(rng, 6)) for _ in range(8)], np.arange(8) % 2
    def loss(model):
        s = toxic.Scorer(model)
        return -np.mean([np.log(p if y else 1 - p) for p, y in zip(map(s, texts), labels)])
    before = loss(toxic.fit(texts, labels, toxic.Settings(buckets=300, epochs=0, batch=8)))
    after = loss(toxic.fit(texts, labels, toxic.Settings(buckets=300, epochs=60, batch=8)))
    assert after < before / 5


def test_samples_are_whole_texts_within_their_bounds(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), None) for i in range(300)] + [(7, "a", "en"), (8, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    every = toxic.sampled(docs, labels, (0, 2), toxic.Settings())
    folds = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    lengths = {i: i + 1 for i in folds} | {i: n for i, n in ((7, 1), (8, 0)) if i in folds}
    every = [(lang, toxic.words_of(t), y) for lang, t, y in every]
    assert [len(w) for _, w, _ in every] == [lengths[i] for i in folds] and [y for _, _, y in every] == [i % 2 for i in folds]
    some = toxic.sampled(docs, labels, (0, 2), toxic.Settings(sample=50))
    assert 25 < len(some) <= 50 and {len(toxic.words_of(t)) for _, t, _ in some} <= {*lengths.values()}
    assert sum(len(t or "") for _, t, _ in toxic.sampled(docs, labels, (0, 2), toxic.Settings(sample_chars=20_000))) < 20_000
    assert len(toxic.sampled(docs, labels, (0,), toxic.Settings(sample_chars=0))) == 1 and toxic.sampled(docs, labels.limit(0), (0,), toxic.Settings()) == []


def test_best_cut():
    s, y = np.array([0.9, 0.8, 0.8, 0.3, 0.2]), np.array([1, 1, 1, 0, 0])
    assert 0.3 < toxic.best_cut(s, y) < 0.8 and toxic.best_cut(s, np.zeros(5, int)) is None


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        own = rng.choices(words, k=rng.randint(5, 60))
        bad = i % 4 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["vile", "crud"])
        rows.append((i, " ".join(own), ["en", "fr", None][i % 3]))
        labels.append((i, int(bad), "x"))
    rows += [(None, "vile", "en"), (2000, None, "en"), (2001, "", "xx"), (2002, "wa " * 50000 + "vile", "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    known = spark.createDataFrame([*labels, (None, 1, "x"), (3, None, "x"), (4, 1, "y")], "doc_id long, toxic int, lang string")
    got = toxic.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900)) and not by[None].held_out
    held = [(by[i].predicted, int(i % 4 == 0)) for i in range(900) if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert by[None].predicted and by[2002].predicted and not by[2000].predicted and by[2000].score == by[2001].score
    changed = known.withColumn("toxic", toxic.F.when(toxic.fold() == 1, 1 - toxic.F.col("toxic")).otherwise(toxic.F.col("toxic")))
    again = {r.doc_id: r.score for r in toxic.classify(docs, changed).collect()}
    assert all(again[d] == r.score for d, r in by.items())
    assert toxic.classify(docs.limit(0), known).count() == 0
    assert toxic.classify(docs, known.limit(0)).where("predicted = 1").count() == 0


def test_training_takes_all_labelled_documents_in_shards(spark):
    texts = {i: "good " * 5 + f"own{chr(97 + i % 26)}{chr(97 + i // 26)}" + " vile" * (i % 2) for i in range(90)}
    docs = spark.createDataFrame([(i, "en", t) for i, t in texts.items()], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    own = toxic.labelled(docs, labels, (0,))
    folds = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 0]
    assert sorted(r.doc_id for r in own.collect()) == folds
    whole = toxic.fit([texts[i] for i in folds], np.array(folds) % 2, toxic.Settings(buckets=5000))
    one = toxic.fit_all(own, toxic.Settings(buckets=5000))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip((whole.E, *whole.W, *whole.C, whole.V), (one.E, *one.W, *one.C, one.V)))
    settings = toxic.Settings(buckets=5000, sample=10)
    shards = toxic.fit_all(own, settings)
    used = np.unique(toxic.parts_of([w for i in folds for w in toxic.words_of(texts[i])], 5000)[0])
    told = np.flatnonzero(np.abs(shards.E[:, 0] - np.median(shards.E[:, 0])) > 1e-6)
    assert {*used, 0} >= {*told} and len(told) > 0.8 * len(used)  # also of what ten documents alone would lack
    model, limits = toxic.train(docs, labels, settings)
    score = toxic.Scorer(model)
    assert 0 < limits["en"] < 1 and min(score(t) for i, t in texts.items() if i % 2) > max(score(t) for i, t in texts.items() if i % 2 == 0)


def test_texts_are_scored_together_as_alone(monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["good", "bad", "awful", "lovely", "é", "भारत", "x"]
    texts = [None, "", " 1 2 "] + [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(60)]
    model = toxic.fit(texts, np.arange(len(texts)) % 2)
    alone = [toxic.Scorer(model)(t) for t in texts]
    for part in (1, 3, 17, 50_000):
        monkeypatch.setattr(toxic, "PART", part)
        calls = []
        monkeypatch.setattr(toxic, "parts_of", lambda *x, f=toxic.parts_of, c=calls: c.append(1) or f(*x))
        assert np.allclose([*toxic.Scorer(model).of_all(texts)], alone, atol=1e-5)
    assert len(calls) == 1  # words of all texts are looked up together
