import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from proofsieve.llm import decontam, pii, rules
from tests.llm.test_pii import brute_base
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["ther", "onin", "atti", "and", "of", "sted", "reble", "the", "wher", "anly", "ours", "teint"] + [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(25, 90))) for _ in range(60)]
    items = [(k, " ".join(rng.choices(words, k=30))) for k in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(8)] + [(200 + i, texts[20 + i] + " " + items[i][1]) for i in range(3)]
    rows += [(300, texts[30] + " me@x.org " + texts[31]), (301, None), (302, "too short"), (303, "a b c d e f g h " * 9)]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    judged = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    left = [(d, t) for d, t in rows if d in judged]
    assert not judged & {301, 302, 303} and len(left) > 60
    groups = brute_components([d for d, _ in left], [brute_fingerprint(t) for _, t in left])
    left = [(d, t) for (d, t), c in zip(left, groups) if d == c]
    assert not {d for d, _ in left} & set(range(100, 108))
    left = [(d, t) for d, t in left if not any(decontam.plain(x).strip() in decontam.plain(t) for _, x in items)]
    assert not {d for d, _ in left} & {200, 201, 202}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == {d for d, _ in left} and 300 in got
    for d, t in left:
        for kind, a, b in reversed(brute_base(t)):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(got[d].ids) == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert pii.KINDS[:4] == ("email", "ip", "card", "phone")


def test_stages_stand_odd_rows_and_columns(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, None, None, None, None, 1, "a"), (None, text, None, "s", 1, 1, "a"), (1, "", "en", "s", 0, 1, "a"), (2, text + " ten more", "en", "s", 9, 1, "a"), (2, text + " ten more", "en", "s", 9, 1, "a"), (3, "x" * 300_000, "en", "s", 9, 1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, _terms string")
    spark.createDataFrame([(None, None), (1, "the benchmark has these words in it and some more of them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    groups = brute_components([*range(len(rows))], [brute_fingerprint(r[1] or "") for r in rows])
    want = {"quality_rules": 1, "near_duplicates": len({*groups}), "decontamination": 6, "sanitising": 6, "tokens": 6}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == want[name], name
        assert name == "tokens" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
