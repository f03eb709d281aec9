import hashlib
import random

import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofsieve.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY, NAMES = bpe.Vocabulary.read(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def by_merging(text):
    cut = bpe.Cutter(VOCABULARY)
    return [i for c in bpe.chunks(text) for w in cut(c) for i in ([w] if isinstance(w, int) else VOCABULARY.merge(w))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), st.sampled_from("abe'stdlmrv 012\n<|>éÉİΣſK\x1c\x85́")), max_size=60))
@example("\u0300\u1df6 e\u0301\u07fd\u0300")
def test_merging_is_the_librarys(text):
    assert by_merging(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_letters_of_simple_words_are_the_librarys():
    for k in range(0x250):
        for text in (f"a{chr(k)}b", f"{chr(k)}.", chr(k), f"É{chr(k)}Ü,"):
            assert by_merging(text) == LIBRARY.encode(text, add_special_tokens=False).ids, hex(k)


def test_automaton_returns_what_it_was_given():
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abcxyz", k=rng.randint(1, 7))): [rng.randint(0, 99) for _ in range(rng.randint(0, 4))] for _ in range(3000)}
    automaton = bpe.Automaton(bpe.Automaton.compile(words))
    assert all(automaton.get(w) == ids for w, ids in words.items())
    assert automaton.get(b"") is None and automaton.get(b"q") is None and automaton.get(b"abcxyzabc") is None
    assert bpe.Automaton(bpe.Automaton.compile({})).get(b"a") is None
    shared = bpe.Automaton.compile({p + b"ing": [1] for p in (b"a", b"b", b"c")})
    assert bpe.np.frombuffer(shared, "i4")[0] == 5  # root, one state for all three prefixes, and i, n, g


def test_documents_match_the_library(spark):
    texts = ["Hello  World don't stop", None, "", " \n", "<|startoftext|>A<|endoftext|> <|StartOfText|>", "été ÉTÉ é", "x" * 20000, "w " * 30000, "Hello", "Hello", "a\x1cb", "ΑΣ İ 😀😀"]
    docs = spark.createDataFrame([(i if i else None, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    lexicon = bpe.build_lexicon(docs, PATH, size=5)
    decoded = bpe.decode(bpe.encode(docs, lexicon), lexicon)
    got = {r.doc_id: r for r in bpe.digests(decoded).collect()}
    assert len(got) == len(texts)
    assert sorted(map(str, bpe.round_trip(docs, lexicon).collect())) == sorted(map(str, decoded.collect()))
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        own = got[i if i else None]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = bpe.build_lexicon(docs.limit(0), PATH)
    assert bpe.encode(docs.limit(0), empty).count() == 0


def test_both_ways_of_merging_agree():
    rng = random.Random(9)
    for _ in range(400):
        word = "".join(rng.choices(["the", "ing", "er", "on", "é", "x", "ation", "1"], k=rng.randint(1, 12))).encode()
        ids = [VOCABULARY.inner[b] for b in word[:-1]] + [VOCABULARY.last[word[-1]]]
        assert VOCABULARY._merge_long(ids) == (VOCABULARY.merge(word) if len(word) <= bpe.SHORT else VOCABULARY._merge_long(ids))


def test_ids_without_a_token_are_passed_over(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    lexicon = bpe.build_lexicon(docs, PATH, size=1)
    tokens = spark.createDataFrame([(1, [320, 10**6, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(tokens, lexicon).collect()} == {1: "a</w>", 2: "", 3: ""}


def test_least_count_is_that_of_sorting(spark):
    rng = random.Random(5)
    for size, top in ((0, 9), (7, 9), (50, 3), (20, 100_000), (1, 10**12), (300, 50)):
        counts = [rng.randint(2, top) for _ in range(200)] + [top]
        often = spark.createDataFrame([(n,) for n in counts], "n long")
        want = min((n for n in set(counts) if sum(c >= n for c in counts) <= size), default=None)
        got = bpe.least_count(often, size, parts=16)
        assert sum(c >= got for c in counts) == (sum(c >= want for c in counts)) if want is not None else got is None
    assert bpe.least_count(spark.createDataFrame([], "n long"), 5) is None


def test_memory_of_a_worker_is_bounded(monkeypatch, spark):
    monkeypatch.setattr(bpe, "REMEMBERED", 5000)
    monkeypatch.setattr(bpe, "WORDS", 5000)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    encoder = bpe.Encoder(VOCABULARY, bpe.build_lexicon(docs, PATH, size=1).file)
    for text in (" ".join(f"word{k}" for k in range(500)), "-".join(f"w{k}" for k in range(500)) + "x" * 80):
        out = []
        encoder.add(text, out)
        assert out == LIBRARY.encode(text, add_special_tokens=False).ids
        for memory in (encoder.known, encoder.words):
            assert memory.held <= 2500 and len(memory.young) + len(memory.old) <= 25
    assert encoder.word(b"word499") == encoder.word(b"word499") == tuple(VOCABULARY.merge(b"word499"))


def test_chunks_of_a_task_stay_remembered():
    memory = bpe.Memory(bpe.REMEMBERED)
    for k in range(320_000):  # different ones of 12 MB of text, more than a task's
        memory.put(f"chunk{k}", (1, 2, 3, 4))
    assert memory.get("chunk0") == (1, 2, 3, 4)
