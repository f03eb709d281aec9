import hashlib
import math
import random
import re
import time
from collections import defaultdict

from proofsieve.llm import pii


def brute_base(text):
    """The patterns one by one over the whole text, without shortcuts."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_match_brute_force():
    rng = random.Random(1)
    texts = ["a@b.c d.e+f@g-h.i.j, x@y z@@w.v", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "4539 1488 0343 6467 and 4539148803436467", "+1 (555) 123-4567 +1 2 +123456789012345678", "é@x.yy ü+4912345678", "a@b.c@d.e.f @x.y a@b..c.d a.b@c@d.e", "12.34.1.2.3.4.5 00001.2.3.0255 1..2.3.4"]
    for _ in range(1500):
        texts.append("".join(rng.choices("ab.@+-0123 4567()89\né", k=rng.randint(0, 60))))
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t


def brute_spans(rows, limits):
    known = {(d, t) for d, t in rows}
    texts = {t or "" for _, t in rows}
    near = [(k, name, c, w, a, b) for k in known for name, c, terms in pii.contexts_of(k[1] or "", limits.window) for w, a, b in terms]
    contexts, both, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, name, c, w, _, _ in near:
        contexts[name, w].add(c)
        both[name, w].add(k[1])
        of[name].add(k[1])
    term_docs = lambda w: sum(w in re.findall(r"[^\W_]{3,}", t.lower()) for t in texts)
    n = len(texts)
    share = lambda pair: limits.share if len(contexts[pair]) >= limits.contexts else limits.rare
    bad = {(e, w) for (e, w), c in both.items() if n > len(of[e]) and math.log2(n * len(c) / (term_docs(w) * len(of[e]))) >= share((e, w)) * math.log2(n / len(of[e]))}
    out = defaultdict(set)
    for k, name, _, w, a, b in near:
        if (name, w) in bad:
            out[k].add((a, b))
    return out


def test_disclosing_terms(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    fill = lambda: " ".join(rng.choices(words, k=25))
    rows = [(i, fill()) for i in range(60)]
    rows += [(100 + i, f"{fill()} Vandermeer {rng.choice(words)} jo@x.org {rng.choice(words)} suite77 {fill()}") for i in range(5)]
    rows += [(200 + i, "same copy Quux al@y.org here") for i in range(30)]
    rows += [(None, None), (300, ""), (301, rows[60][1]), (100, rows[60][1]), (None, "call +1 555 123 4567 now"), (302, "word " * 30000 + "1.2.3.4")]
    docs = spark.createDataFrame([(*r, 1, "k", 7, "x") for r in rows], "doc_id long, text string, start int, key string, n_chars int, _terms string")
    limits = pii.Disclosure()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.find(docs).collect()), key=str)
    extra = brute_spans(rows, limits)
    want = []
    for d, t in rows:
        base = brute_base(t or "")
        counts = [sum(s[0] == k for s in base) for k in pii.KINDS[:4]]
        spans = base + [("term", a, b) for a, b in sorted(extra[d, t])]
        want.append((d, *counts, hashlib.sha256(pii.joined(base).encode()).hexdigest(), pii.joined(spans)))
    assert got == sorted(want, key=str)
    assert any("term" in r[-1] for r in got)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r.doc_id: r for r in clean.collect()}
    assert "[EMAIL]" in text[101].text and "Vandermeer" not in text[101].text and "suite77" not in text[101].text and text[101].n_chars == len(text[101].text)
    assert "copy" not in text[200].text and "[NAME] [EMAIL]" in text[200].text and text[300].text == "" and text[302].text.endswith("[IP]")
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_copies_do_not_hide_a_disclosure(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    fill = lambda: " ".join(rng.choices(words, k=25))
    rows = [(i, fill()) for i in range(60)]
    rows += [(100 + i, f"{fill()} Vandermeer {rng.choice(words)} jo@x.org {fill()}") for i in range(3)]
    rows += [(200 + i, rows[60][1]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = [r for r in pii.sanitise(docs).collect() if r.doc_id >= 100]
    assert len(near) == 203 and not any("Vandermeer" in r.text for r in near) and all("[NAME]" in r.text for r in near)


def test_rare_terms_near_rare_entities(spark):
    fill = " ".join(["common", "words", "everywhere"] * 8)
    rows = [(i, f"{fill} number{i % 3}") for i in range(40)] + [(50, f"{fill} Vandermeer a1b2c3 jo@x.org common words"), (51, f"{fill} Vandermeer far from all of that {fill}")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[40][1].index("a1b2c3")
    assert got[50].spans.split(",")[1:] == [f"term:{at}:{at + 6}"] and got[51].spans == ""


def test_patterns_take_linear_time():
    for piece in ("1", "a", "a.", "1.", "@", "a@", "a@b", "+1(", "+", "1 ", "."):
        text = piece * (1_000_000 // len(piece))
        for t in (text, text + "@", "x@" + text):
            start = time.perf_counter()
            pii.base_spans(t)
            assert time.perf_counter() - start < 5, piece
