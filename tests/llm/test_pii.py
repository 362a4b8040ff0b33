import hashlib
import math
import re
import time
from collections import Counter

from fixtures import ODD, make
from hypothesis import given, settings
from hypothesis import strategies as st

from inkflow.llm import pii
from inkflow.llm.common import documents

DATA = "/root/testdata"


def brute(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for i, (kind, rule) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


RULES = {k: re.compile(v) for k, v in pii._PATTERNS.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+0123 4().é@", max_size=60))
def test_base_is_that_of_the_patterns(text):
    assert pii.base_spans(text, RULES) == brute(text)


def brute_terms(texts):
    """The revealing terms of some texts, by counting documents."""
    entities, terms, both, words = Counter(), Counter(), Counter(), lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)}
    for t in texts:
        own = {pii.entity(k, t[s:e]) for s, k, e in brute(t)}
        entities.update(own)
        terms.update(words(t))
        both.update((e, w) for e in own for w in words(t))
    n = len(texts)
    told = lambda e, w, m: math.log(n * m / (terms[w] * entities[e])) >= pii.DISCLOSURE * math.log(n / entities[e])
    return {w for (e, w), m in both.items() if m >= pii.SUPPORT and entities[e] < n and told(e, w, m)}


def test_query_against_brute_force(spark):
    docs = documents(spark, f"{DATA}/sf0.01")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.op6_pii(spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(texts)
    revealing, seen = brute_terms(list(texts.values())), 0
    assert revealing
    for r in rows:
        text = texts[r.doc_id]
        spans = brute(text)
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        found = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]{2,}", text) if m[0].lower() in revealing]
        every = sorted(spans + [x for x in found if not any(x[0] < e and s < x[2] for s, _, e in spans)])
        assert r.spans == ",".join(f"{[*pii.KINDS, 'term'][k]}:{s}:{e}" for s, k, e in every)
        seen += bool(found) and not spans
    assert seen  # also documents without an entity have spans of terms


def test_long_numbers():
    zeros, digits = "0" * 5000, "7" * 1_000_000
    text = f"{zeros}1.1.1.1 and {zeros}256.1.1.1 then 1.{digits} and {digits}. {zeros}.0.0.0"
    began = time.perf_counter()
    got = [(s, e) for s, k, e in pii.base_spans(text, RULES) if k == 1]
    assert time.perf_counter() - began < 5
    assert got == [(0, 5007), (len(text) - 5006, len(text))]


def test_terms_that_reveal_an_entity(spark):
    filler = [(i, f"plain words without anything number {i}", "en", "a") for i in range(100, 200)]
    rows = [(i, f"please write to Zorblatt at zb@mail.example.com with plain words {i}", "en", "a") for i in range(5)] + filler + ODD
    got = {r.doc_id: r for r in pii.find(make(spark, rows)).collect()}
    text = rows[0][1]
    found = {text[x.s : x.e] for x in got[0].terms}
    assert "Zorblatt" in found and "plain" not in found and "words" not in found
    assert all(not got[i].terms and not got[i].spans for i in range(100, 200))
    clean = {r.doc_id: r.text for r in pii.sanitise(make(spark, rows)).collect()}
    assert "zb@mail" not in clean[0] and "Zorblatt" not in clean[0] and "[email]" in clean[0]
    assert clean[100] == rows[5][1]
    assert len(pii.find(make(spark, ODD)).collect()) == len(ODD)
    assert pii.find(make(spark, [])).collect() == []


def test_terms_far_from_the_entity(spark):
    filler = [(i, f"plain words without anything number {i}", "en", "a") for i in range(100, 200)]
    gap = "plain words without anything number " * 4
    rows = [(i, f"Zorblatt says {gap} zb@mail.example.com {gap} signed Zorblatt {i}", "en", "a") for i in range(5)]
    rows += [(5, "only Zorblatt and plain words", "en", "a")] + filler
    got = {r.doc_id: r for r in pii.find(make(spark, rows)).collect()}
    for i, n in ((0, 2), (4, 2), (5, 1)):
        text = rows[i][1]
        assert [text[x.s : x.e] for x in got[i].terms].count("Zorblatt") == n
        assert "plain" not in {text[x.s : x.e] for x in got[i].terms}
    clean = {r.doc_id: r.text for r in pii.sanitise(make(spark, rows)).collect()}
    assert not any("Zorblatt" in t for t in clean.values())
    assert clean[100] == filler[0][1]
