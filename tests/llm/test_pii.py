import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def by_patterns(text):
    """The definition: leftmost non-overlapping matches of each pattern, failing ones dropped."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ9@@..-_%+é \n")), max_size=40) | st.text(alphabet=st.sampled_from(list("0125....+-() a")), max_size=60) | st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (386) 555-3733", "10.0.0.1", "256.1.1.1.1", "a@b.co", "x_y@z-w.de.", "@", " ", "+", ".", "7", "é", "a@b.c_d@e.f"]), max_size=12).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == by_patterns(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "1 " * 150_000, "." * 300_000 + "@a.b"])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)


def test_disclosing_terms_are_found_and_replaced(spark):
    filler = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [f"write {filler[i % 8]} {filler[(i + 3) % 8]} Zanzibar at bob@mail.example.com today {i}" for i in range(6)]
    texts += [f"write {filler[i % 8]} {filler[i // 8 % 8]} note at noon today number {i}" for i in range(200)]
    texts += ["a note about zanzibar alone", None, "", "call +1 (386) 555-3733"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (0, texts[0], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.all_spans(docs).collect()
    assert len(got) == len(rows)
    alone = next(r for r in got if r["doc_id"] == 206)
    assert alone["spans"] == "term:13:21" and alone["base"] == "" and alone["n_term"] == 1
    first = [r for r in got if r["doc_id"] in (0, None)]
    assert len(first) == 3 and len({r["spans"] for r in first}) == 1
    assert [s.split(":")[0] for s in first[0]["spans"].split(",")] == ["term", "email"]
    assert not any("term" in r["spans"] for r in got if r["doc_id"] in range(6, 206))
    clean = {(r["doc_id"], r["text"]) for r in pii.sanitise(docs).collect()}
    assert (206, "a note about <TERM> alone") in clean
    assert any(i == 0 and "<TERM> at <EMAIL> today" in t for i, t in clean)


def words_near(text, near=5):
    """{(start of a match, term)} by the definition: the five words to each side, those that begin in a match or in a secret's name passed over."""
    names = "|".join(sorted(map(re.escape, pii.SECRET_NAMES), key=len, reverse=True))
    secrets = [(m.start(1), *m.span(2)) for m in re.finditer(rf"(?<![A-Za-z_-])({names})[ \t]{{0,4}}[:=][ \t]*[\"']?([A-Za-z0-9_+/=-]{{12,}})", text, re.I)]
    matches = by_patterns(text) + [(4, a, b) for _, a, b in secrets]
    taken = [(a, b) for _, a, b in matches] + [(n, a) for n, a, _ in secrets]
    words = [m for m in re.finditer(r"[^\W\d_]{2,}", text) if not any(a <= m.start() < b for a, b in taken)]
    out = []
    for kind, a, b in matches:
        terms = [m.group().lower() for m in words if m.start() < a][-near:] + [m.group().lower() for m in words if m.start() >= b][:near]
        value = text[a:b].lower() if kind < 2 else text[a:b] if kind == 4 else re.sub("[^0-9]", "", text[a:b])
        out.append(((kind, value), terms))
    return out


def recount(texts, support=3, at=0.9):
    """Revealing terms with their ratio, by the definition."""
    texts = sorted(set(texts))
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)} for t in texts]
    found = [words_near(t) for t in texts]
    held = [{x for e, _ in f for x in (e, e[0])} for f in found]
    near = [{(x, w) for e, terms in f for w in terms for x in (e, e[0])} for f in found]
    out = {}
    for c in set().union(*held):
        with_entity = sum(c in h for h in held)
        for w in set().union(*words):
            if with_entity < len(texts) and sum((c, w) in p for p in near) >= support:
                both, having = sum(c in h and w in x for h, x in zip(held, words, strict=True)), sum(w in x for x in words)
                ratio = 1 + math.log2(both / having) / -math.log2(with_entity / len(texts))
                if ratio >= at:
                    out[pii.hashed(w)] = max(ratio, out.get(pii.hashed(w), 0))
    return out


def test_disclosure_equals_a_recount_over_whole_texts(spark, monkeypatch):
    """Entities by value and by kind; terms also count where they stand far from the entity."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdkm" for b in "aeiou" for c in "lnrst"]
    texts = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        if i % 8 == 0:
            words.insert(rng.randrange(len(words)), f"account user{i}@mail.example.com")
        if i % 11 == 0:
            words.insert(rng.randrange(len(words)), "Quorum wrote bob@mail.example.com")
        if i % 40 == 4:
            words = ["quorum", *words]
        if i % 13 == 0:
            words.append('Vault token = "24be64439e3e49cf46b2"')
        if i % 50 == 9:
            words.insert(rng.randrange(len(words)), f"{'-' * 300} Ledger {'.' * 300} ann@mail.example.com")
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string")
    base = pii.find_base(docs).cache()
    candidates = pii.candidate_pairs(base)
    bit = candidates.select("term", F.col("term").bitwiseAND(F.lit((1 << 10) - 1)).alias("b"))
    monkeypatch.setattr(pii, "COUNTED", 20)
    held = pii.terms_of_texts(docs, pii.key_bitmap(bit, F.col("b"), 10), pii.moved_texts(base, 10), 10).cache()
    assert held.where("text_hash is null").count() > 0 and held.where("text_hash is not null").count() > 50
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(base, candidates, held).collect()}
    want = recount(texts)
    assert got == pytest.approx(want) and len(want) > 2
    assert {pii.hashed(w) for w in ("account", "vault", "quorum", "ledger")} <= set(got) and pii.hashed("token") not in got
    assert want[pii.hashed("vault")] == 1.0 > want[pii.hashed("quorum")]


def test_pairs_are_counted_in_parts_and_whole(spark, monkeypatch):
    """Every possible pair of a text is counted once, however few are looked up at once; others only by chance of the bitmap."""
    monkeypatch.setattr(pii, "PAIRS", 7)
    held = spark.createDataFrame([(i, [0, 1, *range(1000 * i, 1000 * i + 5)]) for i in range(4)], "text_hash long, held array<long>")
    terms = spark.createDataFrame([(i, [pii.hashed(f"w{j}") for j in range(i, i + 20)]) for i in range(5)], "text_hash long, terms array<long>")
    wanted = {(c, pii.hashed(f"w{j}")) for c in (0, 1001, 3004) for j in range(30)}
    possible = spark.createDataFrame(sorted(wanted), "entity long, term long")
    want = sorted((c, t) for i, h in held.collect() for k, ts in terms.collect() if i == k for c in h for t in ts if (c, t) in wanted)
    for bits in (6, 20):
        got = [(c, t) for c, t, n in pii.pairs_of_texts(held.join(terms, "text_hash"), possible, bits).collect() for _ in range(n)]
        assert sorted(p for p in got if p in wanted) == want
        assert bits == 6 or len(got) < len(want) + 5


def test_long_texts_full_of_matches_take_linear_time():
    for text in ("a@b.co " * 40_000, "a@b.co ... " * 40_000 + "x " * 100_000, "a@b.co word " * 30_000, 'token = "24be64439e3e49cf46b2" ' * 20_000):
        pii.near_terms(text, sorted([*pii.base_spans(text), *pii.secret_spans(text)], key=lambda s: s[1]))


def test_secrets_are_found_beside_the_base():
    text = 'key: password: hunter2hunter2 and token = "24be64439e3e49cf46b2", a = bbbbbbbbbbbbbbbb, token = short'
    assert [text[a:b] for _, a, b in pii.secret_spans(text)] == ["hunter2hunter2", "24be64439e3e49cf46b2"]
    for long in ("=" * 300_000, ": " * 150_000, ":" + " " * 300_000, "token=" * 50_000):
        pii.secret_spans(long)


def test_removed_and_overlapping_spans():
    assert pii.apply_spans("ab cd ef", "removed:3:5") == "ab  ef"
    assert pii.apply_spans("4111.1.1.1 x", "ip:0:10,card:0:4") == "<IP> x"
    assert pii.apply_spans("abcdef", "ip:0:4,phone:2:6") == "<IP>"
    assert pii.apply_spans(None, "") == ""


def test_empty_table(spark):
    assert pii.all_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
