import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import fingerprints as fp

M = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def toss(left, own):
    if left == own:
        return 0
    differ = left ^ own
    at = (differ & -differ).bit_length() - 1
    return 2 * at + (own >> at & 1)


def parse_once(symbols, first):
    """Phrases of one level as lists of (symbol, run length) and their names, by plain loops."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]
    for _ in range(3 if first else 4):
        labels = [toss(a, b) for a, b in zip([0, *labels[:-1]], labels)]
    assert max(labels) < 6
    out = []
    for i, run in enumerate(runs):
        if i == 0 or 0 < i < len(runs) - 1 and labels[i - 1] < labels[i] > labels[i + 1]:
            out.append([])
        out[-1].append(tuple(run))
    names = []
    for phrase in out:
        total = 0
        for k, (s, n) in enumerate(phrase):
            v = mix((s + 1) * ODD & M) if first else s
            v = mix(v + n * ODD & M) if n > 1 else v
            total += v * pow(ODD, k, 1 << 64)
        names.append(mix((total & M) ^ ODD))
    return out, names


def slow(text):
    symbols, parts, level = list(text), [], 0
    while symbols and (level == 0 or len(symbols) > 1):
        level += 1
        symbols = parse_once(symbols, level == 1)[1]
        keys = sorted({n >> 24 for n in symbols})
        if len(keys) <= 4 * fp.KEEP:
            parts.append(f"{level}:{len(keys)}:" + "".join(f"{k >> 8 & 0xFFFFFFFF:08x}" for k in keys[: fp.KEEP]))
    return ",".join(parts)


def samples():
    rng = random.Random(4)
    words = ["river", "stone", "aaaa", "the", "über", "naïve", "    ", "zz", "日本語"]
    texts = ["", "a", "aa", "ab", "a" * 5000, "ab" * 3000, "x" * 70 + "y", "\x00\x00a\x00"]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]


def test_fingerprints_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(fp, "PART", 3000)  # several groups, and texts beyond one
    texts = [t.encode() for t in samples()]
    assert fp.fingerprints(texts) == [slow(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6))
def test_any_bytes(texts):
    assert fp.fingerprints(texts) == [slow(t) for t in texts]


def test_equal_substrings_are_cut_alike_whatever_their_offset():
    rng = random.Random(7)
    same = bytes(rng.randrange(97, 123) for _ in range(600))
    for _ in range(20):
        before, after = (bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 90))) for _ in "ab")
        cuts = []
        for text, offset in ((same, 0), (before + same + after, len(before))):
            at, starts = 0, set()
            for phrase in parse_once(list(text), True)[0]:
                starts.add(at - offset)
                at += sum(n for _, n in phrase)
            cuts.append({s for s in starts if 20 <= s < 580})
        assert cuts[0] == cuts[1]


def test_likeness():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for n in (40, 300, 5000):
        one, two = make(n), make(n)
        half = one[: len(one) // 2] + two[len(two) // 2 :]
        a, b, c, moved = fp.fingerprints([t.encode() for t in (one, two, half, "Some words before it. " + one)])
        assert fp.likeness(a, a) == 1.0
        assert 0.3 < fp.likeness(a, c) < 0.7
        assert fp.likeness(a, b) < 0.25
        assert fp.likeness(a, moved) > 0.8
    assert fp.likeness("", "") == 1.0
    assert fp.likeness("", a) == 0.0


def brute(rows):
    """Rows by descending id, null last; ties by Spark's order aren't tested here."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = slow(text.encode()), slow(edited.encode()), slow(after.encode())
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_edited_texts_equal_brute_force(spark):
    texts = samples()
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(-500, None), (None, "a document without an id")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, cell int, fingerprint string").repartition(5)
    for cells in (1, 7, 60):
        got = [tuple(r) for r in fp.with_edits(docs, cells=cells).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)
    plain = {(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in fp.fingerprint_column(docs).collect()}
    assert plain == {(r[0], r[1], r[3]) for r in brute(rows)}


def test_repeated_rows_and_ids(spark):
    rows = [(5, "the same text again and again")] * 400 + [(5, f"other {i}") for i in range(30)] + [(9, "first of all"), (1, "last of all")]
    got = fp.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), cells=20).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["n_chars"] == len(rows[0][1])]
    assert len(same) == 400
    assert sum(r["near_next"] == 1.0 for r in same) == 399  # each but the last is followed by an equal row
    last = next(r for r in got if r["doc_id"] == 1)
    assert last["edited_sha256"] == hashlib.sha256(b"last ofirst").hexdigest()


def test_empty_table_one_row_and_a_long_text(spark):
    schema = "doc_id long, text string"
    assert fp.with_edits(spark.createDataFrame([], schema)).collect() == []
    only = fp.with_edits(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert [(r["doc_id"], r["edited_sha256"]) for r in only] == [(3, hashlib.sha256(b"abcabc").hexdigest())]
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode()
    a, b = sorted(fp.with_edits(spark.createDataFrame([(1, long), (2, long + "!")], schema)).collect(), key=lambda r: r["doc_id"])
    assert a["n_chars"] == 3_000_000 and a["near_next"] > 0.8 and a["near_edited"] > 0.3
