import random
import re

import numpy as np
import pytest

from kinelake.llm import ngram_join
from kinelake.llm.ngram_join import Threshold


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, num):
    ids = [i for i, _ in rows]
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted((str(ids[i]), len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(rows)))


def corpus(n, seed):
    """Random texts over few words, with chains of edited copies, shared passages and a hub of copies that barely link."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    hub = [rng.choice(words) for _ in range(rng.randint(60, 120))]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            t = list(hub)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.5 and texts:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.7:
            t = passage + [rng.choice(words) for _ in range(rng.randint(0, 20))]
        else:
            t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize(("k", "num", "small", "cell"), [(4, 85, 32, 256), (5, 80, 3, 8), (2, 60, 3, 4)])
def test_equals_all_pairs(spark, monkeypatch, k, num, small, cell):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    monkeypatch.setattr(ngram_join, "PART_SETS", small)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(corpus(220, k))]
    rows += [(2000, None), (2001, " \t\n"), (2002, "One"), (2003, "one"), (2004, "a B c"), (2005, "A b\tC"), (2005, "a b c"), (None, "a b c"), (2006, "z " * 5000), (2007, "y" * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n int, label string").repartition(3)
    got = ngram_join.join(docs, k, Threshold(num)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute(rows, k, num)


@pytest.mark.parametrize(("small", "cell"), [(32, 256), (3, 8), (3, 2)])
def test_all_links_are_counted_and_listed(spark, monkeypatch, small, cell):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    rows = [*enumerate(corpus(120, 4)), (900, None), (901, "a b c"), (901, "a b c"), (902, "A b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [sets_of(t, 4) for _, t in rows]
    linked = [[i != j and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = ngram_join.join(docs, 4, Threshold(80)).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted((rows[i][0], sum(x)) for i, x in enumerate(linked))
    name = {sets[i]: next(r["set_id"] for r in got if r["doc_id"] == rows[i][0]) for i in range(len(rows))}
    want = {tuple(sorted((name[a], name[b]))) for i, a in enumerate(sets) for j, b in enumerate(sets) if linked[i][j] and a != b}
    assert len(want) > 100
    assert sorted(map(tuple, ngram_join.set_links(docs, 4, Threshold(80)).collect())) == sorted(want)


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base.replace("w50", "x")), (3, base.replace("w50", "x")), (9, "other text of six words here"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, set_id string")
    kept = ngram_join.keep_one(docs, 5, Threshold(80))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "9", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0 and ngram_join.keep_one(docs).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a, b = ngram_join.word_hashes("Alpha beta"), ngram_join.word_hashes("x " * 200_000 + "alpha BETA")
    assert (a == b[-2:]).all() and len(b) == 200_002
    long = "q" * 400_000
    assert ngram_join.word_hashes(f"a {long}")[1] == ngram_join.word_hashes(f"{long.upper()} b c")[0]


@pytest.mark.parametrize("seed", range(120))
def test_similar_sets_share_signatures(seed):
    """Whatever the classes, sets at the threshold or above share as many signatures as either counts on."""
    rng = np.random.default_rng(seed)
    t = Threshold(int(rng.choice([60, 80, 85])))
    size = 1 << ngram_join.COUNTER_BITS
    tables = rng.random(size) < rng.choice([0.0, 0.5, 0.95]), rng.integers(0, 255, size).astype(np.uint8), rng.integers(1, 9, size).astype(np.uint16)
    words = rng.integers(1 << 62, size=int(rng.choice([rng.integers(4, 40), rng.integers(40, 900)])), dtype=np.uint64)
    other = words.copy()
    for at in rng.integers(len(words), size=int(rng.integers(1, 1 + len(words) // 8 + 1))):
        other[at] = rng.integers(1 << 62)
    other = other[: max(3, len(other) - int(rng.integers(0, len(other) // 10 + 1)))]
    (a, x, p), (b, y, q) = (ngram_join.signatures(w, 1, t, tables) for w in (words, other))
    known = dict(zip(x.tolist(), p.tolist(), strict=True))
    assert len(x) == len(p) and all(known.get(s, c) == c for s, c in zip(y.tolist(), q.tolist(), strict=True))
    if t.links(np.array(len(np.intersect1d(a, b))), np.array(len(a)), np.array(len(b))):
        assert len(np.intersect1d(x, y)) >= max(t.shared(t.least_overlap(len(s))) for s in (a, b))


def test_sets_of_unlike_size_are_not_tied(spark):
    """Signatures that many sets share chain no sets whose sizes, or too few of whose signatures, fit."""
    t = Threshold(85)
    sizes = [10 * 2**i for i in range(3 * ngram_join.SMALL)]
    alike = [(sig, 1, 1000 + i, 400, 4) for i in range(3 * ngram_join.SMALL) for sig in (7, 8, 9, *([10 + i // 20] if i else []))]
    few = [(sig, 1, 2000 + 100 * g + i, 60, 4) for g in (0, 1) for i in range(40) for sig in (20 + g, 30 + g, 40 + g, *([50] if i < 30 else []))]
    unlike = [(sig, 1, i, n, 4) for i, n in enumerate(sizes) for sig in (1, 2, 3, 4)]
    rows = spark.createDataFrame(unlike + alike + few, "sig long, parts int, set_id long, n long, least int")
    nodes = {}
    for r in ngram_join.components(ngram_join.candidate_edges(rows, t)).collect():
        nodes.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(len, nodes.values())) == [40, 40, 3 * ngram_join.SMALL] and not any(v < 1000 for one in nodes.values() for v in one)


def test_order_tables_are_made_in_tasks(spark):
    """The driver gets the packed tables only, a third of the counters' size at most, and they are those of the counters' sums."""
    size, blocks = 1 << ngram_join.COUNTER_BITS, ngram_join._BLOCKS
    rng = np.random.default_rng(5)
    counters = rng.poisson(3, (2, 2, size)).astype(np.uint32)
    counters[:, 0, rng.integers(size, size=500)] += np.uint32(9000)
    rows = [(what, block, bytearray(ngram_join._pressed(part))) for task in counters for what in (0, 1) for block, part in enumerate(np.split(task[what], blocks))]
    packed = ngram_join.order_tables(spark.createDataFrame(rows, "what int, block int, counts binary"))
    assert sum(len(x) for row in packed for x in row[2:]) < 5_000_000
    total = counters.sum(axis=0, dtype=np.uint64)
    mean = total[0].mean()
    frequent, rarity, parts = ngram_join.unpacked(packed)
    assert (frequent == (total[0] > mean + 4 * np.sqrt(mean) + 8)).all() and 400 < frequent.sum() < size // 2
    assert (rarity == np.minimum(255, 8 * np.log2(1 + total[1])).astype(np.uint8)).all()
    assert (parts == np.clip(np.ceil(total[0] / max(ngram_join.PART_SETS, ngram_join.PART_MEANS * mean)), 1, 65535)).all() and parts.max() > 1


def test_counters_are_added_in_one_python_worker_a_task(spark, monkeypatch):
    plans = []
    real = ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    ngram_join.order_tables(spark.createDataFrame([], "what int, block int, counts binary"))
    names = [line.strip(" +-:").split(" ")[0] for line in plans[0].splitlines()]
    assert names.count("MapInArrow") == 2 and ("MapInArrow", "MapInArrow") not in list(zip(names, names[1:]))


def test_counters_leave_a_task_compressed(spark):
    """A task of few texts sends little, though its counters have a fixed size."""
    found = ngram_join.sets_and_counts(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").coalesce(1), 4, "doc_id", "text").where("what is not null").collect()
    assert len(found) == 2 * ngram_join._BLOCKS and sum(len(r["counts"]) for r in found) < 100_000
    assert [sum(int(ngram_join._counts(bytes(r["counts"])).sum()) for r in found if r["what"] == w) for w in (0, 1)] == [3, 6]


def test_order_tables_without_counters(spark):
    frequent, rarity, parts = ngram_join.unpacked(ngram_join.order_tables(spark.createDataFrame([], "what int, block int, counts binary")))
    assert not frequent.any() and not rarity.any() and (parts == 1).all()
