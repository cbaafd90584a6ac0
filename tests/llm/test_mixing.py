from collections import Counter

import pytest

from kinelake.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, m int"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], SCHEMA)


def water_fill(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by repeated capping and resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i * 37 % 40), ["b", "a", None, "d", "é"][i % 7 % 5]) for i in range(1500)]
    docs = corpus(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _ in rows]
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == 1 + r["doc_id"] * 37 % 40 and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = water_fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 21
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_rounding_keeps_probabilities(spark):
    """Over many seeds each item is up about as often as its probability says, and each sum stays within one item."""
    items = [("s", str(i), float(1 + i % 5), [0.2, 0.5, 0.7][i % 3]) for i in range(60)]
    frame = spark.createDataFrame(items, "source string, id string, words double, p double")
    ups, goal = Counter(), sum(w * p for _, _, w, p in items)
    rounds = 12
    for seed in range(rounds):
        up = {r["id"] for r in mixing.round_dependently(frame, leaf=16, seed=seed).collect() if r["up"]}
        assert abs(sum(w for _, i, w, _ in items if i in up) - goal) <= 5
        ups.update(up)
    for p in (0.2, 0.5, 0.7):
        mine = [i for _, i, _, q in items if q == p]
        assert abs(sum(ups[i] for i in mine) / len(mine) / rounds - p) < 0.12


def test_repeated_rows_nulls_and_blanks(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "a b", "s"), (None, None, "s"), (2, "", None), (3, "x " * 30_000, "t")]
    docs = corpus(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    copies = [r["copies"] for r in got if r["doc_id"] == 1]
    assert max(copies) - min(copies) <= 1
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    assert counts[1] == sum(copies) and counts[3] == next(r["copies"] for r in got if r["doc_id"] == 3) and counts[2] == 1


def test_empty_table(spark):
    docs = corpus(spark, [])
    assert mixing.mix(docs).count() == 0 and mixing.apply_mix(docs).count() == 0
