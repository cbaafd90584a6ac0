import random

import numpy as np
import pytest

from kinelake.llm import language, quality

WORDS = {"en": "the and that with from this have are", "de": "der und nicht für über schön straße ist", "fr": "le était où déjà garçon être la vous"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_language_held_out_accuracy_and_cases(spark):
    rows = [(*r, 0.5) for r in corpus(600)]
    rows += [(1000, None, "en", 0.1), (1001, "", "en", 0.1), (1002, "123 !!", None, 0.1), (1003, "漢字" * 300, None, 0.1), (None, "the and that " * 9000, "en", 0.1), (1, rows[1][1], rows[1][2], 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fit(docs.where(~language.held_out(docs["doc_id"])))
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    own = [r for r in got if r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.98
    assert np.mean([r["rejected"] for r in own]) < 0.01
    by_id = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    assert by_id[1003]["lang_pred"] in WORDS and by_id[1003]["rejected"]
    assert by_id[None]["lang_pred"] == "en" and not by_id[None]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {1000, 1001, 1002, 1003}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_long_texts_count_as_the_whole(monkeypatch):
    text = "Ein Straßenname, déjà vu! " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "_STEP", 100)
    parts = language.ngram_counts(text)
    assert abs(int(parts.sum()) - int(whole.sum())) < 0.25 * whole.sum()
    assert parts @ whole / np.linalg.norm(parts) / np.linalg.norm(whole) > 0.97


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert [tuple(r) for r in language.predict(docs, model).collect()] == [(1, "und", 0.0, True)]
    assert language.predict(docs.limit(0), model).count() == 0


def good(rng):
    return ". ".join(" ".join(rng.choices(["river", "stone", "walks", "green", "seldom", "quiet", "evening", "letters"], k=9)).capitalize() for _ in range(6)) + "."


def test_quality_held_out(spark):
    rng = random.Random(2)
    rows = [(i, good(rng) if i % 3 else rng.choice(["BUY!! NOW!! " * 20, "a | b | c | d " * 30, "spam " * 100]), 0) for i in range(600)]
    rows += [(900, None, 1), (901, "", 1), (None, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality.document_statistics(docs).cache()
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.95


def test_sums_give_the_closed_form():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(300, 3)), 1: rng.normal(loc=1, scale=2, size=(500, 3))}
    model = quality.from_sums({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}, 0.0, 0.0)
    rows = rng.normal(size=(5, 3))
    log_density = []
    for c in (0, 1):
        s, d = np.cov(x[c].T, bias=True), rows - x[c].mean(axis=0)
        log_density.append(np.log(len(x[c]) / 800) - 0.5 * (np.log(np.linalg.det(s)) + (d @ np.linalg.inv(s) * d).sum(axis=1)))
    assert np.allclose(model.score(rows), 1 / (1 + np.exp(log_density[0] - log_density[1])))


def test_quality_without_classes(spark):
    stats = quality.document_statistics(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(stats, quality.fit(stats, none)).first()["score"] == 0.5
    assert quality.score(stats.limit(0), quality.fit(stats, none)).count() == 0


def test_language_sample_is_bounded_and_of_distinct_texts(spark):
    """Thousands of copies of one text are one text of the sample."""
    rows = [("en", "the same text again")] * 3000 + [("en", f"an english text number {chr(97 + i % 26) * (1 + i // 26)}") for i in range(60)] + [("de", f"ein deutscher text {chr(97 + i) * 3}") for i in range(20)]
    sizes = []
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"), fit_rows=40)
    original = language.fit_sample
    try:
        language.fit_sample = lambda langs, *rest: sizes.append(sorted(langs)) or original(langs, *rest)
        language.fit(spark.createDataFrame(rows, "lang string, text string"), fit_rows=40)
    finally:
        language.fit_sample = original
    assert model.languages == ["de", "en"]
    assert len(sizes[0]) <= 40 and sizes[0].count("de") >= 10 and 10 <= sizes[0].count("en") <= 20


def test_only_letters_are_letters():
    assert not any(map(language.has_letter, ("½", "²", "42 _-!", "", None))) and all(map(language.has_letter, ("é", "中", "½a", "ß")))


def test_prediction_is_the_nearest_centroid():
    """Cosines recomputed gram by gram, with the model's own idf and centroids."""
    texts = ["the cat sat on the mat and the dog", "der hund und die katze sind hier", "le chat est sur la table et le chien"]
    counts = np.array([language.ngram_counts(t) for t in texts])
    model = language.fit_sample(["en", "de", "fr"], counts, texts, k=1)
    for text in [*texts, "the dog and the cat", "die katze", "x"]:
        padded = " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()) + " "
        vector = np.zeros(language.DIMENSIONS)
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                key = 0
                for place, c in enumerate(padded[i : i + n]):
                    key = (key + ord(c)) * int(language._MULTIPLIERS[place]) % 2**32
                vector[key >> 21] += 1
        vector = np.sqrt(vector) * model.idf
        cosines = model.centroids @ vector / np.linalg.norm(vector)
        lang, score, _ = model.predict(text)
        assert lang == model.languages[model.owner[int(np.argmax(cosines))]]
        assert score == pytest.approx(min(1.0, float(cosines.max())), abs=1e-5)


def test_quality_scores_equal_the_densities():
    """Against the discriminant written out with the covariances themselves."""
    rng = np.random.default_rng(0)
    d = 3
    rows = {c: rng.normal(size=(60 + 20 * c, d)) @ rng.normal(size=(d, d)) + c for c in (0, 1)}
    model = quality.from_sums({c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in rows.items()})
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in rows.values()) / 140
    dense = []
    for x in rows.values():
        s = 0.75 * np.cov(x.T, bias=True) + 0.2 * pooled + 0.05 * np.diag(np.diag(pooled))
        off = rows[0] - x.mean(axis=0)
        dense.append(np.log(len(x) / 140) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off)))
    assert model.score(rows[0]) == pytest.approx(1 / (1 + np.exp(dense[0] - dense[1])))
