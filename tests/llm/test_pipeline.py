"""The pipeline's stages against brute force on a small corpus."""

import random
import re

import tiktoken

import corpus_pipeline
from kinelake.llm import bpe
from kinelake.llm.queries import tokenizer_path

WORDS = {"en": "the and that with from this have are river stone", "de": "der und nicht für über schön straße ist fluss stein"}


def corpus():
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(WORDS[lang].split()) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(5, 80))), lang) for lang in ("en", "de") for _ in range(60)]
    texts += [(t + " ", lang) for t, lang in texts[:10]]
    for t, lang in texts[20:40]:
        words = t.split()
        words[rng.randrange(len(words))] = "zz"
        texts.append((" ".join(words), lang))
    texts += [(None, "en"), ("", "en"), ("12 34 !!", None)]
    return [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        results.append(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(now.columns) == sorted(docs.columns)

    by_id = {r[0]: r for r in rows}
    kept = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in results]
    letters = [i for i, t, *_ in rows if t and re.search("[a-z]", t)]
    assert kept[0] == letters

    first = {}
    for i in letters:
        first.setdefault(re.sub(r"\s+", " ", by_id[i][1]), i)
    assert kept[1] == sorted(first.values())

    sets = {i: shingles(by_id[i][1]) for i in kept[1]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert kept[2] == sorted({find(i) for i in sets}) and len(kept[2]) < len(kept[1])

    sizes = {i: len(by_id[i][1].split()) for i in kept[2]}
    assert set(kept[3]) <= set(kept[2]) and all(kept[3].count(i) <= 2 for i in kept[2])
    total, taken = sum(sizes.values()), sum(sizes[i] for i in kept[3])
    assert abs(taken - 1.5 * total) <= 3 * max(sizes.values()) / 2

    whole = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    assert kept[4] == kept[3]
    for r in results[4].collect():
        assert r["ids"] == whole.encode_ordinary(by_id[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"]) and r["lossless"]


def test_run_equals_its_stages_and_empty_input(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "lossless"] and out.count() == 0


def test_repeated_rows_clashing_columns_and_long_texts(spark, tmp_path):
    """Every stage on rows that repeat, extra columns named like the operators' own, and a text far longer than the rest."""
    rows = corpus()[:60]
    long = " ".join(f"the river and stone{i} that have {i % 97}" for i in range(30_000))
    rows += [rows[3]] * 5 + [rows[4]] * 2 + [(500, long, "en", "src0", len(long)), (501, None, "en", None, 0)]
    extra = [(*r, f"label{r[0]}", 7, "k", 1.5) for r in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, label string, n int, digest string, copies double")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "_"))
        before = {tuple(r) for r in docs.collect()} if name != "byte-level BPE" else None
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        got = docs.collect()
        if before is not None:
            assert docs.columns == columns and {tuple(r) for r in got} <= before  # rows go along unchanged
        count = sum(r["doc_id"] == 3 for r in got)
        assert count == 6 if name == "language ID" else count >= 1 if name == "exact dedup" else True
        if name in ("exact dedup", "n-gram Jaccard join"):
            assert len({r["doc_id"] for r in got}) == len(got)
        if name != "mixing" and name != "byte-level BPE":
            assert any(r["doc_id"] == 500 and r["text"] == long for r in got)
    assert all(r["lossless"] for r in got) and all(r["n_tokens"] > 100_000 for r in got if r["doc_id"] == 500)
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty, str(tmp_path)).collect() == []
