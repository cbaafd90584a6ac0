import re

from kinelake.llm import license_scan

MIT = license_scan.TEMPLATES[15][1]


def bag(text):
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(zip(w, w[1:], strict=False))


EVERY = license_scan.TEMPLATES + license_scan.WHOLE_TEXTS


def brute(text):
    """Every run of words of every template's size is compared, not only those at cues, so this finds at least as much."""
    def plain(part):
        return re.sub("[^a-z0-9]+", " ", part.lower()).split()

    words = plain(text)
    parts = [plain(x) for x in [text, *text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), *re.split(r"(?<=[.!?])\s+", text)]]
    sizes = {len(plain(t)) for _, t in EVERY}
    parts += [words[i : i + n] for n in sizes for i in range(max(1, len(words) - n + 1))]
    scores = []
    for unit in {tuple(p) for p in parts}:
        a = set(zip(unit, unit[1:], strict=False))
        own = [(-2 * len(a & bag(t)) / (len(a) + len(bag(t))), name) for name, t in EVERY if a]
        if own and min(own)[0] <= -license_scan.LEAST:
            scores.append(min(own))
    best = min(scores, default=(None, None))
    return best[1], -best[0] if scores else None


TEXTS = ["Some words.\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-4.0", "x y z " * 2_000, MIT, "Copyright\n" + MIT.replace(". ", ".\n"), MIT.upper().replace("SOFTWARE", "Program"), "mit", "", "Released under the MIT License. " * 3, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "Released under the Moon License.", "é Released under\nthe MIT\nLicense.\n\nOther"]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(50, None, "n"), (None, TEXTS[0], "n")], "doc_id long, text string, license string")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(docs).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, text in enumerate(TEXTS):
        assert got[i][:2] == brute(text), text[:50]
    assert got[50] == (None, None, "") and got[None] == got[0]
    assert got[10][2] == "Apache-2.0,MIT"


def test_equals_sql(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    rows = [*TEXTS, None, *(t for _, t in license_scan.WHOLE_TEXTS), "walk. " * 40 + MIT.replace("of", "off") + " walk" * 40]
    con.register("documents", pd.DataFrame({"doc_id": range(len(rows)), "text": rows}))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = sorted(con.sql(license_scan.scan_sql()).fetchall())
    assert sorted(map(tuple, license_scan.scan(docs).collect())) == want and sum(r[1] is not None for r in want) > 8


def test_repeated_rows_and_empty_table(spark):
    moon = "Released under the Moon License."
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, moon), (2, moon), (2, moon), (3, MIT), (3, MIT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: (r["doc_id"], r["license"] is None))
    assert [(r["license"], r["dice"]) for r in got] == [("MIT", 1.0), ("MIT", 1.0), (None, None), (None, None), (None, None), ("MIT", 1.0), ("MIT", 1.0)]
    assert {r["body"] for r in license_scan.matches(docs).where("doc_id = 1").collect()} == {"released under the mit license"}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_notices_inside_longer_texts(spark):
    import textwrap

    whole = {name: text for name, text in license_scan.WHOLE_TEXTS}
    prose = "We walked along the river and talked about the weather. "
    texts = [
        ("MIT", "Copyright (c) 2020 A B\n\n" + textwrap.fill(whole["MIT"], 60)),
        ("BSD-2-Clause", textwrap.fill(whole["BSD-2-Clause"], 60)),
        ("MIT", "Our tool is small and fast. Released under the MIT License. Contributions are welcome from all."),
        ("MIT", "This file is released under the MIT License, see LICENSE."),
        *[(name, prose * 60 + "\n" + textwrap.fill(text, 60) + "\n" + prose * 60) for name, text in whole.items()],
        ("MIT", prose * 20 + "\n\n" + textwrap.fill(MIT, 50) + "\n\n" + prose * 20),
        (None, prose * 50 + "The software is licensed to nobody."),
        (None, None),
        (None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
    assert license_scan.scan(docs.limit(0)).count() == 0
