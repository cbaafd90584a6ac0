"""Licence scan: Dice coefficient over word bigrams between texts and licence templates.

A document's units are its lines, paragraphs and sentences, itself as a whole, and windows
of each template's number of words, laid so that a cue word stands where the template has
it. Units and templates are lower-cased, everything but a-z and 0-9 becomes one blank, and
their sets of word bigrams are compared: dice = 2 |A and B| / (|A| + |B|). A unit can only
reach ``least`` against a template of size b if its own size is between
least / (2 - least) * b and (2 - least) / least * b. The lower bound also goes by a unit's
length, before its bigrams are made; the upper one needs the set, as a long unit may
repeat few bigrams. Only templates whose bounds hold are compared. As a match shares that
least size of bigrams, each template has a few long words (cues) of which a match holds one;
documents without any of them aren't cut into units. Templates are one-line notices and
whole licence texts.

All of it is expressions over one row, so no row is moved, and the templates are literals
of the plan.

Cases: null and empty texts match nothing; units of one word have no bigrams; a unit's
best template is that of the largest Dice, then the smaller name; a document's is that
of its best unit, by the same order; every row is scanned by itself, so repeated rows and
rows with equal or null ids get their own text's result; documents without a match have a
null licence; very long texts are scanned whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: More than the words of any template.
WINDOW_STEP = 4096

#: Names of public licences and notices or texts by which they are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole licence texts, without the line that names the holder.
WHOLE_TEXTS = (
    ("BSD-2-Clause", TEMPLATES[2][1] + " " + _AS_IS_BSD),
    ("ISC", TEMPLATES[12][1] + " " + _AS_IS_ISC),
    ("MIT", TEMPLATES[15][1] + " " + _AS_IS),
)


def normalised(text: Column) -> Column:
    """Lower case, and anything but a-z, 0-9 and line ends as one blank."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def bigram_set(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit; null with fewer than two words."""
    words = F.filter(F.split(F.regexp_replace(unit, "\n", " "), " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs))


def bigrams_of(body: str) -> set[tuple[str, str]]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in body.lower()).split()
    return set(zip(words, words[1:], strict=False))


def cue_words(templates, least: float) -> list[str]:
    """Words of which every unit that matches some template holds one: without them, too few of its bigrams are left. Long words first."""
    cues: set[str] = set()
    for _, body in templates:
        left = bigrams_of(body)
        needed = least / (2 - least) * len(left)
        words = sorted({w for pair in left for w in pair}, reverse=True)
        for word in sorted(words, key=lambda w: (w not in cues, -len(w))):
            if len(left) < needed:
                break
            cues.add(word)
            left = {pair for pair in left if word not in pair}
    return sorted(cues)


def template_table(templates) -> Column:
    """A literal array of (license, b, bag): each template's name, number of bigrams, and bigrams."""
    rows = [(name, sorted(" ".join(pair) for pair in bigrams_of(body))) for name, body in templates]
    return F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(bag)).alias("b"), F.array(*map(F.lit, bag)).alias("bag")) for name, bag in rows if bag])


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def hopeful(text: Column, templates, least: float) -> Column:
    """Whether a text holds a cue word of some template. Short words are parts of many others, so they must stand alone."""

    def holds(lowered: Column) -> Column:
        out = F.lit(False)
        for cue in cue_words(templates, least):
            out = out | (lowered.contains(cue) if len(cue) > 4 else lowered.rlike(f"(?:^|[^a-z0-9]){cue}(?:[^a-z0-9]|$)"))
        return out

    return F.coalesce(F.exists(F.array(F.lower(text)), holds), F.lit(False))


def window_table(templates, least: float) -> dict[str, list[int]]:
    """For each cue word of a template: its offset there times WINDOW_STEP, plus the template's number of words."""
    out: dict[str, set[int]] = {}
    for name, body in templates:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in body.lower()).split()
        for cue in cue_words([(name, body)], least):
            out.setdefault(cue, set()).update(at * WINDOW_STEP + len(words) for at, word in enumerate(words) if word == cue)
    return {cue: sorted(spots) for cue, spots in sorted(out.items())}


def windows(words: Column, templates, least: float) -> Column:
    """The windows of an array of words, each as one string."""
    spots = window_table(templates, least)
    table = F.create_map(*[x for cue, at in spots.items() for x in (F.lit(cue), F.array(*[F.lit(a).cast("long") for a in at]))])
    known = F.array(*map(F.lit, spots))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(known, x["w"]))
    starts = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(table, x["w"]), lambda s: F.greatest(x["i"] - F.floor(s / WINDOW_STEP), F.lit(0)) * WINDOW_STEP + s % WINDOW_STEP)))
    return F.transform(F.array_distinct(starts), lambda x: F.array_join(F.slice(words, (F.floor(x / WINDOW_STEP) + 1).cast("int"), (x % WINDOW_STEP).cast("int")), " "))


def units(text: Column, templates, least: float) -> Column:
    """The distinct normalised units of a text."""

    def plain(part: Column) -> Column:
        return F.regexp_replace(normalised(part), "\n", " ")

    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\x0B\f\r]+", "$1\u0001"), "\u0001")
    parts = F.transform(F.concat(paragraphs, sentences), plain)
    at_cues = once(F.filter(F.split(plain(text), " "), lambda w: w != ""), lambda words: windows(words, templates, least))
    return F.array_distinct(F.transform(F.concat(F.array(plain(text)), F.split(normalised(text), "\n"), parts, at_cues), lambda u: F.trim(u)))


def found_units(text: Column, templates=TEMPLATES + WHOLE_TEXTS, least: float = LEAST) -> Column:
    """An array of (minus, license, body) of the units with a template of at least ``least``: minus the Dice, its template, the unit. Empty without any."""
    low, high = least / (2 - least), (2 - least) / least
    sizes = sorted({len(bigrams_of(body)) for _, body in templates})
    table = template_table(templates)

    def fits(n: Column) -> Column:
        out = F.lit(False)
        for size in sizes:
            out = out | n.between(low * size, high * size)
        return out

    def best(unit: Column) -> Column:
        """Of a unit (body, set, n): its best template."""
        near = F.filter(table, lambda t: unit["n"].between(low * t["b"], high * t["b"]))
        scores = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(unit["set"], t["bag"])) / (unit["n"] + t["b"])).alias("minus"), t["license"].alias("license")))
        return once(F.array_min(scores), lambda x: F.struct(x["minus"].alias("minus"), x["license"].alias("license"), unit["body"].alias("body")))

    # A unit's bigrams are fewer than its blanks and two letters each at least, so short units go by their length alone.
    long_enough = F.filter(units(text, templates, least), lambda u: F.length(u) >= 2 * low * sizes[0])
    sets = F.filter(F.transform(long_enough, lambda u: F.struct(u.alias("body"), bigram_set(u).alias("set"))), lambda x: x["set"].isNotNull())
    sized = F.filter(F.transform(sets, lambda x: F.struct(x["body"].alias("body"), x["set"].alias("set"), F.size(x["set"]).alias("n"))), lambda x: fits(x["n"]))
    found = F.filter(F.transform(sized, best), lambda x: x["minus"] <= -least)
    empty = F.array().cast("array<struct<minus:double,license:string,body:string>>")
    return F.when(hopeful(text, templates, least), found).otherwise(empty)


def matches(docs: DataFrame, templates=TEMPLATES + WHOLE_TEXTS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, body): every distinct unit of a document that matches, with its best template."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found_units(F.col(f"`{text_col}`"), templates, least)).alias("x"))
    return rows.select("doc_id", "x.license", (-F.col("x.minus")).alias("dice"), "x.body")


def scan(docs: DataFrame, templates=TEMPLATES + WHOLE_TEXTS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, license, dice, licenses (all found, in order, comma-joined)."""
    summary = once(
        found_units(F.col(f"`{text_col}`"), templates, least),
        lambda found: F.struct(F.array_min(F.transform(found, lambda x: F.struct(x["minus"].alias("minus"), x["license"].alias("license")))).alias("best"), F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"]))), ",").alias("licenses")),
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), summary.alias("s"))
    return rows.select("doc_id", F.col("s.best.license").alias("license"), (-F.col("s.best.minus")).alias("dice"), F.col("s.licenses").alias("licenses"))


def scan_sql(templates=TEMPLATES + WHOLE_TEXTS, least: float = LEAST) -> str:
    """The same over a table ``documents`` with one row a doc_id, in DuckDB's SQL."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    spots = ", ".join(f"('{cue}', {x // WINDOW_STEP}, {x % WINDOW_STEP})" for cue, at in window_table(templates, least).items() for x in at)
    low, high = least / (2 - least), (2 - least) / least

    def words(body: str) -> str:
        return f"list_filter(string_split({body}, ' '), lambda w: w <> '')"

    def sets(rows: str) -> str:
        return f"SELECT * FROM (SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bag FROM (SELECT *, {words('body')} AS w FROM {rows})) WHERE len(w) >= 2"

    def plain(text: str) -> str:
        return f"regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')"

    paragraphs = r"unnest(regexp_split_to_array(text, '\n[ \t\r]*\n'))"
    sentences = r"unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)))"
    return rf"""
WITH t(template, license, raw) AS (VALUES {quoted}),
tb AS ({sets("(SELECT template, license, " + plain("raw") + " AS body FROM t)")}),
spots(cue, place, size) AS (VALUES {spots}),
dw AS (SELECT doc_id, {words(plain("text"))} AS words FROM documents),
hits AS (
  SELECT DISTINCT doc_id, greatest(i - place, 0) AS start, size
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM dw) JOIN spots ON word = cue
),
u AS (
  SELECT doc_id, {plain("text")} AS body FROM documents
  UNION SELECT doc_id, {plain("unnest(string_split(text, chr(10)))")} FROM documents
  UNION SELECT doc_id, {plain(paragraphs)} FROM documents
  UNION SELECT doc_id, {plain(sentences)} FROM documents
  UNION SELECT doc_id, array_to_string(words[start + 1 : start + size], ' ') FROM hits JOIN dw USING (doc_id)
),
ub AS (SELECT * FROM ({sets("u")}) WHERE len(bag) <= {high} * (SELECT max(len(bag)) FROM tb)),
pairs AS (
  SELECT doc_id, license, 2.0 * len(list_intersect(ub.bag, tb.bag)) / (len(ub.bag) + len(tb.bag)) AS dice, ub.body
  FROM ub JOIN tb ON len(ub.bag) BETWEEN {low} * len(tb.bag) AND {high} * len(tb.bag)
),
best AS (SELECT doc_id, body, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM pairs WHERE dice >= {least} GROUP BY doc_id, body),
found AS (
  SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
  FROM best GROUP BY doc_id
)
SELECT d.doc_id, license, dice, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN found USING (doc_id)
"""
