"""Information-theoretic sanitisation of personal data.

Pattern matches (e-mail, IP, card, phone, and secrets that are assigned to names such as
``token``) are the protected entities, each by its value and by its kind. A term reveals
an entity as far as the entity's information is contained in it: pointwise mutual
information over the entity's information content,

    PMI(c, t) / IC(c) = 1 + log2 p(c | t) / -log2 p(c),

with probabilities estimated over the distinct texts of the corpus: p(c | t) is the share
of the texts with t, anywhere in them, that hold c. Candidates are terms that stand near an
entity, or near entities of a kind, in at least ``support`` distinct texts; those whose
ratio reaches ``generalise_at`` for some entity or kind are generalised, and from
``remove_at`` on removed, wherever they occur. Matches themselves are always generalised to
their kind. An entity that stands in fewer texts than ``support`` has too little evidence
for terms of its own; its kind has. The words of a match, and the name that a secret is
assigned to, are never candidates through that match.

The work is three passes over the texts. The first finds matches and the terms around
them; pairs of entity and term are counted by key. The second looks for candidate
terms only, by a bitmap of fixed size that lets few others through; it counts them within
its tasks, and moves the terms only of texts that hold entities or stand more than once
(again by a bitmap; as that fills, more texts are moved). Pairs that can't reach the ratio
even if every text with the entity held the term are left out; those left are counted within
each text that holds entities, so the
work grows with the texts and not with the pairs of texts that share an entity. The third
pass finds where the revealing terms stand. Terms and entities meet by hash, never on the
driver.

Cases: a null text counts as empty and has no spans; repeated rows are one text for
the statistics and one row each in the result; rows whose id is null are kept; texts
without matches can still hold revealing terms; very long texts are searched whole, in
time linear in their length; an empty table has no terms; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.scratch import join_hot_split, key_bitmap, map_batches, materialise

KINDS = ("email", "ip", "card", "phone", "secret", "term", "removed")
BASE, SECRET, TERM, REMOVED = 4, 4, 5, 6  # the first four kinds are the base
SUPPORT, GENERALISE_AT, REMOVE_AT = 3, 0.9, 0.97
#: Names to which secrets are assigned.
SECRET_NAMES = frozenset(("api_key", "apikey", "api-key", "access_key", "access_token", "auth_token", "client_secret", "passwd", "password", "private_key", "pwd", "secret", "secret_key", "token"))
#: Terms so many words before and after a match count as standing near it.
NEAR = 5
BITS = 23
#: Pairs of an entity and a term that are looked up at once.
PAIRS = 1 << 20
#: Terms whose counts a task keeps before it gives them on.
COUNTED = 1 << 18

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"[:=][ \t]*+[\"']?([A-Za-z0-9_+/=-]{12,}+)")
_NAME = re.compile(r"([A-Za-z][A-Za-z_-]*)[ \t]{0,4}$")
_NONDIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{2,}")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs of letters cost one look each."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Chains of numbers and single dots are cut into fours from the left; fours with a part over 255 go."""
    out = []
    for chain in _DOTTED.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        parts = list(_DIGITS.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(_at_most_255(p.group()) for p in parts[i : i + 4]):
                out.append((parts[i].start(), parts[i + 3].end()))
    return out


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * x, 10)) for x in values[1::2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _NONDIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NONDIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """All base matches, by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, *s) for s in emails(text)]
    if _DIGITS.search(text):
        found += [(1, *s) for s in ips(text)]
        found += [(2, *s) for s in cards(text)]
        if "+" in text:
            found += [(3, *s) for s in phones(text)]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def secret_matches(text: str) -> list[tuple[int, int, int]]:
    """(start of the name, start, end) of values of 12 or more characters that are assigned (= or :) to one of SECRET_NAMES."""
    if "=" not in text and ":" not in text:
        return []
    out = []
    for m in _ASSIGNED.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 24), m.start())
        if name and name[1].lower() in SECRET_NAMES:
            out.append((name.start(1), *m.span(1)))
    return out


def secret_spans(text: str) -> list[Span]:
    return [(SECRET, a, b) for _, a, b in secret_matches(text)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def hashed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def entity(kind: int, match: str) -> int:
    """Cards and phones are the same entity however their digits are set apart; e-mails whatever their case."""
    return hashed(f"{kind}:{match.lower() if kind < 2 else match if kind == SECRET else _NONDIGIT.sub('', match)}")


def near_terms(text: str, spans: list[Span], near: int = NEAR) -> set[tuple[int, int]]:
    """(entity, term) and (kind, term) for the ``near`` words before and after each match.

    Words that begin in a match, or in the name a secret is assigned to, are passed over: a
    pattern's own words aren't evidence. A neighbourhood is counted in words, however far apart.
    """
    if not spans:
        return set()
    covers = sorted([(a, b) for _, a, b in spans] + [(name, a) for name, a, _ in secret_matches(text)])
    lows = np.array([a for a, _ in covers])
    highs = np.maximum.accumulate([b for _, b in covers])
    starts = np.fromiter((m.start() for m in _WORD.finditer(text)), dtype=np.int64)
    last = np.searchsorted(lows, starts, side="right") - 1
    free = starts[(last < 0) | (starts >= highs[last])]
    out = set()
    for kind, a, b in spans:
        me = entity(kind, text[a:b])
        i, j = np.searchsorted(free, (a, b))
        for at in (*free[max(0, i - near) : i].tolist(), *free[j : j + near].tolist()):
            term = hashed(_WORD.match(text, at).group().lower())
            out.update(((me, term), (kind, term)))
    return out


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, base (its spans joined), found (base and secrets, joined), n (by kind), held (its entities and kinds), and pairs of them with terms near."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "text_hash", "base", "found", "n", "held", "entities", "terms"]

    def run(batches):
        longs = pa.list_(pa.int64())
        types = (pa.int64(), pa.string(), pa.string(), longs, longs, longs, longs)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = sorted([*base, *secret_spans(text)], key=lambda s: (s[1], s[0], s[2]))
                pairs = sorted(near_terms(text, spans))
                held = sorted({x for k, a, b in spans for x in (k, entity(k, text[a:b]))})
                counts = [sum(s[0] == k for s in spans) for k in range(SECRET + 1)]
                rows.append((hashed(text), joined(base), joined(spans), counts, held, [c for c, _ in pairs], [t for _, t in pairs]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    schema = f"doc_id {kind}, text_hash long, base string, found string, n array<long>, held array<long>, entities array<long>, terms array<long>"
    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, schema)


class _Filter:
    """Which words the bitmap lets through, with their hashes; recent answers are remembered."""

    def __init__(self, bitmap: bytes, bits: int):
        self.words, self.mask, self.seen = np.frombuffer(bitmap, dtype=np.uint8), (1 << bits) - 1, {}

    def terms(self, text: str) -> dict[str, int]:
        if len(self.seen) > 200_000:
            self.seen.clear()
        out = {}
        for word in set(_WORD.findall(text)):
            if word not in self.seen:
                h = hashed(word.lower())
                self.seen[word] = h if self.words[(h & self.mask) >> 3] >> (h & 7) & 1 else None
            if (h := self.seen[word]) is not None:
                out[word] = h
        return out


def terms_of_texts(docs: DataFrame, bitmap: np.ndarray, moved: np.ndarray, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The terms of texts that the bitmap lets through, as (text_hash, terms, n).

    Texts that ``moved``, a bitmap by text hash of the same size, lets through have a row each, without n. All others, each standing
    once, are only counted: rows without text_hash give, for parts of a task's rows, in how many texts (n) each term stands.
    """
    context, mask = docs.sparkSession.sparkContext, (1 << bits) - 1
    shared, whole = context.broadcast(bitmap.tobytes()), context.broadcast(moved.tobytes())
    longs = pa.list_(pa.int64())

    def table(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), longs, longs))], ["text_hash", "terms", "n"])

    def sums(counts: Counter) -> pa.RecordBatch:
        terms = list(counts)
        parts = (terms[i : i + 4096] for i in range(0, len(terms), 4096))
        return table([(None, part, [counts[t] for t in part]) for part in parts])

    def run(batches):
        passing, counts = _Filter(shared.value, bits), Counter()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py() or ""
                if terms := set(passing.terms(text).values()):
                    own = hashed(text)
                    if whole.value[(own & mask) >> 3] >> (own & 7) & 1:
                        rows.append((own, sorted(terms), None))
                    else:
                        counts.update(terms)
            yield table(rows)
            if len(counts) > COUNTED:
                yield sums(counts)
                counts.clear()
        yield sums(counts)

    return map_batches(docs.select(F.col(f"`{text_col}`")), run, "text_hash long, terms array<long>, n array<long>")


def find_terms(docs: DataFrame, bitmap: np.ndarray, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, term, starts, ends) for each term of a document that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        passing = _Filter(shared.value, bits)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if wanted := passing.terms(text):
                    spans: dict[int, list[tuple[int, int]]] = {}
                    for m in _WORD.finditer(text):
                        if m.group() in wanted:
                            spans.setdefault(wanted[m.group()], []).append(m.span())
                    own = hashed(text)
                    rows += [(doc_id, own, term, [a for a, _ in s], [b for _, b in s]) for term, s in sorted(spans.items())]
            types = (batch.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "text_hash", "term", "starts", "ends"])

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, f"doc_id {kind}, text_hash long, term long, starts array<long>, ends array<long>")


def text_pairs(base: DataFrame) -> DataFrame:
    """(text_hash, entity, term) of terms near entities and kinds, each once a distinct text."""
    pairs = base.where(F.size("entities") > 0).select("text_hash", F.explode(F.arrays_zip("entities", "terms")).alias("p"))
    return pairs.select("text_hash", F.col("p.entities").alias("entity"), F.col("p.terms").alias("term")).distinct()


def candidate_pairs(base: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term): those near each other in ``support`` distinct texts."""
    return text_pairs(base).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("entity", "term")


def pairs_of_texts(rows: DataFrame, possible: DataFrame, bits: int = BITS) -> DataFrame:
    """(entity, term, n): n of the texts in ``rows`` (held, terms) hold both, summed within tasks; of pairs that aren't ``possible`` only the few that the bitmaps let through.

    The work is that of the texts with entities, by their own entities and terms. A task looks up at most PAIRS at once and gives its sums on when they are more.
    """
    mask, context = (1 << bits) - 1, rows.sparkSession.sparkContext
    of_entity = context.broadcast(key_bitmap(possible, F.col("entity").bitwiseAND(F.lit(mask)), bits).tobytes())
    of_pair = context.broadcast(key_bitmap(possible, F.col("entity").bitwiseXOR(F.col("term")).bitwiseAND(F.lit(mask)), bits).tobytes())

    def passing(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
        keys = keys & mask
        return (bitmap[keys >> 3] >> (keys & 7).astype(np.uint8) & 1).astype(bool)

    names = ["entity", "term", "n"]
    none = pa.table([pa.array([], pa.int64())] * 3, names)

    def summed(sums: pa.Table | None, fresh: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables([none if sums is None else sums, *fresh])
        return both.group_by(names[:2]).aggregate([("n", "sum")]).select([*names[:2], "n_sum"]).rename_columns(names)

    def run(batches):
        entities, pairs = (np.frombuffer(x.value, dtype=np.uint8) for x in (of_entity, of_pair))
        sums, fresh, waiting = None, [], 0
        for batch in batches:
            for mine, words in zip(batch.column(0), batch.column(1), strict=True):
                c, t = (x.values.to_numpy() for x in (mine, words))
                c = c[passing(entities, c)]
                for part in range(0, len(c), step := max(1, PAIRS // len(t))):
                    i, j = np.nonzero(passing(pairs, c[part : part + step, None] ^ t[None, :]))
                    fresh.append(pa.table([c[part + i], t[j], np.ones(len(i), dtype=np.int64)], names))
                    waiting += len(i)
                    if waiting > PAIRS:
                        sums, fresh, waiting = summed(sums, fresh), [], 0
                        if len(sums) > PAIRS:
                            yield from sums.to_batches()
                            sums = None
        yield from summed(sums, fresh).to_batches()

    return map_batches(rows.select("held", "terms"), run, "entity long, term long, n long")


def moved_texts(base: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the hashes of texts that hold entities or stand more than once."""
    texts = base.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.size("held")).alias("held"))
    return key_bitmap(texts.where("copies > 1 or held > 0"), F.col("text_hash").bitwiseAND(F.lit((1 << bits) - 1)), bits)


def disclosing_terms(base: DataFrame, candidates: DataFrame, terms: DataFrame, generalise_at: float = GENERALISE_AT, bits: int = BITS) -> DataFrame:
    """(term, disclosure): terms whose largest PMI / IC over the entities and kinds reaches ``generalise_at``; ``terms`` as terms_of_texts gives them."""
    texts = base.agg(F.count_distinct("text_hash")).first()[0]
    held = base.where(F.size("held") > 0).groupBy("text_hash").agg(F.first("held").alias("held"))
    with_entity = held.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    moved = terms.where("text_hash is not null").groupBy("text_hash").agg(F.first("terms").alias("terms"))
    moved = materialise(moved.join(held, "text_hash", "left"), "pii-moved")
    counted = terms.where("text_hash is null").select(F.explode(F.arrays_zip("terms", "n")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.n").alias("n"))
    every = counted.unionByName(moved.select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n")))
    with_term = every.groupBy("term").agg(F.sum("n").alias("with_term"))
    content = -F.log2(F.col("with_entity") / F.lit(texts))

    def ratio(both: Column) -> Column:
        return 1 + F.log2(both / F.col("with_term")) / content

    possible = candidates.join(with_entity, "entity").join(with_term, "term").where((F.col("with_entity") < texts) & (ratio(F.least("with_entity", "with_term")) >= generalise_at))
    possible = materialise(possible, "pii-pairs")
    both = pairs_of_texts(moved.where("held is not null"), possible, bits).groupBy("entity", "term").agg(F.sum("n").alias("with_both"))
    scored = both.join(possible, ["entity", "term"]).groupBy("term").agg(F.max(ratio(F.col("with_both"))).alias("disclosure"))
    return scored.where(F.col("disclosure") >= generalise_at)


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(base, added): every document's matches, and for documents with revealing terms (doc_id, text_hash, spans) of those."""
    base = materialise(find_base(docs, id_col, text_col), "pii-base")
    candidates = materialise(candidate_pairs(base, support), "pii-candidates")
    bit = F.col("term").bitwiseAND(F.lit((1 << bits) - 1))
    held = materialise(terms_of_texts(docs, key_bitmap(candidates, bit, bits), moved_texts(base, bits), bits, text_col), "pii-held")
    terms = materialise(disclosing_terms(base, candidates, held, generalise_at, bits), "pii-disclosing")
    found = materialise(find_terms(docs, key_bitmap(terms, bit, bits), bits, id_col, text_col), "pii-terms")
    sizes = found.groupBy("term").agg(F.count(F.lit(1)).alias("rows")).join(terms, "term")
    hits = join_hot_split(found, sizes, ["term"], "rows", found.count())
    name = F.when(F.col("disclosure") >= remove_at, KINDS[REMOVED]).otherwise(KINDS[TERM])
    spans = hits.select("doc_id", "text_hash", "term", F.struct(name.alias("kind"), "starts", "ends").alias("s")).dropDuplicates(["doc_id", "text_hash", "term"])
    return base, spans.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("added"))


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_spans, base (spans joined), spans (all, joined)."""
    base, added = analyse(docs, id_col, text_col, **options)
    right = added.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "added")
    rows = base.select("doc_id", "text_hash", "base", "found", "n").join(right, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, terms = [], []
            for own, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in own.split(",") if x)]
                extra = [(KINDS.index(s["kind"]), a, b) for s in more or [] for a, b in zip(s["starts"], s["ends"], strict=True)]
                terms.append(len(extra))
                texts.append(joined(sorted(spans + extra, key=lambda s: (s[1], s[0], s[2]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(texts, pa.string()), pa.array(terms, pa.int64()), batch.column(3)], ["doc_id", "base", "spans", "n_term", "n"])

    merged = map_batches(rows.select("doc_id", "found", "added", "n", "base"), run, f"doc_id {kind}, base string, spans string, n_term long, n array<long>")
    counts = [F.col("n")[k].alias(f"n_{KINDS[k]}") for k in range(SECRET + 1)]
    every = F.aggregate("n", F.col("n_term"), lambda a, x: a + x).alias("n_spans")
    return merged.select("doc_id", *counts, "n_term", every, "base", "spans")


def apply_spans(text: str | None, spans: str) -> str:
    """The text with each span replaced: matches and generalised terms by their kind, removed terms by nothing. Of overlapping spans the longest run is replaced as the first one's kind."""
    text = text or ""
    out, at = [], 0
    rows = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    for a, b, kind in rows:
        b = -b
        if a >= at:
            out += [text[at:a], "" if kind == KINDS[REMOVED] else f"<{kind.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text_hash, text): the sanitised texts. Spans join their texts by id and text hash."""
    hash_udf = F.pandas_udf(lambda s: s.map(lambda t: hashed(t or "")), "long")
    replace = F.pandas_udf(lambda s, p: s.combine(p, apply_spans), "string")
    base, added = analyse(docs, id_col, text_col, **options)
    pieces = F.transform(F.col("added"), lambda s: F.transform(F.arrays_zip(s["starts"], s["ends"]), lambda p: F.concat_ws(":", s["kind"], p["starts"], p["ends"])))
    more = F.coalesce(F.array_join(F.flatten(pieces), ","), F.lit(""))
    right = added.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "added")
    rows = base.select("doc_id", "text_hash", "found").distinct().join(right, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    rows = rows.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.concat_ws(",", "found", more).alias("spans"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), hash_udf(F.col(f"`{text_col}`")).alias("text_hash"))
    met = texts.join(rows, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")))
    return met.select("doc_id", "text_hash", replace("text", "spans").alias("text"))
