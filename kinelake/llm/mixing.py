"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; its documents then share one expected
number of copies, target / size. The whole part of that is taken outright. The
fraction left is a copy probability, and the probabilities are rounded dependently:
two documents of a source meet, words of probability mass move from one to the
other at random until one probability is 0 or 1, and the other meets the next. A
move keeps both expectations and the source's expected words, so the mix misses its
target by one document at most. The pairing is a reduction tree: documents are dealt
to leaves of about ``leaf`` rows, each leaf folds to one unsettled document, and
these are dealt to leaves again until a source has one left, which is rounded to the
nearer (a draw would be exactly fair to that one document, but miss by up to all of it).

All of it is DataFrame expressions; random numbers are hashes of the ids that meet
and a seed, so reruns agree.

Cases: a null text has no words and no copies to round; repeated rows (equal id, source
and size) count as one item of several copies and get counts that differ by one at
most; a null source is a source of its own, last; of a very long text only its number of
words is mixed; an empty table gives no rows; other
columns are ignored by ``mix`` and carried along by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.llm.scratch import materialise

#: Weights of the sources in order of code point, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take, as a share of all words; and the most copies of a document.
SHARE, MOST = 1.5, 2.0
LEAF = 64

_STATE = "struct<id:string,words:double,p:double>"
_SETTLED = "array<struct<id:string,up:boolean>>"


def words(text: Column) -> Column:
    """Number of maximal runs of non-blanks; null counts 0. Runs become one letter each, then blanks go, so no array is built."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target. One row a source; sources are few beside documents.

    Reshared excess ends where every source has min(most * size, weight * level); with
    sources in order of size / weight the level follows from running sums.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    goal = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * first, F.col("cap")))).select("source", "source_size", "target")


def _fold(rows: str, seed: int) -> Column:
    """SQL fold of an array of (words, id, p): settles all but one. State: carry (null at first) and settled."""
    give = "least((1 - a.carry.p) * a.carry.words, x.p * x.words)"
    take = "least(a.carry.p * a.carry.words, (1 - x.p) * x.words)"
    draw = f"shiftrightunsigned(xxhash64({seed}L, a.carry.id, x.id), 11) / double({1 << 53})"
    full = "(1 - a.carry.p) * a.carry.words <= x.p * x.words"
    room = "(1 - x.p) * x.words <= a.carry.p * a.carry.words"
    return F.expr(f"""
      aggregate({rows}, named_struct('carry', cast(null as {_STATE}), 'settled', cast(array() as {_SETTLED})),
        (a, x) -> case
          when a.carry is null then named_struct('carry', named_struct('id', x.id, 'words', x.words, 'p', x.p), 'settled', a.settled)
          when {draw} * ({give} + {take}) < {take} then
            if({full},
              named_struct('carry', named_struct('id', x.id, 'words', x.words, 'p', x.p - {give} / x.words),
                           'settled', concat(a.settled, array(named_struct('id', a.carry.id, 'up', true)))),
              named_struct('carry', named_struct('id', a.carry.id, 'words', a.carry.words, 'p', a.carry.p + {give} / a.carry.words),
                           'settled', concat(a.settled, array(named_struct('id', x.id, 'up', false)))))
          else
            if({room},
              named_struct('carry', named_struct('id', a.carry.id, 'words', a.carry.words, 'p', a.carry.p - {take} / a.carry.words),
                           'settled', concat(a.settled, array(named_struct('id', x.id, 'up', true)))),
              named_struct('carry', named_struct('id', x.id, 'words', x.words, 'p', x.p + {take} / x.words),
                           'settled', concat(a.settled, array(named_struct('id', a.carry.id, 'up', false)))))
        end)""")


def round_dependently(items: DataFrame, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """(source, id string unique in its source, words > 0, 0 < p < 1) -> (source, id, up): up has probability p, and a source's sum of words * up stays within one item of its expectation."""
    left = materialise(items.select("source", "id", "words", "p"), "mix-items")
    done = []
    for depth in range(64):
        sizes = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        sizes = sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / leaf).alias("leaves"))
        dealt = left.join(sizes, F.col("source").eqNullSafe(F.col("s"))).withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed + depth), "id"), F.col("leaves")))
        leaves = dealt.groupBy("source", "leaf").agg(F.expr("reverse(array_sort(collect_list(struct(words, id, p))))").alias("rows"))
        folded = materialise(leaves.select("source", _fold("rows", seed).alias("out")), "mix-fold")
        done.append(folded.select("source", F.explode("out.settled").alias("s")).select("source", "s.id", "s.up"))
        left = folded.where("out.carry is not null").select("source", "out.carry.id", "out.carry.words", "out.carry.p")
    done.append(left.select("source", "id", (F.col("p") >= 0.5).alias("up")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """One row for each distinct (doc_id, source, size): with m (its rows), copies (of all m rows together), source_size and target."""
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"))
    items = materialise(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = materialise(source_targets(sources, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = items.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = expected.withColumn("whole", F.floor(rate * F.col("m"))).withColumn("p", rate * F.col("m") - F.col("whole"))
    expected = expected.withColumn("id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    unsettled = expected.where("p > 0 and p < 1 and size > 0").select("source", "id", F.col("size").cast("double").alias("words"), "p")
    ups = round_dependently(unsettled, leaf, seed).where("up").select(F.col("source").alias("s"), F.col("id").alias("i"), F.lit(1).alias("one"))
    joined = expected.join(ups, (F.col("id") == F.col("i")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("doc_id", "source", "size", "m", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("copies"), "source_size", "target")


def _share(copies: Column, m: Column, nth: Column) -> Column:
    """Of ``copies`` over ``m`` like rows, what row ``nth`` (from 1) gets."""
    return F.floor(copies / m) + F.when(nth <= copies % m, 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    plan = plan_mix(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    plan = plan.withColumn("copies", _share(F.col("copies"), F.col("m"), F.col("nth")).cast("long"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns unchanged. Documents without words keep one row."""
    plan = plan_mix(docs, id_col, text_col, source_col, **options).where("copies > 0 or size = 0")
    key = ["_n", "_i", "_no_i", "_s", "_no_s"]

    def keyed(size: Column, one: Column, source: Column) -> list[Column]:
        """Equality of these is null-safe equality of the three."""
        both = [(one, "_i", "_no_i"), (source, "_s", "_no_s")]
        return [size.alias("_n"), *[c for col, a, b in both for c in (F.coalesce(col.cast("string"), F.lit("")).alias(a), col.isNull().alias(b))]]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text"), *keyed(words(F.col(f"`{text_col}`")), F.col(f"`{id_col}`"), F.col(f"`{source_col}`")))
    met = rows.join(plan.select(*keyed(F.col("size"), F.col("doc_id"), F.col("source")), "m", "copies"), key)
    nth = F.row_number().over(W.partitionBy(*key).orderBy("_text"))
    takes = F.when(F.col("_n") == 0, 1).otherwise(_share(F.col("copies"), F.col("m"), nth)).cast("int")
    return met.withColumn("_takes", takes).where("_takes > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_takes")))).select("_row.*")
