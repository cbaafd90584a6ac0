import hashlib
import re

import pytest

from kinelake.llm import exact_dedup

ROWS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (None, "a\tb"), (5, "x" * 50000), (6, "x" * 50000), (7, "c"), (7, "c"), (9, " c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, digest string, keep_id int")


def test_an_index_is_made_without_python_workers(spark, monkeypatch):
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    index = exact_dedup.scratch_index(spark, buckets=4)
    assert index.read().count() == 0 and dict(index.read().dtypes) == {"digest": "string", "first_id": "bigint", "batch": "string"}
    index.drop()


def test_decisions_equal_brute_force(spark):
    index = exact_dedup.scratch_index(spark, buckets=4)
    got = exact_dedup.deduplicate(frame(spark, ROWS), index).collect()
    norm = {}
    for i, t in ROWS:
        norm.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    assert len(got) == len(ROWS)
    for row in got:
        text = next(k for k in norm if hashlib.sha256(k.encode()).hexdigest() == row["digest"])
        ids = [i for i in norm[text] if i is not None]
        assert row["keep_id"] == min(ids) and row["group_size"] == len(norm[text])
    kept = sorted(r["doc_id"] for r in got if r["kept"])
    assert kept == sorted(min(i for i in v if i is not None) for v in norm.values())


def test_later_batches_meet_the_index(spark):
    index = exact_dedup.scratch_index(spark, buckets=4)
    exact_dedup.deduplicate(frame(spark, [(10, "a"), (11, "b")]), index).collect()
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(frame(spark, [(1, "a"), (2, "c"), (3, "c")]), index).collect()}
    assert not got[1]["kept"] and got[1]["keep_id"] == 10
    assert got[2]["kept"] and not got[3]["kept"] and got[3]["keep_id"] == 2
    assert index.read().count() == 3


def test_a_repeated_run_of_a_batch_keeps_its_texts(spark):
    """The first run died after it had appended its digests."""
    index = exact_dedup.scratch_index(spark, buckets=4)
    exact_dedup.deduplicate(frame(spark, [(10, "a")]), index, batch="one").collect()
    rows = frame(spark, [(1, "a"), (2, "c"), (3, "c")])
    runs = [sorted(map(tuple, exact_dedup.deduplicate(rows, index, batch="two").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0] if r[3]] == [2]
    assert [r["doc_id"] for r in exact_dedup.keep_first(rows, index, batch="two").collect()] == [2]
    assert exact_dedup.keep_first(rows, index, batch="three").count() == 0 and index.read().count() == 2


def test_keep_first_carries_all_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact_dedup.keep_first(docs, exact_dedup.scratch_index(spark, buckets=4))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7, 9]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, None), (None, "")]])
def test_empty_and_null_only(spark, rows):
    docs = frame(spark, rows)
    got = exact_dedup.deduplicate(docs, exact_dedup.scratch_index(spark, buckets=4)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == min(1, len(rows))
    assert exact_dedup.keep_first(docs, exact_dedup.scratch_index(spark, buckets=4)).count() == min(1, len(rows))


def test_the_default_warehouse_is_refused_on_a_cluster():
    import os

    import pytest

    here = f"file:{os.getcwd()}/spark-warehouse"
    exact_dedup.refuse_local_warehouse("local[4]", here)
    exact_dedup.refuse_local_warehouse("spark://host:7077", "hdfs://store/warehouse")
    with pytest.raises(ValueError, match="warehouse"):
        exact_dedup.refuse_local_warehouse("spark://host:7077", here)


def test_the_index_is_met_in_a_sort_merge_anti_join_without_moving_it(spark):
    index = exact_dedup.scratch_index(spark, buckets=4)
    try:
        docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "doc_id long, text string")
        assert exact_dedup.deduplicate(docs, index, batch="a").where("kept").count() == 7
        offered = docs.select(exact_dedup.digest(docs["text"]).alias("digest")).repartition(4, "digest")
        plan = offered.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
        assert exact_dedup.deduplicate(docs, index, batch="b").where("kept").count() == 0
        assert exact_dedup.deduplicate(docs, index, batch="a").where("kept").count() == 7  # the failed run's digests are its own
        assert index.read().count() == 7
    finally:
        index.drop()


def test_scratch_index_needs_no_warehouse(spark, monkeypatch):
    def refuse(*_):
        raise ValueError("no warehouse")

    monkeypatch.setattr(exact_dedup, "refuse_local_warehouse", refuse)  # a cluster whose warehouse is the default
    index = exact_dedup.scratch_index(spark)
    docs = spark.createDataFrame([(2, "a  b"), (1, "a b"), (3, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(docs, index).collect()) == [1, 3]
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {index.table}").where("col_name = 'Location'").first()["data_type"]
    assert location.removeprefix("file:").lstrip("/") == index.folder.removeprefix("file:").lstrip("/")
    index.drop()
    assert not spark.catalog.tableExists(index.table)
