import pytest

from gristmill.llm import queries

COLUMNS = {
    "p1_found": {"doc_id": "bigint", "item_id": "string"}, "p2_found": {"root_id": "bigint", "id": "bigint"}, "p3_found": {"id": "bigint"},
    "p4_found": {"doc_id": "bigint", "pii_type": "string", "value": "string"}, "p5_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p7_found": {"doc_id": "bigint", "subject": "string"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    if name != "p5_ids":
        assert len(rows) == len(set(rows))


def test_every_problem_has_a_query():
    assert {n[:2] for n in queries.queries()} == {f"p{i}" for i in range(1, 8)}


NAMES = "a b v u root root_id label rep key least now torn split bin weight rank bucket even taken n n0 seq grp i capacity start container spans ids share subject score run item_id gram doc_id id text named value pii_type sentence centre best_x near at".split()


def test_clashing_columns_change_nothing(spark, data, tmp_path):
    """Further columns, named like the ones that the operators make, are ignored in every table."""
    from pyspark.sql import functions as F

    for name in ("documents", "docs", "links", "aliases", "suite", "preparation", "packing", "subject_labels", "subject_areas"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        df.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in df.columns]).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = lambda df: sorted(repr(r) for r in df.collect())
    for name in ("p1_alignments", "p2_groups", "p3_splits", "p4_redacted", "p5_ids", "p7_shares"):
        f = queries.queries()[name]
        assert plain(f(spark, str(tmp_path))) == plain(f(spark, data)), name
    places = lambda d: sorted((r["run_name"], r["doc_id"], r["start"], r["n_tokens"]) for r in queries.p6_containers(spark, d).collect())
    assert places(str(tmp_path)) == places(data)
