"""Physical-plan checks: shuffles, sorts and column pruning of the hot paths."""
import re


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_path_shuffles_once_per_chunk_key(spark):
    from netlens.plans.queries import q_window_summary
    p = plan(q_window_summary(spark, "/root/testdata/sf0.001"))
    chunk_exchanges = re.findall(r"Exchange hashpartitioning\(source#\d+, chunk_id#\d+L?, \d+\)", p)
    assert len(chunk_exchanges) == 1
    # nothing above the chunk exchange shuffles again: the aggregate, the flow
    # windows and the window-id window all reuse it
    above = p.split("Exchange hashpartitioning(source")[0]
    assert "Exchange" not in above
    assert len(re.findall(r"\bSort \[source#\d+ ASC NULLS FIRST, chunk_id", above)) == 1


def test_block_totals_read_only_needed_columns(spark, capsys):
    from netlens.plans.queries import q_window_summary
    q_window_summary(spark, "/root/testdata/sf0.001").explain("formatted")
    out = capsys.readouterr().out
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", out)
    # the block-total branch reads three columns, the main branch six
    assert "struct<event_id:bigint,user_id:bigint,value:double>" in schemas
    assert all("embedding" not in s for s in schemas)


def test_quota_never_windows_a_whole_class(spark):
    """rank_below ranks inside (class, bucket), never over a whole class."""
    from netlens.operators.sampling import sample_n
    df = spark.range(1000).selectExpr("id", "CAST(id % 3 AS STRING) AS label", "repeat('x', 50) AS wide")
    p = plan(sample_n(df, 10, "id", by=["label"]))
    for spec in re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^)]*)\)", p):
        assert "_b" in spec
    # the rows are filtered where they lie: none of them is shuffled
    assert "wide" in p and "Exchange hashpartitioning" not in p and "Exchange SinglePartition" not in p


def test_no_registered_query_plans_a_cross_join(spark):
    """No Cartesian product or nested-loop join in any SQL-checked query."""
    from netlens.plans.catalog import ORACLE as sql, QUERIES as qs
    bad = []
    for name in sorted(sql):
        p = plan(qs[name](spark, "/root/testdata/sf0.001"))
        if "CartesianProduct" in p or "NestedLoopJoin" in p:
            bad.append(name)
    assert bad == []
