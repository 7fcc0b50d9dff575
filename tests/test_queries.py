import os

import pytest

from glean.plans import catalog
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(name, spark):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["video_id", "chunk_id", "concept", "rank", "final_score", "lda_norm", "lsa_norm"]


def test_plans_have_no_nested_loops(spark, capsys):
    """Joins with an equality never become nested loops or products."""
    for name in ("overlap_chunks", "point_in_intervals", "unassigned_points", "flagship_chunk_top_concepts", "score_join", "jaccard_pairs", "item_concept_evidence"):
        catalog.QUERIES[name](spark, DATA).explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filter_and_columns_reach_the_scan(spark, capsys):
    catalog.QUERIES["threshold_predict"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan.replace(",lang:string,source:string", "")
    catalog.QUERIES["label_join"](spark, DATA).explain("formatted")
    assert "EqualTo(quality,1)" in capsys.readouterr().out
