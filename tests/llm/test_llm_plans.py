"""Plans of the operators: native ones run no Python, none forms all pairs, and lineage is cut in the shared folder."""

import re

import pytest

from cueloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cross_join(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.split("_")[0] in ("op9", "op10"):
        assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def test_quality_moves_no_rows(spark, sf_dir):
    plan = queries.op10_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_pages_are_read_without_their_bodies(spark, sf_dir):
    plan = queries.op5_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_no_local_checkpoints():
    import pathlib

    import cueloom

    top = pathlib.Path(cueloom.__file__).parent
    assert not any("localCheckpoint(" in p.read_text() for p in top.rglob("*.py"))
