"""The physical plans: no nested loops, few exchanges, pruned scans, no Python where none is needed."""

import re

import pytest

from cueloom.operators import segments
from cueloom.plans import queries

FOLDS = {"merge_continuous", "overlap_dedup", "rolling_dedup", "split_segments", "auto_caption_words"}  # folds.runs() goes through rows in order
PYTHON = FOLDS | {"sqlite_jobs", "soft_split", "localise", "source_captions", "voice_match", "translated", "spoken", "recognised_chunks", "punctuated", "chat_messages"}


@pytest.fixture(scope="module")
def planned(spark, sf_dir):
    """A query's physical plan, without adaptive changes and broadcasts by size."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_nested_loops_and_no_needless_python(planned, name):
    plan = planned(name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(("name", "most"), [("chunk_words", 1), ("sentences_from_words", 1), ("word_ends", 1), ("stats_upsert_latest", 1), ("sentence_split", 0), ("redact", 0)])
def test_exchanges(planned, name, most):
    assert len(re.findall("Exchange hashpartitioning", planned(name))) <= most


@pytest.mark.parametrize(("name", "rows", "sums"), [("retime", 3, 3), ("gap_detect", 5, 3), ("merge_continuous", 4, 2), ("overlap_dedup", 3, 2), ("rolling_dedup", 2, 2)])
def test_scans_by_stretches_deal_the_rows_once(planned, name, rows, sums):
    """Of the exchanges (those of the derived tables among them) `sums` carry a row a stretch or medium; both readers of the rows share one."""
    plan = planned(name)
    assert len(re.findall(r"\bExchange hashpartitioning", "\n".join(x for x in plan.splitlines() if "ReusedExchange" not in x))) <= rows + sums
    assert "ReusedExchange" in plan
    assert not any("Window [" in x and "lag(" in x and "stretch" not in x for x in plan.splitlines() if name in ("retime", "gap_detect"))


@pytest.mark.parametrize("name", ["dispatch", "queue_position"])
def test_ranks_have_no_window_over_everything(planned, name):
    windows = [x for x in planned(name).splitlines() if "Window [" in x]
    assert windows and not any(re.search(r"\], \[[^\]]*\]$", x) is None or "], []," in x for x in windows)


@pytest.mark.parametrize("name", ["valid_word_range", "context_window"])
def test_range_joins_have_a_stretch_in_their_key(planned, name):
    assert re.search(r"SortMergeJoin \[media_id#\d+L?, (__s|level)", planned(name)) or re.search(r"SortMergeJoin \[[^\]]*stretch", planned(name)) or re.search(r"SortMergeJoin \[media_id[^\]]*, FLOOR", planned(name), re.I)


def test_alignment_gathers_a_chunk_once(spark, planned):
    """Words and texts meet by medium and chunk: an exchange each, and no window."""
    w = spark.range(9).selectExpr("id AS media_id", "id AS chunk", "id AS seq", "'a' AS text", "id AS start_ms", "id AS end_ms")
    plan = segments.align(w, w.select("media_id", "chunk", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall("Exchange hashpartitioning", plan)) == 2


def test_scans_are_pruned_and_filters_pushed(planned):
    plan = planned("stats_by_language")
    assert "o_totalprice" not in plan and "l_extendedprice" not in plan
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan or "PushedFilters: [IsNotNull(" in plan
