"""Plans: filters and columns reach the scan, and what need not shuffle doesn't."""

from scribewell.plans import table_queries
from tests.oracle import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_shuffle_and_reads_a_page_once(spark):
    text = plan(table_queries.doc_titled(spark, SF_DIR))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text
    assert "PushedFilters: [IsNotNull(html)" in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(table_queries.locale_default(spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_last_values_combine_before_the_shuffle(spark):
    text = plan(table_queries.state_recording_last(spark, SF_DIR))
    assert "partial_max_by" in text


def test_prefixes_are_broadcast(spark):
    assert "BroadcastNestedLoopJoin" in plan(table_queries.url_capturable_antijoin(spark, SF_DIR))


def test_entry(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
