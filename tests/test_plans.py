"""Plan properties: pruning, broadcast look-ups, no single-partition windows."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_flagship_prunes_columns_and_shuffles_once(spark):
    df = E.entry(spark)
    phys = df._jdf.queryExecution().executedPlan().toString()
    assert "struct<text:string,lang:string>" in phys
    assert phys.count("Exchange") == 1 and "Exchange hashpartitioning(lang" in phys


@pytest.mark.parametrize("name", ["split_assign", "assign_batches", "bucket_batches", "stratified_split"])
def test_positions_without_single_partition_window_over_rows(spark, name):
    """Rows are numbered by a window partitioned by hash bucket; the only
    single-partition exchange allowed is over the bucket-count table (one
    row per bucket) that feeds the prefix offsets."""
    df = E.queries()[name](spark, SF_SMALL)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("row_number()" in ln and "_b#" in ln for ln in lines)
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            assert "HashAggregate(keys=[" in lines[i + 1] and "_b#" in lines[i + 1], lines[i:i + 2]


def test_vocabulary_lookup_is_broadcast(spark):
    assert "BroadcastHashJoin" in _plan(spark, "encode_word")


def test_batches_to_python_are_bounded_in_bytes(spark):
    """What a Python worker gets at once follows a bound in bytes, not the rows of a partition; a smaller bound is kept."""
    from pyspark.sql import functions as F
    from precis.session import ARROW_BATCH, bound_batches
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound_batches(spark)
    d = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    most = d.mapInArrow(lambda it: iter([b for b in it]), "text string").mapInPandas(
        lambda it: ((p.iloc[:1]).assign(text=str(len(p))) for p in it), "text string")
    assert max(int(r.text) for r in most.collect()) * 2000 <= 1.1 * ARROW_BATCH
    spark.conf.set(name, "100000")
    bound_batches(spark)
    assert spark.conf.get(name) == "100000"
    spark.conf.set(name, str(ARROW_BATCH))
