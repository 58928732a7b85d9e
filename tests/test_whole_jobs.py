"""Whole jobs over tables made here."""

import pytest
from pyspark.sql import functions as F

from burdenlens import AnalysisSpec, score
from burdenlens.plans.score import analysed_samples, analysis_totals
from burdenlens.sources import calls as call_io
from burdenlens.sources import results
from burdenlens.sources.warehouse import order_calls
from workload.groups import ALL_CASE, ALL_CONTROL
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """3,000 line items of 100 customers, half of these in one segment; a null and a repeated key."""
    folder = tmp_path_factory.mktemp("tables")

    def save(name, n, *columns):
        spark.range(n).selectExpr(*columns).write.parquet(f"{folder}/{name}.parquet")

    save("customer", 101, "IF(id = 100, 8L, id) AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey",
         "IF(id % 2 = 0, 'BUILDING', 'MACHINERY') AS c_mktsegment")
    save("orders", 1000, "id AS o_orderkey", "IF(id = 3, NULL, id % 100) AS o_custkey",
         "IF(id % 3 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    save("part", 40, "id AS p_partkey", "'Brand#' || id % 4 AS p_brand", "'SMALL' AS p_type",
         "CAST(id AS INT) AS p_size")
    save("lineitem", 3000, "id DIV 3 AS l_orderkey", "id * 7 % 40 AS l_partkey",
         "CAST(id % 3 AS INT) AS l_linenumber", "20.0D AS l_quantity", "0.01D AS l_discount",
         "0.02D AS l_tax", "'N' AS l_returnflag", "IF(id % 2 = 0, 'O', 'F') AS l_linestatus")
    return str(folder)


def test_preview_holds_the_whole_group(spark, tables):
    read = {t: spark.read.parquet(f"{tables}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    rows = read["lineitem"].join(read["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(
        read["customer"].where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")
    )
    n = rows.count()
    assert n > 1000
    found = QUERIES["preview_unordered"](spark, tables)
    assert found.agg(F.sum("n_calls")).first()[0] == n
    assert found.agg(F.sum("pos")).first()[0] == rows.agg(F.sum("l_partkey")).first()[0]


def test_recurrent_variants_leave_one_scan_for_few_columns(spark, tables):
    """Also a summary that reads some of the columns shares the shuffle with the count of calls."""
    found = QUERIES["recurrent_one_scan"](spark, tables)
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, QUERIES["recurrent_blacklist"](spark, tables).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("lineitem.parquet") == 1


def test_a_large_call_table_has_more_buckets(spark, tables, tmp_path):
    calls = spark.read.parquet(f"{tables}/lineitem.parquet").selectExpr(
        "CAST(l_orderkey AS STRING) AS sample_id", "'G' AS gene_symbol", "l_partkey AS pos"
    )
    call_io.write_calls_table(calls, "many_calls", str(tmp_path / "t"), 2, bucket_rows=500)
    files = spark.table("many_calls").selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
    assert len(files) == 6 and sum(r["count"] for r in files) == 3000
    spark.sql("DROP TABLE many_calls")


def test_an_analysis_reads_its_calls_once(spark, tables, tmp_path):
    """Ranking, samples and totals come from rows that were stored once, and are the same."""
    calls = order_calls(spark, tables)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(sample):
        reads.add(1)
        return sample

    watched = calls.withColumn("sample_id", seen.asNondeterministic()("sample_id"))
    spec = AnalysisSpec("one", ALL_CASE, ALL_CONTROL, min_score=None)
    results.run_analysis(watched, spec, str(tmp_path / "a"))
    assert reads.value == calls.count()
    analysis, scores, samples = results.read_analysis(spark, str(tmp_path / "a"))
    for found, expected in (
        (scores, score(calls, spec)),
        (samples, analysed_samples(calls, spec)),
        (analysis.select("n_case", "n_control", "ntests"), analysis_totals(calls, spec)),
    ):
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
