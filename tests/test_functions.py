import pytest
from pyspark.sql import functions as F

from burdenlens.functions import display, keys
from burdenlens.operators.browse import annotate


def one(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize(
    "value, text",
    [(0.5145098, "0.515"), (16.0, "16"), (0.0, "0"), (-0.05, "-0.05"), (1234.5, "1235"),
     (0.00012349, "0.000123"), (0.9996, "1"), (None, None), (12.34, "12.3"), (100.0, "100")],
)
def test_three_significant_digits(spark, value, text):
    assert one(spark, display.significant(F.lit(value).cast("double"))) == text


def test_other_display(spark):
    assert one(spark, display.scientific(F.lit(5.0866737961e-07))) == "5.09e-07"
    assert one(spark, display.shorten(F.lit("exactly15chars!"))) == "exactly15chars!"
    assert one(spark, display.shorten(F.lit("sixteen chars !!"))) == "sixteen cha..."
    link = one(spark, display.gene_link(F.lit("ASPM"), "http://example.org/?g="))
    assert link == "<a href='http://example.org/?g=ASPM' target='_blank'>ASPM</a>"
    df = spark.sql("SELECT 1 AS a, cast(null as string) AS b")
    assert tuple(display.blank_nulls(df).head()) == ("1", "")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_time_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, display.local_time(F.lit(1454251773.98))) == "2016-01-31 15:49:33"
        assert one(spark, display.local_time(F.lit(1467331200))) == "2016-07-01 02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_variant_ids(spark):
    df = spark.createDataFrame([("1", 5, "A", "C"), ("1", None, "A", "C")],
                               "chr string, pos int, ref string, alt string")
    ids = df.select(keys.variant_id().alias("variant_id"))
    assert [r[0] for r in ids.collect()] == ["1:5:A:C", None]
    assert tuple(keys.split_variant_id(ids).head()) == ("1:5:A:C", "1", 5, "A", "C")


def test_dose_of_both_codings(spark):
    number = spark.createDataFrame([(1,), (2,), (0,), (None,)], "zygosity int")
    assert [r[0] for r in number.select(keys.genotype_dose(number)).collect()] == [1, 2, 1, 1]
    text = spark.createDataFrame([("Heterozygous",), ("Homozygous",), (None,)], "zygosity string")
    assert [r[0] for r in text.select(keys.genotype_dose(text)).collect()] == [1, 2, 2]
    assert one(spark, keys.carrier(F.lit(2))) == 1


def test_pair_key(spark):
    assert tuple(spark.range(1).select(*keys.pair_key(F.lit("b"), F.lit("a"))).head()) == ("a", "b")


def test_annotation_keeps_unmatched_rows(spark):
    rows = spark.createDataFrame([("v1",), ("v2",)], "variant_id string")
    known = spark.createDataFrame([("v1", "rs1")], "variant_id string, dbsnp_id string")
    assert {tuple(r) for r in annotate(rows, known).collect()} == {("v1", "rs1"), ("v2", None)}


def test_results_table(spark):
    pair = spark.sql(
        "SELECT 'G2' AS gene_symbol1, 'G1' AS gene_symbol2, 0.66666D AS score, 0.14285D AS pvalue,"
        " 0.66666D AS ratio_case, 0D AS ratio_control, 2L AS sum_case, 0L AS sum_control"
    )
    shown = display.results_table(pair, links=False).head().asDict()
    assert shown == {
        "Ratio_Difference": "0.667", "P_Value": "1.43e-01", "Ratio_Case": "0.667",
        "Ratio_Control": "0", "Score_Case": 2, "Score_Control": 0, "Gene_Symbol1": "G2",
        "Gene_Symbol2": "G1",
    }
    assert display.results_table(pair).head()["Gene_Symbol1"].startswith("<a href=")
    variant = pair.selectExpr(
        "'1:5:A:C' AS variant_id", "gene_symbol1 AS gene_symbol", "* except (gene_symbol1, gene_symbol2)"
    )
    row = display.results_table(variant, links=False).head()
    assert (row["Chr"], row["Position"], row["Reference"], row["Gene_Symbol"]) == ("1", 5, "A", "G2")
