import json
import re
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import CASES, CONTROLS
from pyspark.sql import functions as F

from burdenlens import AnalysisSpec, score
from burdenlens.sources import calls as call_io
from burdenlens.sources import groups, phenotypes, results, synthetic
from burdenlens.workspace import new_folder, stored

FREE = {"case_max_freq": 1.0, "control_max_freq": 1.0}


def test_parquet_round_trip(spark, calls, tmp_path):
    path = str(tmp_path / "calls")
    call_io.write_calls(calls, path)
    back = call_io.read_calls(spark, path)
    assert dict(back.dtypes)["chr"] == "string"
    assert back.where("chr = '1'").count() == calls.count()
    assert call_io.register(back, "kept_calls").count() == spark.table("kept_calls").count()


def test_chromosome_names_stay_text(spark, calls, tmp_path):
    path = str(tmp_path / "calls")
    call_io.write_calls(calls.withColumn("chr", F.lit("01")), path)
    assert {r[0] for r in call_io.read_calls(spark, path).select("chr").collect()} == {"01"}
    assert spark.conf.get("spark.sql.parquet.binaryAsString") == "false"


def test_binary_text_is_read_as_text(spark, tmp_path):
    """Files of old writers lack the annotation that marks text."""
    table = pa.table({"Sample_ID": pa.array([b"S1", b"S2"]), "gene_symbol": pa.array([b"G1", None])})
    pq.write_table(table, tmp_path / "old.parquet", store_schema=False)
    back = call_io.read_calls(spark, str(tmp_path))
    assert back.dtypes == [("sample_id", "string"), ("gene_symbol", "string")]
    assert back.where("gene_symbol = 'G1'").head()["sample_id"] == "S1"


def test_csv_without_header(spark, calls, tmp_path):
    path = str(tmp_path / "csv")
    columns = ["sample_id", "chr", "pos", "ref", "alt", "gene_symbol", "zygosity"]
    synthetic.write_synthetic_csv(calls.select(columns), path)
    back = call_io.read_calls_csv(spark, path, partitions=3)
    assert back.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, calls.select(columns).collect()))


def test_gene_list_file(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("ASPM\n  ATR \n\nASPM\n")
    genes = call_io.read_gene_list(spark, str(tmp_path / "genes.txt"))
    assert sorted(r[0] for r in genes.collect()) == ["ASPM", "ATR"]


def test_synthetic_table(spark):
    samples = synthetic.numbered_samples(spark, 6)
    made = synthetic.synthetic_calls(samples, variants_per_gene=3, genes=4)
    assert made.count() == 6 * 3 * 4
    assert made.select("pos").distinct().count() == 12
    assert {r[0] for r in made.select("zygosity").distinct().collect()} == {1, 2}
    assert sorted(map(tuple, made.collect())) == sorted(
        map(tuple, synthetic.synthetic_calls(samples, 3, 4).collect()))
    # everyone carries everything: no gene differs between the groups
    spec = AnalysisSpec("s", "sample_id <= '3'", "sample_id > '3'", min_score=None, **FREE)
    found = score(made, spec).collect()
    assert {(r["score"], r["sum_case"], r["sum_control"]) for r in found} == {(0.0, 3, 3)}
    # thinned controls
    spec = AnalysisSpec("s", "sample_id <= '3'", "sample_id > '3' AND pos > 3", **FREE)
    (best,) = score(made, spec).collect()
    assert (best["gene_symbol"], best["score"], best["ntests"]) == ("1", 1.0, 4)


def test_phenotypes(spark, tmp_path):
    records = [
        {"src": "Clinic A", "id": "S1", "path": "NEURODEV", "sex": "F", "pop": "EUR"},
        {"src": phenotypes.EXCLUDED_SOURCES[0], "id": "S2", "path": "Control", "sex": "M", "pop": "EUR"},
        {"src": "", "id": "S3", "path": "Control", "sex": "M", "pop": None},
        {"src": "1000 Genomes", "id": "S4", "path": "Control", "pop": "EAS"},
    ]
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(r) for r in records))
    path = str(tmp_path / "table")
    for _ in range(2):  # the second run replaces the first
        phenotypes.ingest_phenotypes(
            spark, str(tmp_path / "raw.json"), ["src", "id", "path", "sex", "pop"], path)
    kept = phenotypes.read_phenotypes(spark, path)
    assert {r["Sample_ID"] for r in kept.collect()} == {"S1", "S4"}
    assert phenotypes.read_phenotypes(spark, path, "Pathology = 'NEURODEV'").count() == 1


def test_demo_cohort(spark):
    rows = [("1000 Genomes", f"S{i:03}", p) for i in range(40) for p in ("EUR", "EAS", "AFR")]
    df = spark.createDataFrame(rows, "Data_Source string, Sample_ID string, Super_Population string")
    found = phenotypes.demo_cohort(df)
    assert {tuple(r) for r in found.groupBy("Super_Population").count().collect()} == {
        ("EUR", 25), ("EAS", 25)}
    assert found.agg(F.max("Sample_ID")).head()[0] == "S024"


# --- saved groups -------------------------------------------------------------------------------


def names(df):
    return [r["Name"] for r in df.collect()]


def test_group_store(spark, calls, tmp_path):
    path = str(tmp_path / "groups")
    with pytest.raises(Exception):
        groups.load_groups(spark, path)
    groups.create_store(spark, path)
    assert [tuple(r) for r in groups.load_groups(spark, path).collect()] == [("All", "")]
    new = [("cases", CASES), ("list", "sample_id IN('A1 , B1')"), ("quoted", 'a = "b"')]
    groups.save_groups(spark, path, spark.createDataFrame(new, "Name string, SQL string"))
    stored_groups = groups.load_groups(spark, path)
    assert sorted(names(stored_groups)) == ["All", "cases", "list", "quoted"]
    assert groups.group_named(stored_groups, "quoted") == 'a = "b"'
    assert groups.rows_of_group(calls, stored_groups, "All").count() == calls.count()
    listed = groups.rows_of_group(calls, stored_groups, "list")
    assert {r["sample_id"] for r in listed.collect()} == {"A1", "B1"}
    groups.delete_groups(spark, path, ["cases", "quoted"])
    assert sorted(names(groups.load_groups(spark, path))) == ["All", "list"]
    groups.delete_groups(spark, path, ["All", "list"])
    assert names(groups.load_groups(spark, path)) == []
    with pytest.raises(KeyError):
        groups.group_named(groups.load_groups(spark, path), "cases")


def test_group_store_keeps_any_text_and_one_row_a_name(spark, calls, tmp_path):
    path = str(tmp_path / "groups")
    schema = "Name string, SQL string"
    groups.create_store(spark, path)
    for text in ("pos = 1", "pos = 2\n OR pos = 3\t"):
        groups.save_groups(spark, path, spark.createDataFrame([("few", text)], schema))
    found = groups.load_groups(spark, path)
    assert sorted(map(tuple, found.collect())) == [("All", ""), ("few", "pos = 2\n OR pos = 3\t")]
    assert groups.rows_of_group(calls, found, "few").count() == 5
    with pytest.raises(ValueError):
        groups.save_groups(spark, path, spark.createDataFrame([("x", ""), ("x", "a")], schema))


def test_group_store_during_changes(spark, tmp_path):
    """A reader at any time sees the old or the new text of a name; other names are not touched."""
    path = str(tmp_path / "groups")
    schema = "Name string, SQL string"
    groups.create_store(spark, path)
    groups.save_groups(spark, path, spark.createDataFrame([("few", "pos = 0"), ("other", "pos = 9")], schema))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            found = dict(map(tuple, groups.load_groups(spark, path).collect()))
            seen.append((found.get("few"), found.get("other")))

    reader = threading.Thread(target=read)
    reader.start()
    texts = [f"pos = {k}" for k in range(6)]
    early = groups.load_groups(spark, path)
    try:
        for text in texts[1:]:
            groups.save_groups(spark, path, spark.createDataFrame([("few", text)], schema))
    finally:
        stop.set()
        reader.join()
    assert seen and all(other == "pos = 9" for _, other in seen)
    numbers = [texts.index(few) for few, _ in seen]  # fails for a name that is gone
    assert numbers == sorted(numbers)
    assert dict(map(tuple, early.collect()))["few"] == "pos = 0"
    again = str(tmp_path / "compact")
    groups.delete_groups(spark, path, ["other"])
    groups.compact_store(spark, path, again)
    for folder in (path, again):
        found = dict(map(tuple, groups.load_groups(spark, folder).collect()))
        assert found == {"All": "", "few": texts[-1]}


def test_store_of_an_earlier_version(spark, tmp_path):
    """Rows without version are the oldest."""
    path = str(tmp_path / "old")
    spark.createDataFrame([("All", ""), ("few", "pos = 1")], "Name string, SQL string").write.parquet(path)
    groups.save_groups(spark, path, spark.createDataFrame([("few", "pos = 2")], "Name string, SQL string"))
    assert dict(map(tuple, groups.load_groups(spark, path).collect())) == {"All": "", "few": "pos = 2"}


def test_ranking_over_a_table_in_buckets(spark, tmp_path):
    """The calls are grouped where they lie: no exchange of call size; one gene has half of all calls."""
    calls = spark.range(6000).selectExpr(
        "IF(id % 2 = 0, 'A', 'B') || id % 501 AS sample_id", "'1' AS chr", "id % 97 AS pos",
        "'A' AS ref", "'C' AS alt", "IF(id % 4 < 2, 'G', 'g' || id % 30) AS gene_symbol", "1 AS zygosity",
    )
    call_io.write_calls_table(calls, "calls_in_buckets", str(tmp_path / "t"), 4)
    spec = AnalysisSpec("b", CASES, CONTROLS, min_score=None, top_k=None, on_overlap="exclude", case_max_freq=0.9)
    found = score(call_io.read_calls_table(spark, "calls_in_buckets"), spec)
    expected = score(calls, spec)
    assert found.collect() == expected.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    other = expected._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    key = r"hashpartitioning\(gene_symbol#\d+L?, variant_id#\d+, sample_id#\d+"
    assert re.search(key, other) and not re.search(key, plan)
    assert not re.search(r"hashpartitioning\(gene_symbol#\d+, sample_id#\d+", plan)
    files = spark.table("calls_in_buckets").selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 3000
    spark.sql("DROP TABLE calls_in_buckets")


def test_group_file_with_line_breaks(spark, tmp_path):
    path = tmp_path / "saved.csv"
    path.write_text('"Name"\t"SQL"\n"few"\t"pos = 1\n OR pos = 2"\n')
    found = groups.read_group_file(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("few", "pos = 1\n OR pos = 2")]


def test_group_file(spark, tmp_path):
    path = tmp_path / "saved.csv"
    path.write_text('"Name"\t"SQL"\n"All"\t""\n"rare"\t"( x <= 0.01 OR x IS NULL )"\n')
    found = groups.read_group_file(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("All", ""), ("rare", "( x <= 0.01 OR x IS NULL )")]


# --- results ------------------------------------------------------------------------------------


def test_analysis_tables(spark, calls, tmp_path):
    spec = AnalysisSpec("mine", CASES, CONTROLS, case_name="ill", control_name="well", **FREE)
    path = str(tmp_path / "analysis")
    results.run_analysis(calls, spec, path)
    analysis, scores, samples = results.read_analysis(spark, path)
    row = analysis.head()
    assert (row["analysis_name"], row["n_case"], row["n_control"], row["ntests"]) == ("mine", 3, 4, 4)
    assert (row["n_results"], row["case_name"], row["control_name"]) == (2, "ill", "well")
    assert row["start_time"] <= row["end_time"] and row["run_time"] > 0
    assert [r["gene_symbol"] for r in scores.orderBy(F.desc("score")).collect()] == ["G1", "G3"]
    assert samples.where("is_case").count() == 3


def test_analysis_of_saved_groups(spark, calls):
    saved = spark.createDataFrame(
        [("All", ""), ("ill", CASES), ("well", CONTROLS)], "Name string, SQL string")
    spec = groups.analysis_of_groups(saved, "t", "ill", "well", **FREE)
    assert (spec.case, spec.control, spec.control_name) == (CASES, CONTROLS, "well")
    assert [r["gene_symbol"] for r in score(calls, spec).collect()] == ["G1", "G3"]
    assert groups.analysis_of_groups(saved, "t", "ill", None).control is None
    rows = groups.drill_down_groups(calls, saved, "ill", "well", F.col("pos") == 6)
    assert sorted((r["Group"], r["sample_id"]) for r in rows.collect()) == [
        ("ill", "A3"), ("well", "B3"), ("well", "B4")]


# One document of each stored layout, with invented names.
DOCUMENTS = {
    "first": ["other name", "gene", "monogenic", 1454251773.98, 1454252028.54, 254.558,
              [["CENPJ", [0.51, 5.08e-07, 0.94, 0.42, 16.0, 32.0]], ["X\"Y", [0.1, 1.0, 0.2, 0.1, 1, 2]]],
              ["S1", "S2"], ["T1"], "well", "ill", 65],
    "legacy": ["legacy", "gene", "monogenic", 1.0, 2.0, 1.0, [["SREBF1", [4, 4, 0]]],
               ["S1"], ["T1", "T2"], "well", "ill"],
    "pairs": ["pairs", "gene", "digenic", 1.0, 2.0, 1.0,
              [[["G2", "G1"], [["G2", "G1"], 0.5, 0.25, 0.5, 0.0, 2.0, 0.0]]],
              ["S1"], ["T1"], "well", "ill", 10],
    "variants": ["variants", "variant", "monogenic", 1.0, 2.0, 1.0,
                 [[["1:5:A:C", "G1"], [0.5, float("nan"), 0.5, 0.0, 2.0, 0.0]]],
                 ["S1"], ["T1"], "well", "ill", 7],
    "variant_pairs": ["vp", "variant", "digenic", 1.0, 2.0, 1.0,
                      [["['1:5:A:C', '1:6:A:C']", [["1:5:A:C", "1:6:A:C"], 0.5, 0.1, 0.5, 0, 2, 0]]],
                      ["S1"], ["T1"], "well", "ill", 7],
}


def test_stored_documents(spark, tmp_path):
    for name, content in DOCUMENTS.items():
        (tmp_path / f"{name}.txt").write_text(json.dumps(content))
    (tmp_path / "notes.md").write_text("no document")
    listed = results.list_documents(spark, str(tmp_path))
    assert sorted(r[0] for r in listed.collect()) == sorted(DOCUMENTS)
    documents = results.read_documents(spark, str(tmp_path)).cache()
    heads = {r["file_name"]: r for r in results.document_analyses(documents).collect()}
    assert heads["first"]["analysis_name"] == "other name"
    assert (heads["first"]["n_case"], heads["first"]["n_control"]) == (2, 1)
    assert (heads["first"]["ntests"], heads["first"]["run_time"]) == (65, 254.56)
    assert heads["legacy"]["ntests"] is None
    rows = {(r["file_name"], r["rank"]): r for r in results.document_scores(documents).collect()}
    assert len(rows) == 6
    gene = rows["first", 1]
    assert (gene["key1"], gene["key2"], gene["pvalue"]) == ("CENPJ", None, 5.08e-07)
    assert (gene["sum_case"], gene["sum_control"]) == (16.0, 32.0)
    assert rows["first", 2]["key1"] == 'X"Y'
    legacy = rows["legacy", 1]
    assert (legacy["score"], legacy["sum_case"], legacy["sum_control"], legacy["pvalue"]) == (
        4.0, 4.0, 0.0, None)
    assert (rows["pairs", 1]["key1"], rows["pairs", 1]["key2"]) == ("G2", "G1")
    assert (rows["variants", 1]["key1"], rows["variants", 1]["key2"]) == ("1:5:A:C", "G1")
    assert (rows["variant_pairs", 1]["key1"], rows["variant_pairs", 1]["score"]) == ("1:5:A:C", 0.5)


def written(calls, spec, path):
    ranking = score(calls, spec)
    lines = results.document_lines(
        ranking,
        results.analysed_samples(calls, spec),
        results.analysis_totals(calls, spec),
        spec,
        1.0,
        3.5,
    )
    results.write_document(lines, str(path))
    return ranking


def whole(path):
    """All files of a saved document on end."""
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_document_round_trip(spark, calls, tmp_path):
    spec = AnalysisSpec('my "name"', CASES, CONTROLS, scope="digenic", **FREE)
    ranking = written(calls, spec, tmp_path / "d")
    lines = results.read_lines(spark, str(tmp_path / "d"))
    head = results.line_analyses(lines).head()
    assert head["analysis_name"] == 'my "name"' and head["ntests"] == 10
    assert (head["start_local"], head["end_local"]) == ("1970-01-01 01:00:01", "1970-01-01 01:00:03")
    listed = sorted(tuple(r) for r in results.line_samples(lines).collect())
    assert listed == [("d", f"A{k}", True) for k in (1, 2, 3)] + [("d", f"B{k}", False) for k in (1, 2, 3, 4)]
    back = [tuple(r) for r in results.line_scores(lines).select(
        "key1", "key2", "score", "sum_case").orderBy("rank").collect()]
    assert back == [
        (r["gene_symbol1"], r["gene_symbol2"], r["score"], float(r["sum_case"]))
        for r in ranking.collect()]
    content = json.loads(whole(tmp_path / "d"))
    assert len(content) == 12 and content[7] == ["A1", "A2", "A3"]


def test_document_of_nothing_and_of_many_samples(spark, calls, tmp_path):
    written(calls, AnalysisSpec("none", CASES, CONTROLS, min_score=2.0, **FREE), tmp_path / "n")
    lines = results.read_lines(spark, str(tmp_path / "n"))
    head = results.line_analyses(lines).head()
    assert (head["n_case"], head["n_control"], head["ntests"], head["n_results"]) == (3, 4, 4, 0)
    assert results.line_scores(lines).collect() == []
    many = spark.range(120_000).selectExpr(
        "concat(if(id % 2 = 0, 'A', 'B'), id) AS sample_id", "'1' AS chr", "id % 5 AS pos",
        "'A' AS ref", "'C' AS alt", "concat('G', id % 7) AS gene_symbol", "1 AS zygosity")
    spec = AnalysisSpec("many", CASES, CONTROLS, min_score=None, top_k=None, **FREE)
    written(many, spec, tmp_path / "m")
    content = json.loads(whole(tmp_path / "m"))
    assert (len(content[6]), len(content[7]), len(content[8])) == (7, 60_000, 60_000)


def test_document_in_many_files(spark, tmp_path):
    """Ranges are written by many tasks; ranks run on over files and over splits of a file."""
    n = 3000
    odd = {5: 'a, ["x", [', 6: "], [", 7: None, 8: " ,"}
    ranking = spark.createDataFrame(
        [(odd.get(k, f"g{k:04}"), float(n - k // 3), 0.5, 0.1, 0.2, k, 1) for k in range(n)],
        "gene_symbol string, score double, pvalue double, ratio_case double, ratio_control double,"
        " sum_case long, sum_control long",
    )
    samples = spark.createDataFrame([(f'"s{k}, [', k % 2 == 0) for k in range(500)], "sample_id string, is_case boolean")
    totals = spark.createDataFrame([(250, 250, n)], "n_case long, n_control long, ntests long")
    spec = AnalysisSpec("big", CASES, CONTROLS, top_k=None, **FREE)
    lines = results.document_lines(ranking, samples, totals, spec, 1.0, 2.0)
    settings = {
        "spark.sql.shuffle.partitions": "9",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "4k",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        results.write_document(lines, str(tmp_path / "big"))
        assert len(list((tmp_path / "big").glob("part-*"))) > 4
        content = json.loads(whole(tmp_path / "big"))
        assert len(content[6]) == n and len(content[7]) == len(content[8]) == 250
        read = results.read_lines(spark, str(tmp_path / "big"))
        found = results.line_scores(read).select("rank", "key1", "sum_case").orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(1, n + 1))
        assert [r["key1"] for r in found] == [e[0] for e in content[6]]
        assert results.line_samples(read).where("is_case").count() == 250
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_samples_of_an_analysis(spark, calls, tmp_path):
    both = AnalysisSpec("b", CASES, "sample_id IN ('A1', 'B1', 'B2')", on_overlap="exclude", **FREE)
    found = {tuple(r) for r in results.analysed_samples(calls, both).collect()}
    assert found == {("A2", True), ("A3", True), ("B1", False), ("B2", False)}
    with pytest.raises(Exception, match="in the case and in the control group"):
        results.analysed_samples(calls, AnalysisSpec("b", CASES, "sample_id = 'A1'", **FREE)).collect()
    results.run_analysis(calls, AnalysisSpec("n", CASES, CONTROLS, min_score=2.0, **FREE), str(tmp_path / "a"))
    row = results.read_analysis(spark, str(tmp_path / "a"))[0].head()
    assert (row["n_case"], row["n_control"], row["ntests"], row["n_results"]) == (3, 4, 4, 0)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1.5), (None, None)], "name string, value double")
    results.export_csv(df.coalesce(1), str(tmp_path / "quoted"))
    text = next((tmp_path / "quoted").glob("part-*")).read_text().splitlines()
    assert text[:2] == ['"name","value"', '"a b","1.5"']
    results.export_csv(df.coalesce(1), str(tmp_path / "plain"), quote_all=False)
    text = next((tmp_path / "plain").glob("part-*")).read_text().splitlines()
    assert text[:2] == ["name,value", "a b,1.5"]
    results.write_scores_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("value = 1.5").count() == 1


# --- workspace ----------------------------------------------------------------------------------


def test_workspace_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = new_folder(spark, "x"), new_folder(spark, "x")
    assert first.startswith(shared) and first != second
    assert stored(spark.range(5), "numbers").count() == 5
