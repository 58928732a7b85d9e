"""Every stage of the pipeline on what the one before it kept, against SQL or the operator's rule."""

import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from burdenlens.llm import bpe
from burdenlens.llm.queries import ORACLE, op8_toxicity

PLAIN = ["lorem", "ipsum", "dolor", "amet", "elit", "sed", "quis", "nulla", "porta", "velit", "ante"]


def corpus():
    rnd = random.Random(9)

    def text(n):
        return "\n".join(
            " ".join(rnd.choice(PLAIN) + str(rnd.randrange(90)) for _ in range(rnd.randrange(8, 30)))
            for _ in range(n)
        )

    passage, item = text(4), " ".join(text(2).split()[:30])
    rows, marks = [], []
    for k in range(240):
        own = text(rnd.randrange(2, 7))
        if k % 6 == 0:
            own = own.replace(" ", " grobian ", 1)
        if k % 15 == 1:
            own += "\n" + passage
        if k % 20 == 2:
            own = own + " " + item + " " + text(1)
        if k % 10 == 3 and k > 10:
            own = rows[k - 10][1] if k % 20 == 3 else rows[k - 10][1] + " more"
        rows.append((k, own, "en", "s", len(own)))
        marks.append((k, 0, int("grobian" in own)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "x y z", "en", "s", 5)]
    return rows, marks, [(1, item), (2, None), (3, text(2))]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, marks, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {
        "documents": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame(marks, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), [tables["documents"]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept.append(docs)
    return folder, [sorted(map(tuple, d.collect()), key=repr) for d in kept], kept


def sql(name, documents, folder):
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)"
    )
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", documents)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet/*.parquet'")
    return con.execute(ORACLE[name]).fetchall()


def test_columns(stages):
    _, _, frames = stages
    for frame in frames[:5]:
        assert frame.columns == corpus_pipeline.COLUMNS
    assert frames[5].columns == [*corpus_pipeline.COLUMNS, "ids", "round_trip"]


def test_toxic_documents_go(spark, stages):
    folder, rows, _ = stages
    scored = op8_toxicity(spark, folder).where("predicted = 0").collect()
    assert sorted(repr(r["doc_id"]) for r in scored) == sorted(repr(r[0]) for r in rows[1])
    ids = {r[0] for r in rows[1]}
    assert not ids & set(range(0, 240, 6)) and {1, 2, 901, None} <= ids


def test_lines(stages):
    folder, rows, _ = stages
    known = [r for r in rows[1] if r[1] is not None]
    expected = {(d, t) for d, t, _, n in sql("op2_line_dedup", known, folder) if t != "" or n == 0}
    assert {r[:2] for r in rows[2] if r[1] is not None} == expected
    assert all(r[4] == len(r[1]) for r in rows[2] if r[1] is not None)
    assert len(expected) < len(known)


def test_groups(stages):
    folder, rows, _ = stages
    expected = {d for d, _, c in sql("op10_jaccard_join", rows[2], folder) if d == c}
    assert {r[0] for r in rows[3]} == expected | {None}
    assert len(rows[3]) < len(rows[2])


def test_benchmark(stages):
    folder, rows, _ = stages
    found = {r[0] for r in sql("op6_decontamination", rows[3], folder)}
    assert found and {r[0] for r in rows[4]} == {r[0] for r in rows[3]} - found


def test_ids(stages):
    _, rows, _ = stages
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    assert [r[:5] for r in rows[5]] == rows[4]
    for r in rows[5]:
        assert r[5] == encoding.encode_ordinary(r[1] or "") and r[6]


def test_run(spark, stages):
    folder, rows, _ = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == rows[5]
