"""The pipeline against its stages' brute-force versions, and the queries against DuckDB."""

import os

import pytest

import corpus_pipeline
from scrivena.llm import exact_dedup, jaccard_join, packing, queries
from tests.llm.test_operators import ASCII_LOWER, classes_by_force, contamination_by_force, language_rows, near_rows

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    rows = [(i, text, "aa") for i, text in near_rows(8)]
    rows += [(1000 + i, text, lang) for i, text, lang in language_rows(60, 4)]
    rows += [(2000, rows[0][1], "aa"), (2001, "12 34", "aa"), (2002, None, "aa"), (2003, "zz " + rows[-1][1], "dd")]
    items = [(1, " ".join(rows[-10][1].split()[:14])), (2, None)]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    last = {}
    for i in sorted(kept):
        last[kept[i].translate(ASCII_LOWER)] = i
    kept = {i: kept[i] for i in last.values()}
    kept = {i: kept[i] for i, least, _, _ in classes_by_force(list(kept.items())) if i == least}
    kept = {i: kept[i] for i, *_, bad in contamination_by_force(list(kept.items()), items) if not bad}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = function(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns, name
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in docs.collect()} == set(kept)
    expected = packing.packed(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, expected.collect()))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, d string, raw string, _id int, node int, kept string, row string"


def test_pipeline_of_odd_tables(spark, tmp_path):
    prose = language_rows(40, 2)
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(prose)] + [(None, prose[0][1] + " more of it", "aa"), (3, prose[3][1], prose[3][2]), (3, prose[3][1], prose[3][2]), (50, None, None), (51, "", "aa"), (52, "12 !!", "bb")]
    rows += [(60, " ".join(t for _, t, _ in prose) * 200, "aa")]
    docs = spark.createDataFrame([(*r, None, 1, "d", "raw", 7, 8, "kept", "row") for r in rows], CLASHING)
    items = spark.createDataFrame([], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    kept = kept.collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) <= 1 and not {50, 51, 52} & set(ids) and 60 in ids and all(tuple(r)[5:] == ("d", "raw", 7, 8, "kept", "row") for r in kept)
    placed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in placed} == set(ids)

    (tmp_path / "none").mkdir()
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    items.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_one_row_of_each_group_stays_where_rows_repeat(spark):
    base = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, lang string"
    exact = [(1, "Twice", "a"), (1, "Twice", "a"), (2, "x", "a"), (2, "X", "b"), (2, "other", "b"), (3, "twice", "c"), (3, "TWICE", "d"), (3, "twice", "e")]
    exact += [(None, "lost", "a"), (None, "lost", "a"), (None, "Lost", "b"), (None, "else", "a"), (5, None, "a"), (5, "", "b"), (6, "once", "a")]
    found = exact_dedup.deduplicated(spark.createDataFrame(exact, schema)).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in found) == [("2", "other"), ("2", "x"), ("3", "twice"), ("5", ""), ("6", "once"), ("None", "else"), ("None", "lost")]
    near = [(1, base, "a"), (1, base, "a"), (1, base + " more", "b"), (2, base, "c"), (1, "else entirely", "d"), (7, None, "e"), (7, None, "e"), (8, "!", "f"), (9, "alone", "g"), (9, "alone", "g")]
    found = jaccard_join.one_of_each_class(spark.createDataFrame(near, schema)).collect()
    assert sorted((r.doc_id, r.lang.replace("b", "a")) for r in found) == [(1, "a"), (1, "d"), (7, "e"), (8, "f"), (9, "g")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = connection.execute(queries.ORACLE_SQL[name]).df()
    found = queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = lambda frame: sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))
    assert rows(found) == rows(expected)


def test_what_near_copies_share_is_never_broadcast(spark, monkeypatch):
    from scrivena.llm import jaccard_join

    plans, plain = {}, jaccard_join.stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(jaccard_join, "stage", seen)
    words = [f"word{k}" for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(12)], "doc_id long, text string")
    found = jaccard_join.near_duplicates(docs).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 11)}
    wide = [line for line in plans["jaccard-links"].splitlines() if "BroadcastHashJoin" in line]
    assert not wide and "BroadcastHashJoin [node" not in plans["jaccard-candidates"]
