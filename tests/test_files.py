import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from scrivena.sources import files

SPEECHES = StructType().add("id_speech", "long").add("name", "string").add("text", "string").add("age", "integer")


def test_csv_by_declared_columns(spark, tmp_path):
    path = tmp_path / "speeches.csv"
    path.write_text(' text , id_speech,age , more,name\n"a ""b""\nc, d",1,40,x,Ann\n,2,old,y,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(path), SPEECHES)
    assert rows.schema == SPEECHES
    assert sorted(map(tuple, rows.collect())) == [(1, "Ann", 'a "b"\nc, d', 40), (2, None, None, None)]
    with pytest.raises(ValueError, match="party"):
        files.read_csv(spark, str(path), StructType().add("id_speech", "long").add("party", "string"))


def test_missing_files(spark, tmp_path):
    path = str(tmp_path / "none.csv")
    with pytest.raises(AnalysisException):
        files.read_csv(spark, path, SPEECHES)
    assert files.read_optional_csv(spark, path, SPEECHES).collect() == []
    assert files.read_optional_csv(spark, path, SPEECHES).schema == SPEECHES


def test_views_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, None, 1)], "id_speech long, id_person long, fold_id int")
    assert files.write_view(rows, str(tmp_path / "view")) == {"rows": 3, "authors": 1}
    assert files.write_view(rows.limit(0), str(tmp_path / "empty")) == {"rows": 0, "authors": 0}
    files.write_split(rows, str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["fold_id=0", "fold_id=1"]
    assert spark.read.parquet(str(tmp_path / "split")).filter("fold_id = 1").count() == 2
    terms = spark.createDataFrame([("ab",), ("c",)], "term string")
    files.write_vocabulary({"word": terms, "char": terms.limit(1)}, str(tmp_path / "vocabulary"))
    assert spark.read.parquet(str(tmp_path / "vocabulary")).groupBy("block").count().orderBy("block").collect() == [("char", 1), ("word", 2)]


def test_markdown(spark):
    report = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, name string").orderBy("n")
    assert files.markdown(report) == "| n | name |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError):
        files.markdown(report, most=1)
