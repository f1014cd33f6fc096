"""Files as tables: CSV with declared columns, files that may be absent, and the sinks of views, splits and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """The declared columns of CSV files with a header, found by name; a value that isn't of its type is null.

    Names in the header may be padded.  A quoted field may hold quotes, doubled, and, with ``multi_line``, line ends;
    such a file is read by one task, so a large table should come in many files.  Fails if a file or column is missing.
    """
    rows = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    named = {c.strip(): c for c in rows.columns}
    missing = [f.name for f in schema if f.name not in named]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return rows.select(*(F.col(f"`{named[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema))


def read_optional_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """As ``read_csv``; no rows where there is no file."""
    try:
        return read_csv(spark, path, schema, multi_line)
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_view(rows: DataFrame, path: str, author: str = "id_person") -> dict[str, int]:
    """Write a view as Parquet; how many rows and authors it has, by one column of what was written."""
    rows.write.mode("overwrite").parquet(path)
    counts = rows.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(author).alias("authors"))
    return counts.first().asDict()


def write_split(memberships: DataFrame, path: str, fold: str = "fold_id") -> None:
    """Write fold memberships as Parquet, a folder for each fold, so that reading a fold reads nothing else."""
    memberships.write.mode("overwrite").partitionBy(fold).parquet(path)


def write_vocabulary(terms: dict[str, DataFrame], path: str) -> None:
    """Write the terms (term) of each block of features, a folder for each block."""
    blocks = [df.select(F.lit(name).alias("block"), "term") for name, df in sorted(terms.items())]
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    out.write.mode("overwrite").partitionBy("block").parquet(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, null as empty; fails beyond ``most`` rows."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    shown = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [report.columns, ["---"] * len(report.columns), *([shown(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)
