"""Site files as (chrom, pos) tables.

Text is read as strings and cast, nothing is inferred. A row whose cells are all
blank is skipped; one with some cells blank or a wrong number is an error, raised by
the plan itself when rows are read; ``invalid_rows`` shows such rows. Thousands
commas are removed from the two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number, stem

#: Fixed values: (chromosome column, position column, header) of each layout.
LAYOUTS = {"map": (0, 3, False), "tped": (0, 3, True), "txt": (0, 1, True), "tsv": (0, 1, True), "hapflk": (1, 2, True)}


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, only a session on one machine gets a local one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or f'file://{tempfile.gettempdir()}').rstrip('/')}/sites-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """line: without the first one of each file, if it is a header."""
    return spark.read.csv(path, sep="\x01", quote="", header=header, schema="line string", enforceSchema=True)


def _wrong():
    """Not two numbers."""
    return F.col("partly") | number(F.col("chrom_text")).isNull() | number(F.col("pos_text")).isNull()


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """chrom, pos of rows with chrom_text, pos_text, blank (all cells), partly (some cells), line; ``strict``: wrong rows are an error, else they are left out."""
    error = F.raise_error(F.concat(F.lit("rows with missing or wrong cells, as "), F.col("line"))).cast("boolean") if strict else F.lit(False)
    rows = rows.where(F.when(F.col("blank"), False).when(_wrong(), error).otherwise(True))
    return rows.select(number(F.col("chrom_text")).cast("int").alias("chrom"), number(F.col("pos_text")).alias("pos")).where("chrom >= 1")


def invalid_rows(rows: DataFrame) -> DataFrame:
    """line of the rows that are neither blank nor two numbers."""
    return rows.where(~F.col("blank") & _wrong()).select("line")


def csv_rows(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Raw rows of a CSV file; comma or semicolon by its first line."""
    first = spark.read.text(path).first()
    first = first["value"] if first else ""
    sep = sep or (";" if ";" in first else ",")
    lines, width = _lines(spark, path, True), max(2, len(first.split(sep)))
    cells = F.from_csv("line", F.lit(", ".join(f"c{k} string" for k in range(width))), {"sep": sep})
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = lines.withColumn("cells", cells)
    flags = [empty(F.col(f"cells.c{k}")) for k in range(width)]
    every, some = flags[0], flags[0]
    for f in flags[1:]:
        every, some = every & f, some | f
    return rows.select("line", F.col("cells.c0").alias("chrom_text"), F.col("cells.c1").alias("pos_text"), every.alias("blank"), (some & ~every).alias("partly"))


def read_sites_csv(spark: SparkSession, path: str, sep: str | None = None, strict: bool = True) -> DataFrame:
    """chrom, pos of the first two columns of a CSV file with a header."""
    return _checked(csv_rows(spark, path, sep), strict)


def ws_rows(spark: SparkSession, path: str, chrom_col: int, pos_col: int, header: bool) -> DataFrame:
    """Raw rows of a file with columns between white space."""
    lines = _lines(spark, path, header).withColumn("parts", F.split(F.trim("line"), r"\s+"))
    blank = F.trim("line") == ""
    short = F.size("parts") <= max(chrom_col, pos_col)
    return lines.select("line", F.get("parts", F.lit(chrom_col)).alias("chrom_text"), F.get("parts", F.lit(pos_col)).alias("pos_text"), blank.alias("blank"), (short & ~blank).alias("partly"))


def read_sites_ws(spark: SparkSession, path: str, chrom_col: int = 0, pos_col: int = 1, header: bool = True, strict: bool = True) -> DataFrame:
    """chrom, pos of a file with columns between white space."""
    return _checked(ws_rows(spark, path, chrom_col, pos_col, header), strict)


def read_norm(spark: SparkSession, path: str, chrom_id: int = 1, pos_col: int = 1, crit_col: int = -1, crit: int = 1, strict: bool = True) -> DataFrame:
    """chrom, pos of rows whose criterion column is at least ``crit``; all on one chromosome."""
    rows = _lines(spark, path, True).withColumn("parts", F.split(F.trim("line"), r"\s+"))
    value = F.element_at("parts", crit_col if crit_col < 0 else crit_col + 1).try_cast("int")
    blank = F.trim("line") == ""
    rows = rows.select("line", F.lit(str(chrom_id)).alias("chrom_text"), F.get("parts", F.lit(pos_col)).alias("pos_text"), blank.alias("blank"), (value.isNull() & ~blank).alias("partly"), value.alias("value"))
    return _checked(rows.where((F.col("value") >= crit) | F.col("partly")), strict)


def read_sites(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """chrom, pos of a file in the layout of its extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_sites_csv(spark, path)
    if kind == "norm":
        return read_norm(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path).select(F.col("chrom").cast("int"), F.col("pos").cast("long"))
    chrom_col, pos_col, has_header = LAYOUTS[kind]
    return read_sites_ws(spark, path, chrom_col, pos_col, has_header if header is None else header)


def load_sites(spark: SparkSession, universe: str, candidates: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Universe, candidates with a method number for each file, and the names of the methods."""
    from .. import schema

    rows = None
    for m, path in enumerate(candidates, 1):
        own = read_sites(spark, path).select(F.lit(m).alias("method"), "chrom", "pos")
        rows = own if rows is None else rows.unionByName(own)
    names = spark.createDataFrame([(m, p) for m, p in enumerate(candidates, 1)], schema.METHODS)
    return read_sites(spark, universe), rows, names.withColumn("name", stem(F.col("name")))
