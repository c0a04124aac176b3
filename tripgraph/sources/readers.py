"""Source scans (CSV or parquet) with the value hygiene the graph build needs.

* CSV is read all-string, the missing-value tokens become NULL, then columns
  are cast to the declared schema (so ``requires_visa`` stays a string and
  ``1`` / ``True`` can match).
* NaN in score columns becomes NULL once, here, so averages skip it.
* ``_ord`` records input order; the graph build resolves duplicate keys to the
  last row by it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.broadcast import checked_broadcast
from . import schemas
from .records import csv_records

# The default missing-value tokens of pandas.read_csv.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

_CSV_HEADER_RENAMES = {"visa": {"from": "from_country", "to": "to_country"}}


class MissingInputs(FileNotFoundError):
    pass


class BadIds(ValueError):
    pass


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's reader finds ``path`` on the file system it belongs to."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def require_inputs(spark: SparkSession, paths: list[str]) -> None:
    """Check every input up front and name all the missing ones in one error."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise MissingInputs(f"Missing files: {missing}")


def _null_tokens(c: Column) -> Column:
    """Whole values that mean missing; padded or blank text is text."""
    return F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)


def _typed(c: Column, kind: T.DataType) -> Column:
    """Cast of a CSV value; a whole number may be written with a zero fraction
    (``10.0``), as writers of nullable integer columns do."""
    if not isinstance(kind, (T.LongType, T.IntegerType)):
        return c.try_cast(kind)
    wide = c.try_cast("decimal(38,12)")
    return F.coalesce(c.try_cast(kind), F.when(wide == F.floor(wide), wide.try_cast(kind)))


def nan_to_null(df: DataFrame, cols) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in present})


def _header(kind: str) -> list[str]:
    renames = _CSV_HEADER_RENAMES.get(kind, {})
    return [next((k for k, v in renames.items() if v == f.name), f.name) for f in schemas.SOURCES[kind].fields]


def _raw_csv(spark: SparkSession, kind: str, path: str, multi_line: bool | None) -> DataFrame:
    """All columns as strings. Where quoted line breaks are looked for (reviews,
    unless ``multi_line`` says otherwise), records are cut from byte ranges, so
    that one big file is still read by many tasks."""
    header = _header(kind)
    names = [f.name for f in schemas.SOURCES[kind].fields]
    if kind == "reviews" if multi_line is None else multi_line:
        rows = _parsed(spark, kind, path).select("place", "row.*")
        return rows.select(*[_null_tokens(F.col(f"`{h}`")).alias(n) for h, n in zip(header, names)], F.col("place").alias("_place"))
    raw = spark.read.option("header", True).option("escape", '"').schema(T.StructType([T.StructField(n, T.StringType()) for n in header])).csv(path)
    return raw.select(*[_null_tokens(F.col(f"`{h}`")).alias(n) for h, n in zip(header, names)])


def _parsed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(file, place, record, closed, row, fields) of every record but the files'
    headers; places order the records of all files, by the files' names."""
    records = csv_records(spark, path)
    files = records.groupBy("file").agg(F.min("position").alias("first"))  # one row a file
    files = files.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("bigint") - 1)
    body = records.join(checked_broadcast(files), "file").where("position > first")
    ddl = ", ".join(f"`{h}` STRING" for h in _header(kind))
    bare = F.regexp_replace("record", '"[^"]*"', "")
    return body.select("file", (F.col("number") * (1 << 44) + F.col("position")).alias("place"), "record", "closed",
                       F.from_csv("record", ddl, {"escape": '"', "mode": "PERMISSIVE"}).alias("row"),
                       (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).alias("fields"))


def rejected_rows(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(file, record, problem) of every record that a scan would not read as it
    is written: too few or too many fields, or quotes that do not balance (the
    record then holds the rest of its file). A scan reads missing fields as
    NULL and drops those that are too many."""
    width = len(schemas.SOURCES[kind].fields)
    problem = F.when(~F.col("closed"), "unbalanced quotes").when(F.col("fields") < width, "too few fields").when(F.col("fields") > width, "too many fields")
    return _parsed(spark, kind, path).withColumn("problem", problem).where("problem IS NOT NULL").select("file", "record", "problem")


def read_source(spark: SparkSession, kind: str, path: str, fmt: str = "csv", order_col: str | None = None,
                multi_line: bool | None = None) -> DataFrame:
    """Scan one source table (hotels / users / reviews / visa) with its schema.

    ``order_col`` names the column by which the last of several rows with one
    key wins (it may be one that the schema does not list); without it, scan
    order decides, which is input order for a single file only. ``multi_line``
    overrides whether quoted line breaks are looked for."""
    schema = schemas.SOURCES[kind]
    if fmt == "csv":
        if order_col and order_col not in schema.fieldNames():
            raise ValueError(f"{order_col} is not a column of {kind}; other order columns need parquet")
        raw = _raw_csv(spark, kind, path, multi_line)
        # Records of byte ranges know their place in the file; lines are numbered as they are scanned.
        place = [F.col("_place").alias("_ord")] if "_place" in raw.columns and not order_col else []
        df = raw.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields], *place)
    else:
        df = spark.read.parquet(path)
        order = [F.col(order_col).alias("_ord")] if order_col and order_col not in schema.fieldNames() else []
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns], *order)
    df = nan_to_null(df, [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)])
    return with_order(df, order_col)


def rejected_ids(spark: SparkSession, kind: str, path: str, multi_line: bool | None = None) -> DataFrame:
    """The raw CSV rows with a written id that is no whole number: ``read_source``
    reads that id as missing, and the graph build leaves such rows out."""
    raw = _raw_csv(spark, kind, path, multi_line)
    bad = [F.col(f.name).isNotNull() & _typed(F.col(f.name), f.dataType).isNull()
           for f in schemas.SOURCES[kind].fields if f.name.endswith("_id") and isinstance(f.dataType, T.LongType)]
    cond = F.lit(False)
    for b in bad:
        cond = cond | b
    return raw.where(cond)


def with_order(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Attach ``_ord``: the caller's order column, else scan order."""
    if "_ord" in df.columns:
        return df
    return df.withColumn("_ord", F.col(order_col) if order_col else F.monotonically_increasing_id())


def read_sources(spark: SparkSession, paths: dict[str, str], fmt: str = "csv", order_cols: dict[str, str] | None = None,
                 refuse_bad_ids: bool = True) -> dict[str, DataFrame]:
    """All sources. CSV rows whose id is no whole number are an error, so that
    none is lost unseen, unless ``refuse_bad_ids`` is off."""
    require_inputs(spark, list(paths.values()))
    if fmt == "csv" and refuse_bad_ids:
        bad = {k: [r.asDict() for r in rejected_ids(spark, k, p).limit(3).collect()] for k, p in paths.items()}
        if any(bad.values()):
            raise BadIds(f"ids that are no whole numbers: { {k: v for k, v in bad.items() if v} }")
    return {k: read_source(spark, k, p, fmt, (order_cols or {}).get(k)) for k, p in paths.items()}
