"""Readers and writers for delimited tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the input files.
OBSERVATION_FILE = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("usage_dttm", T.TimestampType()),
        T.StructField("tidenhnum", T.IntegerType()),
        T.StructField("xtr10", T.DoubleType()),
        T.StructField("ytr10", T.DoubleType()),
    ]
)
CELL_FILE = T.StructType(
    [
        T.StructField("locid", T.StringType()),
        T.StructField("xtr10", T.DoubleType()),
        T.StructField("ytr10", T.DoubleType()),
    ]
)


# A file's first line is looked for in its first block only.
_FIRST_BLOCK = "_metadata.file_block_start = 0"


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by the columns of their first line.

    A single file costs one line. Several cost a pass over the text of the first block
    of each; what comes back is a name per file, as many as Spark lists anyway.
    """
    text = spark.read.text(path)
    files = text.inputFiles()
    if len(files) == 1:
        lines = [(files[0], row.value) for row in text.head(1)]
    else:
        first = (
            text.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.expr(_FIRST_BLOCK).alias("begin"))
            .filter("begin")
            .groupBy("file")
            .agg(F.min_by("value", "place").alias("value"))
        )
        lines = [(row.file, row.value) for row in first.collect()]
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted(lines):
        names = tuple(name.strip().strip('"') for name in line.split(";"))
        groups.setdefault(names, []).append(file)
    return groups


def _read_text_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The columns ``names`` as text, matched by the header of each file.

    Files with the same header are read together; a header that lacks a column is an
    error that names the column and a file.
    """
    groups = _headers(spark, path)
    for header, files in groups.items():
        missing = [name for name in names if name not in header]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {files[0]}; it has {', '.join(header)}")
    if not groups:
        raise ValueError(f"no header in {path}")
    parts = [
        spark.read.csv(path if len(groups) == 1 else files, sep=";", header=True).select(*names)
        for files in groups.values()
    ]
    return reduce(DataFrame.unionByName, parts)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns with the types of ``schema``; a value that is not of its type is an
    error when it is read, an empty value is null."""

    def column(field: T.StructField) -> Column:
        text, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.StringType):
            return text.alias(field.name)
        value = text.try_cast(kind)
        message = F.concat(F.lit(f"{field.name} is not {kind.simpleString()}: "), text)
        wrong = text.isNotNull() & value.isNull()
        return F.when(wrong, F.raise_error(message).cast(kind)).otherwise(value).alias(field.name)

    return raw.select(*(column(field) for field in schema))


def _with_id_type(raw: DataFrame, schema: T.StructType, name: str) -> T.StructType:
    """The schema with ``name`` as text if any of its values is not a whole number."""
    wrong = F.col(name).isNotNull() & F.col(name).try_cast(T.LongType()).isNull()
    if raw.agg(F.bool_or(wrong)).first()[0]:
        fields = [T.StructField(f.name, T.StringType()) if f.name == name else f for f in schema]
        return T.StructType(fields)
    return schema


def read_observations(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Semicolon-separated observations with a header in every file; ``path`` may be a glob.

    Columns are matched by name, file by file. Without a ``schema`` the user ids are
    numbers if all of them are, else text, which one aggregate over the ids finds
    out; a schema saves that pass.
    """
    raw = _read_text_columns(spark, path, OBSERVATION_FILE.names if schema is None else schema.names)
    return _typed(raw, _with_id_type(raw, OBSERVATION_FILE, "uid") if schema is None else schema)


def read_cells(spark: SparkSession, path: str, schema: T.StructType = CELL_FILE) -> DataFrame:
    """Semicolon-separated cells with a header in every file; ``path`` may be a glob."""
    return _typed(_read_text_columns(spark, path, schema.names), schema)


def write_matrix(matrix: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write a matrix or walk table, replacing what is there."""
    writer = matrix.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
