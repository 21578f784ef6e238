"""File sources and sinks: text corpora, typed CSV, JSON reports, optional inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featureforge.functions.columns import number, stripped, whole
from featureforge.operators.dedupe import first_per_key


def readable_text(raw: Column) -> Column:
    """Drop undecodable bytes and make every line end a line feed."""
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )
    return F.regexp_replace(valid, r"\r\n?", "\n")


def read_corpus(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """One row per file: ``file_name``, ``path``, ``text``. Subfolders are included."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("path"),
        readable_text(F.col("value")).alias("text"),
    )


def file_stem(name: Column | str) -> Column:
    """File name without its last suffix."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def read_metrics(spark: SparkSession, path: str, schema: Mapping[str, str] | T.StructType) -> DataFrame:
    """CSV with a header: names and texts are trimmed, ``schema`` columns are cast, bad values become null."""
    raw = spark.read.csv(path, header=True)
    return coerce(raw.toDF(*[c.strip() for c in raw.columns]), schema)


def coerce(df: DataFrame, schema: Mapping[str, str] | T.StructType) -> DataFrame:
    """Trim texts; cast the listed columns, null where the cast fails. Missing columns are ignored."""
    if isinstance(schema, T.StructType):
        schema = {f.name: f.dataType.simpleString() for f in schema}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in schema and schema[f.name] != "string":
            kind = schema[f.name]
            text = stripped(c) if isinstance(f.dataType, T.StringType) else c
            if kind in ("tinyint", "smallint", "int", "bigint"):
                c = whole(text, f.dataType, kind)
            else:
                c = number(text.try_cast("double")) if kind == "double" else text.try_cast(kind)
        elif isinstance(f.dataType, T.StringType):
            c = stripped(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_optional(spark: SparkSession, path: str, schema: Mapping[str, str]) -> DataFrame:
    """As :func:`read_metrics`; an absent or empty source gives an empty table of that schema."""
    empty = spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in schema.items()))
    try:
        found = read_metrics(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty
    return found if found.columns else empty


def pick_preferred(
    files: DataFrame, run: str, path: str, patterns: Sequence[str]
) -> DataFrame:
    """One file per run: the earliest pattern that matches, then the smallest path."""
    rank = F.coalesce(
        *[F.when(F.col(path).rlike(p), F.lit(i)) for i, p in enumerate(patterns)]
    )
    ranked = files.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    return first_per_key(ranked, [run], ["_rank", path]).drop("_rank")


def read_json_reports(
    df: DataFrame, text: str, schema: T.StructType, column: str = "report", status: str = "parse_status"
) -> DataFrame:
    """Parse a JSON text column; ``status`` is ``ok`` or ``failed``."""
    bad = "_corrupt"
    wanted = T.StructType(schema.fields + [T.StructField(bad, T.StringType())])
    parsed = F.from_json(
        F.col(text), wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    )
    out = df.withColumn(column, parsed)
    ok = F.col(column).isNotNull() & F.col(f"{column}.{bad}").isNull()
    return out.withColumn(status, F.when(ok, F.lit("ok")).otherwise(F.lit("failed"))).withColumn(
        column, F.when(ok, F.col(column)).dropFields(bad)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
