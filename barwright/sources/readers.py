"""Reading bars, table pairs, prepared splits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.rules import nan_to_null
from barwright.schema import BAR_SCHEMA


def normalise_names(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Map raw column names to the canonical ones.

    ``rename`` maps raw to canonical names.  A raw column that is not renamed and
    would collide with a computed one (names are case-insensitive) gets ``src_``.
    """
    from barwright.schema import INDICATORS

    rename = rename or {}
    computed = {c.lower() for c in INDICATORS} | {"target"}
    out = []
    for name in df.columns:
        new = rename.get(name, name)
        if name not in rename and new.lower() in computed:
            new = f"src_{new.lower()}"
        out.append(F.col(f"`{name}`").alias(new))
    return df.select(*out)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every double column, once, at the edge."""
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_timestamp(df: DataFrame, column: str, fmt: str | None = None, out: str = "ts") -> DataFrame:
    """String to ``timestamp_ntz``, the same in every session zone; text that is no timestamp becomes NULL.

    Text with an offset or zone gives the instant's UTC wall time; other text gives what it says.
    """
    text = F.col(column)
    if fmt:
        name = f"`{column.replace('`', '``')}`"
        said = F.expr(f"try_to_timestamp(concat({name}, ' +0000'), {_quoted(fmt + ' Z')})")
        return df.withColumn(out, F.convert_timezone(F.current_timezone(), F.lit("UTC"), said.cast("timestamp_ntz")))
    zoned = F.regexp_like(text, F.lit(r"(?i)\d{1,2}:\d{2}.*([+-]\d{1,2}(:?\d{2})?|z|utc|gmt|[a-z]+/[a-z_]+)\s*$"))
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return df.withColumn(out, F.when(zoned, instant).otherwise(text.try_cast("timestamp_ntz")))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_csv_by_name(
    spark: SparkSession, path: str, schema: T.StructType, rename: dict[str, str] | None = None, corrupt: str | None = None, extra_type: str | None = None
) -> DataFrame:
    """CSV columns matched to ``schema`` by the header's names, in any order.

    ``rename`` maps raw to new names; the schema may use either, the result has the new ones. Columns beyond the
    schema are kept as ``extra_type``; without one they are doubles where they hold numbers only, else text,
    which takes a pass to find out. A schema column that the header lacks is an error. ``corrupt`` names a
    column for the text of malformed lines, which are NULL otherwise.
    """
    rename = rename or {}
    head = spark.read.option("header", True).csv(path).columns
    names = {raw: rename.get(raw, raw) for raw in head}
    raw_of = {raw: raw for raw in head} | {new: raw for raw, new in names.items()}
    missing = [f.name for f in schema.fields if f.name not in raw_of]
    if missing:
        raise ValueError(f"the header lacks {missing}; it has {head}")
    declared = {raw_of[f.name]: f.dataType for f in schema.fields}
    fields = [T.StructField(raw, declared.get(raw, T.StringType())) for raw in head]
    extra = [raw for raw in head if raw not in declared]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if corrupt:
        fields.append(T.StructField(corrupt, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    df = reader.schema(T.StructType(fields)).csv(path)
    kinds = dict.fromkeys(extra, extra_type or "string")
    if extra and extra_type is None:
        odd = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"x{i}") for i, c in enumerate(extra)]).first()
        kinds = {c: "string" if odd[i] else "double" for i, c in enumerate(extra)}
    plain = [F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in extra]
    ordered = [F.col(f"`{raw}`").alias(names[raw]) for raw in declared]
    return df.select(*ordered, *plain, *([F.col(corrupt)] if corrupt else []))


def read_bars_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = BAR_SCHEMA,
    rename: dict[str, str] | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Bars from CSV by the names of its header; further raw columns are kept."""
    return clean_doubles(normalise_names(read_csv_by_name(spark, path, schema, rename, corrupt)))


def read_bars_parquet(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    return clean_doubles(normalise_names(spark.read.parquet(path), rename))


def read_csv_pair(
    spark: SparkSession, reference: str, current: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Two CSV tables with one schema: the reference and the current side of a drift check."""

    def one(path: str) -> DataFrame:
        return clean_doubles(read_csv_by_name(spark, path, schema))

    return one(reference), one(current)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A prepared table written by ``write_split``; ``split`` prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
