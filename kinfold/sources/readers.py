"""Sources. No schema is ever inferred: it is passed in or fixed by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from ..functions.coded import clean_nan
from ..schema import CATALOG, DICTIONARY, FACT_CATALOG, FACTS, FLAG_CATALOG, GROUP_CATALOG, HOUSEHOLD_KEY, PERSON_KEY, SLOT_CATALOG
from .folders import children, literal

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
_CORRUPT = "_corrupt_record"


def _survey_csv(spark: SparkSession, directory: str, table: str, schema: StructType) -> DataFrame:
    """A CSV table as text, with ``_fields``, the columns whose value their type can't hold (whole numbers have no fraction), and
    ``_line``, the line as read if it has too few or too many values."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields]).add(_CORRUPT, StringType())
    df = spark.read.schema(text).options(**_CSV, columnNameOfCorruptRecord=_CORRUPT, columnPruning=False).csv(f"{directory}/{table}.csv")
    unfit = F.array_compact(F.array(*(F.when(F.col(f.name).isNotNull() & _cast(f).isNull(), F.lit(f.name)) for f in schema.fields)))
    return df.select(*text.fieldNames()[:-1], unfit.alias("_fields"), F.col(_CORRUPT).alias("_line"), _decoded(F.col("_metadata.file_path")).alias("_file"))


def _cast(field: StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, IntegralType):
        value = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value)
    return value.try_cast(field.dataType)


def read_survey(spark: SparkSession, directory: str, table: str, schema: StructType, form: str = "parquet", mode: str = "PERMISSIVE") -> DataFrame:
    """One survey table: keys as strings (leading zeros survive), NaN as null. A CSV line with a value that its column
    can't hold, or with too few or too many values, would look like a missing answer: it is left out here and given by
    ``read_rejects``, or fails the job where ``mode`` is FAILFAST."""
    if form == "csv":
        df = _survey_csv(spark, directory, table, schema)
        sound = (F.size("_fields") == 0) & F.col("_line").isNull()
        if mode == "FAILFAST":
            sound = F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), _whole(schema))).cast("boolean"))
        df = df.filter(sound).select(*(_cast(f).alias(f.name) for f in schema.fields))
    else:
        df = spark.read.schema(schema).parquet(f"{directory}/{table}.parquet")
    return clean_nan(df.withColumns({k: F.col(k).cast("string") for k in (PERSON_KEY, HOUSEHOLD_KEY) if k in df.columns}))


def read_rejects(spark: SparkSession, directory: str, table: str, schema: StructType) -> DataFrame:
    """table, file, fields (those that don't fit their type), line: the lines of a CSV table that ``read_survey`` leaves out."""
    df = _survey_csv(spark, directory, table, schema).filter((F.size("_fields") > 0) | F.col("_line").isNotNull())
    return df.select(F.lit(table).alias("table"), F.col("_file").alias("file"), F.col("_fields").alias("fields"), _whole(schema).alias("line"))


def _whole(schema: StructType) -> Column:
    return F.coalesce("_line", F.to_csv(F.struct(*schema.fieldNames())))


def _decoded(path: Column) -> Column:
    """A file path of Spark's, which is written as a URI, as its plain text."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """table, field, kind, missing_codes (codes separated by blanks; empty: the default list)."""
    return spark.read.schema(CATALOG).options(**_CSV).csv(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """group, position, title."""
    return spark.read.schema(GROUP_CATALOG).options(**_CSV).csv(path)


def read_fact_catalog(spark: SparkSession, path: str) -> DataFrame:
    """group, position, kind, field, title, template."""
    return spark.read.schema(FACT_CATALOG).options(**_CSV).csv(path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """list, position, field, name."""
    return spark.read.schema(FLAG_CATALOG).options(**_CSV).csv(path)


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """array, position, part, field: the columns of repeated groups."""
    return spark.read.schema(SLOT_CATALOG).options(**_CSV).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """field, code, label."""
    return spark.read.schema(DICTIONARY).options(**_CSV).csv(path)


def read_sample(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).options(**_CSV).csv(path)


def read_results(spark: SparkSession, root: str, schema: StructType, profile: str | None = None, include_manual: bool = False) -> DataFrame:
    """Result files (JSON lines) of one profile or of all, with ``profile``. Lines that don't parse come with
    ``_corrupt_record`` set. The manual profile is left out of all unless asked for.

    Reads what ``write_results`` writes (folders ``profile=...``, whose names Spark encodes and decodes), where one profile
    is a partition filter and reads its folder only, and folders that are simply named after their profile. Names stay
    text and may hold any character."""
    told = StructType([f for f in schema.fields if f.name not in ("profile", _CORRUPT)]).add(_CORRUPT, StringType())
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    folders = [n for n, (folder, _) in children(spark, root).items() if folder]
    if any(n.startswith("profile=") for n in folders):
        df = reader.schema(StructType([*told.fields]).add("profile", StringType())).json(literal(root))
    elif profile is not None and profile not in folders:
        df = spark.createDataFrame([], StructType([*told.fields]).add("profile", StringType()))
    else:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
        df = reader.schema(told).json([literal(f"{root}/{n}") for n in folders if profile in (None, n)]).withColumn("profile", _decoded(name))
    if profile is not None:
        return df.filter(F.col("profile") == profile)
    return df if include_manual else df.filter(~F.col("profile").eqNullSafe("manual"))
