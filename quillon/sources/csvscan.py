"""CSV scans with date columns cast at the door, and the sinks for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .registry import SourceSpec


#: Share of the rows that are looked at where types have to be sniffed.
SNIFFED = 0.1


def read_csv(spark: SparkSession, paths: str | list[str], spec: SourceSpec | None = None, schema: StructType | str | None = None, known: StructType | None = None) -> DataFrame:
    """CSV files with a header; the source's date columns become dates, and every one that it declares has to be there.

    ``schema`` is taken as it is. ``known`` types (of the stored table) are matched with the header by name, so that files
    are read once; without either, types are sniffed from a share of the rows. Files are split between tasks unless the
    source quotes line breaks.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", bool(spec and spec.quoted_newlines))
    if schema is None and known is not None:
        first = spark.read.option("header", False).option("escape", '"').csv(paths).first()
        names = [str(x) for x in first] if first is not None else known.names
        schema = StructType([StructField(n, known[n].dataType if n in known.names else StringType()) for n in names])
    if schema is not None:
        df = reader.schema(schema).csv(paths)
    else:
        df = reader.option("inferSchema", True).option("samplingRatio", SNIFFED if not (spec and spec.full) else 1.0).csv(paths)
    if spec is not None:
        missing = set(spec.date_columns) - set(df.columns)
        if missing:
            raise ValueError(f"{spec.name} lacks date columns: {', '.join(sorted(missing))}")
        df = df.withColumns({c: F.col(c).cast("date") for c in spec.date_columns})
    return df


def write_predictions(df: DataFrame, path: str) -> None:
    """symbol, prediction_date, score, probability as CSV with a header."""
    df.select("symbol", "prediction_date", "score", "probability").write.mode("errorifexists").csv(path, header=True)
