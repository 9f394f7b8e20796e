"""Reader for delimited files whose separator and encoding are not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank import fixed_values as fv
from auditrank.functions.columns import plain_number

#: Input position of a row: file, block, place in block.
ROW_ORDER = "_row_order"
_EXTRA, _ODD = "_extra_field", "_odd_record"


def _profile(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether quoted fields span lines, from every line.

    The text source hands over the bytes of a line unchanged, so validity of
    UTF-8 can be tested on them.
    """
    line = F.col("value")
    unescaped_quotes = F.length(F.regexp_replace(line, r'\\.|[^"]', ""))
    seen = (
        spark.read.text(path)
        .agg(
            F.count_if(~F.is_valid_utf8(line)).alias("invalid"),
            F.count_if(unescaped_quotes % 2 == 1).alias("unbalanced"),
        )
        .first()
    )
    utf8, latin1 = fv.ENCODINGS
    return (latin1 if seen.invalid else utf8), seen.unbalanced > 0


def _reader(spark: SparkSession, separator: str, encoding: str, multi_line: bool) -> DataFrameReader:
    return spark.read.options(
        sep=separator, encoding=encoding, multiLine=multi_line, header=True, quote='"', escape="\\", mode="PERMISSIVE"
    )


def _has_long_row(reader: DataFrameReader, path: str, columns: list[str]) -> bool:
    """Whether some row has more fields than the header.

    The schema has one field more than the header: an ordinary or short row is
    then an odd record without an extra field, a long row is anything else.
    """
    names = [f"c{i}" for i in range(len(columns))] + [_EXTRA, _ODD]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = reader.options(columnNameOfCorruptRecord=_ODD, columnPruning=False).schema(schema).csv(path)
    long_row = F.col(_EXTRA).isNotNull() | F.col(_ODD).isNull()
    return not rows.where(long_row).isEmpty()


def _missing_as_null(column: Column) -> Column:
    return F.when(~column.isin(list(fv.MISSING_TEXTS)), column)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first reading that has several columns and no long row.

    All columns are text, names trimmed, usual texts for "missing" are NULL;
    :data:`ROW_ORDER` holds the input position.  Short rows are filled with
    NULL.  Files with quoted line breaks are read as a whole, one task each.
    """
    encoding, multi_line = _profile(spark, path)
    for separator in fv.SEPARATORS:
        reader = _reader(spark, separator, encoding, multi_line)
        columns = reader.csv(path).columns
        if len(columns) > 1 and not _has_long_row(reader, path, columns):
            schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in columns])
            rows = _reader(spark, separator, encoding, multi_line).schema(schema).csv(path)
            order = F.struct(
                F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
            )
            return rows.select(
                *(_missing_as_null(F.col(f"`{c}`")).alias(c) for c in schema.names), order.alias(ROW_ORDER)
            )
    raise ValueError(f"no separator and encoding fit {path}")


def typed(df: DataFrame, keep_text: tuple[str, ...] = ("id_cliente",)) -> DataFrame:
    """Text columns whose values are all plain numbers, as doubles; one job."""
    texts = [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep_text
    ]
    if not texts:
        return df
    checks = [
        F.struct(F.count(F.col(f"`{c}`")).alias("given"), F.count(plain_number(F.col(f"`{c}`"))).alias("plain"))
        for c in texts
    ]
    seen = df.agg(*(check.alias(f"c{i}") for i, check in enumerate(checks))).first()
    numeric = [c for c, s in zip(texts, seen) if s.given == s.plain]
    return df.withColumns({c: plain_number(F.col(f"`{c}`")) for c in numeric})
