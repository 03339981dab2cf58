"""S1 csv_scan: the raw feed as delimited text.

The dialect is the usual one (RFC 4180): a value with a quote, comma or line
break stands in double quotes, and a quote inside it is doubled. Every column
is read as STRING (no schema inference pass over the data) and typed later;
the reader's missing-value tokens are mapped to NULL explicitly, because
Spark's CSV reader knows only one ``nullValue``.

A line whose number of fields differs from the header's is not shifted into
the wrong columns but kept whole in ``CORRUPT`` (:func:`rejected`), to be
counted. ``multi_line`` reads line breaks inside quotes; a file is then read
by one task, so it is off by default, and with it off such a record ends up
among the rejected lines rather than misread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import null_tokens
from ..session import shuffles_dropped

CORRUPT = "_corrupt"
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in [*fixed.RAW_COLUMNS, CORRUPT]])
DIALECT = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"',
           "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All lines: the eight columns as strings, and ``CORRUPT`` where a line does not parse."""
    df = (spark.read.schema(RAW_SCHEMA).options(**DIALECT).option("mode", "PERMISSIVE")
          .option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT)
          .option("columnPruning", False)      # else a pruned read does not see that a line is malformed
          .csv(path))
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in fixed.RAW_COLUMNS], CORRUPT)


def parsed(lines: DataFrame) -> DataFrame:
    """The well-formed ones. The second condition never holds; it makes a count name a
    column besides ``CORRUPT``, which Spark's CSV reader refuses to read alone."""
    never = F.length(f"`{fixed.RAW_COLUMNS[0]}`") < 0
    return lines.filter(F.col(CORRUPT).isNull() | never).drop(CORRUPT)


def rejected(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def csv_scan(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The well-formed lines of the raw feed, all eight columns as strings."""
    return parsed(read_lines(spark, path, multi_line))


def write_csv(df: DataFrame, path: str) -> None:
    """Land a raw feed as CSV in the dialect that :func:`csv_scan` reads, a (lightly) gzipped file per task of ``df``."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").options(**DIALECT, compression="gzip").option("zlib.compress.level", "BEST_SPEED").csv(path)
