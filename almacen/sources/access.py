"""S4: access paths of the star, as clustered copies with an index of their files.

The source declares eight indexes. Dates are served by the fact's own
layout. For the other keys the fact is copied once in the order of a Z curve:

1. each of customer, product and geography is ranked by range of the lines'
   quantiles (``2 ** BITS`` ranks; a hot key is one rank, others share);
2. the bits of the three ranks are interleaved, so that lines near on the curve
   are near in all three keys; the cancelled flag goes before;
3. the lines are dealt by range of (flag, curve, line) into files. Lines of one
   point of the curve are parted by line, so a hot combination fills as many
   files as it needs;
4. Parquet Bloom filters on the keys let a scan skip row groups whose range
   holds a key that does not occur in them (where a row group's keys fit a
   dictionary, Parquet writes that instead, and the scan uses it alike).

The index has one row a file: its lines, the least and greatest of each key, and
a bitmap of ``MARKS`` bits that its keys are hashed to. A look-up filters the
index and opens only the files that may hold its lines: by range alone, for one of
three keys, about ``files ** (2/3)`` of them, and by bitmap fewer, as long as a file holds fewer
keys than bits. Dimensions are ordered by the column of their path and indexed
in the same way.

Clustering is an operation on a finished star, like making indexes after a
load; it reads the star and writes below its own folder.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, write_table

BITS = 8
#: A file should hold this many lines (about 128 MB of the fact) ...
FILE_LINES = 4_000_000
#: ... but a small table has files enough for pruning to tell, of at least so many lines.
LEAST_FILES, LEAST_LINES = 512, 16
MARKS = 1024


@dataclass(frozen=True)
class Path:
    """Order of a clustered copy: ``lead`` columns, the curve of ``keys``, then ``tie``."""
    lead: tuple[str, ...]
    keys: tuple[str, ...]
    tie: str


PATHS = {
    # The key of fewest values first: the bitmaps help the others, whose values a file holds a few of.
    "fact_ventas": Path(("is_cancelled",), ("geografia_id", "cliente_id", "producto_id"), "ventas_id"),
    "dim_fecha": Path(("anio", "mes"), (), "fecha_id"),
    "dim_cliente": Path(("segmento",), (), "cliente_id"),
    "dim_geografia": Path(("region",), (), "geografia_id"),
}


def range_cuts(df: DataFrame, keys: tuple[str, ...], bits: int = BITS) -> dict[str, list[int]]:
    """Per key the ``2 ** bits - 1`` values that part the lines into equal ranges (a sketch: only the layout depends on it)."""
    n = 1 << bits
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = df.agg(*[F.percentile_approx(k, at, F.lit(20 * n)).alias(k) for k in keys]).first()
    return {k: sorted(row[k] or []) for k in keys}


def rank_of(value: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` below ``value``, by a balanced tree of comparisons; NULL ranks first."""
    levels = sorted(set(cuts))
    ranks = [bisect.bisect_left(cuts, x) for x in levels] + [len(cuts)]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(ranks[low])
        mid = (low + high) // 2
        return F.when(value <= levels[mid], tree(low, mid)).otherwise(tree(mid + 1, high))
    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(levels)))


def interleave(ranks: list[Column], bits: int = BITS) -> Column:
    """One bit of each rank in turn, the highest first."""
    z = F.lit(0).cast("long")
    for b in range(bits):
        for k, r in enumerate(ranks):
            bit = F.shiftright(r, b).bitwiseAND(F.lit(1)).cast("long")
            z = z.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - k))
    return z


def files_for(lines: int, least: int = LEAST_FILES) -> int:
    return max(1, -(-lines // FILE_LINES), min(least, lines // LEAST_LINES))


def _mark(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(MARKS)).cast("int")


def _marks(column: str) -> Column:
    """The bitmap of a file's keys, as an array of 64-bit words."""
    at = _mark(F.col(column))
    bit = F.expr(f"shiftleft(1L, pmod(xxhash64({column}), 64))")
    return F.array(*[F.coalesce(F.bit_or(F.when(F.floor(at / 64) == w, bit)), F.lit(0).cast("long"))
                     for w in range(MARKS // 64)])


def _marked(marks: Column, value: Column) -> Column:
    at = _mark(value)
    return F.getbit(F.element_at(marks, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64))) == 1


def file_index(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per file of a table: its lines, the least and greatest value of each column, and the bitmap of each key."""
    named = df.select(*columns, F.col("_metadata.file_path").alias("file"))
    return named.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))],
        *[_marks(c).alias(f"marks_{c}") for c in keys])


@dataclass
class Clustered:
    """A written table and the index of its files."""
    spark: SparkSession
    table: DataFrame
    index: DataFrame

    def _held(self, keys: dict) -> DataFrame:
        may = F.lit(True)
        for c, v in keys.items():
            may = may & (F.col(f"least_{c}") <= F.lit(v)) & (F.col(f"most_{c}") >= F.lit(v))
            if f"marks_{c}" in self.index.columns:
                may = may & _marked(F.col(f"marks_{c}"), F.lit(v).cast(self.table.schema[c].dataType))
        return self.index.filter(may)

    def lookup(self, **keys) -> DataFrame:
        """The lines with these key values, from the files that may hold them."""
        files = [r["file"] for r in self._held(keys).select("file").collect()]     # paths only, as in any file listing
        if not files:
            return self.table.limit(0)
        wanted = F.lit(True)
        for c, v in keys.items():
            wanted = wanted & (F.col(c) == F.lit(v))
        return self.spark.read.schema(self.table.schema).parquet(*files).filter(wanted)

    def report(self, **keys) -> dict[str, int]:
        """Files and lines there are, and those that a look-up of ``keys`` reads."""
        total = self.index.agg(F.count(F.lit(1)), F.sum("lines")).first()
        read = self._held(keys).agg(F.count(F.lit(1)), F.sum("lines")).first()
        return {"files": total[0], "lines": total[1] or 0, "files_read": read[0], "lines_read": read[1] or 0}


def cluster(df: DataFrame, path: Path, lines: int, out: str) -> Clustered:
    """Write ``df`` in the order of ``path`` below ``out`` and index its files."""
    # Only the curve needs many files to tell; a dimension's order is one column.
    spark, files = df.sparkSession, files_for(lines, LEAST_FILES if path.keys else LEAST_LINES)
    columns = df.columns
    order = [*path.lead, path.tie]
    if path.keys:
        cuts = range_cuts(df, path.keys)
        # Ranks first, as columns of their own: every bit of the curve refers to one.
        ranks = {f"__rank_{k}": rank_of(F.col(k), cuts[k]) for k in path.keys}
        df = df.withColumns(ranks).withColumn("__z", interleave([F.col(r) for r in ranks]))
        order = [*path.lead, "__z", path.tie]
    writer = df.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*columns).write.mode("overwrite")
    for k in path.keys:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{k}", str(max(1, min(1_000_000, -(-lines // files))))))
    writer.parquet(f"{out}/data")
    table = spark.read.parquet(f"{out}/data")
    return Clustered(spark, table, write_table(file_index(table, [*path.lead, *path.keys], list(path.keys)), f"{out}/index"))


def by_date(fact: DataFrame, out: str) -> Clustered:
    """The fact's own layout (year folders, files of disjoint dates) with an index of its files."""
    return Clustered(fact.sparkSession, fact, write_table(file_index(fact, ["fecha_id"], []), f"{out}/index"))


def cluster_star(tables: dict[str, DataFrame], rows: dict[str, int], out: str | None = None) -> dict[str, Clustered]:
    """All access paths of a star: a clustered copy per table of ``PATHS``, and the fact by date."""
    out = out or scratch_path(tables["fact_ventas"].sparkSession, "access")
    made = {t: cluster(tables[t], p, rows[t], f"{out}/{t}") for t, p in PATHS.items()}
    return made | {"fact_by_date": by_date(tables["fact_ventas"], f"{out}/fact_by_date")}
