"""The batch build: raw feed -> landing CSV -> staged lines -> star schema.

Every stage boundary is a table written to shared storage (below
``spark.checkpoint.dir``): the landing CSV, the raw feed as parsed from it
(Parquet, so the CSV is parsed once and profiles read only the columns they
need), the tagged de-duplicated lines, each dimension and the fact. Builders
that read a table several times read files instead of recomputing the
de-duplication, and a lost executor only costs the tasks of the stage it was
running.

A build writes a folder of its own, ``<out>/builds/<id>``, and is published
last, by one row appended to ``<out>/published``. Readers follow the newest
row, so a refresh is all or nothing: one that stops half-way leaves the star
that was there, and never a mixture.

The registered queries share one build per input: its address is a hash of the
names, sizes and modification times of the input files and of the version of
the build's code, so a changed input is built anew.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import clean as clean_ops
from ..operators import dims as dim_ops
from ..operators import fact as fact_ops
from ..operators.stage import stage, unparsed_dates
from ..session import DENSE, app_id, file_stamps, path_exists, remove_path, scratch_epoch, shared_dir, write_table
from ..sources import access, sinks
from ..sources.csv import parsed, read_lines, rejected, write_csv
from ..sources.feed import SOURCE_TABLES, derived_feed

#: Raise it with every change of what a build writes: older builds are then not reused.
BUILD_VERSION = "3"
MAX_UNPARSED_DATES = 0.05
TABLES = ["dim_fecha", "dim_cliente", "dim_producto", "dim_geografia", "fact_ventas"]


DIMENSIONS = TABLES[:4]
#: Stands for the year of lines without a date.
NO_YEAR = -1


def year_of(date: Column) -> Column:
    return F.coalesce(F.year(date), F.lit(NO_YEAR))


@dataclass
class Star:
    base: str                          # folder of this build
    landing: DataFrame                 # raw feed as parsed from CSV (8 strings, Parquet copy)
    tagged: DataFrame                  # de-duplicated staged lines + removal rule
    landing_path: str                  # the CSV it was read from
    ts_format: str = fixed.INVOICE_TS_FORMAT
    multi_line: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, DataFrame] = field(default_factory=dict)   # members and CSV lines held back
    quarantine: DataFrame | None = None
    rows: dict[str, int] = field(default_factory=dict)
    parts: dict[str, dict[int, str]] = field(default_factory=dict)  # per table: the build that holds each year
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def staged(self) -> DataFrame:
        return stage(self.landing, self.ts_format)

    @property
    def clean(self) -> DataFrame:
        return clean_ops.clean_from_tagged(self.tagged)

    @property
    def fact(self) -> DataFrame:
        return self.tables["fact_ventas"]

    @property
    def unknown_key(self) -> int | None:
        """Surrogate key of the anonymous (UNKNOWN) customer, read once per build."""
        if "unknown" not in self._cache:
            row = (self.tables["dim_cliente"].filter(F.col("customer_id") == fixed.UNKNOWN_CUSTOMER)
                   .agg(F.max("cliente_id")).first())
            self._cache["unknown"] = row[0]
        return self._cache["unknown"]

    def once(self, name: str, make):
        """What ``make()`` gives, kept for this opened star until scratch is released (it may lie there)."""
        key = (name, scratch_epoch(self.fact.sparkSession))
        if key not in self._cache:
            self._cache[key] = make()
        return self._cache[key]

    @property
    def access(self) -> dict[str, access.Clustered]:
        """Clustered copies and file indexes of this star (S4), made once per opened star."""
        return self.once("access", lambda: access.cluster_star(self.tables, self.rows))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def register_views(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Expose the five star tables as temporary views for ``spark.sql``.

        Analysts can then run their own SQL over the warehouse, e.g.
        ``SELECT d.anio, sum(f.total_linea) FROM fact_ventas f JOIN dim_fecha d
        USING (fecha_id) WHERE f.is_cancelled = 0 GROUP BY d.anio``.
        """
        names = []
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names


def star_dir(spark: SparkSession, sf_dir: str) -> str:
    """Content address of the builds of ``sf_dir`` with this code."""
    stamps = [x for t in SOURCE_TABLES for x in file_stamps(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")]
    key = hashlib.sha1(repr((BUILD_VERSION, stamps)).encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/almacen-star/{key}"


def _paths(base: str) -> dict[str, str]:
    p = {t: f"{base}/{t}" for t in TABLES}
    p.update({f"rejected_{t}": f"{base}/rejected/{t}" for t in [*DIMENSIONS, "lines"]})
    p.update(landing=f"{base}/landing_csv", raw=f"{base}/raw_lines", tagged=f"{base}/staged_lines",
             work=f"{base}/_work",
             quarantine=f"{base}/fact_ventas_quarantine", manifest=f"{base}/manifest")
    return p


def build_from_csv(spark: SparkSession, csv_path: str, base: str,
                   timings: dict[str, float] | None = None, **options) -> Star:
    """Build the star from raw CSV files already on storage (no landing copy).

    ``csv_path`` is a file, directory or glob of the raw feed (header row,
    columns Invoice, StockCode, Description, Quantity, InvoiceDate, Price,
    Customer ID, Country). ``options`` are those of :func:`build`.
    """
    return build(spark, None, base=base, landing_path=csv_path, timings=timings, **options)


def build(spark: SparkSession, sf_dir: str | None, base: str | None = None,
          raw: DataFrame | None = None, timings: dict[str, float] | None = None,
          landing_path: str | None = None, ts_format: str = fixed.INVOICE_TS_FORMAT,
          multi_line: bool = False, max_unparsed_dates: float = MAX_UNPARSED_DATES) -> Star:
    """Run the whole ETL once, write the star to a new folder below ``base``, and publish it.

    S2 full refresh: dimensions first (the fact's key lookups read them), then
    the fact, a manifest with every row count, and the pointer to the build last.

    ``ts_format`` is the layout of InvoiceDate; a build where it fails on more
    than ``max_unparsed_dates`` of the written dates raises instead of dropping
    those lines. ``multi_line`` reads line breaks inside quoted values.
    ``timings``, when given, receives the wall time of each stage.
    """
    base = base or star_dir(spark, sf_dir)
    build_id = uuid.uuid4().hex[:12]
    p = _paths(f"{base}/builds/{build_id}")
    if landing_path:
        p["landing"] = landing_path
    clock = _Clock(timings)

    # E: the raw feed as CSV. The driver tables are landed as CSV first (the
    # source system's input format); existing CSV files are read in place.
    if not landing_path:
        write_csv(raw if raw is not None else derived_feed(spark, sf_dir), p["landing"])
    # Parse the CSV once; staging and every profile read the columnar copy.
    lines = write_table(read_lines(spark, p["landing"], multi_line), p["raw"], codec=DENSE)
    landing = parsed(lines)
    held_lines = write_table(rejected(lines), p["rejected_lines"])
    dates, unparsed = unparsed_dates(landing, ts_format).first()
    if unparsed > max_unparsed_dates * dates:
        raise ValueError(f"{unparsed} of {dates} dates are not written as {ts_format!r}")
    clock("land_csv")

    # T1-T12: stage, de-duplicate and tag each line with its removal rule.
    tagged = write_table(clean_ops.tag(stage(landing, ts_format)), p["tagged"], codec=DENSE)
    clean = clean_ops.clean_from_tagged(tagged)
    clock("stage_dedup_tag")

    # Dimensions: four independent jobs, submitted concurrently so their
    # (small) stages share the executors instead of running one by one.
    builders = [("dim_fecha", dim_ops.dim_fecha), ("dim_cliente", dim_ops.dim_cliente),
                ("dim_producto", dim_ops.dim_producto), ("dim_geografia", dim_ops.dim_geografia)]

    def _build_one(name, builder):
        # Builders run jobs themselves (surrogate-key numbering), so the
        # whole builder runs in the worker thread, not just the final write.
        return sinks.write_dim(builder(clean, workdir=p["work"]), name, p[name], p[f"rejected_{name}"],
                               f"{p['work']}/{name}")

    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        futures = {name: pool.submit(_build_one, name, builder) for name, builder in builders}
        tables: dict[str, DataFrame] = {name: f.result() for name, f in futures.items()}
    clock("dims")

    # Fact: resolve the keys, hold back what cannot be loaded, number, lay out by year.
    dim_bytes = fact_ops.lookup_bytes(tables)
    keyed = write_table(fact_ops.resolve_keys(clean, tables, dim_bytes, workdir=p["work"]),
                        f"{p['work']}/keyed", codec=DENSE)
    loadable, bad = fact_ops.split_loadable(keyed)
    quarantine = write_table(bad, p["quarantine"])
    clock("fact_keys")
    fact = sinks.conform(fact_ops.fact_ventas(loadable, workdir=p["work"]), "fact_ventas", keep=("anio",))
    remove_path(spark, f"{p['work']}/keyed")          # numbered and written, or in quarantine
    tables["fact_ventas"] = sinks.write_fact(fact, p["fact_ventas"], True)
    clock("fact_number_and_write")

    rows = {t: df.count() for t, df in tables.items()}
    rows |= {"quarantine": quarantine.count(), "rejected_lines": held_lines.count()}
    sinks.write_manifest(spark, rows, p["manifest"], landing=p["landing"], ts_format=ts_format,
                         multi_line=multi_line)
    publish(spark, base, build_id)
    remove_path(spark, p["work"])
    return _open(spark, base, build_id)


def publish(spark: SparkSession, base: str, build_id: str) -> None:
    """Make a complete build the one that readers of ``base`` see: one appended row."""
    (spark.createDataFrame([(build_id, time.time_ns())], "build string, published long")
     .coalesce(1).write.mode("append").parquet(f"{base}/published"))


def published(spark: SparkSession, base: str) -> list[str]:
    """Builds of ``base`` that were published, the newest first."""
    if not path_exists(spark, f"{base}/published"):
        return []
    rows = spark.read.parquet(f"{base}/published").orderBy(F.desc("published"), "build")
    return [r["build"] for r in rows.collect()]              # one row per refresh


def retire(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest published builds and those that hold years of them."""
    builds = published(spark, base)
    needed = {x for b in builds[:keep] for years in _parts(spark, base, b).values() for x in years.values()}
    old = [b for b in builds[keep:] if b not in needed and path_exists(spark, f"{base}/builds/{b}")]
    for b in old:
        remove_path(spark, f"{base}/builds/{b}")
    return old


def _parts(spark: SparkSession, base: str, build_id: str) -> dict[str, dict[int, str]]:
    """Per table the build that holds each year: of a full build, itself (and then only the years of the fact)."""
    root = f"{base}/builds/{build_id}"
    out: dict[str, dict[int, str]] = {"staged_lines": {}, "fact_ventas": {}}
    if path_exists(spark, f"{root}/parts"):
        for r in spark.read.parquet(f"{root}/parts").collect():            # one row per table and year
            out[r["table_name"]][r["anio"]] = r["build"]
    return out


def compose(spark: SparkSession, base: str, build_id: str) -> dict[str, DataFrame]:
    """The lines and the fact of a refreshed build: each year from the build that holds it."""
    out = {}
    for table, years in _parts(spark, base, build_id).items():
        for build in sorted(set(years.values()) | {build_id}):
            own = sorted(y for y, b in years.items() if b == build)
            df = spark.read.parquet(f"{base}/builds/{build}/{table}")
            if table == "fact_ventas":
                part = df.select(*fact_ops.FACT_COLUMNS, "anio").filter(F.col("anio").isin(own) if own else F.lit(False))
            else:
                part = df.filter(year_of(F.col("invoice_date")).isin(own) if own else F.lit(False))
            out[table] = out[table].unionByName(part) if table in out else part
    return out


def _open(spark: SparkSession, base: str, build_id: str) -> Star:
    root = f"{base}/builds/{build_id}"
    p = _paths(root)
    manifest = spark.read.parquet(p["manifest"]).collect()       # one row per table
    rows = {r["table_name"]: int(r["row_count"]) for r in manifest}
    tables = {t: spark.read.parquet(p[t]) for t in TABLES}
    tables["fact_ventas"] = tables["fact_ventas"].select(*fact_ops.FACT_COLUMNS, "anio")
    tagged, parts = spark.read.parquet(p["tagged"]), _parts(spark, base, build_id)
    if any(parts.values()):
        whole = compose(spark, base, build_id)
        tables["fact_ventas"], tagged = whole["fact_ventas"], whole["staged_lines"]
    wrong = {t: n for t, n in rows.items() if t in tables and tables[t].count() != n}
    if wrong:
        raise ValueError(f"build {root} is damaged: the rows of {', '.join(wrong)} differ from its manifest")
    first = manifest[0]
    return Star(base=root, landing=parsed(spark.read.parquet(p["raw"])), tagged=tagged,
                landing_path=first["landing"], ts_format=first["ts_format"], multi_line=first["multi_line"],
                tables=tables,
                rejected={t: spark.read.parquet(p[f"rejected_{t}"]) for t in [*DIMENSIONS, "lines"]},
                quarantine=spark.read.parquet(p["quarantine"]), rows=rows,
                parts=parts if any(parts.values()) else _whole_parts(tables, tagged, build_id))


def _whole_parts(tables: dict[str, DataFrame], tagged: DataFrame, build_id: str) -> dict[str, dict[int, str]]:
    """The parts of a full build: it holds every year itself."""
    return _Years({"fact_ventas": lambda: tables["fact_ventas"].select("anio"),
                   "staged_lines": lambda: tagged.select(year_of(F.col("invoice_date")).alias("anio"))}, build_id)


class _Years(dict):
    """Years per table, looked up when first asked for: only a refresh needs them."""

    def __init__(self, tables: dict, build_id: str):
        super().__init__()
        self.tables, self.build_id = tables, build_id

    def __missing__(self, table: str) -> dict[int, str]:
        years = self.tables[table]().distinct().collect()          # one row a year
        self[table] = {r["anio"]: self.build_id for r in years}
        return self[table]


def load(spark: SparkSession, base: str) -> Star | None:
    """Open the newest published build of ``base``, or None when there is none."""
    newest = published(spark, base)[:1]
    return _open(spark, base, newest[0]) if newest else None


class _Clock:
    def __init__(self, sink: dict[str, float] | None):
        self.sink, self.t = sink, time.perf_counter()

    def __call__(self, step: str) -> None:
        now = time.perf_counter()
        if self.sink is not None:
            self.sink[step] = round(now - self.t, 3)
        self.t = now


_OPEN: dict[tuple[str, str], Star] = {}


def pin(spark: SparkSession, sf_dir: str, built: Star | None) -> Star | None:
    """Make ``built`` the star that queries over ``sf_dir`` use in this session.

    Returns the previously pinned star; ``None`` unpins.
    """
    key = (app_id(spark), star_dir(spark, sf_dir))
    old = _OPEN.pop(key, None)
    if built is not None:
        _OPEN[key] = built
    return old


def star(spark: SparkSession, sf_dir: str) -> Star:
    """The star for the present content of ``sf_dir``: reuse a published build, else build it once."""
    base = star_dir(spark, sf_dir)
    key = (app_id(spark), base)
    if key not in _OPEN:
        _OPEN[key] = load(spark, base) or build(spark, sf_dir, base)
    return _OPEN[key]
