"""The stored profile catalog (S7, C1, C3, C7): what profiles merge from, per file.

A lake grows by files. The catalog keeps, for every file of every dataset, one row per
column of ``profile.partials``: counts, least and largest values, votes of date layouts,
a HyperLogLog sketch of the values and a KLL sketch of the numbers. A refresh reads only
files that are new or whose size or modification time changed; the profile of a dataset,
or of all of them, is then one grouped sum of small rows, without a scan of data.

Three Parquet tables below ``root``, partitioned by dataset and refresh (``gen``):

* ``files``: the inventory that a refresh found, and in which ``gen`` each file's parts lie;
* ``parts``: the parts of the files that a refresh read;
* ``commits``: one row per finished refresh, a single file written last.

Readers follow the last commit of a dataset, so a refresh that dies leaves nothing
visible. Refreshes of one dataset must follow one another; ``vacuum`` removes what no
commit uses. Files are listed by Spark's ``binaryFile`` source, which reads no content.
The paths of changed files pass the driver, as every path of a scan does; nothing
else of the data or the catalog does.
"""

from __future__ import annotations

import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import Sketches, finish_profile, merged, partial_schema, partials
from ..operators.schema import columns_of

_COLUMN = "struct<ordinal:int,column:string,spark_type:string,kind:string,type_label:string>"
_KEYS = "dataset string, gen string, "
TABLES = {
    "commits": _KEYS + f"as_of timestamp_ntz, schema string, columns array<{_COLUMN}>",
    "files": _KEYS + "file string, modified timestamp, size bigint, part_gen string, as_of timestamp_ntz",
    "parts": _KEYS + "file string, " + partial_schema(),
}


@dataclass(frozen=True)
class Refresh:
    """What a refresh found: files in all, files read, files no longer there."""
    files: int
    read: int
    gone: int


class ProfileCatalog:
    def __init__(self, spark: SparkSession, root: str, sketches: Sketches = Sketches()):
        """``root`` is a folder that driver and executors share; it is set up if it is
        empty. ``sketches`` are the sizes of the sketches, the same for all datasets."""
        self.spark, self.root, self.sketches = spark, root.rstrip("/"), sketches
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("dataset", "gen").parquet(self._path(name))

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name))

    def _write(self, df: DataFrame, name: str, dataset: str, gen: str) -> None:
        """Into the folder of one refresh, so that refreshes may run side by side."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        names = [c for c in self._table(name).columns if c not in ("dataset", "gen")]
        df.select(*names).write.option("compression", "zstd").parquet(f"{self._path(name)}/dataset={escape(dataset)}/gen={gen}")

    def _last(self, datasets: list[str] | None = None) -> DataFrame:
        """The last commit of each dataset (or of those given)."""
        commits = self._table("commits")
        if datasets is not None:
            commits = commits.where(F.col("dataset").isin(list(datasets)))
        return commits.groupBy("dataset").agg(F.max_by(F.struct("gen", F.col("as_of").alias("clock"), "schema", "columns"), "gen").alias("c")).select("dataset", "c.*")

    def datasets(self) -> DataFrame:
        """``(dataset, gen, clock, schema, columns)`` of the last commits."""
        return self._last()

    def files(self, datasets: list[str] | None = None) -> DataFrame:
        """The current inventory."""
        return self._table("files").join(F.broadcast(self._last(datasets).select("dataset", "gen", "clock")), ["dataset", "gen"])

    def parts(self, datasets: list[str] | None = None) -> DataFrame:
        """The parts of the files of the current inventory. Counts of future dates hold
        for the commit's clock: a file whose last date is not after it has none."""
        live = self.files(datasets).select("dataset", F.col("part_gen").alias("gen"), "file", "clock")
        got = self._table("parts").join(live, ["dataset", "gen", "file"])
        after = lambda s: F.when(s["last"] > F.col("clock"), s["future"]).otherwise(0)
        layouts = F.transform("layouts", lambda s: F.struct(s["n"].alias("n"), after(s).alias("future"), s["last"].alias("last")))
        return got.withColumns({"future": F.when(F.col("kind") == "string", F.col("future")).otherwise(
            F.when(F.col("last") > F.col("clock"), F.col("future")).otherwise(0)), "layouts": layouts})

    def refresh(self, dataset: str, path: str, as_of=None, fmt: str = "parquet") -> Refresh:
        """Bring ``dataset`` up to date with the files below ``path``.

        Read are files that are new, whose size or modification time differs, and those
        with dates after a clock ``as_of`` that has moved since (their future dates
        count anew). A changed schema reads all. Partition columns of the path are columns.
        """
        spark, gen = self.spark, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        clock = _clock(spark, as_of)
        schema = spark.read.format(fmt).load(path).schema
        before = self._last([dataset]).select("schema").first()
        fresh = before is None or before["schema"] != schema.json()
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
            F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
        old = self.files([dataset]).select("file", F.col("modified").alias("was"), F.col("size").alias("was_size"),
                                           F.col("part_gen").alias("was_gen"), F.col("as_of").alias("was_as_of"))
        latest = F.greatest(F.max("last"), F.max(F.array_max(F.transform("layouts", lambda s: s["last"]))))
        dates = self.parts([dataset]).groupBy("file").agg(latest.alias("latest"))
        moved = (F.col("latest") > clock) & (F.col("was_as_of") != clock)
        same = (F.col("modified") == F.col("was")) & (F.col("size") == F.col("was_size")) & ~F.coalesce(moved, F.lit(False))
        keep = F.coalesce(same, F.lit(False)) & F.lit(not fresh)
        inventory = found.join(old.join(dates, "file", "left"), "file", "left").withColumn("keep", keep)
        self._write(inventory.select(
            "file", "modified", "size", F.when(F.col("keep"), F.col("was_gen")).otherwise(F.lit(gen)).alias("part_gen"),
            F.when(F.col("keep"), F.col("was_as_of")).otherwise(clock).alias("as_of")), "files", dataset, gen)
        now = self._table("files").where((F.col("dataset") == dataset) & (F.col("gen") == gen))
        changed = [r["file"] for r in now.where(F.col("part_gen") == gen).select("file").toLocalIterator()]
        if changed:
            self._read(dataset, gen, path, fmt, schema, changed, clock, now)
        gone = old.join(now.select("file"), "file", "left_anti").count()
        files = now.count()
        info = columns_of(spark.createDataFrame([], schema))
        commit = spark.createDataFrame([(schema.json(), [(c.ordinal, c.name, c.dtype.simpleString(), c.kind, c.label) for c in info])],
                                       f"schema string, columns array<{_COLUMN}>")
        self._write(commit.withColumn("as_of", clock).coalesce(1), "commits", dataset, gen)
        return Refresh(files, len(changed), gone)

    def refresh_all(self, paths: dict[str, str], as_of=None, fmt: str = "parquet", at_once: int = 4) -> dict[str, Refresh]:
        """``refresh`` of many datasets, ``at_once`` of them at a time: the jobs of small
        tables would leave a cluster idle one after the other."""
        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(paths, pool.map(lambda item: self.refresh(*item, as_of, fmt), paths.items())))

    def _read(self, dataset, gen, path, fmt, schema, changed, clock, now) -> None:
        """Write the parts of the ``changed`` files."""
        reader = self.spark.read.format(fmt).schema(schema)
        if _is_folder(self.spark, path):
            reader = reader.option("basePath", path)
        df = reader.load([re.sub(r"([\\*?{}\[\]])", r"\\\1", f) for f in changed])
        # a scan gives its paths as URIs, a listing as they are
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = partials(df, clock, file, self.sketches).withColumnRenamed("part", "file")
        self._write(rows, "parts", dataset, gen)
        mine = self._table("parts").where((F.col("dataset") == dataset) & (F.col("gen") == gen)).select("file").distinct()
        if not mine.join(now.select("file"), "file", "left_anti").isEmpty():
            raise RuntimeError(f"{dataset}: the scan names files otherwise than their listing")

    def profile(self, datasets: list[str] | None = None, distinct: str | None = None) -> DataFrame:
        """C1 of every dataset (or of those given) from the stored parts, in one job: the
        rows of ``operators.profile.profile``. ``distinct="sketch"`` estimates
        ``unique_values`` from the stored sketches; else they are NULL."""
        stats = merged(self.parts(datasets), ["dataset"])
        columns = self._last(datasets).select("dataset", F.inline("columns"))
        names = ["dataset", "ordinal", "column", "spark_type", "kind", "type_label"]
        # a dataset without rows has columns all the same
        zero = lambda c, cond=F.lit(True): F.when(cond, F.coalesce(c, F.lit(0)))
        text, number = F.col("kind") == "string", F.col("kind") == "numeric"
        out = columns.join(stats, names, "left").withColumns({
            "rows": zero("rows"), "non_null": zero("non_null"), "num_parsed": zero("num_parsed", text),
            "negatives": zero("negatives", number), "bad": zero("bad"), "future": zero("future")})
        if distinct == "sketch":
            counts = self._distinct(self.parts(datasets), ["dataset", "ordinal"])
            out = out.join(counts.withColumnRenamed("estimate", "unique_values"), ["dataset", "ordinal"], "left")
            out = out.withColumn("unique_values", F.when(F.col("kind") != "nested", F.coalesce("unique_values", F.lit(0))))
        else:
            out = out.withColumn("unique_values", F.lit(None).cast("bigint"))
        return finish_profile(out)

    @staticmethod
    def _distinct(parts: DataFrame, keys: list) -> DataFrame:
        return parts.where("distinct_sketch IS NOT NULL").groupBy(*keys).agg(
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("estimate"))

    def distinct(self, groups: dict[str, list[tuple[str, str]]]) -> DataFrame:
        """C3 over unions: ``(name, estimate)`` of the distinct values that the
        ``(dataset, column)`` pairs of each group hold together. Whole numbers of any
        width compare as equal, so do float widths; a value counts once."""
        members = self.spark.createDataFrame([(g, d, c) for g, pairs in groups.items() for d, c in pairs],
                                             "name string, dataset string, column string")
        wanted = sorted({d for pairs in groups.values() for d, _ in pairs})
        parts = self.parts(wanted).join(F.broadcast(members), ["dataset", "column"])  # a row per pair asked for
        return members.select("name").distinct().join(self._distinct(parts, ["name"]), "name", "left").select(
            "name", F.coalesce("estimate", F.lit(0)).alias("estimate"))

    def quantile_sketches(self, datasets: list[str] | None = None) -> DataFrame:
        """``(dataset, column, sketch)``: the merged KLL sketch of each numeric column,
        of all its files."""
        return self.parts(datasets).where("quantile_sketch IS NOT NULL").groupBy("dataset", "column").agg(
            F.kll_merge_agg_double("quantile_sketch").alias("sketch"))

    def vacuum(self) -> int:
        """Remove the folders of refreshes that no last commit uses, and return how many.
        Not while a refresh runs or a reader still holds an older commit's plan."""
        last = self._last().select("dataset", "gen")
        live = {"commits": last, "files": last,
                "parts": self.files().select("dataset", F.col("part_gen").alias("gen")).distinct()}
        # the rows here are refreshes, not files or data
        used = {name: {(r["dataset"], r["gen"]) for r in df.collect()} for name, df in live.items()}
        jvm, removed = self.spark._jvm, 0
        for name, keep in used.items():
            place = jvm.org.apache.hadoop.fs.Path(self._path(name))
            fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for one in fs.globStatus(jvm.org.apache.hadoop.fs.Path(place, "dataset=*/gen=*")):
                folder = one.getPath()
                unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                key = tuple(unescape(p.getName().split("=", 1)[1]) for p in (folder.getParent(), folder))
                if key not in keep:
                    removed += fs.delete(folder, True)
        return removed


def _clock(spark: SparkSession, as_of) -> Column:
    """A fixed clock: the one given, or now."""
    from ..operators.profile import as_of_lit
    now = spark.range(1).select(as_of_lit(as_of).alias("t")).first()["t"]
    return F.lit(now).cast("timestamp_ntz")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
