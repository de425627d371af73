"""Each batch of arrived files against everything accepted before, through an append-only pivot-distance store.

A path is cut into its numbers (experiment number, date, wafer, chip, bias, run), its head (phase, measurement kind,
direction) and its experiment's name; storage root, extra folders, copy marks and endings fall away. The distance of two
paths is a metric, the sum of four: how far their numbers lie apart on a line (days, and within a day a hash of all
numbers), APART if the numbers differ, APART if the heads differ, and the Levenshtein distance of the names. Two paths
are one file if it is at most RADIUS. The store keeps, for every distinct path accepted, the distances to fixed pivots.
A new path meets only stored rows whose distance to the first pivot lies in its own or a neighbouring range of RADIUS + 1;
the other pivots prune by the triangle inequality; the true distance verifies. Hashes are looked up by equality.

A batch reads the store's row groups whose first distance lies in its own days (pushed down as ranges; files are written
in that order), the hash table's two columns, and the roots of the rows it meets. It appends its new paths, hashes and
roots; nothing is written again but for a merge of each MERGE small loads into one. A file's root is the lowest id of its
component: new links are united with the stored roots only, and a component whose root falls gets new records appended
(the least root of a row holds).

Defined results: rows with num_points 0 are no cases and link nothing; a null, unreadable or empty-file hash is no
evidence, nor is a null or blank path; repeated rows are repeats of the row with the lowest id; ties are broken by the
lowest id; rows without id are left out; rows without batch arrive first; empty batches and an empty history give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.components import components
from ohmgrid.session import BROADCAST_BYTES, materialize, shared_dir

#: Most edits between the names of two spellings of a path; distance of unlike numbers or heads.
RADIUS, APART = 3, 4
#: Places on the line of numbers: hashes in a day, and days or parts of unreadable paths that one span of the store covers.
DAY_PLACES, SPAN_DAYS = 1 << 24, 32
#: Spans below the first day, for paths without a date.
UNDATED = 8
#: Fixed pivots (head, name), all at the line's begin; any strings keep the result right, unlike ones prune better.
PIVOTS = (("pre|idvd|fwd", "amberfield acceptance"), ("post|rdson|rev", "kingsmoor screening"), ("||", "zz"))
#: Single loads that are merged into one.
MERGE = 8
#: Links of a batch up to which one task unites them; more are united by components().
LOCAL_LINKS = 200_000
#: Fixed value: MD5 of an empty file.
EMPTY_HASH = "d41d8cd98f00b204e9800998ecf8427e"

EXPERIMENT = r"([a-z_]*[a-z])_([0-9]{4})_([0-9]{6})(?:/|$)"
DAY = r"/([0-9]{8})_([a-z]+)(?:/|$)"
FILE = r"/w([0-9]+)_c([0-9]+)_([a-z]+)_([a-z]+)_([0-9]+)v_([0-9]+)[^/]*$"


def _path(c: Column) -> Column:
    """c without case, escapes and unlike separators."""
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.concat(F.lit("/"), F.regexp_replace(F.lower(F.translate(F.trim(plain), "\\", "/")), r"[\s_\-]+", "_"))


def _number(c: Column) -> Column:
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def keyed(files: DataFrame) -> DataFrame:
    """(id, batch, numbers, words, day, hash) of the rows that can be cases."""
    p = F.col("path")
    part = lambda rule, i: F.regexp_extract(p, rule, i)
    known = p.rlike(EXPERIMENT) & p.rlike(DAY) & p.rlike(FILE)
    numbers = F.concat_ws("/", part(EXPERIMENT, 2), part(EXPERIMENT, 3), part(DAY, 1), *(_number(part(FILE, i)) for i in (1, 2, 5, 6)))
    words = F.concat_ws("|", part(DAY, 2), part(FILE, 3), part(FILE, 4), F.regexp_replace(part(EXPERIMENT, 1), "_", " "))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), r"(_?\([0-9]+\)|_?(copy|kopie|bak)|~|\.(csv|txt|tmp|bak|gz))+$", ""), r"^_|_$", "")
    hashed = F.regexp_replace(F.regexp_replace(F.lower("file_hash"), r"^\s*md5\s*[:=]?", ""), "[^0-9a-f]", "")
    rows = files.filter("id IS NOT NULL AND coalesce(num_points, 1) <> 0").select(
        "id", F.col("ingest_batch").alias("batch"), _path(F.col("csv_path")).alias("path"), F.when((F.length(hashed) == 32) & (hashed != EMPTY_HASH), hashed).alias("hash")
    )
    other = F.concat(F.lit("#"), F.regexp_replace(stem, "[^0-9]+", "/"))
    return rows.select(
        "id", "batch", "hash",
        F.when(known, numbers).when(stem != "", other).alias("numbers"),
        F.when(known, words).when(stem != "", F.concat(F.lit("|||"), F.regexp_replace(stem, "[^a-z]+", " "))).alias("words"),
        F.when(known, F.datediff(F.try_to_date(part(DAY, 1), "yyyyMMdd"), F.lit("1990-01-01").cast("date"))).alias("day"),
    )


def pivoted(paths: DataFrame) -> DataFrame:
    """paths (numbers, words, day, ..) with head, name, place on the line and the distances d0, d1, .. to the pivots."""
    h = F.pmod(F.xxhash64("numbers"), F.lit(DAY_PLACES))
    dated = F.col("day").cast("long") * DAY_PLACES + h
    undated = -1 - F.pmod(F.xxhash64("numbers"), F.lit(UNDATED * SPAN_DAYS * DAY_PLACES))
    begin = UNDATED * SPAN_DAYS * DAY_PLACES
    place = (F.coalesce(dated, undated) + begin) * (RADIUS + 1)
    p = paths.select("*", F.substring_index("words", "|", 3).alias("head"), F.element_at(F.split("words", "[|]"), 4).alias("name"), place.alias("place"))
    far = lambda head, name: F.col("place") + APART + F.when(F.col("head") == head, 0).otherwise(APART) + F.levenshtein("name", F.lit(name))
    return p.select("*", *(far(*x).alias(f"d{i}") for i, x in enumerate(PIVOTS))).drop("day")


def _met(new: DataFrame, old: DataFrame, few: bool) -> DataFrame:
    """(u, v, same): rows of new and of old whose paths are within RADIUS; same: equal paths."""
    width = RADIUS + 1
    a = new.withColumn("range", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col("d0") / width) + i)))
    b = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns)).withColumn("range", F.floor(F.col("o_d0") / width))
    pairs = b.join(F.broadcast(a) if few else a, "range")
    for i in range(len(PIVOTS)):
        pairs = pairs.filter(F.abs(F.col(f"d{i}") - F.col(f"o_d{i}")) <= RADIUS)
    unlike = lambda c: F.when(F.col(c) == F.col(f"o_{c}"), 0).otherwise(APART)
    true = F.abs(F.col("place") - F.col("o_place")) + unlike("numbers") + unlike("head") + F.levenshtein("name", "o_name")
    return pairs.filter(true <= RADIUS).select(F.col("id").alias("u"), F.col("o_id").alias("v"), (F.col("words") == F.col("o_words")).alias("same"))


PATHS = "numbers string, words string, id int, head string, name string, place long, " + ", ".join(f"d{i} long" for i in range(len(PIVOTS)))
TABLES = {"paths": PATHS, "hashes": "hash string, id int", "roots": "node int, root int"}


class Store:
    """Tables paths, hashes and roots below one folder, each a set of loads that are only ever added; a store that is
    opened again at the same path goes on where it was left."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        if path is None:
            path = f"{shared_dir(spark)}/accepted-{uuid.uuid4().hex}"
            spark.sparkContext.__dict__.setdefault("_ohmgrid_written", []).append(path)
        self.path = path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.loads = {t: self._listed(t) for t in TABLES}
        self.pool = ThreadPoolExecutor(len(TABLES))  # the writes of a batch don't wait for each other

    def _listed(self, table: str) -> list[str]:
        """Names of the complete loads, `first-last`, without those that a merged one stands for."""
        folder = self._at(f"{self.path}/{table}")
        if not self._fs.exists(folder):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(folder) if self._fs.exists(self._at(f.getPath(), "_SUCCESS"))]
        ends: dict[int, int] = {}
        for name in found:
            first, last = map(int, name.split("-"))
            ends[first] = max(last, ends.get(first, -1))
        out, covered = [], -1
        for first, last in sorted(ends.items()):
            if first > covered:
                out.append(f"{first:06d}-{last:06d}")
                covered = last
        return out

    def read(self, table: str) -> DataFrame:
        paths = [f"{self.path}/{table}/{n}" for n in self.loads[table]]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def append(self, table: str, rows: DataFrame, few: bool = False) -> None:
        """few: the rows are known to fit one task."""
        own = self.loads[table]
        k = int(own[-1].split("-")[1]) + 1 if own else 0
        self._write(table, rows, k, k, few)
        own.append(f"{k:06d}-{k:06d}")
        small = [n for n in own if len(set(n.split("-"))) == 1]
        if len(small) >= MERGE:
            first, last = int(small[0].split("-")[0]), int(small[-1].split("-")[1])
            self._write(table, self.spark.read.schema(TABLES[table]).parquet(*(f"{self.path}/{table}/{n}" for n in small)), first, last)
            self.loads[table] = [n for n in own if n not in small] + [f"{first:06d}-{last:06d}"]

    def _write(self, table: str, rows: DataFrame, first: int, last: int, few: bool = False) -> None:
        order = {"paths": "d0", "hashes": "hash", "roots": "node"}[table]
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        rows = rows.select(*columns)
        rows = rows.coalesce(1) if few else rows.repartitionByRange(order)
        rows.sortWithinPartitions(order).write.mode("overwrite").parquet(f"{self.path}/{table}/{first:06d}-{last:06d}")

    def near(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The stored paths whose first distance lies in one of the ranges, each widened by RADIUS."""
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | F.col("d0").between(low - RADIUS, high + RADIUS)
        return self.read("paths").filter(hit)

    def repeats(self) -> DataFrame:
        """(id_a, id_b): every later row with the first row of its file."""
        return self.read("roots").groupBy("node").agg(F.min("root").alias("root")).select(F.col("root").alias("id_a"), F.col("node").alias("id_b"))


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of one task to (node, root), root being the least node of the component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    yield pd.DataFrame([(n, find(n)) for n in list(root)], columns=["node", "root"]).astype("int32")


def accept(rows: DataFrame, store: Store) -> None:
    """Hold the keyed rows of one batch against each other and the store, and append what is new."""
    paths = rows.filter("numbers IS NOT NULL").groupBy("numbers", "words").agg(F.min("id").alias("id"), F.first("day").alias("day"))
    own = materialize(pivoted(paths), "paths")
    spans = own.groupBy(F.floor(F.col("d0") / ((RADIUS + 1) * DAY_PLACES * SPAN_DAYS)).alias("span")).agg(F.min("d0").alias("low"), F.max("d0").alias("high"), F.count("*").alias("n")).collect()  # one row a span of days
    few = sum(r.n for r in spans) * 3 * 256 <= BROADCAST_BYTES
    hashes = rows.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id"))
    known = store.near([(r.low, r.high) for r in spans])
    dim = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    links = [
        _met(own, known, few).filter("u <> v"),
        _met(own, own, few).filter("u > v").withColumn("same", F.lit(False)),
        rows.join(dim(own.select("numbers", "words", F.col("id").alias("v"))), ["numbers", "words"]).filter("id <> v").select(F.col("id").alias("u"), "v", F.lit(None).cast("boolean").alias("same")),
        rows.join(hashes.select("hash", F.col("id").alias("v")), "hash").filter("id <> v").select(F.col("id").alias("u"), "v", F.lit(None).cast("boolean").alias("same")),
        store.read("hashes").select("hash", F.col("id").alias("v")).join(dim(hashes), "hash").select(F.col("id").alias("u"), "v", F.lit(None).cast("boolean").alias("same")),
    ]
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    every = materialize(every, "links")
    ids = every.select(F.col("v").alias("node")).unionByName(rows.select(F.col("id").alias("node"))).distinct()  # a row may arrive again
    known_roots = store.read("roots").join(dim(ids), "node", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    edges = every.select("u", "v").unionByName(known_roots)
    n = every.count()
    if n <= LOCAL_LINKS and few:
        found = edges.coalesce(1).mapInPandas(_unite, "node int, root int")
    else:
        found = components(edges).select(F.col("node").cast("int"), F.col("root").cast("int"))
    found = materialize(found.filter("node <> root"), "roots")
    fallen = store.read("roots").withColumnRenamed("root", "old").join(dim(found.select(F.col("node").alias("old"), "root")), "old").select("node", "root")
    new_roots = found.unionByName(fallen).join(dim(known_roots.select(F.col("u").alias("node"), F.col("v").alias("root"))), ["node", "root"], "left_anti")
    fresh = own.join(dim(every.filter("same").select(F.col("u").alias("id"))), "id", "left_anti")
    fresh_hashes = hashes.join(dim(store.read("hashes").join(dim(hashes.select("hash")), "hash", "left_semi").select("hash")), "hash", "left_anti")
    for done in [store.pool.submit(store.append, t, x, few) for t, x in (("roots", new_roots), ("paths", fresh), ("hashes", fresh_hashes))]:
        done.result()


def arrivals(files: DataFrame, loads: int | None = None) -> Iterator[DataFrame]:
    """The keyed rows of one ingest batch after another, rows without batch first; loads: of that many runs of
    consecutive batches instead, where there are more batches."""
    rows = materialize(keyed(files).withColumn("batch", F.coalesce("batch", F.lit(-1))).repartitionByRange("batch", "id").sortWithinPartitions("batch"), "keyed")
    batches = [b for (b,) in rows.select("batch").distinct().orderBy("batch").collect()]  # numbers of batches
    n = min(loads or len(batches), len(batches))
    for i in range(n):
        own = batches[i * len(batches) // n : (i + 1) * len(batches) // n]
        yield rows.filter(F.col("batch").between(own[0], own[-1]))


def accept_all(files: DataFrame, path: str | None = None, loads: int | None = None) -> Store:
    """A store that has taken every ingest batch of files, each (or each load) held against all earlier ones."""
    store = Store(files.sparkSession, path)
    for rows in arrivals(files, loads):
        accept(rows, store)
    return store
