"""Harvest planning: which catalogue assets are missing on disk, how they group, batches.

Assets are ``(scene_id, asset_key, url)`` rows, files are ``(path, length)``
rows relative to the storage root. Folder-level questions (what exists under
a folder, cumulative sizes) explode each file into its ancestor folders and
use equi-joins/aggregations on the folder key, never pairwise comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from .ranking import consecutive_index


ROWS_A_PART = 500_000  # rows that a task sorts


def asset_parts(assets: DataFrame) -> DataFrame:
    """Relative path (host and query removed), folder and file name of each asset URL."""
    rel = text.url_path("url")
    return assets.withColumns({"rel_path": rel, "dir": text.dirname(rel), "fname": text.basename(rel)})


def assets_by_folder(assets: DataFrame) -> DataFrame:
    """Assets keyed by folder, one ``(dir, url)`` row each, clustered by folder.

    The folder -> URLs mapping stays a keyed table rather than one list per
    folder, so a folder holding a large share of all assets is never
    gathered into a single value. There are as many parts as hold ``ROWS_A_PART`` rows each
    (a count of the assets first), so what a task sorts does not grow with the table.
    """
    parts = max(assets.sparkSession.sparkContext.defaultParallelism, assets.count() // ROWS_A_PART + 1)
    return asset_parts(assets).select("dir", "url").repartition(parts, "dir").sortWithinPartitions("dir", "url")


def folder_summary(assets: DataFrame) -> DataFrame:
    """A11 summary: assets per folder with the first and last URL (partial aggregates)."""
    return asset_parts(assets).groupBy("dir").agg(F.count(F.lit(1)).alias("n_assets"),
                                                  F.min("url").alias("first_url"), F.max("url").alias("last_url"))


def file_ancestors(files: DataFrame, path: str = "path") -> DataFrame:
    """Every (ancestor folder, file) pair: one row per folder level of each file."""
    depth = F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))
    anc = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
                      lambda i: F.call_function("substring_index", F.col(path), F.lit("/"), i))
    return files.select("*", F.explode(F.when(depth > 0, anc).otherwise(F.array())).alias("folder"))


def missing_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets with no file of the same name anywhere under the asset's folder.

    An anti equi-join on (folder, file name) against every ancestor folder of
    every file; ``missing_by_substring`` has the containment rule.
    """
    a = asset_parts(assets)
    # Only ancestors at a depth where some asset folder sits can match: the set
    # of asset-folder depths (at most the path depth) is a scalar subquery.
    depth = F.size(F.split(F.col("dir"), "/"))
    depths = a.agg(F.collect_set(depth)).scalar()
    anc = file_ancestors(files.select("path"))
    have = (anc.filter(F.array_contains(depths, F.size(F.split(F.col("folder"), "/"))))
               .select(F.col("folder").alias("dir"), text.basename("path").alias("fname")))
    return a.join(have, ["dir", "fname"], "left_anti")


GRAM = 5  # characters of a posting-list key
FOLDER_PAIRS = 64  # comparisons of a row in a folder that is compared as a whole
FOLDER_ROWS = 100_000  # rows of such a folder, names and paths together


def _grams(name, size: int, step: int = 1):
    """Keys of the runs of ``size`` characters of a name in its folder: of every run, or of
    one every ``step`` characters and the last."""
    last = F.length(name) - size + 1
    at = F.array_distinct(F.concat(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step)), F.array(F.greatest(last, F.lit(1)))))
    return F.when(last >= 1, F.array_distinct(F.transform(at, lambda i: F.xxhash64("dir", F.substring(name, i, F.lit(size))))))


def missing_by_substring(assets: DataFrame, files: DataFrame, gram: int = GRAM, pairs: int = FOLDER_PAIRS,
                         rows: int = FOLDER_ROWS) -> DataFrame:
    """J4, the containment rule: assets whose file name is contained in the path of no file
    anywhere under the asset's folder.

    An anti-join on the folder that compares each name with the paths below it, where that
    is at most ``pairs`` comparisons a row and the folder has at most ``rows`` rows. Folders
    with more of both, if any, are looked up by posting lists (``_missing_in_crowded``).
    """
    a = asset_parts(assets)
    # Only ancestors at a depth where some asset folder sits can match.
    level = F.size(F.split(F.col("dir"), "/"))
    depths = a.agg(F.collect_set(level)).scalar()
    below = (file_ancestors(files.select("path")).select(F.col("folder").alias("dir"), "path").filter(F.array_contains(depths, level))
             .select("dir", F.substring("path", F.length("dir") + 2, F.length("path")).alias("rest")))
    n, m = F.col("_names"), F.col("_paths")
    crowded = cut_lineage(a.groupBy("dir").agg(F.count(F.lit(1)).alias("_names"))
                          .join(below.groupBy("dir").agg(F.count(F.lit(1)).alias("_paths")).hint("merge"), "dir")
                          .filter((n * m > F.lit(pairs) * (n + m)) | (n + m > rows)).select("dir"))
    columns = ["dir", "fname", *[c for c in a.columns if c not in ("dir", "fname")]]
    some = not crowded.isEmpty()
    few = a.join(crowded, "dir", "left_anti") if some else a
    here, there = few.alias("a"), below.hint("merge").alias("f")
    name = F.col("a.fname")
    found = (F.col("a.dir") == F.col("f.dir")) & (F.col("f.rest").contains(name) | F.col("a.dir").contains(name))
    missing = here.join(there, found, "left_anti").select(*columns)
    if some:
        missing = missing.unionByName(_missing_in_crowded(a.join(crowded, "dir", "left_semi"), below.join(crowded, "dir", "left_semi"),
                                                          gram).select(*columns))
    return missing


def _missing_in_crowded(a: DataFrame, below: DataFrame, gram: int) -> DataFrame:
    """The containment rule where a folder has many names and many paths below it.

    A file name holds no slash, so it lies inside one part of a path: in a part of the
    folder itself (then any file there will do), or in a part below it. The different
    parts below each folder are indexed by posting lists: their runs of ``gram``
    characters, by hash. A name that is no whole part is looked up by the rarest of its runs
    in that folder only (one run every ``gram`` characters is tried); a name with a run that
    has no posting is missing, and what shares the rarest run is compared.
    Names shorter than a run are looked up whole, in an index of runs of their own size.
    """
    wanted = cut_lineage(a.select("dir", "fname").distinct())
    parts = cut_lineage(below.select("dir", F.explode(F.split("rest", "/")).alias("part")).distinct())  # read for every look-up below
    name = F.col("fname")
    there = (wanted.filter((name == "") | F.col("dir").contains(name))
             .join(parts.select("dir").distinct(), "dir", "left_semi"))
    open_ = wanted.filter((name != "") & ~F.col("dir").contains(name))
    same = parts.withColumnRenamed("part", "fname")
    whole_part = open_.join(same, ["dir", "fname"], "left_semi")
    open_ = cut_lineage(open_.join(same, ["dir", "fname"], "left_anti"))

    # A folder without files needs no look-up.
    open_ = open_.join(parts.select("dir").distinct(), "dir", "left_semi")
    near = parts.join(open_.select("dir").distinct(), "dir", "left_semi")
    long = open_.filter(F.length(name) >= gram).withColumn("key", F.explode(_grams(name, gram, gram)))
    postings = near.withColumn("key", F.explode(_grams(F.col("part"), gram)))
    lengths = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = (long.join(lengths, "key", "left").groupBy("dir", "fname")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("_r")).filter("_r.n > 0")
              .select("dir", "fname", F.col("_r.key").alias("key")))
    found = rarest.join(postings, ["dir", "key"]).filter(F.col("part").contains(name)).select("dir", "fname")

    short = open_.filter(F.length(name) < gram).select("dir", "fname", F.xxhash64("dir", name).alias("key"))
    near_short = parts.join(short.select("dir").distinct(), "dir", "left_semi")
    keys = F.flatten(F.array_compact(F.array(*[_grams(F.col("part"), k) for k in range(1, gram)])))
    found_short = (short.join(near_short.select("dir", "part", F.explode(keys).alias("key")), ["dir", "key"])
                   .filter(F.col("part").contains(name)).select("dir", "fname"))
    have = there.unionByName(whole_part).unionByName(found).unionByName(found_short).distinct()
    return a.join(have, ["dir", "fname"], "left_anti")


def harvest_plan(assets: DataFrame, files: DataFrame, overwrite: bool = False, complete: bool = False,
                 dry_run: bool = False) -> DataFrame:
    """overwrite = every asset; complete = only missing ones; dry run = summary rows only."""
    if not (overwrite or complete or dry_run):
        raise ValueError("one of overwrite, complete or dry_run must be set")
    if dry_run:
        miss = missing_assets(assets, files)
        return miss.agg(F.count(F.lit(1)).alias("n_missing"),
                        F.count_distinct("dir").alias("n_folders"))
    if overwrite:
        return asset_parts(assets)
    return missing_assets(assets, files)


def _folder_signatures(assets: DataFrame, separator: str) -> DataFrame:
    path = text.unquote(F.try_parse_url(F.col("url"), F.lit("PATH")))
    parts = (assets.select(text.parent_name(path).alias("parent"),
                           text.after_last_match(text.basename(path), separator).alias("part"))
                   .groupBy("parent", "part").agg(F.count(F.lit(1)).alias("n")))
    # Per folder the sorted (part, multiplicity) pairs: bounded by the number of
    # distinct file kinds, however many files the folder holds. Expanded to the
    # part list with duplicates (e.g. [B4, B4, MTL]) only for display.
    per = parts.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("_pn"))
    return per.withColumn("sig", F.flatten(F.transform("_pn", lambda e: F.array_repeat(e["part"], e["n"].cast("int")))))


def signatures(assets: DataFrame, separator: str = text.TIER_SEPARATOR) -> DataFrame:
    """Per parent folder the sorted list of file-name ends (after the last tier
    tag); then folders counted per identical list (``folders_by_signature`` names them).

    The first level collects per folder (a scene's handful of files); the
    second only counts, so no list grows with the number of folders.
    """
    per = _folder_signatures(assets, separator)
    return per.groupBy("sig").agg(F.count(F.lit(1)).alias("n_folders"),
                                  F.min("parent").alias("first_folder"), F.max("parent").alias("last_folder"))


def folders_by_signature(assets: DataFrame, separator: str = text.TIER_SEPARATOR) -> DataFrame:
    """(sig, folder), a row per parent folder with the list of its file-name ends. The
    mapping stays a table, so a signature that most folders share is no long list."""
    return _folder_signatures(assets, separator).select("sig", F.col("parent").alias("folder"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Cumulative size and file count of every folder (each ancestor gets the sum)."""
    anc = file_ancestors(files.select("path", F.coalesce(F.col("length"), F.lit(0)).alias("length")))
    return anc.groupBy("folder").agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("n_files"))


def tree(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Folder and file nodes with depth, size (folders cumulative) and a
    truncation flag for folders at the depth limit that have children."""
    fs = folder_sizes(files).select(F.col("folder").alias("path"), "size", F.lit(True).alias("is_dir"))
    fl = files.select("path", F.coalesce(F.col("length"), F.lit(0)).alias("size"), F.lit(False).alias("is_dir"))
    nodes = fs.unionByName(fl).withColumn("depth", F.size(F.split("path", "/")) - 1)
    if max_depth is None:
        return nodes.withColumn("truncated", F.lit(False))
    return (nodes.filter(F.col("depth") <= max_depth)
                 .withColumn("truncated", F.col("is_dir") & (F.col("depth") == max_depth)))


def leaf_folders(files: DataFrame, pattern: str = "*") -> DataFrame:
    """Folders without sub-folders whose relative path matches a glob (``*`` spans '/')."""
    folders = file_ancestors(files.select("path")).select("folder").distinct()
    parents = folders.select(text.dirname("folder").alias("folder")).distinct()
    leaves = folders.join(parents, "folder", "left_anti")
    return leaves.filter(text.matches_glob("folder", pattern))


def representative_file(files: DataFrame) -> DataFrame:
    """Per folder the first TIFF by path, else the first other image, else an error."""
    ext = text.extension("path")
    d = files.select(text.dirname("path").alias("folder"), "path", ext.alias("ext"))
    g = d.groupBy("folder").agg(
        F.min(F.when(F.col("ext").isin("tif", "tiff"), F.col("path"))).alias("_tif"),
        F.min(F.when(F.col("ext").isin("jpg", "jpeg", "png", "jp2"), F.col("path"))).alias("_img"))
    rep = F.coalesce("_tif", "_img")
    return g.select("folder", rep.alias("file"),
                    F.when(rep.isNull(), F.lit("no image file")).alias("error"))


def band_files(files: DataFrame, band_suffixes: DataFrame, ext: str = ".TIF") -> DataFrame:
    """Per folder and band the first file (by path) whose name ends with the band's suffix.

    ``band_suffixes(band, suffix)`` is a fixed per-product table (a few
    rows), broadcast into the suffix test.
    """
    s = band_suffixes
    f = files.select(text.dirname("path").alias("folder"), "path")
    j = f.join(s, f["path"].endswith(F.concat(s["suffix"], F.lit(ext))))
    return j.groupBy("folder", "band").agg(F.min("path").alias("path"))


def batches(assets: DataFrame, group_size: int = 5) -> DataFrame:
    """Number the folders in path order and cut them into batches of ``group_size``
    folders (batches count folders, not files)."""
    folders = asset_parts(assets).select("dir").distinct()
    idx = consecutive_index(folders, ["dir"], "folder_idx")
    return idx.withColumn("batch", F.floor(F.col("folder_idx") / group_size).cast("long"))


def run_summary(outcomes: DataFrame, status: str = "status", error: str = "error", keys=()) -> DataFrame:
    """Totals, successes, failures and the distinct error messages (null when none).

    Messages are collected as a set: bounded by the number of distinct
    messages, not by the number of failures.
    """
    errs = F.sort_array(F.collect_set(F.col(error)))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(status) != "failed").alias("successful"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        F.when(F.size(errs) > 0, errs).alias("errors"))
