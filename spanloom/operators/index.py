"""Incremental index upkeep: snapshot difference, reuse by content, replacement, garbage collection.

Tables are snapshots; each function returns the next one. Joins are on content hashes or
paths, which are spread evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.shared import written

STATUSES = ("unchanged", "touched", "binary", "empty", "error", "changed", "added", "removed")


def snapshot_diff(current: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Each path of either side with a status.

    ``current``: path, size, mtime, hash, and optionally readable, binary, blank. ``known``:
    path, size, mtime, hash. Equal size and time are unchanged without a look at the hash; an
    unreadable file keeps what is known of it.
    """
    now = current.select(key, F.lit(True).alias("_now"), *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "hash")), *(F.col(c).alias(f"_{c}") if c in current.columns else F.lit(v).alias(f"_{c}") for c, v in (("readable", True), ("binary", False), ("blank", False))))
    then = known.select(key, F.lit(True).alias("_known"), "size", "mtime", "hash")
    known_, now_ = F.col("_known").isNotNull(), F.col("_now").isNotNull()
    status = (
        F.when(~now_, "removed")
        .when(~F.col("_readable"), "error")
        .when(known_ & (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime")), "unchanged")
        .when(F.col("_binary"), "binary")
        .when(known_ & (F.col("_hash") == F.col("hash")), "touched")
        .when(F.col("_blank"), "empty")
        .when(known_, "changed")
        .otherwise("added")
    )
    return now.join(then, key, "full_outer").select(key, status.alias("status"), F.coalesce("_hash", "hash").alias("hash"), known_.alias("was_known"))


def report(diff: DataFrame) -> DataFrame:
    """One row of counts; a binary file counts as removed if it was known."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias(s[0])
    removed = F.count_if((F.col("status") == "removed") | ((F.col("status") == "binary") & F.col("was_known"))).alias("removed")
    return diff.agg(n("added"), n("changed"), n("touched"), n("unchanged"), n("empty").alias("skipped"), n("error"), removed)


def restored(diff: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """Rows to be indexed, with whether the cache holds their content; only the others need a model."""
    due = diff.where(F.col("status").isin("added", "changed"))
    held = cache.select(F.col("content_hash").alias("hash")).distinct().withColumn("restored", F.lit(True))
    return due.join(held, "hash", "left").select(key, "status", "hash", F.coalesce("restored", F.lit(False)).alias("restored"))


def replace_files(chunks: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Chunks with those of the files in ``new`` put in place of the old."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(chunks.columns))


def touch_files(files: DataFrame, touched: DataFrame, key: str = "path") -> DataFrame:
    """Files with new size and mtime where ``touched`` has them."""
    new = touched.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = files.join(new, key, "left")
    return joined.withColumns({"size": F.coalesce("_size", "size"), "mtime": F.coalesce("_mtime", "mtime")}).select(files.columns)


def forget(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    return cache.join(hashes.select(F.col("hash").alias("content_hash")).distinct(), "content_hash", "left_anti")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both; of equal (content_hash, seq) the older content with the newest last_used."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.select(cache.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in cache.columns if c not in ("content_hash", "seq", "last_used")]
    merged = both.groupBy("content_hash", "seq").agg(F.max("last_used").alias("last_used"), F.min_by(F.struct(*rest), "_new").alias("r"))
    return merged.select("content_hash", "seq", "last_used", "r.*").select(cache.columns)


def versions(cache: DataFrame) -> DataFrame:
    return cache.groupBy("content_hash").agg(F.max("last_used").alias("last_used"), F.count("*").alias("chunks"))


def running_total(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds a running sum over all rows in ``order``: sums inside sorted ranges, and of the ranges before.

    Each row is written once with the number of its range. Bounds of ranges come from a sample, so
    a second plan over the same rows may draw others; the stored numbers fit each other.
    """
    stored = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = stored.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = stored.withColumn("_inside", F.sum(value).over(inside))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def gc_age(cache: DataFrame, now, days: float = 45) -> DataFrame:
    """Content that stays: used within ``days`` before ``now`` (seconds)."""
    return versions(cache).where(F.col("last_used") >= now - days * 86400)


def gc_surplus(cache: DataFrame, most: int = 20_000) -> DataFrame:
    """Content that stays: the ``most`` versions used last; of equals the larger hashes."""
    return versions(cache).orderBy(F.col("last_used").desc(), F.col("content_hash").desc()).limit(most)


def gc_dead(cache: DataFrame, live: DataFrame, ratio: float = 1.0, least: int = 2000) -> DataFrame:
    """Content that stays: what is live, and if dead chunks exceed max(least, live chunks x ratio), the dead used last up to half of that."""
    every = versions(cache)
    used = live.select(F.col("hash").alias("content_hash")).distinct()
    alive, dead = every.join(used, "content_hash", "left_semi"), every.join(used, "content_hash", "left_anti")
    totals = alive.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n")).crossJoin(dead.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("d")))
    limit = totals.select(F.greatest(F.lit(float(least)), F.col("n") * ratio).alias("limit"), "d")
    placed = running_total(dead, [F.col("last_used").desc(), F.col("content_hash")], "chunks", "_total")
    stay = placed.crossJoin(F.broadcast(limit)).where((F.col("d") <= F.col("limit")) | (F.col("_total") <= F.col("limit") / 2))
    return alive.unionByName(stay.select(alive.columns))


def collect_garbage(cache: DataFrame, live: DataFrame, now, days: float = 45, most: int = 20_000, ratio: float = 1.0, least: int = 2000) -> DataFrame:
    """Age, then surplus, then dead content."""
    for stay in (lambda c: gc_age(c, now, days), lambda c: gc_surplus(c, most), lambda c: gc_dead(c, live, ratio, least)):
        cache = cache.join(stay(cache).select("content_hash"), "content_hash", "left_semi")
    return cache


def stats(chunks: DataFrame, key: str = "path") -> DataFrame:
    """Files and chunks of an index."""
    return chunks.agg(F.countDistinct(key).alias("files"), F.count("*").alias("chunks"))


def last_sync(logs: DataFrame, key: str = "index", most: int = 200) -> DataFrame:
    """at, report and error of the newest log (at, text) of each index: a log in JSON is a report, of another the end of its last line that is not blank counts, ``empty log`` where there is none."""
    newest = logs.groupBy(key).agg(F.max_by(F.struct("at", F.coalesce("text", F.lit("")).alias("text")), F.struct("at", "text")).alias("l")).select(key, "l.*")
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    end = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("empty log"))
    good = F.try_parse_json("text").isNotNull()
    error = F.substring(end, F.greatest(F.length(end) - most + 1, F.lit(1)), F.lit(most))
    return newest.select(key, "at", F.when(good, F.col("text")).alias("report"), F.when(~good, error).alias("error"))


def status(chunks: DataFrame, disabled: DataFrame, holders: DataFrame, logs: DataFrame, key: str = "index", path: str = "path") -> DataFrame:
    """One row for each index of ``chunks``: files and chunks, whether it syncs by itself, who is syncing it now (null: nobody), and its last sync.

    ``disabled``: the indexes that are switched off. ``holders``: index and holder of a lock, the smallest of several.
    """
    counts = chunks.groupBy(key).agg(F.countDistinct(path).alias("files"), F.count("*").alias("chunks"))
    off = disabled.select(key).distinct().withColumn("_off", F.lit(True))
    held = holders.groupBy(key).agg(F.min("holder").alias("holder"))
    joined = counts.join(off, key, "left").join(held, key, "left").join(last_sync(logs, key), key, "left")
    return joined.select(key, "files", "chunks", F.when(F.col("_off"), "disabled").otherwise("ok").alias("autosync"), "holder", "at", "report", "error")


def model_mismatch(stamp: DataFrame, model: str, engine: str) -> str | None:
    """What keeps an index from being written by ``model``: its ``stamp`` (model, engine; no row: new) names another one."""
    other = stamp.where(~(F.col("model").eqNullSafe(F.lit(model)) & F.col("engine").eqNullSafe(F.lit(engine)))).select("model", "engine").first()
    return other and f"index of {other.model} ({other.engine}), now {model} ({engine})"


def reset(tables: dict[str, DataFrame], cache: DataFrame, mismatch: str | None, force: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables and the cache that a sync starts from.

    Without ``force`` all stay, and a mismatch is an error. With it the tables are emptied; the cache goes only with
    a mismatch, since its vectors are then of another model. Otherwise all content comes back from the cache.
    """
    if mismatch and not force:
        raise ValueError(mismatch)
    if not force:
        return tables, cache
    return {name: t.limit(0) for name, t in tables.items()}, cache.limit(0) if mismatch else cache
