"""Segments out of frames: runs, groups, dimension lookups, frame sampling, indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments_runs(frames: DataFrame, tasks: DataFrame, least: int = 10) -> DataFrame:
    """Runs of one ``task_index`` in the frame order of an episode: ``(episode, task_index, task, frame_start, frame_end)``.

    A run shorter than ``least`` by its frame numbers, or without a named task, is left out. Gaps in
    the frame numbers do not end a run.
    """
    order = Window.partitionBy("episode").orderBy("frame_index")
    changed = F.coalesce((F.col("task_index") != F.lag("task_index").over(order)).cast("int"), F.lit(1))
    runs = frames.withColumn("run", F.sum(changed).over(order)).groupBy("episode", "run", "task_index")
    runs = runs.agg(F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"))
    runs = runs.where(F.col("frame_end") - F.col("frame_start") + 1 >= least)
    return runs.join(tasks.where("task <> ''"), "task_index").select("episode", "task_index", "task", "frame_start", "frame_end")


def segments_grouped(meta: DataFrame, images: DataFrame, cameras: tuple[str, ...] = ("cam_high",)) -> DataFrame:
    """Frames of one (source, episode, task_index), whether or not they adjoin.

    ``meta``: ``(source, episode, frame, task_index, task, pos)``; ``images``: ``(source, episode,
    frame, camera)``. Rows without episode or frame are skipped; the last task that is not empty
    names the group; frames without an image of the cameras don't count.
    """
    usable = meta.where(F.col("episode").isNotNull() & F.col("frame").isNotNull())
    seen = images.where(F.col("camera").isin(*cameras)).select("source", "episode", "frame").distinct()
    named = F.max(F.when(F.col("task") != "", F.struct("pos", "task")))
    groups = usable.groupBy("source", "episode", "task_index").agg(named.alias("named"))
    frames = usable.join(seen, ["source", "episode", "frame"]).groupBy("source", "episode", "task_index").agg(F.sort_array(F.collect_set("frame")).alias("frame_indices"))
    return groups.join(frames, ["source", "episode", "task_index"]).select("source", "episode", "task_index", F.coalesce("named.task", F.lit("")).alias("task"), "frame_indices")


def last_wins(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """One row for each key: the value at its last position."""
    return rows.groupBy(key).agg(F.max(F.struct(position, value)).alias("last")).select(key, F.col(f"last.{value}").alias(value))


def sample_frames(start: Column, end: Column, n: int = 10) -> Column:
    """All frame numbers if there are at most ``n``, else ``n`` evenly spread ones, ends included."""
    total = end - start + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + F.floor(i * (total - 1) / (n - 1))).cast("long"))
    return F.when(total <= n, F.sequence(start, end)).otherwise(spread)


def pick9(frames: Column) -> Column:
    """Nine of the frames: evenly spread if there are ten or more, else the first nine."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(frames, F.floor(i * (F.size(frames) - 1) / 8).cast("int")))
    return F.when(F.size(frames) >= 10, spread).otherwise(F.slice(frames, 1, 9))


def inverted_index(segments: DataFrame, key: str, *fields: str) -> DataFrame:
    return segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("segments"))


def evictable(files: DataFrame, limit: int) -> DataFrame:
    """Files that have to go so that the newest ones stay within ``limit`` bytes: ``(path, size, mtime)``, and the bytes ``held`` up to each."""
    return running(files, F.col("size"), "held", -F.col("mtime"), "path").where(F.col("held") > limit)


def with_tar(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments with what the tars hold of them, by episode and task index; those of which nothing is there are left out."""
    return segments.join(found, ["episode", "task_index"])


def first_chunk(videos: DataFrame, *keys: str) -> DataFrame:
    """``(keys, video)``: the first file, by path, of those that are there for each of ``keys``."""
    return videos.groupBy(*keys).agg(F.min("path").alias("video"))


def datasets_of(pairs: DataFrame, default_a: str, default_b: str) -> DataFrame:
    """The different data sets of the pairs' sides ``dataset_a`` and ``dataset_b``; a side that names none has the default."""
    names = F.array(F.coalesce("dataset_a", F.lit(default_a)), F.coalesce("dataset_b", F.lit(default_b)))
    return pairs.select(F.explode(names).alias("dataset")).distinct()


def by_task(segments: DataFrame, task: Column | str, most: int) -> DataFrame:
    """Rows whose task is the given one but for case and outer blanks, at most ``most``, in order of ``idx``."""
    task = F.lit(task) if isinstance(task, str) else task
    return segments.where(F.lower(F.trim("task")) == F.lower(F.trim(task))).orderBy("idx").limit(most)


def one_per_task(segments: DataFrame, seed: int = 42) -> DataFrame:
    """One segment of each task, by least seeded hash."""
    order = Window.partitionBy("task").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("idx").cast("string"))), "idx")
    return segments.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def hash_sample(rows: DataFrame, n: int, key: str = "idx", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for one seed however the rows are partitioned."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def running(rows: DataFrame, value: Column, name: str, key: Column, *ties: str, block: int = 65_536, most_ranges: int = 1000) -> DataFrame:
    """``rows`` with the running sum ``name`` of ``value`` in the order of ``key`` (numbers, none null), then ``ties``.

    Keys are cut at their quantiles to ranges of about ``block`` rows, ``most_ranges`` at most. Only the
    ranges' sums are added up in one place; rows are summed within their range. Rows of one key are
    in one range.
    """
    # ranges go by doubles, which may be alike for different keys; rows within them by the keys
    keyed = rows.withColumns({"running_order": key, "running_key": key.cast("double")})
    n = keyed.count()
    ranges = min(most_ranges, -(-n // block))
    cuts = []
    if ranges > 1:
        cuts = sorted(set(keyed.agg(F.percentile_approx("running_key", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]))
    number = _range_number(cuts)(F.col("running_key")) if cuts else F.lit(0)
    dealt = keyed.withColumn("running_range", number)
    before = Window.orderBy("running_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("running_range").agg(F.sum(value).alias("running_sum"))
    starts = sums.select("running_range", F.coalesce(F.sum("running_sum").over(before), F.lit(0)).alias("running_start"))
    own = F.sum(value).over(Window.partitionBy("running_range").orderBy("running_order", *ties).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(starts), "running_range").withColumn(name, F.col("running_start") + own).drop("running_order", "running_key", "running_range", "running_start")


def _range_number(cuts: list[float]):
    """How many of the sorted cuts are below a key, by binary search; NaN is above all, as Spark orders it."""
    bounds = np.array(cuts)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(float)).astype(np.int32))

    return number


def numbered(rows: DataFrame, key: Column | str = "idx", name: str = "pos", *ties: str, block: int = 65_536) -> DataFrame:
    """Rows numbered from 0 in the order of ``key`` (numbers, none null), then ``ties``, which together tell all rows apart."""
    key = F.col(key) if isinstance(key, str) else key
    return running(rows, F.lit(1).cast("long"), name, key, *ties, block=block).withColumn(name, F.col(name) - 1)


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2**48 out of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(x.cast("string") for x in parts))), 1, 12), 16, 10).cast("long")


def shuffled(rows: DataFrame, key: str = "idx", seed: int = 42) -> DataFrame:
    """All rows in a seeded order, the same however they are partitioned."""
    return rows.orderBy(seeded(seed, F.col(key)), key)


def drawn_with_replacement(rows: DataFrame, n: int, key: str = "idx", seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, numbered by ``draw`` from 0. No rows: no draws."""
    size = rows.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (seeded(seed, F.col("id")) % max(1, size)).alias("drawn"))
    return numbered(rows, key, "drawn").join(draws, "drawn").drop("drawn")
