"""Planning over file metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mvmap.operators import ranges

#: Fixed values of the level shape.
L0_TRIGGER, L0_STOP, LEVELS, TARGET_FILE = 4, 12, 7, 2 << 20
GRANDPARENT_CAP, EXPANSION_CAP = 10 * TARGET_FILE, 25 * TARGET_FILE
MAX_FLUSH_LEVEL = 2


def max_bytes(level: Column) -> Column:
    return F.lit(10.0 * (1 << 20)) * F.pow(F.lit(10.0), level - 1)


def statistics(entries: DataFrame, by: list[str], key: str, size: Column) -> DataFrame:
    return entries.groupBy(*by).agg(F.min(key).alias("smallest_key"), F.max(key).alias("largest_key"), F.count("*").alias("n_entries"), F.sum(size).cast("bigint").alias("file_size"))


def find_file(probes: DataFrame, files: DataFrame, probe: str) -> DataFrame:
    """Of disjoint sorted files, the first whose largest key is at or past the
    distinct probe; null past the end."""
    at = ranges.nearest(probes, files, probe, "largest_key").select(probe, F.col("ge").alias("largest_key"))
    return at.join(files.select("largest_key", "file_no"), "largest_key", "left").select(probe, "file_no")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of files whose closed key ranges meet."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in ("file_no", "smallest_key", "largest_key")])
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in ("file_no", "smallest_key", "largest_key", "file_size")])
    return ranges.meeting(x, y, "a_smallest_key", "a_largest_key", "b_smallest_key", "b_largest_key")


def starts(*levels: DataFrame) -> list:
    """Cut points of the ordered cells for files of all these levels."""
    keys = levels[0].select("smallest_key")
    for f in levels[1:]:
        keys = keys.union(f.select("smallest_key"))
    return ranges.cuts(keys, "smallest_key")


def met(a: DataFrame, b: DataFrame, points: list | None = None) -> DataFrame:
    """a's files with ``n``, ``bytes``, ``lo`` and ``hi``: number, bytes and span of b's
    files whose closed key ranges meet theirs. No pair is made: of the files that start at
    or before a file's end, those that end before its start do not meet it."""
    points = starts(a, b) if points is None else points
    b = b.filter("smallest_key <= largest_key")
    one, size = (F.sum, F.lit(1)), (F.sum, F.col("file_size"))
    out = ranges.sides(a, "largest_key", b, "smallest_key", points, True, {"_n": one, "_bytes": size, "hi": (F.max, F.col("largest_key"))})
    out = ranges.sides(out, "smallest_key", b, "largest_key", points, False, {"_n_gone": one, "_bytes_gone": size}, {"lo": (F.min, F.col("smallest_key"))})
    some = (F.col("smallest_key") <= F.col("largest_key")) & (F.col("_n") > F.col("_n_gone"))
    of = lambda x, none: F.when(some, x).otherwise(F.lit(none))
    n, size = of(F.col("_n") - F.col("_n_gone"), 0), of(F.col("_bytes") - F.col("_bytes_gone"), 0)
    return out.select(*a.columns, n.alias("n"), size.alias("bytes"), of(F.col("lo"), None).alias("lo"), of(F.col("hi"), None).alias("hi"))


def islands(files: DataFrame) -> DataFrame:
    """Transitive overlap clusters of one level, numbered from 0."""
    order = ["smallest_key", "file_no"]
    points = ranges.cuts(files, order[0])
    seen = ranges.running(files, order, F.col("largest_key"), F.max, "_seen", points)
    new = seen.withColumn("_new", F.when(F.col("smallest_key") <= F.col("_seen"), 0).otherwise(1)).drop("_seen")
    out = ranges.running(new, order, F.col("_new"), F.sum, "_ahead", points)
    return out.withColumn("cluster", F.coalesce("_ahead", F.lit(0)) + F.col("_new") - 1).drop("_new", "_ahead")


def scores(levels: DataFrame) -> DataFrame:
    """level, n_files, n_bytes -> score; at 1 or more a level wants compaction."""
    return levels.withColumn("score", F.when(F.col("level") == 0, F.col("n_files") / L0_TRIGGER).otherwise(F.col("n_bytes") / max_bytes(F.col("level"))))


def pick(files: DataFrame, pointer) -> DataFrame:
    """The first file past the compaction pointer, from the start if none is."""
    return files.orderBy((F.col("largest_key") <= pointer).cast("int"), "smallest_key").limit(1)


def flush_level(flushed: DataFrame, below: DataFrame) -> DataFrame:
    """file_no, flush_level: where a flushed file goes. It sinks a level while the next
    one holds none of its keys and the one after that at most GRANDPARENT_CAP bytes of
    files that meet it, to MAX_FLUSH_LEVEL at most."""
    points = starts(flushed, below)
    out = flushed.select("file_no", "smallest_key", "largest_key")
    for n in range(1, MAX_FLUSH_LEVEL + 1):
        out = met(out, below.filter(F.col("level") == n), points).select(*out.columns, F.col("n").alias(f"_n{n}"), F.col("bytes").alias(f"_bytes{n}"))
    level = F.lit(MAX_FLUSH_LEVEL)
    for n in reversed(range(MAX_FLUSH_LEVEL)):
        heavy = F.col(f"_bytes{n + 2}") > GRANDPARENT_CAP if n + 2 <= MAX_FLUSH_LEVEL else F.lit(False)
        level = F.when((F.col(f"_n{n + 1}") > 0) | heavy, n).otherwise(level)
    return out.select("file_no", level.alias("flush_level"))


def running_bucket(rows: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Output number by running bytes before each row of the total order."""
    out = ranges.running(rows, order, F.col(size), F.sum, "_ahead")
    return out.withColumn("bucket", F.floor(F.coalesce("_ahead", F.lit(0)) / limit).cast("bigint")).drop("_ahead")


def offset_of(keys: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Approximate bytes before each distinct key in disjoint sorted files: all files
    below it and a proportional share of the file that holds it."""
    points = ranges.cuts(files, "smallest_key")
    ahead = ranges.running(files, ["smallest_key"], F.col("file_size"), F.sum, "_ahead", points)
    at = ranges.nearest(keys, files, key, "smallest_key", points).select(key, F.col("le").alias("smallest_key"))
    held = at.join(ahead.select("smallest_key", "largest_key", "file_size", "_ahead"), "smallest_key", "left")
    span = F.col("largest_key") - F.col("smallest_key") + 1
    inside = F.floor(F.col("file_size") * (F.col(key) - F.col("smallest_key")) / span)
    part = F.when(F.col("largest_key") <= F.col(key), F.col("file_size")).otherwise(inside)
    return held.select(key, F.coalesce(F.coalesce("_ahead", F.lit(0)) + part, F.lit(0)).cast("bigint").alias("bytes_before"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """Files live after a run of edits: the last action on (level, file_no) wins."""
    w = Window.partitionBy("level", "file_no").orderBy(F.col("edit_no").desc())
    return edits.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1 and action = 'add'").drop("_rank")


def disjointness(files: DataFrame) -> DataFrame:
    """Files of a level that start at or before the end of their predecessor."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_no")
    return files.withColumn("prev_largest", F.lag("largest_key").over(w)).filter("prev_largest >= smallest_key")


def obsolete(listing: DataFrame, live: DataFrame) -> DataFrame:
    return listing.join(live, "file_no", "left_anti")


def levels(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").cast("bigint").alias("n_bytes"))


def compaction_inputs(level: DataFrame, below: DataFrame) -> DataFrame:
    """For each file of a disjoint level as the seed of a compaction: its inputs once the
    next level's files that meet it are known. More files of the seed's own level join
    where that brings in none of the next level's and all together stay below
    EXPANSION_CAP. file_no, n_inputs, n_below, input_bytes, below_bytes."""
    points = starts(level, below)

    def reach(found, n, size):
        """The files, as wide as what they met, with its number and bytes under these names."""
        kept = [c for c in found.columns if c not in ("smallest_key", "largest_key", "n", "bytes", "lo", "hi")]
        return found.select(*kept, F.least("smallest_key", "lo").alias("smallest_key"), F.greatest("largest_key", "hi").alias("largest_key"), F.col("n").alias(n), F.col("bytes").alias(size))

    first = reach(met(level.select("file_no", "file_size", "smallest_key", "largest_key"), below, points), "n_below", "below_bytes")
    wider = reach(met(first, level, points), "n_wider", "wider_bytes").filter("n_wider > 0")
    both = met(wider, below, points).withColumnRenamed("n", "n_again")
    grows = (F.col("n_below") > 0) & (F.col("n_wider") > 1) & (F.col("n_again") == F.col("n_below")) & (F.col("wider_bytes") + F.col("below_bytes") < EXPANSION_CAP)
    return both.select(
        "file_no",
        F.when(grows, F.col("n_wider")).otherwise(1).cast("bigint").alias("n_inputs"),
        F.col("n_below").cast("bigint").alias("n_below"),
        F.when(grows, F.col("wider_bytes")).otherwise(F.col("file_size")).cast("bigint").alias("input_bytes"),
        F.col("below_bytes").cast("bigint").alias("below_bytes"),
    )


def trivial_moves(level: DataFrame, below: DataFrame, deeper: DataFrame) -> DataFrame:
    """file_no of the files that can move down as they are: nothing of the next level
    meets them, and at most GRANDPARENT_CAP bytes of the one after."""
    points = starts(level, below, deeper)
    free = met(level.select("file_no", "smallest_key", "largest_key"), below, points).filter("n = 0").select("file_no", "smallest_key", "largest_key")
    return met(free, deeper, points).filter(F.col("bytes") <= GRANDPARENT_CAP).select("file_no")


def range_inputs(files: DataFrame, begin, end) -> DataFrame:
    """Level-0 files of a manual compaction of [begin, end]: those that meet it, and all
    that hang together with them by overlaps."""
    found = islands(files)
    hit = found.groupBy("cluster").agg(F.min("smallest_key").alias("_lo"), F.max("largest_key").alias("_hi"))
    # Within a cluster every key between its ends is covered by some file.
    hit = hit.filter((F.col("_lo") <= end) & (F.col("_hi") >= begin)).select("cluster")
    return found.join(hit, "cluster", "left_semi").drop("cluster")


def best_level(levels: DataFrame) -> DataFrame:
    """level, score of the level that wants compaction most, the upper one of equals."""
    return scores(levels).orderBy(F.col("score").desc(), "level").limit(1).select("level", "score")


def live_files(edits: DataFrame, versions: list[int]) -> DataFrame:
    """file_no of the files that any of the versions (numbers of their last edits) holds."""
    every = F.explode(F.array(*[F.lit(v) for v in versions]))
    seen = edits.withColumn("version", every).filter(F.col("edit_no") <= F.col("version"))
    w = Window.partitionBy("version", "level", "file_no").orderBy(F.col("edit_no").desc())
    return seen.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1 and action = 'add'").select("file_no").distinct()
