"""Queries of the engine by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mvmap.functions import keys
from mvmap.operators import access, compaction, files, visibility
from mvmap.sources import bindings as b
from mvmap.sources import wal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """loge AS (SELECT user_id AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events),
s AS (SELECT max(seq) // 2 AS s FROM loge),
newest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) AS rn FROM loge) WHERE rn = 1),
live AS (SELECT user_key, seq, value FROM newest WHERE op = 1),
old AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) AS rn FROM loge, s WHERE seq <= s) WHERE rn = 1),
oldlive AS (SELECT user_key, seq, value FROM old WHERE op = 1),
mapo AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders),
f0 AS (SELECT (seq - 1) // 1000 AS file_no, min(user_key) AS smallest_key, max(user_key) AS largest_key, count(*) AS n_entries,
  CAST(sum(CASE WHEN op = 1 THEN 24 ELSE 16 END) AS BIGINT) AS file_size, 0 AS level FROM loge GROUP BY 1),
f1 AS (SELECT k // 1000 AS file_no, min(k) AS smallest_key, max(k) AS largest_key, count(*) AS n_entries, CAST(24 * count(*) AS BIGINT) AS file_size, 1 AS level FROM mapo GROUP BY 1),
probes AS (SELECT DISTINCT c_custkey * 7 + 3 AS p FROM customer)"""

KEY = ["user_key"]


def query(name: str, sql: str, wrap: bool = True):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if ' UNION ALL\n  SELECT ' in sql else ''}{LOG}{sql if sql.startswith(',') else ' ' + sql}" if wrap else sql
        return f

    return add


def log(spark, d):
    return b.event_log(spark, d)


def live(spark, d, snapshot=None):
    return visibility.live(log(spark, d), KEY, snapshot, fixed=["value"])


def probes(spark, d):
    return b.table(spark, d, "customer").select((F.col("c_custkey") * 7 + 3).alias("p")).distinct()


@query("q01_put_log", "SELECT * FROM loge")
def q01(spark, d):
    return log(spark, d)


@query("q02_latest_state", "SELECT * FROM live")
def q02(spark, d):
    return live(spark, d)


@query("q03_snapshot_state", "SELECT * FROM oldlive")
def q03(spark, d):
    return live(spark, d, b.half(log(spark, d)))


@query("q04_multi_get", "SELECT c_custkey AS user_key, seq, value, seq IS NOT NULL AS found FROM customer LEFT JOIN live ON c_custkey = user_key")
def q04(spark, d):
    asked = b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return access.multi_get(asked, live(spark, d), "user_key").select("user_key", "seq", "value", "found")


@query("q05_get_missing", "SELECT c_custkey AS user_key FROM customer WHERE c_custkey NOT IN (SELECT user_key FROM loge)")
def q05(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key")).join(log(spark, d), "user_key", "left_anti")


@query("q06_tombstoned_keys", "SELECT user_key, seq FROM newest WHERE op = 2")
def q06(spark, d):
    return visibility.newest_fixed(log(spark, d), KEY, []).filter("op = 2").select("user_key", "seq")


@query("q07_version_history", "SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) AS rank FROM loge")
def q07(spark, d):
    return visibility.history(log(spark, d), KEY)


@query("q08_state_diff", """SELECT coalesce(a.user_key, n.user_key) AS user_key, CASE WHEN a.user_key IS NULL THEN 'added' WHEN n.user_key IS NULL THEN 'removed' ELSE 'changed' END AS change,
 a.value AS old, n.value AS new FROM oldlive a FULL JOIN live n ON a.user_key = n.user_key WHERE a.user_key IS NULL OR n.user_key IS NULL OR a.value IS DISTINCT FROM n.value""")
def q08(spark, d):
    return visibility.difference(live(spark, d, b.half(log(spark, d))), live(spark, d), "user_key", "value")


@query("q09_batch_last_op_wins", "SELECT * EXCLUDE rn FROM (SELECT *, (seq - 1) // 100 AS batch, row_number() OVER (PARTITION BY (seq - 1) // 100, user_key ORDER BY seq DESC) AS rn FROM loge) WHERE rn = 1")
def q09(spark, d):
    rows = log(spark, d).withColumn("batch", F.floor((F.col("seq") - 1) / 100).cast("bigint"))
    return visibility.last_in_batch(rows, KEY, "batch")


@query("q10_scan_range", "SELECT * FROM live WHERE user_key >= 20 AND user_key < 90")
def q10(spark, d):
    return access.scan(live(spark, d), "user_key", 20, 90)


@query("q11_scan_reverse_topn", "SELECT * FROM live ORDER BY user_key DESC LIMIT 20")
def q11(spark, d):
    return access.last_n(live(spark, d), "user_key", 20)


@query("q12_seek_first_last", "SELECT min(user_key) AS first_key, arg_min(value, user_key) AS first_value, max(user_key) AS last_key, arg_max(value, user_key) AS last_value FROM live")
def q12(spark, d):
    return access.ends(live(spark, d), "user_key", "value")


@query("q13_seek_ge", "SELECT p, k AS ge FROM probes ASOF LEFT JOIN mapo ON p <= k")
def q13(spark, d):
    return access.seek(probes(spark, d), b.order_map(spark, d), "p", "k").select("p", "ge")


@query("q14_seek_lt_prev", "SELECT p, k AS lt FROM probes ASOF LEFT JOIN mapo ON p > k")
def q14(spark, d):
    return access.seek(probes(spark, d), b.order_map(spark, d), "p", "k").select("p", "lt")


@query("q15_next_prev_links", "SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key, lead(user_key) OVER (ORDER BY user_key) AS next_key FROM live")
def q15(spark, d):
    return access.neighbours(live(spark, d).select("user_key"), "user_key")


@query("q16_next_n", """SELECT r_regionkey * 20 AS p, user_key, value, row_number() OVER (PARTITION BY r_regionkey ORDER BY user_key) AS rank FROM region, live
 WHERE user_key >= r_regionkey * 20 QUALIFY rank <= 5""")
def q16(spark, d):
    starts = b.table(spark, d, "region").select((F.col("r_regionkey") * 20).alias("p"))
    return access.next_n(starts, live(spark, d).select("user_key", "value"), "p", "user_key", 5)


@query("q17_contains", "SELECT c_custkey AS user_key FROM customer WHERE c_custkey IN (SELECT user_key FROM live)")
def q17(spark, d):
    return access.contains(b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key")), live(spark, d), "user_key")


def children(spark, d):
    """Three children that hold the whole log, and a fourth with a part of it again."""
    rows = log(spark, d)
    return [rows.filter(F.col("seq") % 3 == i) for i in range(3)] + [rows.filter(F.col("seq") % 6 == 2)]


CHILDREN = """(SELECT *, CAST(seq % 3 AS INT) AS child FROM loge UNION ALL SELECT *, 3 FROM loge WHERE seq % 6 = 2)"""


@query("q18_merge_bag", f"SELECT * FROM {CHILDREN}")
def q18(spark, d):
    return access.merge(children(spark, d))


@query("q19_merge_ordered_rank", f"SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC, child) AS rank FROM {CHILDREN}")
def q19(spark, d):
    return access.merge_ranked(children(spark, d), KEY)


@query("q20_level_concat", """SELECT f.file_no, f.smallest_key, f.largest_key, f.n_entries, coalesce(lag(f.largest_key) OVER (ORDER BY f.file_no) < f.smallest_key, TRUE) AS in_order FROM f1 f""")
def q20(spark, d):
    f = b.map_files(b.order_map(spark, d))
    w = Window.partitionBy("level").orderBy("file_no")
    return f.withColumn("in_order", F.coalesce(F.lag("largest_key").over(w) < F.col("smallest_key"), F.lit(True))).select("file_no", "smallest_key", "largest_key", "n_entries", "in_order")


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("q21_newest_lineitem", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""", wrap=False)
def q21(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.col(c).desc() for c in LINE_ORDER])
    rows = b.line_log(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


#: Probes of every user and over the whole run of sequence numbers, at any size of the tables.
ASKED = "q AS (SELECT o_orderkey AS probe_id, o_custkey // 10 AS user_key, o_orderkey * 2 // 3 AS \"at\" FROM orders)"


@query("q22_asof_snapshot_read", f""", {ASKED} SELECT probe_id, q.user_key, "at", CASE WHEN op = 1 THEN seq END AS found_seq, CASE WHEN op = 1 THEN l.value END AS value
 FROM q ASOF LEFT JOIN loge l ON q.user_key = l.user_key AND "at" >= l.seq""")
def q22(spark, d):
    asked = b.table(spark, d, "orders").selectExpr("o_orderkey AS probe_id", "o_custkey div 10 AS user_key", "o_orderkey * 2 div 3 AS at")
    return visibility.as_of(asked, log(spark, d), "user_key", "at")


GC = "g AS (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) AS newer FROM loge)"


@query("q23_compact_full", "SELECT * FROM live")
def q23(spark, d):
    rows = log(spark, d)
    return compaction.collect(rows, KEY, 2 * b.half(rows) + 1).filter("op = 1").drop("op")


@query("q24_compact_snapshot", f", {GC} SELECT user_key, seq, op, value FROM g, s WHERE (newer IS NULL OR newer > s) AND NOT (op = 2 AND seq <= s)".lstrip())
def q24(spark, d):
    rows = log(spark, d)
    return compaction.collect(rows, KEY, b.half(rows))


@query("q25_compact_multi_snapshot", """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_key, "interval" ORDER BY seq DESC, op DESC) AS rn
 FROM (SELECT loge.*, CASE WHEN seq > s // 2 THEN 1 ELSE 0 END + CASE WHEN seq > s THEN 1 ELSE 0 END AS "interval" FROM loge, s)) WHERE rn = 1""")
def q25(spark, d):
    rows = log(spark, d)
    s = b.half(rows)
    return compaction.collect_for(rows, KEY, [s // 2, s])


@query("q26_tombstone_base_level", f""", {GC} SELECT user_key, seq, op, value FROM g, s WHERE (newer IS NULL OR newer > s) AND NOT (op = 2 AND seq <= s
 AND NOT EXISTS (SELECT 1 FROM f1 WHERE file_no % 2 = 1 AND user_key * 50 BETWEEN smallest_key AND largest_key))""".lstrip())
def q26(spark, d):
    rows = log(spark, d).withColumn("deep_key", F.col("user_key") * 50)
    deeper = b.map_files(b.order_map(spark, d)).filter("file_no % 2 = 1")
    out = compaction.collect(compaction.covered(rows, deeper, "deep_key"), KEY, b.half(rows), F.col("base_level"))
    return out.select("user_key", "seq", "op", "value")


@query("q27_gc_stats", f""", {GC}, m AS (SELECT CASE WHEN op = 1 THEN 24 ELSE 16 END AS b, (newer IS NULL OR newer > s) AND NOT (op = 2 AND seq <= s) AS stays FROM g, s)
 SELECT count(*) AS n_before, count(*) FILTER (stays) AS n_after, CAST(sum(b) AS BIGINT) AS bytes_before, CAST(sum(b) FILTER (stays) AS BIGINT) AS bytes_after FROM m""".lstrip())
def q27(spark, d):
    rows = log(spark, d)
    sums = lambda x, n: x.agg(F.count("*").alias(f"n_{n}"), F.sum(b.entry_size()).cast("bigint").alias(f"bytes_{n}"))
    return sums(rows, "before").join(sums(compaction.collect(rows, KEY, b.half(rows)), "after"))


VIEW = "SELECT * EXCLUDE (op, rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC) AS rn FROM {}) WHERE rn = 1 AND op = 1"


@query("q28_compact_invariant", f""", {GC}, k AS (SELECT user_key, seq, op, value FROM g, s WHERE (newer IS NULL OR newer > s) AND NOT (op = 2 AND seq <= s)),
 n AS ({VIEW.format("k")}), o AS ({VIEW.format("(SELECT k.* FROM k, s WHERE seq <= s)")})
 SELECT count(*) AS differences FROM ((FROM live EXCEPT ALL FROM n) UNION ALL (FROM n EXCEPT ALL FROM live) UNION ALL (FROM oldlive EXCEPT ALL FROM o) UNION ALL (FROM o EXCEPT ALL FROM oldlive))""")
def q28(spark, d):
    rows = log(spark, d)
    s = b.half(rows)
    kept = compaction.collect(rows, KEY, s)
    gaps = None
    for at in (s, None):
        x, y = (visibility.live(r, KEY, at, fixed=["value"]) for r in (rows, kept))
        gap = x.exceptAll(y).union(y.exceptAll(x))
        gaps = gap if gaps is None else gaps.union(gap)
    return gaps.agg(F.count("*").alias("differences"))


@query("q29_file_stats", "SELECT * FROM f0 UNION ALL SELECT * FROM f1")
def q29(spark, d):
    return b.log_files(log(spark, d)).unionByName(b.map_files(b.order_map(spark, d)))


@query("q30_find_file", "SELECT p, (SELECT arg_min(file_no, largest_key) FROM f1 WHERE largest_key >= p) AS file_no FROM probes")
def q30(spark, d):
    return files.find_file(probes(spark, d), b.map_files(b.order_map(spark, d)), "p")


@query("q31_overlap_in_level", "SELECT a.file_no AS a_file_no, z.file_no AS b_file_no FROM f0 a JOIN f0 z ON a.file_no < z.file_no AND a.smallest_key <= z.largest_key AND z.smallest_key <= a.largest_key")
def q31(spark, d):
    f = b.log_files(log(spark, d))
    return files.overlaps(f, f).filter("a_file_no < b_file_no").select("a_file_no", "b_file_no")


@query("q32_l0_transitive_overlap", """, x AS (SELECT c_custkey AS file_no, c_custkey * 10 AS smallest_key, c_custkey * 10 + 3 + (c_custkey % 5) * 3 AS largest_key FROM customer),
 y AS (SELECT *, max(largest_key) OVER (ORDER BY smallest_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x)
 SELECT file_no, smallest_key, largest_key, CAST(sum(CASE WHEN seen IS NULL OR smallest_key > seen THEN 1 ELSE 0 END) OVER (ORDER BY smallest_key, file_no) - 1 AS BIGINT) AS cluster FROM y""")
def q32(spark, d):
    k = F.col("c_custkey")
    f = b.table(spark, d, "customer").select(k.alias("file_no"), (k * 10).alias("smallest_key"), (k * 10 + 3 + (k % 5) * 3).alias("largest_key"))
    return files.islands(f)


LEVELS = "l AS (SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1) GROUP BY level)"


def level_files(spark, d):
    return b.log_files(log(spark, d)).unionByName(b.map_files(b.order_map(spark, d)))


@query("q33_compaction_score", f", {LEVELS}, c AS (SELECT *, CASE WHEN level = 0 THEN n_files / 4.0 ELSE n_bytes / (10.0 * 1048576 * pow(10.0, level - 1)) END AS score FROM l) SELECT level, n_files, n_bytes, CAST(round(score, 6) AS DOUBLE) AS score, score >= 1 AS wanted FROM c".lstrip())
def q33(spark, d):
    s = files.scores(files.levels(level_files(spark, d)))
    return s.withColumn("wanted", F.col("score") >= 1).withColumn("score", F.round("score", 6))


@query("q34_pick_compaction", "SELECT file_no, smallest_key, largest_key FROM f1 ORDER BY CASE WHEN largest_key <= 2500 THEN 1 ELSE 0 END, smallest_key LIMIT 1")
def q34(spark, d):
    return files.pick(b.map_files(b.order_map(spark, d)), 2500).select("file_no", "smallest_key", "largest_key")


@query("q35_pick_flush_level", """, o AS (SELECT a.file_no, max(CASE WHEN z.file_no % 2 = 0 THEN 1 ELSE 0 END) AS at1, max(CASE WHEN z.file_no % 2 = 1 THEN 1 ELSE 0 END) AS at2,
 sum(CASE WHEN z.file_no % 2 = 1 THEN file_size END) AS bytes2 FROM
 (SELECT file_no, smallest_key * 25 AS lo, largest_key * 4 AS hi FROM f0) a LEFT JOIN f1 z ON a.lo <= a.hi AND a.lo <= z.largest_key AND z.smallest_key <= a.hi GROUP BY a.file_no)
 SELECT file_no, CASE WHEN at1 = 1 OR bytes2 > 20971520 THEN 0 WHEN at2 = 1 THEN 1 ELSE 2 END AS flush_level FROM o""")
def q35(spark, d):
    flushed = b.log_files(log(spark, d)).select("file_no", (F.col("smallest_key") * 25).alias("smallest_key"), (F.col("largest_key") * 4).alias("largest_key"))
    below = b.map_files(b.order_map(spark, d)).withColumn("level", F.when(F.col("file_no") % 2 == 0, 1).otherwise(2))
    return files.flush_level(flushed, below)


@query("q36_split_outputs", """, n AS (SELECT user_key, seq, CASE WHEN op = 1 THEN 24 ELSE 16 END AS bytes FROM loge)
 SELECT user_key, seq, CAST((sum(bytes) OVER (ORDER BY user_key, seq DESC) - bytes) // 2097152 AS BIGINT) AS bucket FROM n""")
def q36(spark, d):
    rows = log(spark, d).withColumn("bytes", b.entry_size()).withColumn("newest", -F.col("seq"))
    return files.running_bucket(rows, ["user_key", "newest"], "bytes", files.TARGET_FILE).select("user_key", "seq", "bucket")


@query("q37_next_level_overlap_bytes", "SELECT a.file_no, CAST(sum(z.file_size) AS BIGINT) AS overlap_bytes FROM f0 a JOIN f1 z ON a.smallest_key <= z.largest_key AND z.smallest_key <= a.largest_key GROUP BY a.file_no")
def q37(spark, d):
    met = files.met(b.log_files(log(spark, d)), b.map_files(b.order_map(spark, d)))
    return met.filter("n > 0").select("file_no", F.col("bytes").cast("bigint").alias("overlap_bytes"))


OFFSET = "CAST(sum(CASE WHEN largest_key <= {k} THEN file_size WHEN smallest_key > {k} THEN 0 ELSE floor(file_size * ({k} - smallest_key) / (largest_key - smallest_key + 1)) END) AS BIGINT)"


@query("q38_approx_sizes", f"""SELECT c_custkey AS range_id, greatest(0, (SELECT {OFFSET.format(k='(c_custkey * 13)')} FROM f1) * -1 + (SELECT {OFFSET.format(k='(c_custkey * 13 + 750)')} FROM f1)) AS size FROM customer""")
def q38(spark, d):
    f = b.map_files(b.order_map(spark, d))
    c = F.col("c_custkey")
    ranges = b.table(spark, d, "customer").select(c.alias("range_id"), (c * 13).alias("lo"), (c * 13 + 750).alias("hi"))
    ends = ranges.select(F.col("lo").alias("k")).union(ranges.select("hi")).distinct()
    at = files.offset_of(ends, f, "k")
    low, high = at.select(F.col("k").alias("lo"), F.col("bytes_before").alias("low")), at.select(F.col("k").alias("hi"), F.col("bytes_before").alias("high"))
    return ranges.join(low, "lo").join(high, "hi").select("range_id", F.greatest(F.lit(0), F.col("high") - F.col("low")).alias("size"))


EDITS = """ed AS (SELECT event_id AS edit_no, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS action, CAST(event_id % 3 AS INT) AS level, user_id AS file_no, CAST(floor(value) AS BIGINT) AS file_size FROM events)"""


def edits(spark, d):
    return b.table(spark, d, "events").select(F.col("event_id").alias("edit_no"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("action"), (F.col("event_id") % 3).cast("int").alias("level"), F.col("user_id").alias("file_no"), F.floor("value").cast("bigint").alias("file_size"))


@query("q39_manifest_fold", f", {EDITS} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY level, file_no ORDER BY edit_no DESC) AS rn FROM ed) WHERE rn = 1 AND action = 'add'")
def q39(spark, d):
    return files.fold_edits(edits(spark, d))


BLOCKS = "n AS (SELECT c_custkey, c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS rn, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS p FROM customer)"


def blocks(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")
    return b.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", F.row_number().over(w).alias("rn"), F.lag("c_name").over(w).alias("p"))


@query("q40_prefix_compress", f", {BLOCKS} SELECT c_custkey, c_nationkey, CASE WHEN (rn - 1) % 16 = 0 THEN 0 ELSE coalesce(list_max(list_filter(range(0, least(length(p), length(c_name)) + 1), lambda i: p[1:i] = c_name[1:i])), 0) END AS shared FROM n")
def q40(spark, d):
    n = F.when((F.col("rn") - 1) % 16 == 0, 0).otherwise(keys.shared_prefix(F.col("p"), F.col("c_name")))
    return blocks(spark, d).select("c_custkey", "c_nationkey", n.cast("bigint").alias("shared"))


@query("q41_restart_points", f", {BLOCKS}, o AS (SELECT *, sum(length(c_name) + 12) OVER (PARTITION BY c_nationkey ORDER BY rn) - length(c_name) - 12 AS start FROM n) SELECT c_nationkey, rn, CAST(start AS BIGINT) AS start FROM o WHERE (rn - 1) % 16 = 0")
def q41(spark, d):
    size = F.length("c_name") + 12
    w = Window.partitionBy("c_nationkey").orderBy("rn")
    return blocks(spark, d).withColumn("start", (F.sum(size).over(w) - size).cast("bigint")).filter("(rn - 1) % 16 = 0").select("c_nationkey", "rn", "start")


@query("q42_disjointness_check", "SELECT file_no, smallest_key, largest_key, prev_largest FROM (SELECT *, lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_no) AS prev_largest FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1)) WHERE prev_largest >= smallest_key")
def q42(spark, d):
    return files.disjointness(level_files(spark, d)).select("file_no", "smallest_key", "largest_key", "prev_largest")


#: Records of one operation: batch header, tag and key, and a put's value.
RECORDS = """r AS (SELECT user_key, seq, op, 25 + CASE WHEN op = 1 THEN 12 ELSE 0 END AS bytes FROM loge),
 n AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY seq) - bytes) // 4194304 AS BIGINT) AS log_no FROM r),
 i AS (SELECT *, row_number() OVER (PARTITION BY log_no ORDER BY seq) AS i, sum(bytes) OVER (PARTITION BY log_no ORDER BY seq) AS upto FROM n)"""


def records(spark, d):
    rows = log(spark, d).select("user_key", "seq", (F.lit(25) + F.when(F.col("op") == 1, 12).otherwise(0)).cast("bigint").alias("bytes"))
    return wal.log_numbers(rows, "seq", "bytes")


@query("q43_wal_framing", f""", {RECORDS},
 p(log_no, i, seq, user_key, block, fragments, pos) AS (SELECT log_no, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM i GROUP BY log_no UNION ALL
  SELECT log_no, i, seq, user_key, start // 32768, 1 + more, CASE WHEN more > 0 THEN (start // 32768 + 1) * 32768 + over + 11 * more ELSE start + 11 + bytes END FROM
  (SELECT *, CASE WHEN over > 0 THEN (over + 32756) // 32757 ELSE 0 END AS more FROM
   (SELECT *, bytes - (32768 - start % 32768 - 11) AS over FROM
    (SELECT i.log_no, i.i, i.seq, i.user_key, i.bytes, CASE WHEN 32768 - pos % 32768 < 11 THEN pos + 32768 - pos % 32768 ELSE pos END AS start FROM p JOIN i ON i.log_no = p.log_no AND i.i = p.i + 1))))
 SELECT user_key, seq, log_no, block, fragments FROM p WHERE i > 0""")
def q43(spark, d):
    return wal.framed(records(spark, d), "seq", "bytes").select("user_key", "seq", "log_no", "block", "fragments")


@query("q44_group_commit", f""", {RECORDS},
 w AS (SELECT *, upto - bytes + CASE WHEN bytes <= 131072 THEN bytes + 131072 ELSE greatest(bytes, 1048576) END AS last FROM i),
 c(log_no, i, commit_no) AS (SELECT log_no, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM w GROUP BY log_no UNION ALL
  SELECT c.log_no, min(x.i), c.commit_no + 1 FROM c JOIN w ON w.log_no = c.log_no AND w.i = c.i JOIN w x ON x.log_no = w.log_no AND x.upto > w.last GROUP BY c.log_no, c.commit_no)
 SELECT user_key, seq, w.log_no, c.commit_no FROM w ASOF JOIN c ON w.log_no = c.log_no AND w.i >= c.i""")
def q44(spark, d):
    return wal.commit_groups(records(spark, d), "seq", "bytes").select("user_key", "seq", "log_no", "commit_no")


@query("q45_tag_pack_unpack", "SELECT seq, op, (seq << 8) | op AS tag, ((seq << 8) | op) >> 8 AS seq_back, CAST(((seq << 8) | op) & 255 AS INT) AS op_back FROM loge")
def q45(spark, d):
    rows = log(spark, d).select("seq", "op", keys.pack_tag(F.col("seq"), F.col("op")).alias("tag"))
    return rows.select("seq", "op", "tag", keys.tag_sequence(F.col("tag")).alias("seq_back"), keys.tag_op(F.col("tag")).alias("op_back"))


@query("q46_obsolete_files", f", {EDITS}, v AS (SELECT level, file_no, arg_max(action, edit_no) AS a FROM ed GROUP BY level, file_no) SELECT DISTINCT file_no FROM ed WHERE file_no NOT IN (SELECT file_no FROM v WHERE a = 'add' AND level = 0)")
def q46(spark, d):
    e = edits(spark, d)
    return files.obsolete(e.select("file_no").distinct(), files.fold_edits(e).filter("level = 0").select("file_no"))


@query("q47_level_properties", f", {LEVELS} SELECT * FROM l")
def q47(spark, d):
    return files.levels(level_files(spark, d))


@query("q48_bloom_prefilter_get", "SELECT c_custkey AS user_key FROM customer WHERE c_custkey IN (SELECT user_key FROM live)")
def q48(spark, d):
    state = live(spark, d)
    asked = b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return access.contains(access.may_contain(asked, state, "user_key"), state, "user_key")


TIERS = """t1 AS (SELECT c_custkey AS file_no, c_custkey * 10 AS smallest_key, c_custkey * 10 + 7 AS largest_key, 1000000 + c_custkey % 7 * 300000 AS file_size FROM customer),
 t2 AS (SELECT c_custkey AS file_no, c_custkey * 25 AS smallest_key, c_custkey * 25 + 11 AS largest_key, (c_custkey % 5 + 1) * 2097152 AS file_size FROM customer),
 t3 AS (SELECT c_custkey AS file_no, c_custkey * 40 AS smallest_key, c_custkey * 40 + 35 AS largest_key, (c_custkey % 4 + 1) * 6291456 AS file_size FROM customer)"""


def tiers(spark, d):
    """Three disjoint levels of files."""
    k = F.col("c_custkey")
    make = lambda step, width, size: b.table(spark, d, "customer").select(k.alias("file_no"), (k * step).alias("smallest_key"), (k * step + width).alias("largest_key"), size.alias("file_size"))
    return make(10, 7, 1000000 + k % 7 * 300000), make(25, 11, (k % 5 + 1) * 2097152), make(40, 35, (k % 4 + 1) * 6291456)


@query("q49_compaction_inputs", f""", {TIERS},
 m AS (SELECT a.file_no, a.file_size, a.smallest_key AS lo, a.largest_key AS hi, count(z.file_no) AS n_below, coalesce(sum(z.file_size), 0) AS below_bytes, min(z.smallest_key) AS zlo, max(z.largest_key) AS zhi
  FROM t1 a LEFT JOIN t2 z ON a.smallest_key <= z.largest_key AND z.smallest_key <= a.largest_key GROUP BY a.file_no, a.file_size, a.smallest_key, a.largest_key),
 r AS (SELECT *, least(lo, coalesce(zlo, lo)) AS lo2, greatest(hi, coalesce(zhi, hi)) AS hi2 FROM m),
 w AS (SELECT r.file_no, r.file_size, n_below, below_bytes, lo2, hi2, count(*) AS n_wider, sum(x.file_size) AS wider_bytes, min(x.smallest_key) AS xlo, max(x.largest_key) AS xhi
  FROM r JOIN t1 x ON x.smallest_key <= hi2 AND x.largest_key >= lo2 GROUP BY r.file_no, r.file_size, n_below, below_bytes, lo2, hi2),
 g AS (SELECT w.file_no, w.file_size, n_below, below_bytes, n_wider, wider_bytes, count(z.file_no) AS n_again FROM w LEFT JOIN t2 z ON z.smallest_key <= greatest(hi2, xhi) AND z.largest_key >= least(lo2, xlo) GROUP BY w.file_no, w.file_size, n_below, below_bytes, n_wider, wider_bytes),
 e AS (SELECT *, n_below > 0 AND n_wider > 1 AND n_again = n_below AND wider_bytes + below_bytes < 52428800 AS grows FROM g)
 SELECT file_no, CASE WHEN grows THEN n_wider ELSE 1 END AS n_inputs, n_below, CAST(CASE WHEN grows THEN wider_bytes ELSE file_size END AS BIGINT) AS input_bytes, CAST(below_bytes AS BIGINT) AS below_bytes FROM e""")
def q49(spark, d):
    t1, t2, _ = tiers(spark, d)
    return files.compaction_inputs(t1, t2)


@query("q50_trivial_moves", f""", {TIERS} SELECT file_no FROM t1 a WHERE NOT EXISTS (SELECT 1 FROM t2 z WHERE a.smallest_key <= z.largest_key AND z.smallest_key <= a.largest_key)
 AND coalesce((SELECT sum(file_size) FROM t3 z WHERE a.smallest_key <= z.largest_key AND z.smallest_key <= a.largest_key), 0) <= 20971520""")
def q50(spark, d):
    return files.trivial_moves(*tiers(spark, d))


@query("q51_manual_range_inputs", """, x AS (SELECT c_custkey AS file_no, c_custkey * 10 AS smallest_key, c_custkey * 10 + 3 + (c_custkey % 5) * 3 AS largest_key FROM customer),
 y AS (SELECT *, max(largest_key) OVER (ORDER BY smallest_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x),
 c AS (SELECT *, sum(CASE WHEN seen IS NULL OR smallest_key > seen THEN 1 ELSE 0 END) OVER (ORDER BY smallest_key, file_no) AS cluster FROM y),
 h AS (SELECT cluster FROM c GROUP BY cluster HAVING min(smallest_key) <= 1204 AND max(largest_key) >= 745)
 SELECT file_no, smallest_key, largest_key FROM c WHERE cluster IN (SELECT cluster FROM h)""")
def q51(spark, d):
    k = F.col("c_custkey")
    f = b.table(spark, d, "customer").select(k.alias("file_no"), (k * 10).alias("smallest_key"), (k * 10 + 3 + (k % 5) * 3).alias("largest_key"))
    return files.range_inputs(f, 745, 1204)


@query("q52_best_level", f", {LEVELS}, c AS (SELECT level, CASE WHEN level = 0 THEN n_files / 4.0 ELSE n_bytes / (10.0 * 1048576 * pow(10.0, level - 1)) END AS score FROM l) SELECT level, CAST(round(score, 6) AS DOUBLE) AS score FROM c ORDER BY c.score DESC, level LIMIT 1")
def q52(spark, d):
    return files.best_level(files.levels(level_files(spark, d))).withColumn("score", F.round("score", 6))


@query("q53_live_files", f""", {EDITS}, n AS (SELECT max(edit_no) AS n FROM ed), v AS (SELECT unnest([n // 3, n // 2, n]) AS version FROM n),
 r AS (SELECT version, level, file_no, arg_max(action, edit_no) AS a FROM ed, v WHERE edit_no <= version GROUP BY ALL) SELECT DISTINCT file_no FROM r WHERE a = 'add'""")
def q53(spark, d):
    e = edits(spark, d)
    n = e.agg(F.max("edit_no").alias("n")).first()["n"] or 0
    return files.live_files(e, [n // 3, n // 2, n])


@query("q54_get_by_level", """, t AS (SELECT loge.*, CASE WHEN seq > s THEN 0 WHEN seq > s // 2 THEN 1 ELSE 2 END AS level FROM loge, s)
 SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY level, seq DESC, op DESC) AS rn FROM t) WHERE rn = 1""")
def q54(spark, d):
    rows = log(spark, d)
    s = b.half(rows)
    seq = F.col("seq")
    return visibility.first_hit([rows.filter(seq > s), rows.filter((seq <= s) & (seq > s // 2)), rows.filter(seq <= s // 2)], KEY)


@query("q55_log_recovery", f", {RECORDS} SELECT log_no, count(*) AS n_records, max(seq) AS max_seq, CAST(sum(bytes) AS BIGINT) AS bytes FROM i GROUP BY log_no")
def q55(spark, d):
    return records(spark, d).groupBy("log_no").agg(F.count("*").alias("n_records"), F.max("seq").alias("max_seq"), F.sum("bytes").alias("bytes"))
