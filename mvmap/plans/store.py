"""A directory-backed store: an ordered, versioned map as DataFrames.

A write appends a sorted Parquet folder and publishes it with a manifest commit;
reads merge the live files, newest wins; compaction merges files of a level into the
next one under the collection rule. Snapshots are sequence numbers pinned in the
store's folder, so they bind every process. Data folders have names of their own, so
two writers never meet on one; the one that commits second is refused and its folder
removed.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvmap.operators import access, compaction, files, ranges, visibility
from mvmap.plans import leveling
from mvmap.sources import wal
from mvmap.sources.batch import BadFormat, WriteBatch
from mvmap.sources.manifest import CommitConflict, Manifest

LOGGER = logging.getLogger("mvmap.store")
LOG_SCHEMA = "user_key binary, seq bigint, op int, value binary"


@dataclass
class Options:
    """The options with a meaning for Parquet folders; block size, restart
    interval, compression and caches are Parquet's and Spark's own."""

    create_if_missing: bool = True
    error_if_existing: bool = False
    #: Level-0 files at which a write compacts first, and at which one is refused otherwise.
    l0_trigger: int = files.L0_TRIGGER
    l0_stop: int = files.L0_STOP
    #: Compact after a write that makes a level due.
    auto_compact: bool = False
    write_buffer: int = 4 << 20
    target_file: int = files.TARGET_FILE
    rows_per_file: int = 5_000_000
    bloom_ndv: int = 1_000_000
    #: Check live folders when the store is opened.
    paranoid_checks: bool = True


@dataclass
class ReadOptions:
    snapshot: int | None = None


@dataclass
class WriteOptions:
    """``sync``: a commit is always on the file system before write() returns."""

    sync: bool = True


class SnapshotTooOld(ValueError):
    """Compaction has dropped versions this snapshot would need."""


class WritesStalled(RuntimeError):
    """Level 0 holds as many files as ``l0_stop``; compact first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.manifest = Manifest(spark, path)
        self.pinned: list[tuple[int, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        store = cls(spark, path, options or Options())
        if store.manifest.exists():
            if store.options.error_if_existing:
                raise FileExistsError(path)
        elif not store.options.create_if_missing:
            raise FileNotFoundError(path)
        else:
            store.manifest.commit({"next_file": 1, "last_sequence": 0, "floor": 0, "files": [], "pointers": {}})
        if store.options.paranoid_checks:
            missing = {f["folder"] for f in store.state["files"] if not store.manifest.holds(f["folder"])}
            if missing:
                raise FileNotFoundError(f"live files are missing: {sorted(missing)}")
        return store

    @property
    def state(self) -> dict:
        return self.manifest.read()

    # writes

    def write_frame(self, ops: DataFrame, order: str, also: dict | None = None) -> int:
        """Apply rows (user_key, op, value) in the order of the integer column
        ``order``, distinct from 0 on; returns the last sequence number. ``also``:
        entries of the state that change in the same commit."""
        self._make_room()
        state = self.state
        base = state["last_sequence"] + 1
        rows = ops.select(F.col("user_key").cast("binary"), (F.col(order).cast("bigint") + base).alias("seq"), F.col("op").cast("int"), F.col("value").cast("binary"))
        rows = rows.withColumn("op", F.when(F.col("user_key").isNull(), F.raise_error(F.lit("null key"))).when(~F.col("op").isin(1, 2), F.raise_error(F.lit("unknown operation"))).otherwise(F.col("op")))
        made = self._add(rows, state, 0)
        state["files"] += made
        state["last_sequence"] = max([state["last_sequence"], *(m["largest_seq"] for m in made)])
        out = self._commit(state | (also or {}), made)["last_sequence"]
        if self.options.auto_compact:
            self.maybe_compact()
        return out

    def _make_room(self) -> None:
        """Before a write: compact, or refuse it, where level 0 is full."""
        held = sum(f["level"] == 0 for f in self.state["files"])
        if held >= self.options.l0_stop:
            if not self.options.auto_compact:
                raise WritesStalled(f"{held} files at level 0")
            self.maybe_compact()

    def write(self, batch: WriteBatch, options: WriteOptions | None = None) -> int:
        if not len(batch):
            return self.state["last_sequence"]
        rows = [(bytearray(k), i, op, None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(batch.ops)]
        return self.write_frame(self.spark.createDataFrame(rows, "user_key binary, ord int, op int, value binary"), "ord")

    def write_group(self, batches: list[WriteBatch]) -> int:
        """Waiting batches as few commits: each takes what leveling.batch_groups gives it."""
        last = self.state["last_sequence"]
        for group in leveling.batch_groups([b.byte_size() for b in batches]):
            joint = WriteBatch()
            for i in group:
                joint.append(batches[i])
            last = self.write(joint)
        return last

    def recover_log(self, raw: bytes) -> int:
        """Apply the batches of a framed log that the store does not hold yet, known by
        their sequence numbers, in one commit; returns the last sequence number. A batch
        that begins at or before the store's last number is skipped, the end of a log
        that was not written whole is dropped."""
        last = self.state["last_sequence"]
        joint, ahead = WriteBatch(), last
        for record in wal.unframe(raw)[0]:
            sequence, batch = WriteBatch.parse(record)
            if sequence <= ahead:
                continue
            if sequence != ahead + 1:
                raise BadFormat(f"sequence {ahead + 1} is missing from the log")
            joint.append(batch)
            ahead += len(batch)
        LOGGER.info("recovering operations %d to %d from a log", last + 1, ahead)
        return self.write(joint)

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(WriteBatch().delete(key))

    def _commit(self, state: dict, made: list[dict]) -> dict:
        try:
            return self.manifest.commit(state)
        except CommitConflict:
            for top in {m["folder"].split("/")[0] for m in made}:
                self.manifest.drop_folder(top)
            raise

    def _add(self, rows: DataFrame, state: dict, level: int, replaces: list[str] = (), cuts: list[int] = ()) -> list[dict]:
        """Write rows as one sorted folder, or one for each range between ``cuts``
        (places of keys); the metadata of those that are not empty."""
        number = state["next_file"]
        folder = self.manifest.new_folder(number)
        if cuts:
            rows = rows.withColumn("part", ranges.cell(ranges.place(rows, "user_key"), list(cuts))).repartition("part")
        writer = rows.sortWithinPartitions(*(["part"] if cuts else []), F.col("user_key"), F.col("seq").desc()).write.option("maxRecordsPerFile", self.options.rows_per_file)
        writer = writer.option("parquet.bloom.filter.enabled#user_key", "true").option("parquet.bloom.filter.expected.ndv#user_key", str(self.options.bloom_ndv))
        (writer.partitionBy("part") if cuts else writer).parquet(f"{self.path}/data/{folder}")
        made = [m | {"level": level, "file_no": number + i} for i, m in enumerate(self._measure(folder, bool(cuts)))]
        state["next_file"] = number + max(1, len(made))
        self.manifest.describe(folder, {"files": made, "floor": state["floor"], "replaces": list(replaces)})
        return made

    def _measure(self, folder: str, parted: bool) -> list[dict]:
        """Metadata of a folder's parts in key order, from one pass over it."""
        schema = f"{LOG_SCHEMA}, part int" if parted else LOG_SCHEMA
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}")
        size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
        found = rows.groupBy(*(["part"] if parted else [])).agg(F.hex(F.min("user_key")).alias("lo"), F.hex(F.max("user_key")).alias("hi"), F.max("seq").alias("seq"), F.count("*").alias("n"), F.sum(size).alias("bytes")).filter("n > 0").collect()
        name = lambda r: f"{folder}/part={r['part']}" if parted else folder
        return [{"folder": name(r), "smallest_key": r["lo"], "largest_key": r["hi"], "largest_seq": r["seq"], "n_entries": r["n"], "file_size": r["bytes"]} for r in sorted(found, key=lambda r: r["lo"])]

    # reads

    def files(self) -> DataFrame:
        rows = [(f["level"], f["file_no"], f["file_size"], f["smallest_key"], f["largest_key"], f["largest_seq"], f["n_entries"]) for f in self.state["files"]]
        return self.spark.createDataFrame(rows, "level int, file_no bigint, file_size bigint, smallest_key string, largest_key string, largest_seq bigint, n_entries bigint")

    def _rows(self, found: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{f['folder']}" for f in found]
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)

    def log(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """All versions in live files, of those alone whose range meets [lo, hi]."""
        return self._rows([f for f in self.state["files"] if leveling.meets(f, lo, hi)])

    def _check(self, snapshot: int | None) -> None:
        if snapshot and snapshot < self.state["floor"]:
            raise SnapshotTooOld(snapshot)

    def view(self, snapshot: int | None = None) -> DataFrame:
        self._check(snapshot)
        return visibility.live(self.log(), ["user_key"], snapshot)

    def get(self, key: bytes, snapshot: int | ReadOptions | None = None) -> bytes | None:
        """The value of a key. Levels are asked from the newest on, and the first that
        holds a visible entry answers: one read for each level until then."""
        snapshot = snapshot.snapshot if isinstance(snapshot, ReadOptions) else snapshot
        self._check(snapshot)
        for found in leveling.read_order(self.state["files"], key):
            rows = self._rows(found).filter(F.col("user_key") == F.lit(bytearray(key)))
            top = visibility.at_snapshot(rows, snapshot).orderBy(F.col("seq").desc()).limit(1).collect()
            if top:
                return bytes(top[0]["value"]) if top[0]["op"] == 1 else None
        return None

    def iterator(self, start: bytes | None = None, limit: bytes | None = None, reverse: bool = False, snapshot: int | None = None) -> DataFrame:
        """Live entries of [start, limit) in order; only files that meet the range are read."""
        self._check(snapshot)
        literal = lambda k: None if k is None else F.lit(bytearray(k))
        held = access.scan(self.log(start, limit), "user_key", literal(start), literal(limit))
        rows = visibility.live(held, ["user_key"], snapshot)
        return rows.orderBy(F.col("user_key").desc() if reverse else F.col("user_key"))

    def snapshot(self) -> int:
        sequence = self.state["last_sequence"]
        self.pinned.append((sequence, self.manifest.pin(sequence)))
        return sequence

    def release(self, snapshot: int) -> bool:
        for held in self.pinned:
            if held[0] == snapshot:
                self.manifest.unpin(held[1])
                self.pinned.remove(held)
                return True
        return False

    def property(self, name: str) -> str | None:
        found = self.state["files"]
        if name.startswith("num-files-at-level"):
            return str(sum(f["level"] == int(name[18:]) for f in found))
        if name == "stats":
            return "\n".join(f"level {n}: {sum(f['level'] == n for f in found)} files, {sum(f['file_size'] for f in found if f['level'] == n)} bytes" for n in range(files.LEVELS))
        if name == "sstables":
            return "\n".join(f"{f['level']} {f['file_no']}: {f['file_size']} [{f['smallest_key']} .. {f['largest_key']}]" for f in found)
        return None

    def approximate_sizes(self, bounds: list[tuple[bytes, bytes]]) -> list[int]:
        """Bytes of whole files below the limit less those below the start; a file
        that holds a bound counts by the bound's place between its ends."""
        found = self.state["files"]
        return [max(0, leveling.bytes_before(found, b) - leveling.bytes_before(found, a)) for a, b in bounds]

    # upkeep

    def _oldest(self, state: dict) -> int:
        return min([*self.manifest.pins(), state["last_sequence"]])

    def compact(self, begin: bytes | None = None, end: bytes | None = None) -> int:
        """Push all entries of [begin, end] down, level by level, to the deepest level
        that holds any; returns the number of steps. Without bounds all files become
        one level."""
        steps = 0
        held = [f["level"] for f in self.state["files"] if leveling.meets(f, begin, end)]
        deepest = max(held, default=0)
        for level in range(max(1, deepest)):
            steps += self.compact_level(level, begin, end)
        if held and deepest and not steps:
            steps += self._rewrite(deepest, begin, end)
        return steps

    def compact_level(self, level: int, begin: bytes | None = None, end: bytes | None = None) -> int:
        """One step: the files of a level that meet [begin, end] go into the next level."""
        state = self.state
        seeds = leveling.overlapping(state["files"], level, begin, end)
        if not seeds:
            return 0
        self._run(state, leveling.plan(state["files"], level, seeds))
        return 1

    def _rewrite(self, level: int, begin: bytes | None, end: bytes | None) -> int:
        """Collect within the deepest level itself, as a released snapshot asks for."""
        state = self.state
        seeds = leveling.overlapping(state["files"], level, begin, end)
        self._run(state, leveling.Plan(level, seeds, [], []), target=level)
        return 1

    def _run(self, state: dict, plan: leveling.Plan, target: int | None = None) -> None:
        """One compaction: move a file down as it is, or merge the inputs."""
        target = plan.level + 1 if target is None else target
        inputs = plan.inputs + plan.below
        gone = {f["folder"] for f in inputs}
        rest = [f for f in state["files"] if f["folder"] not in gone]
        LOGGER.info("compacting level %d: %d files, %d below, into level %d", plan.level, len(plan.inputs), len(plan.below), target)
        if plan.trivial and target != plan.level:
            state["files"] = rest + [plan.inputs[0] | {"level": target}]
            self._commit(self._pointed(state, plan), [])
            return
        oldest = self._oldest(state)
        deeper = [f for f in rest if f["level"] > target]
        rows = self._rows(inputs)
        spans = [(bytearray.fromhex(f["smallest_key"]), bytearray.fromhex(f["largest_key"])) for f in deeper]
        if spans:
            below = self.spark.createDataFrame(spans, "smallest_key binary, largest_key binary")
            kept = compaction.collect(compaction.covered(rows, below, "user_key"), ["user_key"], oldest, F.col("base_level")).select("user_key", "seq", "op", "value")
        else:
            kept = compaction.collect(rows, ["user_key"], oldest)
        state["floor"] = max(state["floor"], oldest)
        made = self._add(kept, state, target, sorted(gone), self._cuts(rows, inputs, plan))
        state["files"] = rest + made
        self._commit(self._pointed(state, plan), made)

    def _cuts(self, rows: DataFrame, inputs: list[dict], plan: leveling.Plan) -> list[int]:
        """Where outputs end: at quantiles of the keys, for files of about ``target_file``
        bytes, and where one would meet too many bytes of the level after the next."""
        n = min(ranges.MAX_CELLS, -(-leveling.size(inputs) // self.options.target_file))
        per_cell = -(-sum(f["n_entries"] for f in inputs) // n)
        return sorted({*(ranges.cuts(rows, "user_key", per_cell) if n > 1 else []), *leveling.grandparent_cuts(plan.grandparents)})

    @staticmethod
    def _pointed(state: dict, plan: leveling.Plan) -> dict:
        pointers = dict(state.get("pointers", {}))
        pointers[str(plan.level)] = max(f["largest_key"] for f in plan.inputs)
        return state | {"pointers": pointers}

    def maybe_compact(self) -> int:
        """Compact the level of the highest score until none is due; returns the steps."""
        steps = 0
        while True:
            state = self.state
            level, score = leveling.best_level(state["files"], self.options.l0_trigger)
            if score < 1:
                return steps
            self._run(state, leveling.plan(state["files"], level, leveling.next_seeds(state["files"], level, state.get("pointers", {}).get(str(level)))))
            steps += 1

    def vacuum(self, keep_versions: int = 10, pending_seconds: float = 3600) -> list[str]:
        """Delete data folders, and parts of folders, that none of the ``keep_versions``
        latest versions names (readers may still scan those) and that no writer has
        touched for ``pending_seconds`` (it may be about to commit them)."""
        live = {f["folder"] for state in self.manifest.recent(max(1, keep_versions)) for f in state["files"]}
        tops = {f.split("/")[0] for f in live}
        gone = []
        for d in self.manifest.folders():
            if self.manifest.age(d) < pending_seconds or d in live:
                continue
            gone += [d] if d not in tops else [f["folder"] for f in (self.manifest.described(d) or {"files": []})["files"] if f["folder"] not in live and self.manifest.holds(f["folder"])]
        for d in gone:
            LOGGER.info("deleting %s", d)
            self.manifest.drop_folder(d)
        return gone

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> bool:
        return Manifest(spark, path).destroy()

    @classmethod
    def repair(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Rebuild the manifest from the data folders that were written whole, all as
        level 0. Folders that a compaction has replaced stay out, so nothing that it
        dropped comes back. The floor is the highest of any folder."""
        store = cls(spark, path, options or Options())
        told = {d: m for d in store.manifest.folders() if (m := store.manifest.described(d))}
        replaced = {r for m in told.values() for r in m["replaces"]}
        every = [f for m in told.values() for f in m["files"]]
        found = [f | {"level": 0} for f in every if f["folder"] not in replaced and store.manifest.holds(f["folder"])]
        version = (store.manifest.versions() or [0])[-1]
        state = {"version": version, "next_file": 1 + max([0, *(int(d.split("-")[0]) for d in store.manifest.folders()), *(f["file_no"] for f in every)]), "pointers": {}}
        state |= {"last_sequence": max((f["largest_seq"] for f in every), default=0), "floor": max((m["floor"] for m in told.values()), default=0), "files": found}
        store.manifest.commit(state)
        return store

    def close(self) -> None:
        for _, name in self.pinned:
            self.manifest.unpin(name)
        self.pinned.clear()
