"""Catalog and vectors as rows of one append-only Parquet table, partitioned by the commits' places.

    rows/seq=<n>/            what a commit did: op is put, delete, told (a feed's change without effect) or failed
    places/<n>.<commit_id>   marked before the rows, so a replayed commit keeps its place
    base/<version>-<through>/   all commits up to ``through`` folded: ``slots``, ``paths`` (by hash of path), ``free``

The state is the row with the highest ``seq`` of each slot; within a commit a put beats a delete,
since a freed slot may be taken again at once. One writer at a time is assumed. A base folds the
commits before the first one that has a place but no rows yet; that one can still be replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.ranking import row_index
from vecatlas.session import empty_table
from vecatlas.sources.storage import Storage

_COLUMNS = {"slot": "long", "path": "string", "size": "long", "op": "string", "embedding": "array<float>", "source_seq": "long",
            "error": "string"}
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items()) + ", seq long"
_PATHS = "path string, slot long, size long, told long, failed struct<size:long,source_seq:long,error:string>, seq long"
_FREE = "start long, length long, before long"
BUCKETS = 64


def _rows(df: DataFrame, op: str, **given: Column) -> DataFrame:
    """Rows of a commit; columns that ``df`` does not have are null."""
    column = lambda name, kind: given.get(name, F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    return df.select(*(F.lit(op).alias(name) if name == "op" else column(name, kind).alias(name) for name, kind in _COLUMNS.items()))


def puts(df: DataFrame) -> DataFrame:
    return _rows(df, "put")


def deletes(df: DataFrame) -> DataFrame:
    return _rows(df, "delete", embedding=F.lit(None))


def pads(df: DataFrame) -> DataFrame:
    """Tombstones for slots that were never filled."""
    return _rows(df.select("slot"), "delete", size=F.lit(0))


def told(df: DataFrame) -> DataFrame:
    """Changes of a feed that changed nothing, so that older ones are known to be late."""
    return _rows(df.select("path", "source_seq"), "told")


def failed(df: DataFrame) -> DataFrame:
    """Rows that could not be encoded. They have no slot: what the path had before stays."""
    return _rows(df, "failed", slot=F.lit(None))


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class CommitLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._storage = Storage(spark)

    def _bases(self) -> list[tuple[int, int, str]]:
        """Version, last place folded, and folder of the finished bases, oldest first."""
        names = self._storage.names(f"{self.path}/base")
        found = sorted((*map(int, name.split("-", 1)), f"{self.path}/base/{name}") for name in names)
        return [base for base in found if self._storage.exists(f"{base[2]}/free/_SUCCESS")]  # written last

    def _base(self) -> tuple[int, int, str | None]:
        return (self._bases() or [(0, -1, None)])[-1]

    def _places(self) -> dict[str, int]:
        names = (name.split(".", 1) for name in self._storage.names(f"{self.path}/places"))
        return {commit: int(seq) for seq, commit in names}

    def _pending(self) -> list[tuple[int, bool]]:
        """Places since the base, oldest first, and whether their rows are complete."""
        through = self._base()[1]
        return [(n, self._storage.exists(f"{self.path}/rows/seq={n}/_SUCCESS")) for n in sorted(self._places().values()) if n > through]

    def ordinal(self, commit_id: str) -> int:
        """The place of a commit; a new commit gets the next one, a replayed commit keeps its own."""
        known = self._places()
        if commit_id not in known:
            known[commit_id] = max([*known.values(), self._base()[1]], default=-1) + 1
            self._storage.touch(f"{self.path}/places/{known[commit_id]:012d}.{commit_id}")
        return known[commit_id]

    def last(self) -> int:
        """The place of the last finished commit; -1 for none."""
        return max([seq for seq, done in self._pending() if done], default=self._base()[1])

    def holds(self, since: int) -> bool:
        """Whether all commits after the given place can still be told from the state."""
        return since >= self._base()[1]

    def append(self, rows: DataFrame, commit_id: str) -> None:
        """Write a commit. One whose place is folded is part of the state, or was before a reset: nothing changes."""
        seq = self.ordinal(commit_id)
        if seq > self._base()[1]:
            rows.select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/rows/seq={seq}")

    def tail(self, before: int | None = None) -> DataFrame:
        """Rows of the commits since the base, or of those before the given place."""
        folders = [f"{self.path}/rows/seq={seq}" for seq, done in self._pending() if done and (before is None or seq < before)]
        if not folders:
            return empty_table(self.spark, _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", f"{self.path}/rows").parquet(*folders)

    def _folded(self, kind: str, schema: str) -> DataFrame:
        folder = self._base()[2]
        return self.spark.read.schema(schema).parquet(f"{folder}/{kind}") if folder else empty_table(self.spark, schema)

    def _state(self, before: int | None, *columns: str) -> DataFrame:
        """``slot, op, seq`` and ``columns`` of the deciding row of each slot.

        Only the commits since the base are grouped. The base has one row per slot already and
        loses the slots that were written since; while those are few they are broadcast by their size,
        and the base is read without a shuffle.
        """
        tail = self.tail(before).filter("slot is not null")
        latest = tail.groupBy("slot").agg(F.max_by(F.struct("op", "seq", *columns), _newest()).alias("_row")).select("slot", "_row.*")
        if not self._base()[2]:
            return latest
        base = self._folded("slots", _SCHEMA).select("slot", "op", "seq", *columns)
        return base.join(tail.select("slot").distinct(), "slot", "left_anti").unionByName(latest)

    def catalog(self, before: int | None = None) -> DataFrame:
        """``slot, path, size, live``; embeddings are not read."""
        live = F.col("op") == "put"
        return self._state(before, "path", "size").select(
            "slot", F.when(live, F.col("path")).alias("path"), "size", live.alias("live")
        )

    def vectors(self, before: int | None = None) -> DataFrame:
        """``slot, path, size, embedding`` of the live rows."""
        state = self._state(before, "path", "size", "embedding")
        return state.filter("op = 'put'").select("slot", "path", "size", "embedding")

    def paths(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """What is known of each path: its slot (null if it has none), size, last change told by a feed, and failure.

        ``failed`` is null unless the path's last change could not be encoded. With ``only(path)``, a small table,
        just its paths are looked up, in their buckets of the base.
        """
        tail, base = self.tail(before).filter("path is not null"), self._folded("paths", f"{_PATHS}, bucket int")
        if only is not None:
            tail = tail.join(only.select("path"), "path", "left_semi")
        if only is not None and self._base()[2]:
            wanted = [r["bucket"] for r in only.select(bucket(F.col("path")).alias("bucket")).distinct().collect()]  # at most BUCKETS
            base = base.filter(F.col("bucket").isin(wanted)).join(only.select("path"), "path", "left_semi")
        kept = F.col("op").isin("put", "delete")
        last = F.max_by(F.when(kept, F.struct(F.when(F.col("op") == "put", F.col("slot")).alias("slot"), "size")), F.when(kept, _newest()))
        failure = F.struct("size", "source_seq", "error")
        new = tail.groupBy("path").agg(
            last.alias("last"), F.max(F.when(F.col("op") != "failed", F.col("source_seq"))).alias("told"),
            F.max_by(F.when(F.col("op") == "failed", failure), F.struct("seq", (F.col("op") != "failed").alias("done"))).alias("failed"),
            F.max("seq").alias("seq"), F.max(kept).alias("kept"))
        new = new.select("path", F.col("last.slot").alias("slot"), F.col("last.size").alias("size"), "told", "failed", "seq", "kept")
        both = base.drop("bucket").withColumn("kept", F.lit(True)).unionByName(new)
        newest = F.struct("seq", "kept")
        at = F.when(F.col("kept"), newest)
        return both.groupBy("path").agg(
            F.max_by("slot", at).alias("slot"), F.max_by("size", at).alias("size"), F.max("told").alias("told"),
            F.max_by("failed", newest).alias("failed"), F.max("seq").alias("seq"))

    def errors(self, before: int | None = None) -> DataFrame:
        """``path, size, source_seq, error, seq`` of the paths whose last change could not be encoded."""
        failures = self.tail(before).filter("op = 'failed'").select("path").distinct()
        base = self._folded("paths", f"{_PATHS}, bucket int").filter("failed is not null").select("path")
        some = failures.unionByName(base).distinct()
        known = self.paths(before).join(some, "path", "left_semi")
        return known.filter("failed is not null").select("path", "failed.*", "seq")

    def free(self, before: int | None, wanted: int, gone: DataFrame) -> tuple[DataFrame | None, int]:
        """``slot``: the lowest free slots, at least ``wanted`` if there are so many, and the length of the slot sequence.

        ``gone(slot)`` are freed in this commit. The base keeps its free slots as intervals with running totals: only so
        many are opened as the commits since then can have taken, and the catalog is not read. None if no slot is free.
        """
        # The newest row as one number, odd for a put: a hash table and no sort.
        newest = F.max(F.col("seq").cast("long") * 2 + F.when(F.col("op") == "put", 1).otherwise(0))
        tail = self.tail(before).filter("slot is not null").groupBy("slot").agg(newest.alias("newest"))
        freed = tail.filter("newest % 2 = 0").select("slot").unionByName(gone.select("slot"))
        intervals = self._folded("free", _FREE)
        # The interval of length 0 closes the base: its start is the length of the slot sequence.
        ends = tail.select((F.col("slot") + 1).alias("end"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("free")).unionByName(
            freed.select(F.lit(0).cast("long").alias("end"), F.lit(0).alias("n"), F.lit(1).cast("long").alias("free"))).unionByName(
            intervals.filter("length = 0").select(F.col("start").alias("end"), F.lit(0).alias("n"), F.col("before").alias("free")))
        n, end, some = ends.agg(*(F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "n"), (F.max, "end"), (F.sum, "free")))).first()
        if not some:
            return None, end
        most = F.least("length", F.lit(wanted + n) - F.col("before"))
        opened = intervals.filter((F.col("length") > 0) & (F.col("before") < wanted + n)).select(
            F.explode(F.sequence("start", F.col("start") + most - 1)).alias("slot"))
        return opened.join(tail, "slot", "left_anti").unionByName(freed).distinct(), end

    def reset(self, commit_id: str) -> None:
        """Start again from an empty base, as the first act of the given commit; a replay changes nothing.

        The old state stays on storage until compaction.
        """
        place, (version, through, _) = self.ordinal(commit_id), self._base()
        if place - 1 > through:
            self._fold(version + 1, place - 1, empty_table(self.spark, _SCHEMA), empty_table(self.spark, _PATHS))

    def compact(self) -> None:
        """Fold the finished commits into a new base and remove what the base before it had folded."""
        version, through, _ = self._base()
        last = through
        for seq, done in self._pending():
            if not done:
                break
            last = seq
        state = self._state(last + 1, "path", "size", "embedding")
        self._fold(version + 1, last, state, self.paths(last + 1))
        for commit, seq in self._places().items():
            if seq <= through:
                self._storage.delete(f"{self.path}/rows/seq={seq}")
                self._storage.delete(f"{self.path}/places/{seq:012d}.{commit}")
        for _, _, folder in self._bases()[:-2]:
            self._storage.delete(folder)

    def _fold(self, version: int, through: int, state: DataFrame, paths: DataFrame) -> None:
        folder = f"{self.path}/base/{version}-{through}"
        state.select("slot", "path", "size", "op", "embedding", "seq").write.mode("overwrite").parquet(f"{folder}/slots")
        by_path = paths.withColumn("bucket", bucket(F.col("path")))
        by_path.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/paths")
        slots = self.spark.read.schema(_SCHEMA).parquet(f"{folder}/slots").select("slot", "op")
        ranked, count = row_index(slots.filter("op <> 'put'").select("slot"), ["slot"], "place")
        runs = ranked.groupBy(F.col("slot") - F.col("place")).agg(
            F.min("slot").alias("start"), F.count(F.lit(1)).alias("length"), F.min("place").alias("before"))
        closing = slots.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("start")).select(
            "start", F.lit(0).cast("long").alias("length"), F.lit(count).cast("long").alias("before"))
        runs.select("start", "length", "before").unionByName(closing).write.mode("overwrite").parquet(f"{folder}/free")


def _newest() -> Column:
    return F.struct("seq", (F.col("op") == "put").alias("_put"))


def changed_slots(log: CommitLog, since: int) -> DataFrame:
    """``slot, embedding`` of the slots written by commits after the place ``since``; the embedding is null where the slot is empty now.

    The commits must not be folded yet (``CommitLog.holds``).
    """
    rows = log.tail().filter((F.col("seq") > since) & F.col("slot").isNotNull())
    last = rows.groupBy("slot").agg(F.max_by(F.struct("op", "embedding"), _newest()).alias("c"))
    return last.select("slot", F.when(F.col("c.op") == "put", F.col("c.embedding")).alias("embedding"))
