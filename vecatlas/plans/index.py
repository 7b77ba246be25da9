"""A cell index that is kept beside a commit log and follows its commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators.cells import CellIndex, bounded_search, build_cell_index, probed_search
from vecatlas.operators.hits import with_paths
from vecatlas.sources.commitlog import CommitLog, changed_slots
from vecatlas.sources.storage import Storage

#: Changes beside the base are folded into their cells from this share of all rows on.
FOLD = 0.1


class KeptIndex:
    """The index of a log's vectors below ``path``: built once, then fed with the slots that commits have written.

    Searches read it and write no vector. It is built anew only when commits were folded before it has seen them.
    """

    def __init__(self, log: CommitLog, path: str, cells: int = 32, metric: str = "cosine", fold: float = FOLD) -> None:
        self.log, self.path, self.cells, self.metric, self.fold = log, path.rstrip("/"), cells, metric, fold
        self._storage = Storage(log.spark)

    def _latest(self) -> tuple[int, int] | None:
        """The number of the finished build, and the last commit it has seen."""
        builds = sorted(int(n) for n in self._storage.names(self.path))
        for build in reversed(builds):
            seen = [int(n.removeprefix("seen-")) for n in self._storage.names(f"{self.path}/{build}") if n.startswith("seen-")]
            if seen:
                return build, max(seen)
        return None

    def index(self) -> CellIndex:
        """The index as it was last refreshed."""
        latest = self._latest()
        if latest is None:
            raise ValueError("the index was never refreshed")
        return CellIndex.load(self.log.spark, f"{self.path}/{latest[0]}")

    def refresh(self) -> CellIndex:
        """Bring the index up to the log's last commit."""
        latest, through = self._latest(), self.log.last()
        if latest is None or not self.log.holds(latest[1]):
            build = latest[0] + 1 if latest else 0
            self._storage.delete(f"{self.path}/{build}")  # what an interrupted build has left
            build_cell_index(self.log.vectors(), f"{self.path}/{build}", self.cells, self.metric)
            if build > 1:
                self._storage.delete(f"{self.path}/{build - 2}")  # searches may still read the last one
        else:
            build, seen = latest
            if through > seen:
                index = CellIndex.load(self.log.spark, f"{self.path}/{build}")
                index.apply(changed_slots(self.log, seen), through)
                if index.changed_share() >= self.fold:
                    index.fold()
        self._storage.touch(f"{self.path}/{build}/seen-{through}")
        return self.index()

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """``query_id, rank, slot, path, score``: exact, or over the ``nprobe`` nearest cells."""
        index = self.index()
        hits = bounded_search(index, queries, k) if nprobe is None else probed_search(index, queries, k, nprobe)
        return with_paths(hits, self.log.catalog().filter(F.col("live")))
