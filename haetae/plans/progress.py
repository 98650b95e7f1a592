"""How far a run has come: files, findings and errors, counted while they pass by."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _metrics(results: DataFrame) -> list[Any]:
    """What is counted of the results of ``process``, or of findings if these are what ``results`` holds."""
    if "findings" not in results.columns:
        return [F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("confirmed", "suspicious", "already_masked")]]
    errors = F.count_if(F.col("error").isNotNull()) if "error" in results.columns else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"), errors.alias("errors")]


def observed(results: DataFrame, name: str = "haetae") -> tuple[DataFrame, Observation]:
    """``results`` with its counts taken on the way, without another pass; the observation has them once an action is over."""
    counts = Observation(name)
    return results.observe(counts, *_metrics(results)), counts


def observed_stream(results: DataFrame, name: str = "haetae") -> DataFrame:
    """A stream with its counts taken per micro-batch, for a ``Watch`` of that name."""
    return results.observe(name, *_metrics(results))


@dataclass
class Watch(StreamingQueryListener):
    """Counts of the micro-batches of streams observed under ``name``, as they end.

    ``batches`` has (query, batch, counts); a batch that is reported again, after a restart, counts once in ``total``.
    """

    name: str = "haetae"
    batches: list[tuple[str, int, dict[str, int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__()
        self._lock = threading.Lock()

    def attach(self, spark: SparkSession) -> Watch:
        spark.streams.addListener(self)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def total(self) -> dict[str, int]:
        with self._lock:
            last = {(query, batch): counts for query, batch, counts in self.batches}
        out: dict[str, int] = {}
        for counts in last.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802  the listener's own names
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            with self._lock:
                self.batches.append((str(event.progress.id), event.progress.batchId, {k: v or 0 for k, v in seen.asDict().items()}))

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass
