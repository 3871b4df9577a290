"""Probes as a stream against a static gallery (an extension: the batch engine has no streaming operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from dapple.operators.metrics import gallery_calibration
from dapple.plans.pipelines import identify


def identify_stream(probes: DataFrame, gallery: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, k: int = 7) -> StreamingQuery:
    """Each micro-batch of probes (id, embedding) is ranked; ``sink`` gets ranks, verdicts and the batch number.

    The batch number lets a sink write idempotently, so a replayed batch
    changes nothing.  The gallery's confidence range is taken once, at the start.
    """

    band = tuple(gallery_calibration(gallery).first())

    def each(batch: DataFrame, number: int) -> None:
        ranked, verdicts = identify(batch, gallery, k, band)
        sink(ranked, verdicts, number)

    return probes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
