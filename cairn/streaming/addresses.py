"""Address operators on streams.

The projections (cleaning, mapping, tagging) are stateless and run unchanged on
a stream. Matching picks the best candidate for each row and so runs on micro
batches against a static reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.match import AddressIndex, match_addresses


def match_stream(stream: DataFrame, reference: AddressIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, x_id: str = "x_id", **options) -> StreamingQuery:
    """Matches each micro batch of ``stream`` and hands the result to ``sink``;
    takes what is there and ends (``availableNow``)."""

    def batch(df: DataFrame, n: int) -> None:
        sink(match_addresses(df, reference, x_id, **options), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
