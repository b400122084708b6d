"""Stream-static joins: a streaming input leads, static ones are joined natively; watermarks and sinks are the caller's."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from weftjoin.api import Query


def stream_query(stream_binding: str, stream: DataFrame, static: Mapping[str, DataFrame]) -> Query:
    """A query led by the stream; ``to_df()`` of it is a streaming DataFrame for ``writeStream``."""
    return Query({stream_binding: stream, **static}).plan(leftmost="default", strategy="native")
