"""Gray rewrite of requests as they arrive.

A request carries its id, its text and the colour spaces it may name, and is answered by id: a result or an
error. The rewrite lives inside the row, so the stream needs no state, watermark or shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagetone.operators.rewrite import rewrite_streams

REQUEST_SCHEMA = ("id bigint, text string, cs_map map<string,struct<type:string,fn_n:double,c0:array<double>,"
                  "c1:array<double>,alt:string>>")


def gray_replies(requests: DataFrame, gain: int = 0) -> DataFrame:
    """Replies to a (streaming or static) table of requests."""
    return rewrite_streams(requests, gain).select("id", "gray_text", "n_rewritten", "error")


def start_replies(requests: DataFrame, path: str, checkpoint: str, gain: int = 0) -> StreamingQuery:
    """Answer everything that has arrived, exactly once, into Parquet files."""
    return (gray_replies(requests, gain).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
