"""Request counts per client and day, and the answer to each request as it comes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batch_counts(requests: DataFrame, limit: int = 10) -> DataFrame:
    """``client, day, n, over_quota`` for rows ``client, ts``; combines before its shuffle."""
    counts = requests.groupBy("client", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(
        "client", F.to_date("w.start").alias("day"), "n", (F.col("n") > limit).alias("over_quota")
    )


def stream_quota(stream: DataFrame, limit: int = 10, delay: str = "1 hour") -> DataFrame:
    """The same on a stream; events older than the watermark are dropped."""
    return batch_counts(stream.withWatermark("ts", delay), limit)


DAY_MS = 24 * 3600 * 1000
BUCKETS = 256


def stream_accept(stream: DataFrame, limit: int = 10, delay: str = "1 hour") -> DataFrame:
    """Every request (``client, ts`` and others) with its UTC ``day`` and ``accepted``.

    The first ``limit`` requests of a client and day are accepted as they come, those
    that come together in order of time and ``request_id``. What is kept per client and
    day is one number; clients are dealt to ``BUCKETS`` groups a day, as a call of Python for
    each client and day would cost more than its rows. It is kept until the watermark has passed the day; later requests of that day
    are dropped. A null client is a client; requests without a time belong to no day and
    are refused when their batch comes, without counting.
    """
    columns = stream.columns
    order = ["ts", *[c for c in ("request_id",) if c in columns]]
    keyed = stream.withWatermark("ts", delay).withColumn("day", F.to_date("ts"))
    keyed_columns = keyed.columns
    schema = T.StructType([*keyed.schema.fields, T.StructField("accepted", T.BooleanType())])

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, day = pickle.loads(state.get[0]) if state.exists else {}, key[-1]
        some = pd.concat(frames).sort_values(order, kind="stable")[keyed_columns]
        if day is None or pd.isna(day):
            yield some.assign(accepted=False)
            return
        place, size = _numbered(some["client"])
        known = some["client"].map(lambda c: used.get(_plain(c), 0)).to_numpy()
        yield some.assign(accepted=place + known < limit)
        used |= {c: min(limit, used.get(c, 0) + n) for c, n in size.items()}
        state.update((pickle.dumps(used),))
        over = int(pd.Timestamp(day, tz="UTC").timestamp() * 1000) + DAY_MS
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    # A null makes numbers of a frame's other clients inexact, so it is a group of its own.
    bucket = F.pmod(F.xxhash64("client"), F.lit(BUCKETS))
    dealt = keyed.withColumns({"_bucket": bucket, "_none": F.col("client").isNull()})
    grouped = dealt.groupBy("_bucket", "_none", "day")
    return grouped.applyInPandasWithState(admit, schema, "used binary", "append", GroupStateTimeout.EventTimeTimeout)


def _plain(client):
    return None if pd.isna(client) else client


def _numbered(clients: pd.Series) -> tuple[np.ndarray, dict]:
    """Each row's number among its client's rows, and how many rows a client has."""
    place = clients.groupby(clients, dropna=False).cumcount().to_numpy()
    return place, {_plain(c): int(n) for c, n in clients.value_counts(dropna=False).items()}
