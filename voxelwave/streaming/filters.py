"""Streaming: the two operators whose state carries over between pieces of a recording (an extension of the batch engine).

A filter's delay line is kept by channel, so a stream filtered piece by piece equals the whole recording filtered at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelwave.functions import dsp
from voxelwave.runtime import ship


def stream_filter(df: DataFrame, b, a=(1.0,), channel: str = "channel", t: str = "t", value: str = "value") -> DataFrame:
    """(channel, t, value) in, the same filtered out; samples of a batch are put in order, later batches continue."""
    ship(df.sparkSession)
    b, a = [float(x) for x in b], [float(x) for x in a]
    order = max(len(a), len(b)) - 1

    def run(key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z = np.array(state.get[0]) if state.exists else np.zeros(order)
        d = pd.concat(list(pieces)).sort_values(t)
        y, z = dsp.lfilter(b, a, d[value].to_numpy(float), z)
        state.update((z.tolist(),))
        yield pd.DataFrame({channel: key[0], t: d[t].to_numpy(), value: y})

    kind = df.schema[channel].dataType.simpleString()
    schema = f"{channel} {kind}, {t} long, {value} double"
    return df.select(channel, F.col(t).cast("long").alias(t), F.col(value).cast("double").alias(value)).groupBy(channel).applyInPandasWithState(run, schema, "z array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_power(df: DataFrame, ts: str, channel: str, value: str, width: str = "10 seconds", hop: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Mean power in sliding event-time windows, with a watermark for late samples."""
    w = F.window(ts, width, hop)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), channel).agg(F.avg(F.col(value) * F.col(value)).alias("power"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), channel, "power", "n")
