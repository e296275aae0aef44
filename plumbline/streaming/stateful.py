"""The causal operators as stateful streams: state per key survives restarts through Spark's checkpoint.

Points must come in order of time within a key and batch; a point older than the last one seen of its key is late and
is dropped. The adaptive radius needs the length of a series and a fill looks ahead, so the streaming shield has a
fixed radius and fills from behind only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.stabilize import Stabilizer, step

OUT = "key string, ts timestamp, value double, filtered double"


def stabilized(stream: DataFrame, conf: Stabilizer | None = None) -> DataFrame:
    """(key, ts, value, filtered) of a stream (key string, ts timestamp, value double). State: four numbers a key."""
    conf = conf or Stabilizer()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, vol, m, last = state.get if state.exists else (None, 0.0, 0.0, pd.Timestamp.min.value)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rows = rows[rows["ts"].astype("datetime64[ns]").astype("int64") >= last]
        out = []
        for x in rows["value"].to_numpy(dtype=float, na_value=np.nan):
            x = float(x) if np.isfinite(x) else float("nan")
            if p is None:
                p = m = 0.0 if np.isnan(x) else x
            else:
                p, vol, m = (float(v) for v in step(np.float64(p), np.float64(vol), np.float64(m), np.float64(x), conf, conf.threshold))
            out.append(p)
        if len(rows):
            state.update((p, vol, m, int(rows["ts"].astype("datetime64[ns]").astype("int64").iloc[-1])))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "value": rows["value"], "filtered": out})

    return stream.groupBy("key").applyInPandasWithState(run, OUT, "p double, vol double, m double, last long", "append", GroupStateTimeout.NoTimeout)


def triggered(stream: DataFrame, radius: int = 20) -> DataFrame:
    """(key, ts, value, filtered): the shield with a fixed radius; state is the last `radius` raw values of a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, seen, last = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, pd.Timestamp.min.value)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rows = rows[rows["ts"].astype("datetime64[ns]").astype("int64") >= last]
        out = []
        for x in rows["value"].to_numpy(dtype=float, na_value=np.nan):
            w = np.array(past)
            if not np.isfinite(x):
                x = float(np.median(w)) if len(w) else 0.0
            y = x = float(x)
            if seen >= 2:
                base, g = w.mean(), w[-1] - w[-2]
                s = max(float(np.diff(w).std()), 1e-6) if len(w) >= 3 else 1e-6
                d = x - base
                sign = float(np.sign(d) * np.sign(g)) if abs(d) > 1e-12 and abs(g) > 1e-12 else 0.0
                phi = min(1.0, max(0.0, 0.6 * (sign + 1) / 2 + 0.4 * (1 - abs(d) / s)))
                fired = abs(x) > 1e-12 and abs(base) > 1e-12 and abs(5 * np.clip(np.log(abs(x) / abs(base)), -5, 5) * phi) > 1e-2
                y = x if fired else float(np.median(w))
            out.append(y)
            past = [*past, x][-radius:]
            seen += 1
        if len(rows):
            state.update((past, seen, int(rows["ts"].astype("datetime64[ns]").astype("int64").iloc[-1])))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "value": rows["value"], "filtered": out})

    return stream.groupBy("key").applyInPandasWithState(run, OUT, "past array<double>, seen long, last long", "append", GroupStateTimeout.NoTimeout)
