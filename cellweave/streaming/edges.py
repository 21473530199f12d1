"""Edge streams: running graph operators over rising scales."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transition_edges(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of event types of each user by window; rows later than the watermark are dropped by Spark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "user_id", "event_type").agg(F.count("*").alias("n"))


def l0_trace(edges: DataFrame) -> DataFrame:
    """(cloud_id, scale, n_edges, trace, n_components, refused) after each batch of edges(cloud_id, src, dst, birth).

    The state of a cloud is its scale and a forest of its vertices. Scales must not fall: an
    edge born below the scale that the cloud has reached is refused and leaves the state as it is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scale, n, names, parents = state.get if state.exists else (float("-inf"), 0, [], [])
        at, parent, refused = {v: i for i, v in enumerate(names)}, list(parents), 0

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        rows = pd.concat(list(frames))
        known = rows.birth >= scale
        refused = int((~known).sum())
        for r in rows[known].itertuples():
            for v in (r.src, r.dst):
                if v not in at:
                    at[v] = len(parent)
                    parent.append(len(parent))
            parent[find(at[r.dst])] = find(at[r.src])
            n += 1
        if known.any():
            scale = float(rows.birth[known].max())
        state.update((scale, n, list(at), parent))
        yield pd.DataFrame({"cloud_id": [key[0]], "scale": [scale], "n_edges": [n], "trace": [2 * n], "n_components": [sum(find(x) == x for x in range(len(parent)))], "refused": [refused]})

    out = "cloud_id string, scale double, n_edges long, trace long, n_components long, refused long"
    kept = "scale double, n long, names array<string>, parents array<int>"
    rows = edges.select(F.col("cloud_id").cast("string").alias("cloud_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "birth")
    return rows.groupBy("cloud_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
