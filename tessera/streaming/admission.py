"""Online admission as a stateful stream, and windows over event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.crawl import Admission


#: Rows that one result chunk of a site has.
CHUNK = 10_000


def admit(urls: DataFrame, ratios: list[float], cum_shares: list[float], shares: list[float], by_cluster: dict[int, float], quota: int) -> DataFrame:
    """Stream (site, rec_id, cluster) to ``site, rec_id, fetched``; the state of each site survives restarts.

    Urls are decided trigger by trigger, within a trigger by rec_id; limit the rows of a trigger at the source.
    """

    def run(key, batches, state):
        gate = Admission(ratios, cum_shares, shares, quota)
        if state.exists:
            gate.restore(state.get)
        # a site's new urls of one trigger are decided in the order of their ids, whatever chunks they arrive in
        arrived = pd.concat(list(batches)).sort_values("rec_id", kind="stable")
        for at in range(0, len(arrived), CHUNK):
            pdf = arrived.iloc[at : at + CHUNK]
            fetched = [gate.fetch(by_cluster.get(c, 0.0)) for c in pdf["cluster"]]
            yield pd.DataFrame({"site": pdf["site"], "rec_id": pdf["rec_id"], "fetched": fetched})
        state.update(gate.state())

    return urls.groupBy("site").applyInPandasWithState(run, "site string, rec_id bigint, fetched boolean", "used int, tried int, at int, border double", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per window; with ``late`` the stream's watermark."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, n`` of each user's sessions, closed by ``gap`` of silence."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
