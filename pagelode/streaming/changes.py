"""Stateful streams: version deltas for each key, settling of page mutations, and re-indexing of changed pages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.config import DEFAULTS, DeltaConfig

DELTA = "key string, version string, mode string, fields string, dropped array<string>"


def content_mark(payload: dict) -> str:
    """A mark of a payload's content; its own marks (names with _) don't count."""
    plain = {k: v for k, v in payload.items() if not k.startswith("_")}
    return hashlib.md5(json.dumps(plain, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def delta(history: list[tuple[str, dict]], payload: dict, since: str | None, most: int) -> tuple[list[tuple[str, dict]], dict]:
    """The new history, and what to send: unchanged, the fields that differ, or all of it."""
    version = content_mark(payload)
    known = dict(history).get(since) if since else None
    history = [(v, p) for v, p in history if v != version][-(most - 1) :] + [(version, payload)]
    if known is None:
        return history, {"version": version, "mode": "full", "fields": payload, "dropped": []}
    if since == version:
        return history, {"version": version, "mode": "unchanged", "fields": {}, "dropped": []}
    fields = {k: v for k, v in payload.items() if not k.startswith("_") and known.get(k) != v}
    return history, {"version": version, "mode": "partial", "fields": fields, "dropped": sorted(k for k in known if not k.startswith("_") and k not in payload)}


def payload_deltas(stream: DataFrame, cfg: DeltaConfig = DEFAULTS.delta) -> DataFrame:
    """stream (key, ord, payload as a JSON object) to a delta of each payload against the one before; works on batches too.

    State holds a key's last versions, as many as the configuration says.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for payload in rows["payload"]:
            since = history[-1][0] if history else None
            history, sent = delta(history, json.loads(payload or "{}"), since, cfg.history)
            out.append((key[0], sent["version"], sent["mode"], json.dumps(sent["fields"], sort_keys=True, ensure_ascii=False), sent["dropped"]))
        state.update((json.dumps(history, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=["key", "version", "mode", "fields", "dropped"])

    return stream.groupBy("key").applyInPandasWithState(step, DELTA, "history string", "append", GroupStateTimeout.NoTimeout)


def settled(events: DataFrame, key: str = "user_id", ts: str = "ts", quiet: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """(key, start, end, events): bursts of events that a quiet time ends; with `late`, a watermark for streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    bursts = rows.groupBy(F.col(key), F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("events"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def changed_pages(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pages of `now` that are new or whose html differs from `before`; whole texts are compared, not marks."""
    old = before.select("page_id", F.col("html").alias("_old"), F.lit(True).alias("_known"))
    rows = now.join(old, "page_id", "left")
    return rows.where(F.col("_known").isNull() | ~F.col("html").eqNullSafe(F.col("_old"))).drop("_old", "_known")


def reindex_stream(pages: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch's last version of each page to `publish`, with the batch's number.

    A batch is replayed with the same number after a failure, so publish() can refuse one that it has already taken.
    """

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("page_id").agg(F.max_by(F.struct("url", "html"), "version").alias("p"))
        publish(last.select("page_id", "p.url", "p.html"), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
