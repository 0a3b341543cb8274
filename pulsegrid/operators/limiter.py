"""Fixed-window request limiter over a request log.

The first request of a client opens a window of one minute; up to ``limit`` requests in it pass, the
others are rejected but still counted; the first request at or after its end opens the next. Windows
are chained, so a client's log is sequential -- but only through its window starts. The plan keeps
every group bounded however busy a client is:

1. combine requests per (client, millisecond);
2. per (client, hour) tabulate "if the open window ends at t, when does the last window of this hour
   end" -- a step function with at most one step per millisecond of the first minute;
3. step functions compose: per (client, group of hours) chain them into one, in parallel; per client walk
   only those of the groups, then, in parallel again, look the hours of each group up;
4. per (client, hour) lay out the windows; number the requests inside each window.

A missing client counts as the one that unnamed requests get, a missing path is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.web import client_or_default, gated
from pulsegrid.operators.ordered import running_before
from pulsegrid.session import materialise

LIMIT = 1000  # fixed value: requests per window
WINDOW_MS = 60_000  # fixed value
CHUNK_MS = 3_600_000
CHUNKS = 32  # chunks whose tables are chained into one
NO_WINDOW = -1


def _next_index(times: np.ndarray, index: np.ndarray, window: int) -> np.ndarray:
    """Where the window after the one opened at each index starts (len(times) when none does)."""
    return np.searchsorted(times, times[index] + window, side="left")


def window_transitions(times: np.ndarray, chunk_start: int, window: int = WINDOW_MS) -> tuple[np.ndarray, np.ndarray]:
    """Step function of a chunk: an incoming window end in ``(upto[i-1], upto[i]]`` leads to ``out[i]``.
    Ends beyond the last step pass through unchanged. An incoming window was opened by ``chunk_start``."""
    starts = np.arange(np.searchsorted(times, chunk_start + window, side="left") + 1)
    starts = starts[starts < len(times)]
    last = starts.copy()
    active = np.arange(len(starts))
    while len(active):
        nxt = _next_index(times, last[active], window)
        more = nxt < len(times)
        active = active[more]
        last[active] = nxt[more]
    out = times[last] + window
    keep = np.append(out[1:] != out[:-1], True)
    return times[starts][keep], out[keep]


def window_anchors(times: np.ndarray, free_at: int | None, window: int = WINDOW_MS) -> np.ndarray:
    """Start of the window each time falls into, given the end of the window open before."""
    i = 0
    anchors = np.empty(len(times), dtype=np.int64)
    if free_at is not None:
        i = int(np.searchsorted(times, free_at, side="left"))
        anchors[:i] = free_at - window
    while i < len(times):
        j = int(np.searchsorted(times, times[i] + window, side="left"))
        anchors[i:j] = times[i]
        i = j
    return anchors


def compose(tables: list[tuple[np.ndarray, np.ndarray]], window: int = WINDOW_MS) -> tuple[np.ndarray, np.ndarray]:
    """One step function for consecutive ones, as far as a window opened before the first can reach."""
    upto, out = tables[0]
    reach = upto[0] + window
    for later, ends in tables[1:]:
        at = np.searchsorted(later, out, side="left")
        out = np.where(at < len(later), ends[np.minimum(at, len(later) - 1)], out)
        # an end beyond the first table still meets the later ones
        beyond = (later > upto[-1]) & (upto[-1] < reach)
        upto, out = np.concatenate([upto, later[beyond]]), np.concatenate([out, ends[beyond]])
    needed = int(np.searchsorted(upto, reach, side="left")) + 1
    upto, out = upto[:needed], out[:needed]
    keep = np.append(out[1:] != out[:-1], True)
    return upto[keep], out[keep]


def sorted_groups(batches: Iterator[pd.DataFrame],
                  keys: Sequence[str]) -> Iterator[list[tuple[tuple, dict[str, np.ndarray]]]]:
    """Complete groups out of batches sorted by ``keys``; only the group at a batch edge is held."""
    held: list[pd.DataFrame] = []

    def split(b: pd.DataFrame):
        columns = {c: b[c].to_numpy() for c in b.columns}
        changed = np.zeros(len(b) - 1, dtype=bool)
        for k in keys:
            changed |= columns[k][1:] != columns[k][:-1]
        edges = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(b)]])
        return [(tuple(columns[k][i] for k in keys), {c: v[i:j] for c, v in columns.items()})
                for i, j in zip(edges[:-1], edges[1:])], edges

    for b in batches:
        if b.empty:
            continue
        if held and all(b[k].iloc[-1] == held[0][k].iloc[0] for k in keys):
            held.append(b)  # the group goes on: put together once, when it ends
            continue
        b = pd.concat([*held, b], ignore_index=True)
        groups, edges = split(b)
        held = [b.iloc[edges[-2]:]]
        if len(groups) > 1:
            yield groups[:-1]
    if held:
        yield split(pd.concat(held, ignore_index=True))[0]


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})


def rate_limit(requests: DataFrame, *, limit: int = LIMIT, window_ms: int = WINDOW_MS,
               path: str | None = "path", chunk_ms: int = CHUNK_MS, chunks: int = CHUNKS,
               carried: DataFrame | None = None, anchors: bool = False) -> DataFrame:
    """Adds ``allowed`` and ``window_count`` (NULL for paths the limiter leaves alone) to
    ``(event_id, client_id, ts, ...)``; with ``anchors`` also the client's name ``limited_client`` and the
    ``anchor`` of the window. Requests of a client are ordered by (millisecond, event_id).

    ``carried`` holds ``(client, anchor, used)``, the window each client has open from earlier requests; one
    that arrives behind its start counts into it.
    """
    stamped = requests.withColumns({"_client": client_or_default(F.col("client_id")), "_ms": F.unix_millis("ts")})
    checked: Column = F.coalesce(gated(F.col(path)), F.lit(True)) if path else F.lit(True)
    counted = stamped.filter(checked)
    if carried is not None:
        opened = carried.select(F.col("client").alias("_client"), F.col("anchor").alias("_open"), F.col("used").alias("_used"))
        counted = counted.join(opened, "_client", "left").withColumn("_ms", F.greatest("_ms", "_open"))
    else:
        counted = counted.withColumns({"_open": F.lit(None).cast("long"), "_used": F.lit(None).cast("long")})
    # narrow and read by every later step: written down so that the log is scanned twice in all
    blocks = materialise(counted.groupBy("_client", "_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_open").alias("_open"), F.max("_used").alias("_used")))
    chunk = F.floor(F.col("_ms") / chunk_ms)
    times = blocks.select("_client", "_ms", chunk.alias("_chunk"), F.floor(chunk / chunks).alias("_group"), "_open")

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in sorted_groups(batches, ["_client", "_chunk"]):
            parts = []
            for (client, at), g in groups:
                upto, out = window_transitions(g["_ms"], int(g["_ms"][0]), window_ms)
                parts.append((np.repeat(client, len(out)), np.repeat(g["_group"][0], len(out)), np.repeat(at, len(out)), upto, out))
            yield _frame(parts, ["_client", "_group", "_chunk", "upto", "out"])

    def tables_of(g: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        first = np.flatnonzero(np.append(True, g["_chunk"][1:] != g["_chunk"][:-1]))
        last = np.append(first[1:], len(g["_chunk"]))
        return g["_chunk"][first], [(g["upto"][i:j], g["out"][i:j]) for i, j in zip(first, last)]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in sorted_groups(batches, ["_client", "_group"]):
            parts = []
            for (client, group), g in groups:
                upto, out = compose(tables_of(g)[1], window_ms)
                parts.append((np.repeat(client, len(out)), np.repeat(group, len(out)), upto, out))
            yield _frame(parts, ["_client", "_group", "upto", "out"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, free, settled = None, NO_WINDOW, True
        for b in batches:
            rows = []
            for client, group, upto, out, start in zip(b["_client"], b["_group"], b["upto"], b["out"], b["_start"]):
                if at is None or client != at[0]:
                    free = start
                if (client, group) != at:
                    at, settled = (client, group), False
                    rows.append((client, group, free))
                if not settled and (free == NO_WINDOW or free <= upto):
                    free, settled = out, True
            yield pd.DataFrame(rows, columns=["_client", "_group", "_free"])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in sorted_groups(batches, ["_client", "_group"]):
            parts = []
            for (client, _), g in groups:
                names, tables = tables_of(g)
                free, entered = int(g["_free"][0]), []
                for upto, out in tables:
                    entered.append(free)
                    i = 0 if free == NO_WINDOW else int(np.searchsorted(upto, free, side="left"))
                    free = int(out[i]) if i < len(upto) else free
                parts.append((np.repeat(client, len(names)), names, np.array(entered)))
            yield _frame(parts, ["_client", "_chunk", "_free"])

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in sorted_groups(batches, ["_client", "_chunk"]):
            parts = []
            for (client, _), g in groups:
                free = g["_free"][0]
                placed = window_anchors(g["_ms"], None if free == NO_WINDOW else int(free), window_ms)
                parts.append((np.repeat(client, len(placed)), g["_ms"], placed))
            yield _frame(parts, ["_client", "_ms", "_anchor"])

    def arranged(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
        # dealt by a column of its own: Spark leaves a repartition out where a join has dealt by the same keys before, and
        # may later replace that join by a broadcast, after which a group's rows lie in several partitions
        dealt = df.withColumn("_deal", F.xxhash64(*keys)).repartition("_deal")
        return dealt.sortWithinPartitions(*keys, *order).drop("_deal")

    one, several = ["_client", "_chunk"], ["_client", "_group"]
    steps = materialise(arranged(times.drop("_open"), one, "_ms").mapInPandas(
        tabulate, "_client string, _group long, _chunk long, upto long, out long"))
    chained = arranged(steps, several, "_chunk", "upto").mapInPandas(chain, "_client string, _group long, upto long, out long")
    starts = times.groupBy("_client").agg(F.coalesce(F.max("_open") + window_ms, F.lit(NO_WINDOW)).alias("_start"))
    free = arranged(chained.join(starts, "_client"), ["_client"], "_group", "upto").mapInPandas(
        walk, "_client string, _group long, _free long")
    entries = arranged(steps.join(free, several), several, "_chunk", "upto").mapInPandas(enter, "_client string, _chunk long, _free long")
    entered = times.drop("_open").join(entries, one)
    laid = arranged(entered, one, "_ms").mapInPandas(lay_out, "_client string, _ms long, _anchor long")
    group = ["_client", "_ms"]
    placed = running_before(blocks.join(laid, group), ["_client", "_anchor"], ["_ms"], "_n", "_before")
    placed = placed.withColumn("_before", F.col("_before") + F.when(F.col("_anchor") == F.col("_open"), F.col("_used")).otherwise(0))

    # a millisecond of a client, not a client, is a window's partition
    ranked = counted.drop("_open", "_used").withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy("event_id")))
    count = F.col("_before") + F.col("_rn")
    more = [F.col("_client").alias("limited_client"), F.col("_anchor").alias("anchor")] if anchors else []
    decided = ranked.join(placed.select(*group, "_before", "_anchor"), group).select(
        *requests.columns, count.cast("long").alias("window_count"), (count <= limit).alias("allowed"), *more)
    passed = stamped.filter(~checked).select(
        *requests.columns, F.lit(None).cast("long").alias("window_count"), F.lit(True).alias("allowed"),
        *([F.lit(None).cast("string").alias("limited_client"), F.lit(None).cast("long").alias("anchor")] if anchors else []))
    return decided.unionByName(passed) if path else decided
