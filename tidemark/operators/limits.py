"""Anchored windows: a window opens at the first hit and lasts a fixed time, the first hit after it opens the next.

Where a window opens depends on all windows before it, back to a quiet spell as long as a window. The time of an
identity is cut into blocks of some windows. A block whose first hit follows a quiet spell begins a chain. In
any other block the chain may enter at a hit of its first window's time, or at the next hit after that; every such entry is
followed to the end of its block, which is a job by block. The hit at which the chain then enters a later block is
found by a range lookup, and entries that are on the chain by pointer doubling, so a chain of n blocks takes
log n rounds over its entries, however busy it is. What is open at the end of a block travels with the hits of the next one,
and the hits of all blocks are placed at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import staged

#: Windows of a block: what one task follows at a time, and the share of the hits that can be entries.
BLOCK_WINDOWS = 64

Place = Callable[[np.ndarray, int | None, int], tuple[np.ndarray, int | None, int]]


def anchored_window(width: int) -> Place:
    """Function that places hits of one identity, in time order, in their anchored windows.

    Made by a factory so that workers get it by value and need no copy of this package.
    """

    def place(at: np.ndarray, start: int | None, count: int) -> tuple[np.ndarray, int | None, int]:
        ranks = np.empty(len(at), dtype=np.int64)
        i = 0
        while i < len(at):
            if start is None or at[i] >= start + width:
                start, count = int(at[i]), 0
            j = i + int(np.searchsorted(at[i:], start + width, side="left"))
            ranks[i:j] = np.arange(count + 1, count + 1 + j - i)
            count += j - i
            i = j
        return ranks, start, count

    return place


def _chains(width: int, span: int):
    """Of each block the entries, and what is open at its end when the chain enters there."""

    def follow(at: np.ndarray, block: int, rooted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        following = np.searchsorted(at, at + width, side="left")
        entry = np.zeros(1, np.int64)
        if not rooted:
            early = int(np.searchsorted(at, block * span + width, side="left"))
            entry = np.arange(min(early + 1, len(at)))
            entry = entry[np.searchsorted(at, at[entry], side="left") == entry]  # one for hits of the same moment
        last = entry.copy()
        while len(live := np.flatnonzero(following[last] < len(at))):
            last[live] = following[last[live]]
        return at[entry], at[last], len(at) - last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []  # one block at a time

        def done() -> pd.DataFrame:
            identity, block, rooted = key
            entry, last, tail = follow(np.concatenate(parts), block, rooted)
            return pd.DataFrame({"identity": identity, "block": block, "rooted": rooted, "entry": entry, "last": last, "tail": tail})

        for pdf in batches:
            identity, block = pdf["identity"].to_numpy(), pdf["block"].to_numpy()
            cuts = np.flatnonzero((identity[1:] != identity[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(pdf)] if len(pdf) else []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                now = (identity[low], int(block[low]), bool(pdf["rooted"].iat[low]))
                if now != key:
                    if parts:
                        yield done()
                    key, parts = now, []
                parts.append(pdf["at"].to_numpy()[low:high])
        if parts:
            yield done()

    return run


def _entered(nodes: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """(identity, entry, block, last, tail) of the entries that are on their chain."""
    ahead = blocks.select("identity", "block", "next", "next_rooted", "after", "after_first", "after_rooted")
    leaving = nodes.join(ahead, ["identity", "block"]).where("next IS NOT NULL AND NOT next_rooted")
    probes = leaving.select("identity", F.col("next").alias("at_block"), (F.col("last") + width).alias("t"), "entry", "after_first", "after_rooted")
    places = nodes.select("identity", F.col("block").alias("at_block"), F.col("entry").alias("t"))
    both = probes.unionByName(places, allowMissingColumns=True)
    later = W.partitionBy("identity", "at_block").orderBy(F.desc("t"), F.col("entry").asc_nulls_first())
    found = both.withColumn("hit", F.min(F.when(F.col("entry").isNull(), F.col("t"))).over(later)).where("entry IS NOT NULL")
    # nothing that late in the next block: the chain enters at the first hit of the one after it
    target = F.coalesce("hit", F.when(~F.col("after_rooted"), F.col("after_first")))
    jump = staged(found.select("identity", "entry", target.alias("target")).where("target IS NOT NULL"), "jumps")
    on = staged(nodes.where("rooted").select("identity", "entry"), "entered")
    while True:
        reached = on.join(jump, ["identity", "entry"]).select("identity", F.col("target").alias("entry")).distinct()
        fresh = staged(reached.join(on, ["identity", "entry"], "left_anti"), "entered")
        if fresh.isEmpty():
            break
        on = staged(on.unionByName(fresh), "entered")
        twice = jump.select("identity", F.col("entry").alias("target"), F.col("target").alias("further"))
        jump = staged(jump.join(twice, ["identity", "target"]).select("identity", "entry", F.col("further").alias("target")), "jumps")
    return nodes.join(on, ["identity", "entry"], "left_semi").select("identity", "entry", "block", "last", "tail")


def _carried(rows: DataFrame, width: int, span: int) -> DataFrame | None:
    """(identity, block, start, count): the window that is open when a block begins. None if all blocks begin anew."""
    order = W.partitionBy("identity").orderBy("block")
    blocks = rows.groupBy("identity", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("hits"))
    blocks = blocks.withColumn("rooted", F.coalesce(F.col("first") - F.lag("last").over(order) >= width, F.lit(True)))
    for name, step in (("next", 1), ("after", 2)):
        blocks = blocks.withColumn(name, F.lead("block", step).over(order)).withColumn(f"{name}_first", F.lead("first", step).over(order))
        blocks = blocks.withColumn(f"{name}_rooted", F.lead("rooted", step).over(order))
    blocks = staged(blocks.where("NOT rooted OR NOT coalesce(next_rooted, true)"), "blocks")
    if blocks.isEmpty():
        return None
    hits = rows.join(blocks.select("identity", "block", "rooted"), ["identity", "block"]).select("identity", "block", "rooted", "at")
    dealt = hits.repartition("identity", "block").sortWithinPartitions("identity", "block", "at")
    found = dealt.mapInPandas(_chains(width, span), "identity string, block long, rooted boolean, entry long, last long, tail long")
    nodes = staged(found, "chains")
    entered = _entered(nodes, blocks, width).groupBy("identity", "block").agg(F.min_by(F.struct("last", "tail"), "entry").alias("open"))
    known = blocks.select("identity", "block", "rooted", "hits").join(entered, ["identity", "block"], "left")
    before, one, hits_before = F.lag("open").over(order), F.lag("open", 2).over(order), F.lag("hits").over(order)
    # a block without an entry lies in the window that was open before it
    skipped = F.struct(one["last"].alias("last"), (one["tail"] + hits_before).alias("tail"))
    state = known.withColumn("state", F.when(before.isNotNull(), before).otherwise(skipped))
    return state.where("NOT rooted").select("identity", "block", F.col("state.last").alias("start"), F.col("state.tail").alias("count"))


def _placed(width: int, limit: int):
    place = anchored_window(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = None, None, 0
        for pdf in batches:  # by block: first the window that is open, if one is, then the hits
            identity, block, opens = (pdf[c].to_numpy() for c in ("identity", "block", "opens"))
            cuts = np.flatnonzero((identity[1:] != identity[:-1]) | (block[1:] != block[:-1]) | opens[:-1]) + 1
            at, ids, ranks = pdf["at"].to_numpy(), pdf["event_id"].to_numpy(), np.zeros(len(pdf), np.int64)
            bounds = [0, *cuts.tolist(), len(pdf)] if len(pdf) else []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                now = (identity[low], int(block[low]))
                if now != key:
                    key, start, count = now, None, 0
                if opens[low]:
                    start, count = int(at[low]), int(ids[low])
                else:
                    ranks[low:high], start, count = place(at[low:high], start, count)
            out = pd.DataFrame({"identity": identity, "event_id": ids, "place": ranks, "rejected": ranks > limit})
            yield out[~opens]

    return run


def rate_limit(hits: DataFrame, limit: int, window_seconds: int = 60, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Hits (identity, ts, event_id) with their place in the anchored window and the rejection.

    Hits without an identity are left out. A task holds the times of one identity in ``block_windows`` windows.
    """
    width = int(window_seconds) * 1_000_000
    span = width * block_windows
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = hits.where("identity IS NOT NULL").select(F.col("identity").cast("string").alias("identity"), F.col("event_id").cast("long").alias("event_id"), at.alias("at"))
    rows = rows.withColumn("block", F.floor(F.col("at") / span).cast("long"))
    carried = _carried(rows, width, span)
    both = rows.select("identity", "block", F.lit(False).alias("opens"), "at", "event_id")
    if carried is not None:  # a row with the window's start, and its hits so far in place of an id
        both = both.unionByName(carried.select("identity", "block", F.lit(True).alias("opens"), F.col("start").alias("at"), F.col("count").alias("event_id")))
    dealt = both.repartition("identity", "block").sortWithinPartitions("identity", "block", F.desc("opens"), "at", "event_id")
    return dealt.mapInPandas(_placed(width, limit), "identity string, event_id long, place long, rejected boolean")
