"""One-to-one assignment of large clusters by auction with scaled prices, over many tasks.

Rows of a cluster's smaller side bid for those of its larger side. A bidder knows its ``listed`` best
ones and a bound that no other exceeds, found in tiles: what a row is worth less its price is a product of two vectors.
As prices only rise, bounds stay true; a bidder whose list falls below its bound gets a new one.

A round deals bidders to blocks. A block auctions off what its bidders list among themselves, at the prices
of the round's beginning, and the highest claim on each row counts; bidders that lose it bid again. A claim made at older, lower
prices is as good as one at today's: every bidder stays within ``eps`` of its best choice.
Rounds go on until all bidders hold a row. Then the increment is made smaller and all bid again, at the prices reached.

Rows of the larger side that nobody holds must be the cheapest ones. Where they are not, as prices
are kept from one increment to the next, as many cheapest rows as stay free are raised to just above the
next one's price, as bidders to whom all rows are alike would do, and their holders bid again.

With ``n`` bidders the total is at most ``n eps`` below the best one: the best one itself where values are whole numbers
and ``n eps < 1``. No task holds more of a cluster than a tile or a block's lists; state is one row for each row of a side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from simloom.operators.similarity import packed, ranked, tiles, topk_parts
from simloom.sources.scratch import discard, stored

LISTED, BIDDERS, STEP, MOST_ROUNDS = 64, 2048, 6.0, 2000
_LISTS = "cluster int, bidder long, rows array<long>, worth array<double>, bound double"


def _lists(bidders: DataFrame, offered: DataFrame, listed: int) -> DataFrame:
    """``(cluster, bidder, rows, worth, bound)``: the best rows of each bidder by worth less price.

    ``offered`` has the ``price`` of each row. ``worth`` is without prices; no row off the list gives more than ``bound``.
    """
    blank = F.lit(0).cast("long").alias("task")
    left = bidders.select("idx", blank, F.col("cluster").cast("long").alias("grp"), "cluster", F.concat("v", F.array(F.lit(1.0))).alias("v"))
    right = offered.select("idx", blank, F.col("cluster").cast("long").alias("grp"), "cluster", F.concat("v", F.array(-F.col("price"))).alias("v"))
    kernel, merge, schema = topk_parts(listed + 1)
    near = ranked(tiles(packed(left, "cluster"), packed(right, "cluster"), kernel, schema, merge=merge), listed + 1)
    one = near.groupBy("query_idx").agg(F.sort_array(F.collect_list(F.struct("rank", "match_idx", "sim"))).alias("x"))
    kept = F.slice("x", 1, listed)
    one = one.select(F.col("query_idx").alias("bidder"), F.transform(kept, lambda r: r["match_idx"]).alias("rows"), F.transform(kept, lambda r: r["sim"]).alias("net"), F.when(F.size("x") > listed, F.element_at("x", -1)["sim"] + 1e-9).otherwise(-math.inf).alias("bound"))
    one = bidders.select("cluster", F.col("idx").alias("bidder")).join(one, "bidder")
    prices = one.select("cluster", "bidder", F.posexplode(F.arrays_zip("rows", "net")).alias("at", "x")).select("cluster", "bidder", "at", F.col("x.rows").alias("row"), F.col("x.net").alias("net"))
    prices = prices.join(offered.select("cluster", F.col("idx").alias("row"), "price"), ["cluster", "row"])
    worth = prices.groupBy("cluster", "bidder").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("net") + F.col("price")).alias("worth")))).alias("w"))
    return one.join(worth, ["cluster", "bidder"]).select("cluster", "bidder", "rows", F.transform("w", lambda r: r["worth"]).alias("worth"), "bound")


def bids(lists: np.ndarray, worth: np.ndarray, bound: np.ndarray, price: np.ndarray, holder: np.ndarray, eps: float) -> np.ndarray:
    """Auction a block's lists off among its bidders; changes ``price`` and ``holder`` and tells who needs a new list.

    ``lists``: numbers of rows, -1 where a list is shorter. ``holder``: the bidder that holds a row, -1 nobody or one of another block.
    """
    held = np.full(len(lists), -1)
    taken = np.flatnonzero(holder >= 0)
    held[holder[taken]] = taken
    stuck = np.zeros(len(lists), bool)
    free = np.flatnonzero(held < 0)
    while len(free):
        net = np.where(lists[free] >= 0, worth[free] - price[lists[free]], -np.inf)
        at = net.argmax(axis=1)
        own = np.arange(len(free))
        best = net[own, at]
        net[own, at] = -np.inf
        second = np.maximum(net.max(axis=1), bound[free])
        lost = best < bound[free]
        stuck[free[lost]] = True
        bidder, at, best, second = free[~lost], at[~lost], best[~lost], second[~lost]
        row = lists[bidder, at]
        offer = price[row] + np.where(np.isfinite(second), best - second, 0) + eps
        order = np.lexsort((bidder, -offer, row))  # the highest for each row first
        first = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(order) else order
        out = holder[row[first]]
        held[out[out >= 0]] = -1
        price[row[first]], holder[row[first]], held[bidder[first]] = offer[first], bidder[first], row[first]
        free = np.flatnonzero((held < 0) & ~stuck)
    return stuck


def _block(eps: dict[int, float]):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(part["bidder"].to_numpy(), return_inverse=True)
        rows, number = np.unique(part["row"].to_numpy(), return_inverse=True)
        width = int(part["at"].max()) + 1
        lists, worth, bound = np.full((len(names), width), -1), np.zeros((len(names), width)), np.empty(len(names))
        lists[place, part["at"]], worth[place, part["at"]], bound[place] = number, part["worth"], part["bound"]
        price, holder = np.empty(len(rows)), np.full(len(rows), -1)
        price[number] = part["price"]
        own = part["holder"].to_numpy(np.float64, na_value=np.nan)
        spot = np.searchsorted(names, np.where(np.isnan(own), 0, own).astype(np.int64)).clip(max=len(names) - 1)
        mine = ~np.isnan(own) & (names[spot] == own)
        holder[number[mine]] = spot[mine]
        before = holder.copy()
        stuck = bids(lists, worth, bound, price, holder, eps[int(key[0])])
        new = np.flatnonzero((holder >= 0) & (holder != before))
        none = np.zeros(int(stuck.sum()))
        return pd.DataFrame({"cluster": key[0], "row": np.append(rows[new], none.astype(np.int64)), "price": np.append(price[new], none), "holder": np.append(names[holder[new]], names[stuck]), "stuck": np.append(np.zeros(len(new), bool), none == 0)})

    return run


def _settled(bidders: DataFrame, offered: DataFrame, lists: DataFrame, eps: dict[int, float], listed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rounds until each bidder holds a row; gives the rows with their prices and holders, and the lists as they are then."""
    n = lists.count()
    for number in range(MOST_ROUNDS):
        held = offered.where("holder IS NOT NULL").select("cluster", F.col("holder").alias("bidder"))
        free = lists.select("cluster", "bidder").join(held, ["cluster", "bidder"], "left_anti")
        dealt = lists.withColumn("block", F.pmod(F.xxhash64("bidder", F.lit(number)), F.lit(-(-n // block))))
        # blocks whose bidders all hold a row have nothing to do
        busy = dealt.join(free, ["cluster", "bidder"]).select("cluster", "block").distinct()
        flat = dealt.join(busy, ["cluster", "block"]).select("cluster", "block", "bidder", "bound", F.posexplode(F.arrays_zip("rows", "worth")).alias("at", "x"))
        flat = flat.select("cluster", "block", "bidder", "bound", "at", F.col("x.rows").alias("row"), F.col("x.worth").alias("worth"))
        flat = flat.join(offered.select("cluster", F.col("idx").alias("row"), "price", "holder"), ["cluster", "row"])
        told = Observation()
        claims = flat.groupBy("cluster", "block").applyInPandas(_block(eps), "cluster int, row long, price double, holder long, stuck boolean")
        claims = stored(claims.observe(told, F.count_if("stuck").alias("stuck")), "auction-claims")
        best = claims.where("NOT stuck").groupBy("cluster", F.col("row").alias("idx")).agg(F.max(F.struct(F.col("price"), -F.col("holder"))).alias("x"))
        best = best.select("cluster", "idx", F.col("x.price").alias("bid"), (-F.col("x.col2")).alias("by"))
        higher = F.coalesce(F.col("bid") > F.col("price"), F.lit(False))
        now = offered.join(best, ["cluster", "idx"], "left").select("cluster", "idx", F.when(higher, F.col("bid")).otherwise(F.col("price")).alias("price"), F.when(higher, F.col("by")).otherwise(F.col("holder")).alias("holder"), "v")
        counted = Observation()
        now = stored(now.observe(counted, F.count("holder").alias("held")), "auction-rows")
        discard(offered)
        offered = now
        if counted.get["held"] == n:
            discard(claims)
            return offered, lists
        stuck = claims.where("stuck").select("cluster", F.col("holder").alias("bidder"))
        if told.get["stuck"]:
            fresh = _lists(bidders.join(stuck.withColumnRenamed("bidder", "idx"), ["cluster", "idx"], "left_semi"), offered, listed)
            now = stored(lists.join(stuck, ["cluster", "bidder"], "left_anti").unionByName(fresh), "auction-lists")
            discard(lists)
            lists = now
        discard(claims)
    raise RuntimeError(f"no assignment after {MOST_ROUNDS} rounds")


def _raised(offered: DataFrame, free: DataFrame, eps: dict[int, float]) -> DataFrame | None:
    """The rows with the cheapest ones raised and let go, in clusters where a free row is dearer than the cheapest; None if there is none."""
    spread = F.create_map(*(F.lit(x) for pair in eps.items() for x in pair))[F.col("cluster")]
    ends = offered.groupBy("cluster").agg(F.min("price").alias("low"), F.max(F.when(F.col("holder").isNull(), F.col("price"))).alias("high"))
    wrong = ends.where(F.col("high") > F.col("low") + spread * (1 + 1e-9)).select("cluster")
    if not wrong.limit(1).count():
        return None
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("price", "idx"))
    ordered = offered.join(F.broadcast(wrong), "cluster").select("cluster", "idx", "price").withColumn("nth", rank).join(F.broadcast(free), "cluster")
    ordered = stored(ordered.where("nth <= free + 1"), "auction-cheapest")
    level = ordered.where("nth = free + 1").select("cluster", (F.col("price") + spread).alias("level"))
    cheap = ordered.where("nth <= free").join(F.broadcast(level), "cluster").select("cluster", "idx", "level")
    lifted = offered.join(cheap, ["cluster", "idx"], "left")
    out = stored(lifted.select("cluster", "idx", F.coalesce("level", "price").alias("price"), F.when(F.col("level").isNull(), F.col("holder")).alias("holder"), "v"), "auction-rows")
    discard(ordered, offered)
    return out


def auction(bidders: DataFrame, rows: DataFrame, eps: float = 1e-6, listed: int = LISTED, block: int = BIDDERS) -> DataFrame:
    """``(cluster, bidder, row, value)``: one row for each bidder of its cluster, of near the largest total.

    Both sides are ``(cluster, idx, v)``, ``idx`` told apart over all clusters of its side; a cluster must not have more bidders than rows. The total of a
    cluster of ``n`` bidders is at most ``n eps`` below the largest.
    """
    bidders, rows = bidders.select("cluster", "idx", "v"), rows.select("cluster", "idx", "v")
    sizes = bidders.groupBy("cluster").count().withColumnRenamed("count", "n").join(rows.groupBy("cluster").count(), "cluster").select("cluster", "n", F.col("count").alias("m"))
    sizes = sizes.collect()  # one row for each large cluster
    if any(r["n"] > r["m"] for r in sizes):
        raise ValueError("a cluster has more bidders than rows")
    spark = bidders.sparkSession
    free = spark.createDataFrame([(r["cluster"], r["m"] - r["n"]) for r in sizes], "cluster int, free long")
    offered = stored(rows.withColumns({"price": F.lit(0.0), "holder": F.lit(None).cast("long")}).select("cluster", "idx", "price", "holder", "v"), "auction-rows")
    lists = stored(_lists(bidders, offered, listed), "auction-lists")
    found = lists.agg(F.max(F.array_max("worth")).alias("high"), F.min(F.array_min("worth")).alias("low")).first()
    span = max(eps, (found["high"] - found["low"]) / 2) if found["high"] is not None else eps
    steps = [eps * STEP**k for k in range(max(1, math.ceil(math.log(span / eps, STEP))))][::-1]
    for nth, step in enumerate(steps):
        if nth:  # lists at the prices reached
            fresh = stored(_lists(bidders, offered, listed), "auction-lists")
            discard(lists)
            lists = fresh
        own = {r["cluster"]: step for r in sizes}
        now = stored(offered.withColumn("holder", F.lit(None).cast("long")), "auction-rows")
        discard(offered)
        now = _raised(now, free, own) or now  # here all rows are free: the cheapest are as good as held
        while now is not None:
            offered, lists = _settled(bidders, now, lists, own, listed, block)
            now = _raised(offered, free, own)
    pairs = offered.where("holder IS NOT NULL").select("cluster", F.col("holder").alias("idx"), F.col("idx").alias("row"), F.col("v").alias("w"))
    value = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = stored(bidders.join(pairs, ["cluster", "idx"]).select("cluster", F.col("idx").alias("bidder"), "row", value.alias("value")), "auction-pairs")
    discard(offered, lists)
    return out
