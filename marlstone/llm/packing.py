"""Filling fixed-capacity windows with items of varying length.

Karmarkar-Karp multiway differencing: every item starts as a partition of k windows with one
filled; the two partitions of largest spread are merged with their fullest windows against
each other's emptiest, until one is left. The window count starts at the least possible and
rises while a window exceeds the capacity.

Items are dealt into blocks by a hash, each block of a bounded number of windows, and each
block is packed in one task. A block wastes less than one window more than the items force,
so with 256 windows a block the whole wastes under half a percent for being split.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS_PER_BLOCK = 256
ITEMS_PER_BLOCK = 20_000


def difference_partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of the items in each of k windows of near-equal sums (Karmarkar-Karp).

    A partition is held as its filled windows, fullest first; the others are empty.
    """
    if not sizes:
        return [[] for _ in range(k)]
    if k == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[tuple[int, list]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:
            keep_a, keep_b = len(a) - over, len(b) - over
            # the emptiest filled windows of both meet; the fuller ones meet empty windows
            met = [(x[0] + y[0], [x[1], y[1]]) for x, y in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
            a, b = a[:keep_a] + met, b[:keep_b]
            a.sort(key=_sum, reverse=True)
        merged = list(heapq.merge(a, b, key=_sum, reverse=True)) if b else a
        if len(merged) == k:  # only differences matter from here on
            spread = merged[0][0] - merged[-1][0]
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    out = [_flat(x[1]) for x in heap[0][2]]
    return out + [[] for _ in range(k - len(out))]


def _sum(x: tuple[int, list]) -> int:
    return x[0]


def _flat(tree: list) -> list[int]:
    """Leaves of nested pairs, without recursion."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            stack.extend(x)
    return out


def exchange(windows: list[list[int]], sizes: list[int], capacity: int) -> bool:
    """Swap items between overfull windows and others, in place, until none is overfull.

    Each step takes the fullest window and, of all swaps that do not overfill the other side, the one whose
    difference comes closest to the excess: one item against none or one, else two against none or one, or one
    against two. Every step lowers the total excess, so the steps end by themselves. False where no swap helps
    any more.
    """
    size = np.array(sizes, dtype=np.int64)
    room = np.array([capacity - int(size[items].sum()) for items in windows], dtype=np.int64)
    owner = np.empty(len(sizes), dtype=np.int64)
    for w, items in enumerate(windows):
        owner[items] = w
    while True:
        w = int(room.argmin())
        if room[w] >= 0:
            return True
        found = _best_swap(windows, size, room, owner, w)
        if found is None:
            return False
        out, v, back = found
        for i in out:
            windows[w].remove(i)
            owner[i] = v
        for i in back:
            windows[v].remove(i)
            owner[i] = w
        windows[w] += back
        windows[v] += out
        moved = int(size[out].sum() - size[back].sum())
        room[w] += moved
        room[v] -= moved


def _best_swap(windows: list[list[int]], size: np.ndarray, room: np.ndarray, owner: np.ndarray, w: int) -> tuple[list[int], int, list[int]] | None:
    """Items of w, other window, items of it, of the best swap; the first kind of swap that ends the excess counts."""
    excess = int(-room[w])
    open_windows = np.nonzero(room > 0)[0]
    if not len(open_windows):
        return None
    free = room[open_windows]
    theirs = np.nonzero(room[owner] > 0)[0]
    their_room = room[owner[theirs]]
    mine = np.array(windows[w], dtype=np.int64)
    i, j = np.triu_indices(len(mine), 1)
    best: tuple[tuple[bool, int], list[int], int, list[int]] | None = None

    def look(sums: np.ndarray, of, took: np.ndarray, space: np.ndarray, at, back) -> bool:
        """Try all sums of mine against all of theirs, a row of mine at a time; True once the excess is ended."""
        nonlocal best
        for x, s in enumerate(sums.tolist()):
            gain = s - took
            ok = (gain > 0) & (gain <= space)
            full = ok & (gain >= excess)
            if full.any():
                y = int(np.where(full, gain, np.iinfo(np.int64).max).argmin())
                score = (True, -int(gain[y]))
            elif ok.any():
                y = int(np.where(ok, gain, -1).argmax())
                score = (False, int(gain[y]))
            else:
                continue
            if best is None or score > best[0]:
                best = (score, of(x), at(y), back(y))
            if best[0] == (True, -excess):  # nothing fits better
                return True
        return best is not None and best[0][0]

    one, two = (lambda x: [int(mine[x])]), (lambda x: [int(mine[i[x]]), int(mine[j[x]])])
    nothing = (np.zeros(len(free), dtype=np.int64), free, lambda y: int(open_windows[y]), lambda y: [])
    single = (size[theirs], their_room, lambda y: int(owner[theirs[y]]), lambda y: [int(theirs[y])])
    pairs = size[mine[i]] + size[mine[j]]
    if look(size[mine], one, *nothing) or look(size[mine], one, *single) or look(pairs, two, *nothing) or look(pairs, two, *single):
        return best[1:]
    for v in open_windows.tolist():  # two of theirs, one window at a time
        other = np.array(windows[v], dtype=np.int64)
        a, b = np.triu_indices(len(other), 1)
        if len(a) and look(size[mine], one, size[other[a]] + size[other[b]], np.full(len(a), room[v]), lambda y, v=v: v, lambda y, a=a, b=b, other=other: [int(other[a[y]]), int(other[b[y]])]):
            break
    return best[1:] if best else None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows by best fit in decreasing order: each item into the fullest window that takes it."""
    rooms: list[tuple[int, int]] = []  # (room, window), sorted
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, w = rooms.pop(at)
        else:
            room, w = capacity, len(out)
            out.append([])
        out[w].append(i)
        bisect.insort(rooms, (room - sizes[i], w))
    return out


def windows_of(sizes: list[int], capacity: int) -> tuple[list[list[int]], bool]:
    """Windows of items whose sums stay within the capacity, and whether differencing made them; every item is at most that large.

    Differencing evens the windows out; what little exceeds the capacity is exchanged, and only
    if that fails the count rises. Even windows are the wrong aim where a window holds but two
    or three items: their leftovers cannot be closed. So the count also stops rising where best
    fit needs no more windows, and its windows are then taken.
    """
    if not sizes:
        return [], True
    greedy = best_fit(sizes, capacity)
    for k in range(max(1, math.ceil(sum(sizes) / capacity)), len(greedy) + 1):
        found = difference_partition(sizes, k)
        if exchange(found, sizes, capacity):
            return [w for w in found if w], True
    return greedy, False


def pack(items: DataFrame, kinds: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens",
         windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """The container of every item, for each kind of container.

    items: one row per key, with its size (null and negative sizes count as 0); they are read
    twice, so pass a written table. Only an item above the capacity is split: into pieces that each
    fill a container, and a rest that is packed like any other item. Items of size 0 are placed
    too. Kinds without a positive capacity give no rows; no items give none.

    Returns container_kind, container_id, key, piece (from 0), start, length (in units of size), method (differencing, best-fit or whole).
    """
    kinds = [(k, int(c)) for k, c in kinds if k is not None and c and c > 0]
    out_type = f"container_kind string, container_id string, {key} {items.schema[key].dataType.simpleString()}, piece int, start long, length long, method string"
    if not kinds:
        return items.sparkSession.createDataFrame([], out_type)
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    base = items.select(F.col(key).alias("k"), n.alias("n"))
    totals = base.agg(F.count(F.lit(1)), F.sum("n")).first()
    count, total = totals[0], totals[1] or 0
    spec = [
        F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap"),
                 F.lit(max(1, math.ceil(total / (c * windows_per_block)), math.ceil(count / ITEMS_PER_BLOCK))).alias("blocks"))
        for k, c in kinds
    ]
    each = base.withColumn("s", F.explode(F.array(*spec))).select(
        "k", "n", "s.kind", "s.cap", "s.blocks", F.floor(F.col("n") / F.col("s.cap")).alias("whole"))
    whole = each.where("whole > 0").select(
        "kind", "k", "cap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece")).select(
        F.col("kind").alias("container_kind"), F.concat_ws("-", "kind", F.lit("whole"), F.col("k").cast("string"), F.col("piece").cast("string")).alias("container_id"),
        F.col("k").alias(key), F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("length"), F.lit("whole").alias("method"))
    rest = each.withColumn("rest", F.col("n") - F.col("whole") * F.col("cap")).where("rest > 0 or n = 0").select(
        "kind", "k", "cap", "rest", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("cap")).alias("start"),
        F.pmod(F.xxhash64("k", "kind"), F.col("blocks")).alias("block"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "k"], ascending=[False, True], kind="stable").reset_index(drop=True)
        windows, evened = windows_of([int(x) for x in pdf["rest"]], int(pdf["cap"].iloc[0]))
        of = np.zeros(len(pdf), dtype=np.int64)
        for w, members in enumerate(windows):
            of[members] = w
        kind, no = pdf["kind"].iloc[0], int(pdf["block"].iloc[0])
        return pd.DataFrame({
            "container_kind": pdf["kind"], "container_id": [f"{kind}-{no:06d}-{w:05d}" for w in of], key: pdf["k"],
            "piece": pdf["piece"], "start": pdf["start"], "length": pdf["rest"],
            "method": "differencing" if evened else "best-fit"})

    return rest.groupBy("kind", "block").applyInPandas(block, out_type).unionByName(whole)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, those filled by differencing, by best fit and by a piece of a larger item, pieces, units held, units in the fullest container."""
    boxes = packed.groupBy("container_kind", "container_id").agg(F.sum("length").alias("held"), F.count(F.lit(1)).alias("pieces"), F.first("method").alias("m"))
    made = lambda m: F.sum((F.col("m") == m).cast("int")).alias("n_" + m.replace("-", "_"))
    return boxes.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_containers"), made("differencing"), made("best-fit"), made("whole"), F.sum("pieces").alias("n_pieces"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
