"""Greedy acceptance of boxes in confidence order, per group.

Rows of a group are visited in a total order. Each row looks for the first
accepted row it collides with. A plain collision drops the row; a takeover
collision puts the row in that place; no collision appends it.

Groups up to ``fold_rows`` rows are one sorted array and one fold. Larger
groups are never collected. Their rows are numbered in order, and then worked
off in rounds that stay exact:

* the first ``head_rows`` remaining rows of each group (cut on the map side)
  are played onto the accepted list so far;
* all later rows are tested against that list, in chunks spread over tasks. A
  row whose first collision is a plain one is settled as dropped if that place
  can not be taken over any more, or not before the row: the place's next
  possible taker, among the remaining rows, comes later;
* the rest goes to the next round.

Copies and near-copies, which make a group hot, go in the first rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.operators.grid import Grid, close_pairs
from panelflow.operators.skew import first_rows, numbered, salted_lookup, split_hot
from panelflow.session import cut

FOLD_ROWS = 1000
HEAD_ROWS = 20_000
CHUNK_ROWS = 100_000
BOX = ["x", "y", "w", "h"]


@dataclass(frozen=True)
class Rule:
    """When box r collides with accepted box k: their shared area over the union (or over
    the smaller box) is above ``drop_over``; or it is above ``take_over`` and only r has a mask."""

    over_union: bool
    drop_over: float
    take_over: float | None = None

    def share(self, k: Column, r: Column) -> Column:
        return g.iou(k, r) if self.over_union else g.overlap_min(k, r)

    def drops(self, k: Column, r: Column) -> Column:
        return self.share(k, r) > self.drop_over


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(start: Column, rows: Column, rule: Rule) -> Column:
    def step(accepted: Column, row: Column) -> Column:
        appended = F.concat(accepted, F.array(row))
        if rule.take_over is None:
            return F.when(F.exists(accepted, lambda k: rule.drops(k, row)), accepted).otherwise(appended)

        def kind(k: Column) -> Column:
            """0: no collision, 1: takeover, 2: plain; the overlap of a pair is computed once."""
            return _bound(rule.share(k, row), lambda s: F.when(s > rule.drop_over, 2).when(
                (s > rule.take_over) & row["has_mask"] & ~k["has_mask"], 1).otherwise(0))

        def settle(kinds: Column, place: Column) -> Column:
            replaced = F.transform(accepted, lambda k, i: F.when(i + 1 == place, row).otherwise(k))
            return F.when(place == 0, appended).when(F.get(kinds, place.cast("int") - 1) == 2, accepted).otherwise(replaced)

        return _bound(F.transform(accepted, kind), lambda kinds: _bound(
            F.array_position(F.transform(kinds, lambda c: c > 0), F.lit(True)), lambda place: settle(kinds, place)))

    return F.aggregate(rows, start, step)


def greedy(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    rule: Rule,
    never: Column | None = None,
    fold_rows: int = FOLD_ROWS,
    position: str | None = None,
    **hot_kw,
) -> DataFrame:
    """Rows of ``df`` that stay accepted, with their place in the accepted list as column ``position`` if named;
    see ``greedy_lists``.
    """
    lists, hot = greedy_lists(df, keys, order, rule, never, fold_rows, **hot_kw)
    accepted = lists.select(*keys, F.posexplode("__rows").alias("__pos", "__row"))
    if hot is not None:
        accepted = accepted.unionByName(hot)
    return placed_rows(accepted, df.columns, keys, position)


def placed_rows(accepted: DataFrame, columns: list[str], keys: list[str], position: str | None = None) -> DataFrame:
    """Accepted rows (keys, __pos, __row) with their own columns again."""
    place = [F.col("__pos").alias(position)] if position else []
    return accepted.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns], *place)


def greedy_lists(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    rule: Rule,
    never: Column | None = None,
    fold_rows: int = FOLD_ROWS,
    **hot_kw,
) -> tuple[DataFrame, DataFrame | None]:
    """The accepted list of each ordinary group (keys, __rows), and the accepted rows of hot groups
    (keys, __pos, __row), None when there are none.

    ``keys`` must not be null. ``order`` are ascending sort columns (negate for descending), or names
    of columns, which are carried once; the other columns break ties. ``never`` marks rows that cannot collide with anything; in
    hot groups they are kept without being played, in their place. A null mask counts as none.
    ``hot_kw`` goes to the rounds.
    """
    if rule.take_over is not None:
        df = df.withColumn("has_mask", F.coalesce("has_mask", F.lit(False)))
    payload = [c for c in df.columns if c not in keys and c not in [o for o in order if isinstance(o, str)]]
    rows = df.select(*keys, F.struct(
        *[c if isinstance(c, str) else c.alias(f"__o{i}") for i, c in enumerate(order)], *payload
    ).alias("__row"), (F.lit(False) if never is None else F.coalesce(never, F.lit(False))).alias("__never"))
    normal, hot = split_hot(rows, keys, fold_rows)
    empty = F.array().cast(f"array<{rows.schema['__row'].dataType.simpleString()}>")
    # A list of one row is as it stays.
    lists = normal.groupBy(*keys).agg(F.collect_list("__row").alias("__rows")).select(
        *keys, F.when(F.size("__rows") < 2, F.col("__rows")).otherwise(_fold(empty, F.sort_array("__rows"), rule)).alias("__rows"))
    return lists, None if hot is None else _rounds(hot, keys, rule, **hot_kw)


def _kernels(over_union: bool, drop_over: float, take_over: float | None):
    """The two array functions that run inside tasks; they carry plain values only."""

    def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Share of each box of a with the box of b in the same row."""
        dx = np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        dy = np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        both, one, other = dx * dy, a[:, 2] * a[:, 3], b[:, 2] * b[:, 3]
        base = one + other - both if over_union else np.minimum(one, other)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((dx > 0) & (dy > 0) & (base > 0), both / base, 0.0)

    def play(group: pd.DataFrame) -> pd.DataFrame:
        """Head rows (pos null) played in order onto the slots (pos set)."""
        slots, head = group[group["pos"].notna()].sort_values("pos"), group[group["pos"].isna()].sort_values("n")
        m = len(slots)
        boxes = np.zeros((m + len(head), 4))
        masks, owner, opened = np.zeros(len(boxes), bool), np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
        boxes[:m], masks[:m], owner[:m], opened[:m] = slots[["x", "y", "w", "h"]].to_numpy(float), slots["m"], slots["n"], slots["opened"]
        grid = Grid(boxes[:m])
        for box, mask, n in zip(head[["x", "y", "w", "h"]].to_numpy(float), head["m"].to_numpy(bool), head["n"].to_numpy()):
            close = grid.close(box.tolist())
            share = shares(boxes[close], box[None, :])
            hit = share > drop_over
            if take_over is not None and mask:
                hit = hit | ((share > take_over) & ~masks[close])
            first = int(hit.argmax()) if len(close) else 0
            if not len(close) or not hit[first]:
                at, m = m, m + 1
                opened[at] = n
            elif share[first] > drop_over:
                continue
            else:
                at = int(close[first])
                grid.remove(at, boxes[at].tolist())
            boxes[at], masks[at], owner[at] = box, mask, n
            grid.add(at, box.tolist())
        out = pd.DataFrame(boxes[:m], columns=["x", "y", "w", "h"])
        return out.assign(m=masks[:m], n=owner[:m], pos=np.arange(m, dtype=np.int64), opened=opened[:m])

    def test(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        """Rows not settled by the slots: pos is the place a row waits on (-1: none). Also, as rows
        with n null, each open place's first possible taker in column ``taker``."""
        slots = slots.sort_values("pos")
        k, closed = slots[["x", "y", "w", "h"]].to_numpy(float), slots["m"].to_numpy(bool)
        rows = rows.sort_values("n")
        r, masks, n = rows[["x", "y", "w", "h"]].to_numpy(float), rows["m"].to_numpy(bool), rows["n"].to_numpy()
        waits_on = np.full(len(rows), -1, np.int64)
        settled = np.zeros(len(rows), bool)
        taker = np.full(len(slots), np.iinfo(np.int64).max)
        i, j = close_pairs(r, k)
        share = shares(k[j], r[i])
        drop = share > drop_over
        take = np.zeros_like(drop)
        if take_over is not None:
            take = ~drop & (share > take_over) & masks[i] & ~closed[j]
        row, first = np.unique(i[drop | take], return_index=True)  # a row's first place, as pairs are in order
        first = np.flatnonzero(drop | take)[first]
        plain = drop[first]
        waits_on[row[plain]] = j[first[plain]]
        settled[row[plain]] = closed[j[first[plain]]] if take_over is not None else True
        open_pairs = take & ~settled[i]
        np.minimum.at(taker, j[open_pairs], n[i[open_pairs]])
        left = rows[~settled].assign(pos=waits_on[~settled], taker=pd.array([None] * int((~settled).sum()), "Int64"))
        turning = np.flatnonzero(taker < np.iinfo(np.int64).max)
        marks = pd.DataFrame({"pos": turning, "taker": pd.array(taker[turning], "Int64")})
        return pd.concat([left, marks.reindex(columns=left.columns)], ignore_index=True)

    return play, test


def _rounds(hot: DataFrame, keys: list[str], rule: Rule, head_rows: int = HEAD_ROWS,
            chunk_rows: int = CHUNK_ROWS, **number_kw) -> DataFrame:
    ranked = cut(numbered(hot, keys, [F.col("__row")], "__n", **number_kw))
    mask = F.col("__row.has_mask") if rule.take_over is not None else F.lit(False)
    rest = ranked.filter("NOT __never").select(*keys, F.col("__n").alias("n"), *[F.col(f"__row.{c}").cast("double").alias(c) for c in BOX],
                         mask.alias("m"))
    play, test = _kernels(rule.over_union, rule.drop_over, rule.take_over)
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema.fields}
    names = [*keys, "n", *BOX, "m"]
    slot_type = ", ".join(f"{c} {kinds[c]}" for c in names) + ", pos long, opened long"
    test_type = slot_type.replace("opened", "taker")
    width = len(keys)

    def keyed(fn):
        """Put the group's key back on the rows a kernel returns."""
        def run(key: tuple, *frames: pd.DataFrame) -> pd.DataFrame:
            out = fn(*frames)
            return out.assign(**dict(zip(keys, key[:width])))
        return run

    def play_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return keyed(play)(key, group)[[*names, "pos", "opened"]]

    def test_group(key: tuple, rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        out = keyed(test)(key, rows, slots)[[*names, "pos", "taker"]]
        return out.astype({"n": "Int64", "pos": "Int64", "m": "boolean"})

    slots = None
    while not rest.isEmpty():
        head = first_rows(rest, keys, [F.col("n")], head_rows).withColumns(
            {"pos": F.lit(None).cast("long"), "opened": F.lit(None).cast("long")})
        onto = head if slots is None else head.unionByName(slots)
        slots = cut(onto.groupBy(*keys).applyInPandas(play_group, slot_type))
        last = head.groupBy(*keys).agg(F.max("n").alias("last"))
        later = salted_lookup(rest, last, keys).filter("n > last").drop("last")
        later = later.withColumn("chunk", F.floor(F.col("n") / chunk_rows))
        # Named anew, so that the two sides of the cogroup share no columns.
        chunks = later.select(*[F.col(c).alias(c) for c in (*keys, "chunk")]).distinct()
        copies = chunks.join(slots, keys).select(*[F.col(c).alias(c) for c in (*names, "pos", "chunk")])
        tested = cut(later.groupBy(*keys, "chunk").cogroup(copies.groupBy(*keys, "chunk")).applyInPandas(
            test_group, test_type))
        takers = tested.filter("n IS NULL").groupBy(*keys, "pos").agg(F.min("taker").alias("first_taker"))
        rows = tested.filter("n IS NOT NULL").drop("taker")
        free = rows.filter("pos < 0")
        waiting = salted_lookup(rows.filter("pos >= 0"), takers, [*keys, "pos"]).filter("n > first_taker")
        rest = cut(free.unionByName(waiting.drop("first_taker")).select(*names))
    # A place in the list belongs to the row that opened it; rows that never collide open one each.
    opened = ranked.filter("__never").select(*keys, "__n", F.col("__n").alias("__opened"))
    if slots is not None:
        opened = opened.unionByName(slots.select(*keys, F.col("n").alias("__n"), F.col("opened").alias("__opened")))
    places = numbered(opened, keys, [F.col("__opened")], "__at", **number_kw).select(
        *keys, "__n", (F.col("__at") - 1).cast("int").alias("__pos"))
    return ranked.join(places, [*keys, "__n"]).select(*keys, "__pos", "__row")
