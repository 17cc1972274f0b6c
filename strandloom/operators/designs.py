"""Choosing sets of primer pairs: one slot each, by simulated annealing with a seed, a group for each design."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def set_weight(pairs: list[dict]) -> float:
    """Product of the distinct pairs' mean weights and of how near their melting temperatures are to the mean."""
    if not pairs:
        return 0.0
    by: dict[str, list[float]] = {}
    for p in pairs:
        by.setdefault(p["pair"], []).append(p["weight"])
    out = math.prod(sum(v) / len(v) for v in by.values())
    tms = [p["tm"] for p in {p["pair"]: p for p in pairs}.values()]
    mean = sum(tms) / len(tms)
    up = lambda x, s, at: 1 / (1 + s ** (at - x))
    return out * math.prod(up(t - mean, 5, -2.5) * up(mean - t, 5, -2.5) for t in tms)


def best_set(slots: list[list[dict]], mode: str, iterations: int, seed: int, weight: Callable[[list[dict]], float] = set_weight) -> list[dict]:
    """best: the first of each slot. direct: swap pairs while that helps. ranked and uniform: random sets, by weight or evenly, worse ones
    being accepted at a chance that falls from 1 to 1e-4."""
    import random

    rng = random.Random(seed)
    slots = [sorted(s, key=lambda p: (-p["weight"], p["pair"])) for s in slots if s]
    now = best = [s[0] for s in slots]
    if mode == "direct":
        better = True
        while better:
            better = False
            for k in sorted(range(len(slots)), key=lambda k: now[k]["weight"]):
                for p in slots[k]:
                    new = [*now[:k], p, *now[k + 1 :]]
                    if weight(new) > weight(now):
                        now = best = new
                        better = True
                        break
    elif mode != "best":
        for i in range(iterations):
            pick = (lambda s: rng.choices(s, [p["weight"] + 1e-12 for p in s])[0]) if mode == "ranked" else rng.choice
            new = [pick(s) for s in slots]
            if weight(new) >= weight(now) or rng.random() <= 1e-4 ** (i / iterations):
                now = new
                best = max(best, now, key=weight)
    return best


def optimise(candidates: DataFrame, mode: str = "ranked", iterations: int = 1000, most_per_slot: int = 1000) -> DataFrame:
    """(design, slot, pair, set_weight) from (design, slot, pair, weight, tm). Only a slot's best pairs take part, which bounds a group."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    top = candidates.withColumn("k", F.row_number().over(Window.partitionBy("design", "slot").orderBy(F.desc("weight"), "pair"))).where(F.col("k") <= most_per_slot)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slot", "pair"])
        slots = [g.to_dict("records") for _, g in rows.groupby("slot", sort=True)]
        found = best_set(slots, mode, iterations, zlib.crc32(str(rows.design.iloc[0]).encode()))
        return pd.DataFrame([(rows.design.iloc[0], p["slot"], p["pair"], set_weight(found)) for p in found], columns=["design", "slot", "pair", "set_weight"])

    return top.drop("k").groupBy("design").applyInPandas(one, "design string, slot int, pair string, set_weight double")


def schedule(start: dict[str, float], end: dict[str, float], step: dict[str, float]) -> list[dict[str, float]]:
    """Cutoffs cycle by cycle: in turn one parameter moves by its step towards its end."""
    now, out = dict(start), [dict(start)]
    while any(now[k] != end[k] for k in now):
        for k in now:
            if now[k] != end[k]:
                far = end[k] - now[k]
                now[k] = end[k] if abs(far) <= abs(step[k]) else now[k] + math.copysign(step[k], far)
                out.append(dict(now))
    return out
