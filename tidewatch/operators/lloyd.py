"""k-means, all restarts at once: every round is one pass over the data, however many runs it serves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settle

ROUNDS, SHIFT = 30, 1e-4  # a run ends after so many rounds, or when no centre moves further


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt alone (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres)."""
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2.0 * (x @ centers.T), 0.0)


def prepare(points: DataFrame, vec: str = "vec", weight: str | None = None) -> DataFrame:
    """(vec, w, key) settled: one weighted row per distinct vector."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    rows = points.select(F.col(vec).cast("array<double>").alias("vec"), w.alias("w")).groupBy("vec").agg(F.sum("w").alias("w")).filter("w > 0")
    return settle(rows.withColumn("key", F.xxhash64("vec")))


def spread_centers(data: DataFrame, k: int, seed: int, restarts: int) -> np.ndarray:
    """restarts x k x d starting centres: each next one drawn with a chance of its weight times its squared distance to those before.

    One pass per centre for all restarts together.  The draw is the largest of
    log(u) / chance, u from a hash of seed, run, step and row, so it needs no
    order and comes out the same when a task is repeated.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(k):
        held = [np.array(c) for c in chosen]

        def draw(frames):
            best: dict[int, tuple[float, np.ndarray]] = {}
            for pdf in frames:
                if not len(pdf):
                    continue
                x, w, keys = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["w"].to_numpy(np.float64), pdf["key"].to_numpy(np.int64)
                for r in range(restarts):
                    chance = w * (_gaps(x, held[r]).min(1) if step else 1.0)  # noqa: B023
                    u = _uniform(keys, (seed + r) * 1_000_003 + step)  # noqa: B023
                    score = np.where(chance > 0, np.log(u) / np.where(chance > 0, chance, 1.0), -np.inf)
                    at = int(score.argmax())
                    if score[at] > best.get(r, (-np.inf, None))[0]:
                        best[r] = (float(score[at]), x[at])
            if best:
                yield pd.DataFrame({"r": list(best), "score": [b[0] for b in best.values()], "vec": [b[1] for b in best.values()]}).astype({"r": "int32", "score": "float64"})

        rows = data.mapInPandas(draw, "r int, score double, vec array<double>").groupBy("r").agg(F.max_by("vec", "score").alias("vec")).collect()
        found = {row["r"]: np.array(row["vec"]) for row in rows}
        for r in range(restarts):
            if r in found:
                chosen[r].append(found[r])
            elif chosen[r]:  # fewer distinct rows than centres
                chosen[r].append(chosen[r][-1])
    return np.array(chosen, dtype=np.float64)


def _round(data: DataFrame, centers: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One pass: the means of each centre's rows, and the cost of the centres as they were, per run."""
    dims = next(iter(centers.values())).shape[1]

    def sums(frames):
        total = {r: np.zeros((len(c), dims + 2)) for r, c in centers.items()}
        for pdf in frames:
            if not len(pdf):
                continue
            x, w = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["w"].to_numpy(np.float64)
            for r, c in centers.items():
                near = _gaps(x, c).argmin(1)
                cost = w * ((x - c[near]) ** 2).sum(1)
                np.add.at(total[r], near, np.column_stack([w, cost, x * w[:, None]]))
        for r, t in total.items():
            i, j = np.nonzero(t)
            yield pd.DataFrame({"r": np.int32(r), "c": i.astype(np.int32), "i": j.astype(np.int32), "x": t[i, j]})

    table = {r: np.zeros((len(c), dims + 2)) for r, c in centers.items()}
    for row in data.mapInPandas(sums, "r int, c int, i int, x double").groupBy("r", "c", "i").agg(F.sum("x").alias("x")).collect():  # runs x k x (d + 2)
        table[row["r"]][row["c"], row["i"]] = row["x"]
    moved = {r: np.where(t[:, :1] > 0, t[:, 2:] / np.where(t[:, :1] > 0, t[:, :1], 1.0), centers[r]) for r, t in table.items()}
    return moved, {r: float(t[:, 1].sum()) for r, t in table.items()}


def lloyd(data: DataFrame, starts: np.ndarray, rounds: int = ROUNDS, shift: float = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """(centres, costs) of all runs from their starting centres (runs x k x d); a run that has come to rest leaves the rounds."""
    centers = {r: c for r, c in enumerate(starts)}
    active = dict(centers)
    for _ in range(rounds):
        if not active:
            break
        moved, _ = _round(data, active)
        resting = {r for r, c in moved.items() if np.sqrt(((c - active[r]) ** 2).sum(1)).max() <= shift}
        centers.update(moved)
        active = {r: c for r, c in moved.items() if r not in resting}
    _, costs = _round(data, centers)
    return np.array([centers[r] for r in range(len(starts))]), np.array([costs[r] for r in range(len(starts))])


def best_of(points: DataFrame, k: int, seed: int, restarts: int, vec: str = "vec", weight: str | None = None) -> np.ndarray:
    """Centres (k x d, in lexicographic order) of the run with the least cost."""
    data = prepare(points, vec, weight)
    centers, costs = lloyd(data, spread_centers(data, k, seed, restarts))
    best = centers[int(costs.argmin())]
    return best[np.lexsort(best.T[::-1])]
