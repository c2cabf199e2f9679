"""Exact nearest neighbours within blocks by an index of cells around pivots.

A bounded hash sample of the donors gives pivots; every donor belongs to the cell of its block's nearest pivot, and every cell has a
count and the least and largest distance from its pivot. For a target the triangle inequality bounds the distance to all donors of a
cell from both sides: the cells that surely hold enough donors bound the k-th distance, and only cells that may come as near are
visited. Donors of a large cell are dealt out in chunks and visits of a popular one in parts, each chunk hands on its k nearest, and
one ranking of those few rows for each target is exact, ties included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Donors to a pivot, and the most pivots that tasks get.
PER_PIVOT, MOST_PIVOTS = 64, 1024
#: Donors of a cell, and visits to it, that one task compares.
CHUNK, PART = 8192, 4096
#: Squared distances that differ by no more than this tie.
TIE = 1e-10


def squares(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of w and v, summed by coordinate in order."""
    out = np.zeros((len(w), len(v)))
    for a, b in zip(w.T, v.T):
        out += (a[:, None] - b[None, :]) ** 2
    return out


def _rows(column) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _pivots(donors: DataFrame, block: str, per_pivot: int, most: int) -> dict:
    """Block -> vectors of its pivots: the donors with the least hashes."""
    n = donors.count()
    chosen = donors.select(block, "v", F.xxhash64("donor").alias("h")).orderBy("h").limit(min(most, max(1, n // per_pivot))).collect()
    found: dict = {}
    for r in chosen:
        found.setdefault(r[block], []).append(r["v"])
    return {key: np.unique(np.array(v, float), axis=0) for key, v in found.items()}


def _visited(w: np.ndarray, pivots: np.ndarray, stats: np.ndarray, need: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells that may hold one of the ``need`` nearest donors; stats has count, least and largest radius of cells."""
    away = np.sqrt(squares(w, pivots))
    count, least, most = stats.T
    far = np.where(count > 0, away + most, np.inf)
    order = np.argsort(far, axis=1)
    enough = np.cumsum(np.take_along_axis(np.broadcast_to(count, far.shape), order, 1), axis=1) >= need
    at = np.where(enough.any(1), enough.argmax(1), far.shape[1] - 1)
    bound = np.where(enough.any(1), np.take_along_axis(np.take_along_axis(far, order, 1), at[:, None], 1)[:, 0], np.inf)
    near = np.maximum(np.maximum(away - most, least - away), 0)
    # The bounds carry rounding errors of distances, and ties within the slack count.
    return np.nonzero((near <= np.sqrt(bound**2 + slack)[:, None] * (1 + 1e-9) + 1e-9) & (count > 0))


def candidates(targets: DataFrame, donors: DataFrame, block: str, k: int, slack: float, ties: bool = True, per_pivot: int = PER_PIVOT, most_pivots: int = MOST_PIVOTS, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """Rows (target, donor, d2) with at least all donors whose squared distance is within ``slack`` of the target's k-th; without ``ties``
    with at least the k first ones by distance and id."""
    donors = donors.select(F.col("donor"), F.col(block).alias("block"), "v").where(F.col("block").isNotNull() & F.col("v").isNotNull()).checkpoint()
    targets = targets.select(F.col("target"), F.col(block).alias("block"), "w").where(F.col("block").isNotNull() & F.col("w").isNotNull())
    kinds = {name: df.schema[c].dataType.simpleString() for name, df, c in (("target", targets, "target"), ("donor", donors, "donor"), ("block", donors, "block"))}
    pivots = _pivots(donors, "block", per_pivot, most_pivots)

    def place(batches):
        for pdf in batches:
            for key, rows in pdf.groupby("block"):
                if key in pivots:
                    d = squares(_rows(rows["v"]), pivots[key])
                    cell = d.argmin(1)
                    yield rows.assign(cell=cell.astype(np.int32), radius=np.sqrt(d[np.arange(len(d)), cell]))
                else:
                    yield rows.assign(cell=np.int32(-1), radius=0.0)

    placed = donors.mapInPandas(place, f"donor {kinds['donor']}, block {kinds['block']}, v array<double>, cell int, radius double")
    found = placed.where("cell >= 0").groupBy("block", "cell").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")).collect()
    stats = {key: np.zeros((len(v), 3)) for key, v in pivots.items()}
    for r in found:
        stats[r["block"]][r["cell"]] = r["n"], r["least"], r["most"]

    def visit(batches):
        for pdf in batches:
            for key, rows in pdf.groupby("block"):
                if key in pivots:
                    # One more than k, as a target may be a donor itself.
                    row, cell = _visited(_rows(rows["w"]), pivots[key], stats[key], k + 1, slack)
                    yield rows.iloc[row].assign(cell=cell.astype(np.int32))
                else:
                    yield rows.assign(cell=np.int32(-1))

    visits = targets.mapInPandas(visit, f"target {kinds['target']}, block {kinds['block']}, w array<double>, cell int").checkpoint()
    calls = visits.where("cell >= 0").groupBy("block", "cell").count().collect()
    # At most one row for each pivot.
    chunks = {(r["block"], r["cell"]): -(-r["n"] // chunk) for r in found}
    parts = {(r["block"], r["cell"]): -(-r["count"] // part) for r in calls}
    shares = [(b, c, chunks[b, c], parts.get((b, c), 0)) for b, c in chunks]
    plan = F.broadcast(targets.sparkSession.createDataFrame(shares, f"block {kinds['block']}, cell int, chunks int, parts int"))
    split = lambda df: df.join(plan, ["block", "cell"], "left").fillna(1, ["chunks", "parts"])
    every = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.col(n), F.lit(1))).cast("int")
    left = split(placed.select("donor", "block", "v", "cell")).select("donor", "block", "v", "cell", dealt("donor", "chunks").alias("chunk"), every("parts").alias("part"))
    right = split(visits).select("target", "block", "w", "cell", dealt("target", "parts").alias("part"), every("chunks").alias("chunk"))

    def compare(_, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            ids, v = own["donor"].to_numpy(), _rows(own["v"])
            for at in range(0, len(asked), 256):
                some = asked.iloc[at : at + 256]
                d = squares(_rows(some["w"]), v)
                d[some["target"].to_numpy()[:, None] == ids[None, :]] = np.inf
                limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, column = np.nonzero((d <= limit[:, None] + slack) & np.isfinite(d))
                if not ties:
                    order = np.lexsort((ids[column], d[row, column], row))
                    row, column = row[order], column[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, column = row[kept], column[kept]
                out.append(pd.DataFrame({"target": some["target"].to_numpy()[row], "donor": ids[column], "d2": d[row, column]}))
        return pd.concat(out) if out else pd.DataFrame({"target": own["donor"][:0], "donor": own["donor"][:0], "d2": np.zeros(0)})

    keys = ["block", "cell", "chunk", "part"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(compare, f"target {kinds['target']}, donor {kinds['donor']}, d2 double")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("d2", "donor")))


def top_k(targets: DataFrame, donors: DataFrame, block: str, k: int, **bounds: int) -> DataFrame:
    """k nearest donors of each target within its block, ties by donor id; (target, donor, d2, rank).

    targets (target, block, w), donors (donor, block, v) with vectors of one length; null vectors and blocks meet nothing, and a
    target never meets the donor of its own id. ``bounds`` changes the index's sizes and no result.
    """
    return _ranked(candidates(targets, donors, block, k, 0.0, False, **bounds)).where(F.col("rank") <= k)


def top_k_ties(targets: DataFrame, donors: DataFrame, block: str, k: int, tolerance: float = TIE, **bounds: int) -> DataFrame:
    """All donors within the k-th squared distance plus the tolerance; targets with fewer than k donors give none."""
    pairs = candidates(targets, donors, block, k, tolerance, True, **bounds).checkpoint()
    kth = _ranked(pairs).where(F.col("rank") == k).select("target", F.col("d2").alias("limit"))
    return pairs.join(kth, "target").where(F.col("d2") <= F.col("limit") + tolerance).drop("limit")
