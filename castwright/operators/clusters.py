"""Clustering of the voices of an episode; each group is the clips of one episode and thus small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.functions.vectors import dot, unit

SAME_VOICE = 0.31


def _units(group: pd.DataFrame) -> np.ndarray:
    v = np.stack(group["embedding"].map(lambda x: np.asarray(x, dtype=np.float64)).to_list())
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def greedy_labels(units: np.ndarray, least: float = SAME_VOICE) -> list[int]:
    """Each vector joins the most similar cluster seed of at least ``least``, the earliest of equals, or seeds a new cluster."""
    seeds: list[int] = []
    out = []
    for i, u in enumerate(units):
        sims = units[seeds] @ u if seeds else np.empty(0)
        if len(sims) and sims.max() >= least:
            out.append(int(sims.argmax()))
        else:
            out.append(len(seeds))
            seeds.append(i)
    return out


def medoid_labels(units: np.ndarray, k: int, rounds: int = 25) -> list[int]:
    """k-medoids by cosine; far apart starts among vectors of at least half the best mean similarity; ties to the lowest index."""
    n = len(units)
    if k >= n:
        return list(range(n))
    sim = np.maximum(units @ units.T, 0)
    np.fill_diagonal(sim, 1)
    mean = (sim.sum(axis=1) - 1) / max(1, n - 1)
    usable = np.flatnonzero(mean >= 0.5 * mean.max())
    medoids = [int(usable[mean[usable].argmax()])]
    while len(medoids) < k:
        pool = [i for i in usable if i not in medoids] or [i for i in range(n) if i not in medoids]
        medoids.append(int(min(pool, key=lambda i: (sim[i, medoids].max(), i))))
    for _ in range(rounds):
        label = sim[:, medoids].argmax(axis=1)
        after = [int(own[sim[np.ix_(own, own)].sum(axis=1).argmax()]) if len(own := np.flatnonzero(label == c)) else m for c, m in enumerate(medoids)]
        if after == medoids:
            break
        medoids = after
    return sim[:, medoids].argmax(axis=1).tolist()


def zero_shares(df: DataFrame, by: str) -> DataFrame:
    """``by, zeros``: the share of the similarities of different vectors of a group that are (nearly) zero; groups of one have none."""
    v = df.where("embedding is not null").select(by, "vec_id", unit(F.col("embedding")).alias("u"))
    pairs = v.join(v.select(by, F.col("vec_id").alias("other"), F.col("u").alias("w")), by).where("vec_id < other")
    return pairs.groupBy(by).agg(F.avg((dot(F.col("u"), F.col("w")) <= 1e-9).cast("double")).alias("zeros"))


def align_voices(df: DataFrame, by: str = "label", k: int | None = None, strict: bool = True) -> DataFrame:
    """``by, vec_id, cluster`` of the vectors of each group in the order of vec_id; greedy, or with ``k`` clusters.

    ``strict`` raises if more than half of the similarities of a group of three or more are zero: such vectors tell nothing.
    """
    kind = df.schema[by].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        units = _units(group)
        if strict and len(units) >= 3:
            sim = np.maximum(units @ units.T, 0)
            if (sim[~np.eye(len(units), dtype=bool)] <= 1e-9).mean() > 0.5:
                raise ValueError("the similarities of a group are mostly zero")
        labels = greedy_labels(units) if k is None else medoid_labels(units, k)
        return group[[by, "vec_id"]].assign(cluster=labels)

    return df.where("embedding is not null").select(by, "vec_id", "embedding").groupBy(by).applyInPandas(run, f"{by} {kind}, vec_id bigint, cluster int")


def sweep(df: DataFrame, by: str, ks: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """``by, k, silhouette, min_share`` of the clusterings of each group into each of ``ks``; groups of at most k vectors are left out."""
    kind = df.schema[by].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        units, rows = _units(group), []
        apart = 1 - units @ units.T
        for k in (k for k in ks if k < len(units)):
            labels = np.array(medoid_labels(units, k))
            own = labels[:, None] == labels[None, :]
            sizes = own.sum(axis=1)
            within = (apart * own).sum(axis=1) / np.maximum(sizes - 1, 1)
            other = np.stack([np.where(labels == c, np.inf, apart[:, labels == c].mean(axis=1)) for c in np.unique(labels)]).min(axis=0)
            most = np.maximum(within, other)
            value = np.where(most > 0, (other - within) / np.where(most > 0, most, 1), 0)[sizes > 1]
            rows.append((group[by].iloc[0], k, float(value.mean()) if len(value) and len(np.unique(labels)) > 1 else 0.0, float(np.bincount(labels, minlength=k).min() / len(labels))))
        return pd.DataFrame(rows, columns=[by, "k", "silhouette", "min_share"])

    return df.where("embedding is not null").select(by, "vec_id", "embedding").groupBy(by).applyInPandas(run, f"{by} {kind}, k int, silhouette double, min_share double")
