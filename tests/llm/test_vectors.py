"""Recall and hot lists of the vector index against brute force."""

import numpy as np
import pandas as pd

from barloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, cosine=0.95):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, j) for i in range(len(x)) for j in np.flatnonzero(x @ x[i] >= cosine) if i != j]


def test_planted_partners_are_found(spark, monkeypatch):
    """Partners of cosine 0.95 to 1 beside random vectors and a hot list of a third of all rows."""
    monkeypatch.setattr(vectors, "PLACED", 70)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    off = rng.normal(size=x[:600].shape)
    off -= (off * x[:600]).sum(1)[:, None] / (x[:600] ** 2).sum(1)[:, None] * x[:600]
    off *= (np.linalg.norm(x[:600], axis=1) / np.linalg.norm(off, axis=1))[:, None]
    angle = np.arccos(rng.uniform(0.9505, 1, 600))[:, None]
    hot = rng.normal(size=64) + rng.normal(size=(1000, 64)) * 0.3
    everything = np.concatenate([x, np.cos(angle) * x[:600] + np.sin(angle) * off, hot]).astype(np.float32)
    want = brute(everything)
    rows = pd.DataFrame({"vec_id": range(len(everything)), "embedding": list(everything), "label": 1})
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("vec_id")
    links = np.bincount([i for i, _ in want], minlength=len(everything))
    assert len(want) > 1200 and got.n_links.sum() <= len(want)
    assert got.n_links.sum() >= 0.99 * len(want)
    assert (got.n_links.reindex(range(len(everything))) <= links).all()
    hundredth = np.arange(0, len(everything), 100)
    assert got.n_links.loc[hundredth].sum() >= 0.9 * links[hundredth].sum()


def test_pairs_across_lists_count_once_for_both(spark, monkeypatch):
    """Partners on both sides of a plane, floats and doubles, and no vector sent to most lists."""
    sent = []
    written = vectors.materialized
    monkeypatch.setattr(vectors, "materialized", lambda df: sent.append(written(df)) or sent[-1])
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 64)).astype(np.float32).astype(float)
    near = base + rng.normal(size=base.shape) * 0.2
    everything = np.concatenate([base, near, np.repeat(base[:5], 2, axis=0)])
    rows = pd.DataFrame({"vec_id": range(len(everything)), "embedding": list(everything)})
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    links = np.bincount([i for i, _ in brute(everything)], minlength=len(everything))
    assert links.sum() > 1500 and (got.n_links.sort_index().to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.99 * links.sum()
    # Vectors are written once, not once for each list that they ask in.
    wide = [df.count() for df in sent if "x" in df.columns]
    assert wide and max(wide) <= len(everything)
