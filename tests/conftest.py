import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="barloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk():
    """Seeded hourly random walks of two instruments, with a few flat bars."""
    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("A", 3500), ("B", 1300)):
        close = 1.7 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
        open_ = np.r_[close[0], close[:-1]]
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.0005, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.0005, n)))
        flat = rng.random(n) < 0.002
        close = np.where(flat, open_, close)
        high, low = np.where(flat, open_, np.maximum(high, close)), np.where(flat, open_, np.minimum(low, close))
        frames.append(
            pd.DataFrame(
                {
                    "instrument": name,
                    "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
                    "open": open_,
                    "high": high,
                    "low": low,
                    "close": close,
                    "volume": rng.integers(1, 500, n).astype(float),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    from barloom.operators.positions import with_position
    from barloom.session import materialized

    df = spark.createDataFrame(walk)
    df = df.withColumn("ts", df.ts.cast("timestamp_ntz"))
    return materialized(with_position(df))
