"""Seeded bar fixtures."""

import numpy as np
import pandas as pd


def walk(n=700, seed=0, symbol="A", step=86_400, gaps=False):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.005, n))
    high = np.maximum(open_, close) * (1 + rng.random(n) * 0.01)
    low = np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
    jump = rng.integers(1, 5, n) if gaps else np.ones(n, dtype=int)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "time": np.cumsum(jump) * step,
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": rng.integers(0, 50, n).astype(float),
        }
    )


def pooled(sizes=(700, 431, 300), gaps=True):
    return pd.concat([walk(n, i, chr(65 + i), gaps=gaps) for i, n in enumerate(sizes)], ignore_index=True)
