"""Combinations of blocks swept in groups and ranges against plain loops."""

import math
from itertools import combinations

import numpy as np
import pytest

from tidemark.operators import overfit as O


def ratio(x):
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return x.mean() / sd if sd > 1e-9 else x.mean()


def loop(rows, n_splits):
    """Best config and logit of every combination, one after another."""
    times = sorted({t for t, _, _ in rows})
    size = len(times) // n_splits
    block = {t: i // size for i, t in enumerate(times) if i < size * n_splits}
    by: dict = {}
    for t, c, v in rows:
        if t in block:
            by.setdefault(c, {}).setdefault(block[t], []).append(v)
    out = []
    for combo in combinations(range(n_splits), n_splits // 2):
        table = []
        for c, blocks in by.items():
            side = [[v for b, vs in blocks.items() if (b in combo) == inside for v in vs] for inside in (True, False)]
            table.append((c, *(ratio(np.array(x)) if x else math.nan for x in side)))
        known = [r for r in table if not math.isnan(r[1])]
        best = min(known, key=lambda r: (-round(r[1], 12), r[0]))
        less = sum(r[2] < best[2] - 1e-12 for r in table)
        level = sum(abs(r[2] - best[2]) <= 1e-12 for r in table)
        w = (less + (level + 1) / 2) / (len(table) + 1)
        out.append((best[0], math.log(w / (1 - w))))
    return out


@pytest.mark.parametrize("group_configs,range_combos", [(512, 2048), (3, 4), (1, 1)])
def test_groups_and_ranges(spark, group_configs, range_combos):
    """Ties, a flat config, one that lacks whole blocks, and times left over at the end."""
    rng = np.random.default_rng(5)
    rows = [(t, f"c{c}", float(v)) for c in range(9) for t, v in enumerate(rng.normal(0.1, 1, 26))]
    rows += [(t, "d", v) for t, c, v in rows if c == "c4"] + [(t, "flat", 0.25) for t in range(26)]
    rows += [(t, "part", float(rng.normal(0.3, 1))) for t in range(8)]
    df = spark.createDataFrame(rows, "t long, config string, value double")
    got = {r["combo"]: r for r in O.pbo_logits(df, 6, group_configs, range_combos).collect()}
    want = loop(rows, 6)
    assert sorted(got) == list(range(20))
    for i, (config, logit) in enumerate(want):
        assert got[i]["best_config"] == config and got[i]["logit"] == pytest.approx(logit, abs=1e-9)


def test_sixteen_blocks(spark):
    """All 12,870 combinations over a wide table; the rank of a config that is best everywhere is the highest."""
    rng = np.random.default_rng(6)
    values = rng.normal(0, 1, (32, 60))
    values[:, 7] = 5 + 0.01 * values[:, 7]
    rows = [(t, c, float(values[t, c])) for t in range(32) for c in range(60)]
    df = spark.createDataFrame(rows, "t long, config int, value double")
    out = O.pbo_logits(df, 16, group_configs=20).toPandas()
    assert len(out) == 12_870 and (out["best_config"] == 7).all()
    np.testing.assert_allclose(out["logit"], math.log(60))
    noise = df.filter("config <> 7")
    got = {r["combo"]: r for r in O.pbo_logits(noise, 16, group_configs=25).collect()}
    x = values[:, [c for c in range(60) if c != 7]]
    names = [c for c in range(60) if c != 7]
    blocks = x.reshape(16, 2, -1)
    for i, combo in enumerate(combinations(range(16), 8)):
        if i % 643:
            continue
        a = blocks[list(combo)].reshape(16, -1)
        b = blocks[[k for k in range(16) if k not in combo]].reshape(16, -1)
        inside, outside = a.mean(0) / a.std(0, ddof=1), b.mean(0) / b.std(0, ddof=1)
        best = int(inside.argmax())
        w = ((outside < outside[best]).sum() + 1) / 60
        assert got[i]["best_config"] == names[best]
        assert got[i]["logit"] == pytest.approx(math.log(w / (1 - w)))
