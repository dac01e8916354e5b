"""Series builders and plain loops the distributed results are compared with."""

import math

import numpy as np


def series_frame(spark, columns, name_seq="seq"):
    """Wide table from equal-length lists, with an explicit order column."""
    names = list(columns)
    n = len(columns[names[0]])

    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else (v.item() if hasattr(v, "item") else v)

    rows = [(i, *[plain(columns[c][i]) for c in names]) for i in range(n)]
    kinds = {c: "string" if any(isinstance(v, str) for v in columns[c]) else "double" for c in names}
    ddl = f"{name_seq} int, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    rows = [(r[0], *[float(v) if kinds[c] == "double" and v is not None else v for c, v in zip(names, r[1:])]) for r in rows]
    return spark.createDataFrame(rows, ddl)


def loop_run_rules(v):
    """The eight rules, sample by sample."""
    v = np.asarray(v, float)
    n, mean, std = len(v), v.mean(), v.std(ddof=1) if len(v) > 1 else 0.0
    counts = [0] * 8
    if n < 9 or std < 1e-12:
        return counts
    z = (v - mean) / std
    counts[0] = int((abs(z) > 3).sum())

    def runs(flags, k, start=0):
        hits, length = 0, start
        for f in flags:
            length = length + 1 if f else start
            hits += f and length == k
        return int(hits)

    d = np.diff(v)
    counts[1] = runs([(a > 0) == (b > 0) for a, b in zip(z[1:], z)], 9, 1)
    counts[2] = runs(d > 0, 6, 1) + runs(d < 0, 6, 1)
    s = np.sign(d)
    counts[3] = runs([a != 0 and a == -b for a, b in zip(s[1:], s)], 14, 1)
    for i, (size, need, level) in ((4, (3, 2, 2.0)), (5, (5, 4, 1.0))):
        windows = [z[j:j + size] for j in range(n - size + 1)]
        counts[i] = sum((w > level).sum() >= need or (w < -level).sum() >= need for w in windows)
    counts[6], counts[7] = runs(abs(z) < 1, 15), runs(abs(z) > 1, 8)
    return [int(c) for c in counts]


def loop_ewma(v, lam=0.2):
    v = np.asarray(v, float)
    out = [v.mean()]
    for x in v[1:]:
        out.append(lam * x + (1 - lam) * out[-1])
    return np.array(out)


def loop_cusum(v, slack=0.5):
    v = np.asarray(v, float)
    mean, k = v.mean(), slack * v.std(ddof=1)
    up, down = [0.0], [0.0]
    for x in v[1:]:
        up.append(max(0.0, up[-1] + x - mean - k))
        down.append(max(0.0, down[-1] + mean - k - x))
    return np.array(up), np.array(down)
