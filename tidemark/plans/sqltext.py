"""Small builders for the SQL twins: staged CTEs over bars."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY time"
EPS = "1e-12"


def d(x: float | int) -> str:
    """A DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


def over(expr: str, lo: int | None = None, hi: int = 0) -> str:
    """Windowed expression over rows lo..hi relative to the current one (lo None: from the start)."""

    def edge(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    start = "UNBOUNDED PRECEDING" if lo is None else edge(lo)
    return f"{expr} OVER ({P} ROWS BETWEEN {start} AND {edge(hi)})"


def lag(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) OVER ({P})"


def lead(expr: str, k: int = 1) -> str:
    return f"lead({expr}, {k}) OVER ({P})"


def merge(*stage_lists: list[dict[str, str]]) -> list[dict[str, str]]:
    """Join stage lists depth by depth; a name keeps its shallowest definition."""
    seen: set[str] = set()
    out = []
    for depth in range(max(map(len, stage_lists))):
        level: dict[str, str] = {}
        for st in stage_lists:
            if depth < len(st):
                level.update({k: v for k, v in st[depth].items() if k not in seen})
        seen.update(level)
        out.append(level)
    return out


def chain(stages: list[dict[str, str]], base: str = "bars", prefix: str = "st") -> tuple[str, str]:
    """CTE text of the stages and the name of the last one."""
    parts, cur = [], base
    for i, level in enumerate(stages):
        if not level:
            continue
        name = f"{prefix}{i}"
        cols = ", ".join(f"{e} AS {n}" for n, e in level.items())
        parts.append(f"{name} AS (SELECT *, {cols} FROM {cur})")
        cur = name
    return ",\n".join(parts), cur


def avg_in_order(col: str, n: int) -> str:
    """Mean of n rows summed oldest first, so that flat stretches compare equal bit by bit."""
    return "(" + " + ".join([lag(col, k) for k in range(n - 1, 0, -1)] + [col]) + f") / {d(float(n))}"


def csum(col: str = "close") -> dict[str, str]:
    return {f"cs_{col}": over(f"sum({col})")}


def sma(s: int, col: str = "close") -> dict[str, str]:
    c = f"cs_{col}"
    gone = f"CASE WHEN bar = {s - 1} THEN CAST(0 AS DOUBLE) ELSE {lag(c, s)} END"
    return {f"sma_{col}_{s}": f"CASE WHEN bar >= {s - 1} THEN ({c} - {gone}) / {d(float(s))} END"}


def position(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {hi} <> {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE {d(0.5)} END"


def pir(x: str, lb: int, out: str) -> list[dict[str, str]]:
    """Stages for a position in range named `out`."""
    lo, hi = f"lo_{out}", f"hi_{out}"
    return [
        {lo: over(f"min({x})", -(lb - 1)), hi: over(f"max({x})", -(lb - 1))},
        {out: position(x, lo, hi)},
    ]


def scale_pir(s: int, lb: int) -> tuple[list[dict[str, str]], str]:
    """Stages and expression of the per-scale position in range."""
    a = f"sma_close_{s}"
    r = f"r{s}"
    st = [
        csum(),
        sma(s),
        {r: f"CASE WHEN {a} > 0 THEN close / {a} ELSE {d(1.0)} END"},
        {f"lo_{r}": over(f"min({r})", -(lb - 1)), f"hi_{r}": over(f"max({r})", -(lb - 1))},
        {
            f"l2_{r}": f"CASE WHEN bar < {lb - 1} THEN least(lo_{r}, {d(1.0)}) ELSE lo_{r} END",
            f"h2_{r}": f"CASE WHEN bar < {lb - 1} THEN greatest(hi_{r}, {d(1.0)}) ELSE hi_{r} END",
        },
    ]
    return st, position(r, f"l2_{r}", f"h2_{r}")


def agreement(start: int, end: int, step: int, pct: float, hi: str, lo: str) -> list[dict[str, str]]:
    scales = range(start, end + 1, step)
    built = [scale_pir(s, max(s, 20)) for s in scales]
    st = merge(*[b for b, _ in built])
    st.append({f"p{s}": e for s, (_, e) in zip(scales, built)})
    n = d(float(len(scales)))
    up = " + ".join(f"CASE WHEN p{s} > {d(pct)} THEN 1 ELSE 0 END" for s in scales)
    dn = " + ".join(f"CASE WHEN p{s} < {d(1.0 - pct)} THEN 1 ELSE 0 END" for s in scales)
    st.append({hi: f"({up}) / {n}", lo: f"({dn}) / {n}"})
    return st


def er(p: int, directional: bool, out: str) -> list[dict[str, str]]:
    net = f"net{p}" if directional else f"abs(net{p})"
    return [
        {"move": f"abs(close - {lag('close')})", f"net{p}": f"close - {lag('close', p)}"},
        {f"path{p}": over("sum(move)", -(p - 1))},
        {out: f"CASE WHEN bar >= {p} THEN CASE WHEN path{p} > 0 THEN {net} / path{p} ELSE {d(0.0)} END END"},
    ]


TRUE_RANGE = [
    {"pc": lag("close")},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"},
]


def rma_rec(col: str, n: int, base: str, out: str = "rma") -> str:
    """Recursive CTE `rec_<out>`(symbol, bar, out); `base` has symbol, bar and col."""
    return f"""seed_{out} AS (
  SELECT symbol, avg({col}) AS s FROM {base} WHERE bar < {n} GROUP BY symbol HAVING count(*) = {n}),
rec_{out} AS (
  SELECT symbol, CAST({n - 1} AS BIGINT) AS bar, s AS {out} FROM seed_{out}
  UNION ALL
  SELECT b.symbol, b.bar, (r.{out} * {d(float(n - 1))} + b.{col}) / {d(float(n))}
  FROM rec_{out} r JOIN {base} b ON b.symbol = r.symbol AND b.bar = r.bar + 1)"""


def safe_log(num: str, den: str) -> str:
    return f"ln(greatest({num}, {d(1e-10)}) / greatest({den}, {d(1e-10)}))"


def clamp(x: str) -> str:
    return f"greatest({d(-1.0)}, least({d(1.0)}, {x}))"


GJR_INPUT = [
    {"pc": lag("close")},
    {"lr": safe_log("close", "coalesce(pc, close)")},
    {"r2": "lr * lr", "plr": lag("lr")},
    {
        "pr2": lag("r2"),
        "sma_r2": f"CASE WHEN bar >= 251 THEN {over('avg(r2)', -251)} END",
    },
    {"lrv": f"greatest(coalesce(sma_r2, r2), {d(1e-12)})"},
    {"omega": f"greatest(lrv * {d(1.0 - 0.03 - 0.90 - 0.08 / 2.0)}, {d(1e-12)})"},
    {"lev": f"CASE WHEN plr < 0 THEN {d(1.0)} ELSE {d(0.0)} END", "pr2x": "CASE WHEN bar = 0 THEN lrv ELSE pr2 END"},
]


def gjr_rec(base: str) -> str:
    """Recursive CTE `rec_gjr`(symbol, bar, g, s)."""

    def step(prev: str, coef: str) -> str:
        return f"greatest(b.omega + {coef} * b.pr2x + {d(0.90)} * {prev}, {d(1e-12)})"

    lever, flat = f"({d(0.03)} + {d(0.08)} * b.lev)", d(0.03 + 0.08 * 0.5)
    return f"""rec_gjr AS (
  SELECT b.symbol, b.bar, {step('b.lrv', lever)} AS g, {step('b.lrv', flat)} AS s FROM {base} b WHERE b.bar = 0
  UNION ALL
  SELECT b.symbol, b.bar, {step('r.g', lever)}, {step('r.s', flat)}
  FROM rec_gjr r JOIN {base} b ON b.symbol = r.symbol AND b.bar = r.bar + 1)"""


GJR_OUT = f"CASE WHEN bar >= 251 THEN {clamp('(g / s - 1) / ' + d(0.1))} END"


def har(out: str = "har_vol") -> list[dict[str, str]]:
    hl, co = safe_log("high", "low"), safe_log("close", "open")
    return [
        {"hl": hl, "co": co},
        {"gk": f"greatest({d(0.5)} * hl * hl - (2 * ln({d(2.0)}) - 1) * co * co, {d(1e-10)})"},
        {"gkw": f"CASE WHEN bar >= 4 THEN {over('avg(gk)', -4)} ELSE gk END", "gkm": over("avg(gk)", -21)},
        {"fc": f"greatest({d(0.36)} * gk + {d(0.28)} * gkw + {d(0.28)} * gkm, {d(1e-10)})"},
        {out: f"CASE WHEN bar >= 21 THEN {clamp('(sqrt(fc) / sqrt(gk) - 1) / ' + d(0.5))} END"},
    ]


def slope(s: int, out: str) -> list[dict[str, str]]:
    dd = max(int(s / 4 + 0.5), 2)
    a, b = f"sma_close_{s}", f"smad_{s}"
    return [
        csum(),
        sma(s),
        {b: lag(a, dd)},
        {
            out: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} > 0 "
            f"THEN ({a} - {b}) / ({d(float(dd))} * {a}) * 1000 ELSE {d(0.0)} END"
        },
    ]


def linreg(s: int, out: str) -> list[dict[str, str]]:
    a = f"sma_close_{s}"
    return [
        csum() | {f"ols{s}": over("regr_slope(close, CAST(bar AS DOUBLE))", -(s - 1))},
        sma(s),
        {out: f"CASE WHEN bar >= {s - 1} THEN CASE WHEN {a} > 0 THEN ols{s} / {a} * 1000 ELSE {d(0.0)} END END"},
    ]


def momentum(lb: int) -> list[dict[str, str]]:
    """price_return, mom_divergence, mom_velocity for one lookback."""
    return [
        {f"cl{lb}": lag("close", lb), f"vl{lb}": lag("volume", lb)},
        {f"price_return_L{lb}": f"(close - cl{lb}) / NULLIF(cl{lb}, 0)"},
        {
            f"mom_divergence_L{lb}": f"CASE WHEN vl{lb} IS NULL THEN NULL ELSE price_return_L{lb} * "
            f"((volume - vl{lb}) / greatest(vl{lb}, {d(1.0)})) END",
            f"pret{lb}": lag(f"price_return_L{lb}"),
        },
        {f"mom_velocity_L{lb}": f"price_return_L{lb} - pret{lb}"},
    ]


def full(expr: str, n: int, x: str) -> str:
    """Windowed aggregate that needs n non-null values."""
    return f"CASE WHEN {over(f'count({x})', -(n - 1))} = {n} THEN {over(expr, -(n - 1))} END"


def realized_vol(win: int) -> list[dict[str, str]]:
    return [
        {"pc": lag("close")},
        {"lret": "CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END"},
        {f"rv{win}": full("stddev_pop(lret)", win, "lret")},
    ]


def dist_z(n: int, z: int, out: str) -> list[dict[str, str]]:
    return [
        {f"zm{n}": full("avg(close)", n, "close"), f"zs{z}": full("stddev_pop(close)", z, "close")},
        {
            out: f"CASE WHEN zm{n} IS NULL OR zs{z} IS NULL THEN NULL WHEN zs{z} > 0 "
            f"THEN tanh((close - zm{n}) / zs{z}) ELSE {d(0.0)} END"
        },
    ]


def drawdown(n: int, out: str) -> list[dict[str, str]]:
    return [
        {f"top{n}": full("max(close)", n, "close")},
        {
            out: f"CASE WHEN top{n} IS NULL THEN NULL WHEN top{n} > 0 THEN (close - top{n}) / top{n} ELSE {d(0.0)} END"
        },
    ]


def up_streak(cap: int, out: str) -> list[dict[str, str]]:
    return [
        {"pc": lag("close")},
        {"isl": over("sum(CASE WHEN pc IS NULL OR close <= pc THEN 1 ELSE 0 END)")},
        {"streak": "row_number() OVER (PARTITION BY symbol, isl ORDER BY time) - 1"},
        {out: f"least(streak, {cap}) / {d(float(cap))}"},
    ]
