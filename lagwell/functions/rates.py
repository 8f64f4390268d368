"""Column expressions for rates, guards and blends. NULL stays NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagwell.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return _c(x).cast("double")


def safe_div(num, den) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def cap(x, upper: float) -> Column:
    x = _c(x)
    return F.when(x > upper, F.lit(upper)).otherwise(x)


def half_even(x, digits: int) -> Column:
    """Round half to even after scaling, the way numpy rounds floats."""
    scale = float(10 ** digits)
    return F.rint(dbl(x) * scale) / scale


def truth(cond: Column) -> Column:
    """A condition that is false, not NULL, when an input is missing."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """1/0 integer of a condition, NULL conditions counting as 0."""
    return truth(cond).cast("int")


def lookup(x, table: dict, default) -> Column:
    """Constant-map lookup with a default for absent keys."""
    entries = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*entries), _c(x)), F.lit(default))


def obp(h, bb, ab) -> Column:
    return safe_div(dbl(h) + dbl(bb), dbl(ab) + dbl(bb))


def slg(tb, ab) -> Column:
    return safe_div(tb, ab)


def woba(bb, singles, doubles, triples, hr, ab) -> Column:
    w = K.WOBA
    top = (dbl(bb) * w["bb"] + dbl(singles) * w["singles"] + dbl(doubles) * w["doubles"]
           + dbl(triples) * w["triples"] + dbl(hr) * w["hr"])
    return safe_div(top, dbl(ab) + dbl(bb))


def babip(h, hr, ab, k) -> Column:
    return safe_div(dbl(h) - dbl(hr), dbl(ab) - dbl(k) - dbl(hr))


def lob_pct(h, bb, r, hr) -> Column:
    reached = dbl(h) + dbl(bb)
    return safe_div(reached - dbl(r), reached - dbl(hr) * 1.4)


def fip(hr, free_bases, k, pa) -> Column:
    """Fielding-independent pitching per plate appearance (not per inning)."""
    return safe_div(dbl(hr) * 13 + dbl(free_bases) * 3 - dbl(k) * 2, pa) + K.FIP_CONSTANT


def pythagorean(runs_for, runs_against) -> Column:
    e = F.lit(K.PYTHAGOREAN_EXPONENT)
    a, b = F.pow(dbl(runs_for), e), F.pow(dbl(runs_against), e)
    return safe_div(a, a + b)


def log5(b, p, league) -> Column:
    b, p, lg = dbl(b), dbl(p), dbl(league)
    top = F.try_divide(b * p, lg)
    bottom = top + F.try_divide((1 - b) * (1 - p), 1 - lg)
    return F.when(bottom > 0, F.try_divide(top, bottom))


def shrink(split, prior, n, k: float) -> Column:
    """n/(n+k) of the split plus the rest of the prior; missing n counts as 0."""
    n = F.coalesce(dbl(n), F.lit(0.0))
    w = n / (n + F.lit(float(k)))
    return w * dbl(split) + (1 - w) * dbl(prior)


def shrink_count(successes, trials, prior, k: float) -> Column:
    return (dbl(successes) + F.lit(float(k)) * dbl(prior)) / (dbl(trials) + F.lit(float(k)))


def blend(parts: dict) -> Column:
    """Weighted sum {column: weight}; weights must add to 1."""
    if abs(sum(parts.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    out = None
    for name, w in parts.items():
        term = dbl(name) * float(w)
        out = term if out is None else out + term
    return out


def clip_probability(p, eps: float) -> Column:
    p = dbl(p)
    return F.when(p < eps, F.lit(eps)).when(p > 1 - eps, F.lit(1 - eps)).otherwise(p)


def row_log_loss(y, p, eps: float = 1e-15) -> Column:
    q, y = clip_probability(p, eps), dbl(y)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


# ---- the same guards as SQL text, for projections of many columns ------------------------

def ratio_sql(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def ratio1_sql(num: str, den: str) -> str:
    """num / max(den, 1); a NULL den stays NULL."""
    return f"CAST({num} AS DOUBLE) / CASE WHEN {den} < 1 THEN 1D ELSE CAST({den} AS DOUBLE) END"


def in_sql(x: str, values) -> str:
    """Membership that is false, not NULL, for a missing value."""
    items = ", ".join(str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "\\'") + "'" for v in values)
    return f"coalesce({x} IN ({items}), false)"


def count_sql(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


def fip_sql(hr: str, free_bases: str, k: str, pa: str) -> str:
    return f"{ratio_sql(f'(13 * {hr} + 3 * {free_bases} - 2 * {k})', pa)} + {K.FIP_CONSTANT}D"


def named(items: dict) -> list:
    """SELECT items of a {name: SQL text} mapping."""
    return [f"{e} AS `{n}`" for n, e in items.items()]


def named_columns(items: dict) -> list:
    """The same as columns, for grouped aggregation."""
    return [F.expr(x) for x in named(items)]
