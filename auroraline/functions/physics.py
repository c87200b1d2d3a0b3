"""Solar-wind and ring-current formulas as column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants of the published models; fixed values.
PRESSURE = 1.6726e-6
DST_STAR_B, DST_STAR_C = 7.26, 11.0
QUIET_PRESSURE, PRESSURE_MAX_AGE = 2.0, 6
BURTON_ALPHA, BURTON_TAU, BURTON_THRESHOLD = 5.4e-3, 7.7, 500.0
OBRIEN_ALPHA, OBRIEN_THRESHOLD = 4.4, 0.49
RATE_LIMIT, STATE_LOW, STATE_HIGH = 200.0, -2000.0, 50.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float, high: float) -> Column:
    """Limits that keep null as null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def positive(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def dynamic_pressure(n, v) -> Column:
    n, v = col(n), col(v)
    return F.when((n >= 0) & (v >= 0), (F.lit(PRESSURE) * n) * (v * v))


def dst_star(dst, pressure) -> Column:
    return col(dst) - DST_STAR_B * F.sqrt(positive(col(pressure))) + DST_STAR_C


def dst_from_star(star, pressure) -> Column:
    return col(star) + DST_STAR_B * F.sqrt(positive(col(pressure))) - DST_STAR_C


def southward(bz) -> Column:
    return positive(-col(bz))


def clock_angle(by, bz) -> Column:
    return F.atan2(F.abs(col(by)), col(bz))


def transverse(by, bz) -> Column:
    return F.hypot(col(by), col(bz))


def newell(v, by, bz) -> Column:
    half = F.sin(clock_angle(by, bz) / 2)
    value = F.pow(col(v), F.lit(4 / 3)) * F.pow(transverse(by, bz), F.lit(2 / 3)) * F.pow(positive(half), F.lit(8 / 3))
    return F.when(col(v) >= 0, value)


def burton(v, bs, star) -> Column:
    return -BURTON_ALPHA * col(v) * col(bs) - col(star) / BURTON_TAU


def burton_full(v, bs, star) -> Column:
    drive = col(v) * col(bs)
    return F.when(drive > BURTON_THRESHOLD, -BURTON_ALPHA * (drive - BURTON_THRESHOLD)).when(drive.isNotNull(), 0.0) - col(star) / BURTON_TAU


def obrien(v, bs, star) -> Column:
    field = col(v) * col(bs) / 1000.0
    injected = F.when(field > OBRIEN_THRESHOLD, -OBRIEN_ALPHA * (field - OBRIEN_THRESHOLD)).when(field.isNotNull(), 0.0)
    return injected - col(star) / (2.40 * F.exp(9.74 / (4.69 + field)))


def euler(state: Column, rate: Column, hours: float | Column = 1.0) -> Column:
    """One step with the limits of the models on rate and state."""
    return clamp(state + clamp(rate, -RATE_LIMIT, RATE_LIMIT) * hours, STATE_LOW, STATE_HIGH)


def library(poly_order: int = 2, trig: bool = True, cross: bool = True, known: bool = True, n_v2: bool = False, collapsed_clock: bool = False) -> list[tuple[str, Column]]:
    """Candidate terms in their declared order, over v, bs, n, pdyn, dst_star, by_gsm, bz."""
    v, bs, n, pdyn, star = (F.col(c) for c in ("v", "bs", "n", "pdyn", "dst_star"))
    half = F.sin(clock_angle("by_gsm", "bz") / 2)
    terms = [("one", F.lit(1.0)), ("v", v), ("bs", bs), ("n", n), ("pdyn", pdyn), ("dst_star", star)]
    if poly_order >= 2:
        terms += [("v_2", v * v), ("bs_2", bs * bs), ("n_2", n * n)]
    if cross:
        terms += [("v_bs", v * bs), ("n_v", n * v), ("n_bs", n * bs), ("pdyn_bs", pdyn * bs)]
        if poly_order >= 2:
            terms.append(("n_v_bs", n * v * bs))
            if n_v2:
                terms.append(("n_v_2", n * v * v))
    if trig and not collapsed_clock:
        terms += [("sin_half", half), ("sin_half_2", half * half), ("sin_half_4", F.pow(half, F.lit(4.0))), ("sin_half_8_3", F.pow(positive(half), F.lit(8 / 3))), ("v_sin_half_2", v * half * half)]
    if known:
        terms.append(("newell", newell("v", "by_gsm", "bz")))
    return terms


def minimal_library() -> list[tuple[str, Column]]:
    return [("one", F.lit(1.0)), ("dst_star", F.col("dst_star")), ("v_bs", F.col("v") * F.col("bs"))]


# ---------------------------------------------------------------- classes


def activity(dst, threshold: float = -30.0) -> Column:
    """An unknown index is taken as disturbed, the class with the wider interval."""
    return F.when(col(dst) > threshold, "quiet").otherwise("disturbed")


def depth(dst) -> Column:
    return F.when(col(dst) <= -100, "deep").when(col(dst) <= -50, "moderate").otherwise("shallow")


def severity(dst) -> Column:
    return F.when(col(dst) <= -200, "superintense").when(col(dst) <= -100, "intense").when(col(dst) <= -50, "moderate").when(col(dst).isNotNull(), "quiet")


def severity_rank(dst) -> Column:
    return F.when(col(dst) <= -200, 3).when(col(dst) <= -100, 2).when(col(dst) <= -50, 1).otherwise(0)


def horizon_bin(hours, edges: tuple[float, ...] = (0, 2, 4, 7)) -> Column:
    """Number of the half-open bin [edge, next edge), the last one for all beyond and for null."""
    found = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, 0, -1):
        found = F.when(col(hours) < edges[i], i).otherwise(found)
    return found


def g_level(kp) -> Column:
    return F.when(col(kp) >= 9, 5).when(col(kp) >= 8, 4).when(col(kp) >= 7, 3).when(col(kp) >= 6, 2).when(col(kp) >= 5, 1).otherwise(0)


def solar_cycle(day) -> Column:
    """Number of the solar cycle by the published months of its minima."""
    # first days of cycles 20 to 25; fixed values
    starts = ((25, "2019-12-01"), (24, "2008-12-01"), (23, "1996-08-01"), (22, "1986-09-01"), (21, "1976-03-01"), (20, "1964-10-01"))
    found = F.lit(19)
    for cycle, start in reversed(starts):
        found = F.when(col(day) >= F.to_date(F.lit(start)), cycle).otherwise(found)
    return found


def cycle_split(cycle) -> Column:
    return F.when(col(cycle).between(20, 23), "train").when(col(cycle) == 24, "val").when(col(cycle) >= 25, "test").otherwise("exclude")
