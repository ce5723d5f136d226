"""Column expressions: cleaning, returns, tokens, rounding, labels. All stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the token grid: 400 half-open bins of width 0.005 on [-1, 1].
BINS = 400
BIN_WIDTH = 0.005
VOCABULARY = BINS + 2
PAD_TOKEN = 0
CLIP = 1.0 - 1e-9
LOG_FLOOR = -0.9999


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def winsorise(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Clip, keeping NULL as NULL (``greatest`` and ``least`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_even(x: Column, places: int) -> Column:
    """Scale, round to the even neighbour, scale back; no negative zero."""
    scale = float(10 ** places)
    return F.rint(x * scale) / scale + 0.0


def whole_volume(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("bigint")


def ratio_return(current: Column, previous: Column) -> Column:
    """current/previous - 1, where a zero previous close is a signed 100 % move or NULL."""
    from_zero = F.when(current > 0, F.lit(1.0)).when(current < 0, F.lit(-1.0))
    return F.when(previous == 0, from_zero).otherwise(F.try_divide(current, previous) - 1)


def bin_edge(i: Column) -> Column:
    return i * F.lit(BIN_WIDTH) - F.lit(1.0)


def token_of(r: Column) -> Column:
    """Bin number 1..400 of a return, exact on every edge; NULL stays NULL.

    The arithmetic guess may be off by one beside an edge, so it is compared with the two
    exact edges around it.
    """
    x = winsorise(r, -CLIP, CLIP)
    guess = (F.floor((x + 1) * 200) + 1).cast("int")
    return (F.when(x < bin_edge(guess - 1), guess - 1)
             .when(x >= bin_edge(guess), guess + 1)
             .otherwise(guess))


def centre_of(token: Column) -> Column:
    """Return that a token stands for: the bin's midpoint, -1 and +1 for the two end tokens."""
    return (F.when(token <= 0, F.lit(-1.0))
             .when(token > BINS, F.lit(1.0))
             .otherwise((bin_edge(token - 1) + bin_edge(token)) / 2))


def log_growth(r: Column) -> Column:
    return F.log1p(F.greatest(r, F.lit(LOG_FLOOR)))


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail for whole degrees of freedom, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    extra = F.floor((df - 2) / 2).cast("int")

    def grow(acc: Column, j: Column) -> Column:
        factor = F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
        term = acc["term"] * factor * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(extra >= 1, F.sequence(F.lit(1), F.greatest(extra, F.lit(1))))
    one = F.lit(1.0)
    series = F.aggregate(F.coalesce(steps, F.array().cast("array<int>")),
                         F.struct(one.alias("term"), one.alias("total")), grow)["total"]
    tail = F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0)
    inside = F.when(odd, (2 / F.pi()) * (theta + tail)).otherwise(F.sin(theta) * series)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def signal_band(rank: Column, total: Column) -> Column:
    pct = rank / total * 100
    return (F.when(pct <= 5, "STRONG BUY").when(pct <= 20, "BUY")
             .when(pct >= 95, "STRONG AVOID").when(pct >= 80, "AVOID").otherwise("NEUTRAL"))


def better_than_pct(rank: Column, total: Column) -> Column:
    return F.bround((1 - rank / total) * 100, 0).cast("int")


def volatility_wording(ratio: Column) -> Column:
    return (F.when(ratio > 1.3, "more jumpy than usual")
             .when(ratio < 0.7, "calmer than usual").otherwise("normal"))


def strength_wording(pctile: Column) -> Column:
    return F.when(pctile >= 95, "strong").when(pctile <= 20, "weak").otherwise("moderate")


def regime_label(prob_up: Column, bull: float = 55, bear: float = 42) -> Column:
    return F.when(prob_up >= bull, "bull").when(prob_up <= bear, "bear").otherwise("neutral")


def p_wording(p: Column) -> Column:
    return (F.when(p < 0.001, "p<0.001").when(p < 0.01, "p<0.01")
             .when(p < 0.05, "p<0.05").otherwise("not significant"))


def t_marks(t: Column) -> Column:
    size = F.abs(t)
    return (F.when(size > 2.58, "p<0.01").when(size > 1.96, "p<0.05")
             .when(size > 1.65, "p<0.10").otherwise(""))


def asked_count(text: Column, default: int = 10, cap: int = 30) -> Column:
    """Last all-digit word of a question, capped; the default where there is none."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w.rlike("^[0-9]+$"))
    last = F.try_element_at(words, F.lit(-1))
    # leading zeros say nothing; what is then too long for BIGINT is still a number, and so is capped
    digits = F.regexp_replace(last, "^0+(?=[0-9])", "")
    value = F.when(F.length(digits) > 18, F.lit(cap)).otherwise(digits.cast("bigint"))
    return F.when(last.isNull(), default).otherwise(F.least(value, F.lit(cap))).cast("int")
