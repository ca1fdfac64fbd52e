"""Votes of indicators, fused into one signal a bar; all in one plan."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bars import SIGNAL_ALIASES
from ..functions import indicators as ind
from ..functions.kernels import back
from ..functions.scalars import vote
from ..operators.recurrence import with_recurrences
from ..sources.files import as_bars


@dataclass(frozen=True)
class IndicatorConfig:
    name: str
    params: dict = field(default_factory=dict)
    weight: float = 1.0


@dataclass(frozen=True)
class Policy:
    """steps(df, reference, params) adds windowed columns; recur(params) names recurrences.

    vote(params) is the expression of the vote over them; `outputs` are the columns shown.
    `lagged` names expressions whose previous value the vote needs.
    """

    outputs: tuple[str, ...]
    vote: Callable[[dict], Column]
    steps: Callable | None = None
    recur: Callable | None = None
    spread: tuple[str, str] | None = None


C = F.col


def _crossed(a: str, b: str, over: Column | None = None, under: Column | None = None) -> Column:
    """1 where a comes from at or below b to above it, -1 for the mirror, under further conditions."""
    up, down = (C(a) > C(b)) & (C("_before") <= 0), (C(a) < C(b)) & (C("_before") >= 0)
    return vote(up if over is None else up & over, down if under is None else down & under)


def _only(p: dict, *names: str) -> dict:
    return {k: x for k, x in p.items() if k in names}


def _bollinger(p: dict) -> Column:
    if str(p.get("mode", "mean_reversion")).lower() == "trend":
        return vote(C("Close") > C("bb_upper"), C("Close") < C("bb_lower"))
    return vote(C("Close") <= C("bb_lower"), C("Close") >= C("bb_upper"))


POLICIES: dict[str, Policy] = {
    "rsi": Policy(("rsi",), lambda p: vote(C("rsi") <= p.get("buy_below", 30.0), C("rsi") >= p.get("sell_above", 70.0)), recur=lambda p: ("rsi", _only(p, "length"))),
    "macd": Policy(("macd_line", "macd_signal", "macd_hist"), lambda p: _crossed("macd_line", "macd_signal"), recur=lambda p: ("macd", p), spread=("macd_line", "macd_signal")),
    "bollinger": Policy(("bb_basis", "bb_upper", "bb_lower", "bb_width"), _bollinger, steps=lambda df, r, p: ind.bollinger(df, r, **_only(p, "length", "stdev_mult"))),
    "keltner": Policy(("kc_basis", "kc_upper", "kc_lower"), lambda p: vote(C("Close") > C("kc_upper"), C("Close") < C("kc_lower")), recur=lambda p: ("keltner", p)),
    "dmi_adx": Policy(
        ("plus_di", "minus_di", "adx"),
        lambda p: vote((C("plus_di") > C("minus_di")) & (C("adx") >= p.get("adx_min", 20.0)), (C("minus_di") > C("plus_di")) & (C("adx") >= p.get("adx_min", 20.0))),
        recur=lambda p: ("dmi_adx", _only(p, "length")),
    ),
    "stochastic": Policy(
        ("stoch_k", "stoch_d"),
        lambda p: _crossed("stoch_k", "stoch_d", C("stoch_k") < p.get("oversold", 20.0), C("stoch_k") > p.get("overbought", 80.0)),
        steps=lambda df, r, p: ind.stochastic(df, r, **_only(p, "k", "d", "smooth_k")),
        spread=("stoch_k", "stoch_d"),
    ),
    "supertrend": Policy(
        ("supertrend", "supertrend_dir"),
        lambda p: vote((C("Close") > C("supertrend")) & (C("supertrend_dir") > 0), (C("Close") < C("supertrend")) & (C("supertrend_dir") < 0)),
        recur=lambda p: ("supertrend", p),
    ),
    "donchian": Policy(("donchian_upper", "donchian_lower", "donchian_mid"), lambda p: vote(C("Close") > C("donchian_upper"), C("Close") < C("donchian_lower")), steps=lambda df, r, p: ind.donchian(df, r, **p)),
    "ichimoku": Policy(
        ("conversion", "base", "span_a", "span_b", "lagging"),
        lambda p: _crossed("conversion", "base", *_cloud(C("Close"))),
        steps=lambda df, r, p: ind.ichimoku(df, r, **p),
        spread=("conversion", "base"),
    ),
    "vwap": Policy(("vwap",), lambda p: vote(C("Close") > C("vwap"), C("Close") < C("vwap")), steps=lambda df, r, p: ind.vwap(df, r, **p)),
    "roc": Policy(("roc",), lambda p: vote(C("roc") > p.get("buy_above", 0.0), C("roc") < p.get("sell_below", 0.0)), steps=lambda df, r, p: ind.roc(df, r, **_only(p, "length"))),
    "obv": Policy(
        ("obv", "obv_ema"),
        lambda p: vote(C("obv") > C("obv_ema"), C("obv") < C("obv_ema")),
        steps=lambda df, r, p: ind.obv(df, r),
        recur=lambda p: ("ema", {"column": "obv", "length": p.get("ema_length", 20), "name": "obv_ema"}),
    ),
    "mfi": Policy(("mfi",), lambda p: vote(C("mfi") <= p.get("oversold", 20.0), C("mfi") >= p.get("overbought", 80.0)), steps=lambda df, r, p: ind.mfi(df, r, **_only(p, "length"))),
}

# The parameters that each policy takes.
PARAMETERS = {
    "rsi": ("length", "buy_below", "sell_above"), "macd": ("fast", "slow", "signal_len"), "bollinger": ("length", "stdev_mult", "mode"),
    "keltner": ("length", "atr_mult"), "dmi_adx": ("length", "adx_min"), "stochastic": ("k", "d", "smooth_k", "overbought", "oversold"),
    "supertrend": ("length", "multiplier"), "donchian": ("length",), "ichimoku": ("tenkan", "kijun", "senkou_b"), "vwap": ("session_resets",),
    "roc": ("length", "buy_above", "sell_below"), "obv": ("ema_length",), "mfi": ("length", "overbought", "oversold"),
}


def register_policy(name: str, policy: Policy, parameters: tuple[str, ...] = ()) -> None:
    """Makes a policy of the caller's available under a (lower-case) name."""
    POLICIES[name.lower()] = policy
    PARAMETERS[name.lower()] = parameters


def _cloud(close: Column) -> tuple[Column, Column]:
    """Above and below both spans; false while either is null."""
    both = C("span_a").isNotNull() & C("span_b").isNotNull()
    return both & (close > F.greatest("span_a", "span_b")), both & (close < F.least("span_a", "span_b"))


def parse_params(text: str | None) -> dict:
    """"length=14; mode=trend, flag" as a dict of bools, floats, ints and strings; a bare name is True."""
    out: dict = {}
    for part in (text or "").replace(";", ",").split(","):
        name, sep, value = (x.strip() for x in part.partition("="))
        if not sep:
            out |= {name: True} if name else {}
        elif value.lower() in ("true", "false"):
            out[name] = value.lower() == "true"
        else:
            kind = float if "." in value or "e" in value.lower() else int
            try:
                out[name] = kind(value)
            except ValueError:
                out[name] = value
    return out


def load_default_params(path: str) -> dict[str, dict]:
    """Parameters by indicator from a CSV file with the columns Key (else the first) and Params."""
    with open(path, newline="") as f:
        rows = csv.DictReader(f)
        names = rows.fieldnames or []
        key = "Key" if "Key" in names else names[0] if names else ""
        return {row[key].strip().lower(): parse_params(row.get("Params")) for row in rows}


def indicator(df: DataFrame, name: str, params: dict | None = None, semantics: str = "reference") -> DataFrame:
    """Bars with one policy's columns and its vote as signal_<name>."""
    return _apply(df, [IndicatorConfig(name, params or {})], semantics == "reference")


def _apply(df: DataFrame, configs: list[IndicatorConfig], reference: bool) -> DataFrame:
    shared = df.columns
    made: list[str] = []
    # windows first, then all recurrences in one pass, then votes
    recurrences, late = [], []
    for i, cfg in enumerate(configs):
        policy, tag = POLICIES[cfg.name], f"_{i}_"
        if policy.steps:
            df = policy.steps(df, reference, cfg.params)
        if policy.recur:
            name, p = policy.recur(cfg.params)
            recurrences.append((name, p | ({"column": f"{tag}obv"} if p.get("column") == "obv" else {}), tag))
        late.append((cfg, policy, tag))
        fresh = [c for c in policy.outputs if c in df.columns and c not in shared]
        df = df.withColumnsRenamed({c: tag + c for c in fresh})
    df = with_recurrences(df, recurrences, reference)
    for cfg, policy, tag in late:
        have = {c: tag + c for c in policy.outputs}
        df = df.withColumns({c: C(x) for c, x in have.items()})
        if policy.spread:
            df = df.withColumn("_spread", C(policy.spread[0]) - C(policy.spread[1])).withColumn("_before", back("_spread"))
        df = df.withColumn(f"signal_{cfg.name}", policy.vote(cfg.params))
        made = [x for x in made if x != f"signal_{cfg.name}" and not x.startswith(f"{cfg.name}_")] + [f"signal_{cfg.name}"]
        df = df.withColumns({f"{cfg.name}_{c}": C(c) for c in policy.outputs}).drop("_spread", "_before", *policy.outputs, *have.values())
        made += [f"{cfg.name}_{c}" for c in policy.outputs]
    return df.select(*shared, *made)


def fuse(df: DataFrame, configs: list[IndicatorConfig], aggregation: str = "weighted", deadband: float = 0.10) -> DataFrame:
    """df with signal, score and reason from its signal_<name> columns."""
    if not configs:
        return df.withColumns({"signal": F.lit(0.0), "score": F.lit(0.0), "reason": F.lit("no_votes")})
    votes = [C(f"signal_{cfg.name}") for cfg in configs]
    if aggregation == "majority":
        cast = F.array_sort(F.filter(F.array(*votes), lambda x: x != 0))
        n = F.size(cast)
        score = F.when(n == 0, 0.0).otherwise((F.get(cast, F.floor((n - 1) / 2).cast("int")) + F.get(cast, F.floor(n / 2).cast("int"))) / 2)
        signal = F.when(F.abs(score) > 1e-12, F.signum(score)).otherwise(0.0)
    else:
        total = sum(abs(cfg.weight) for cfg in configs) or 1.0
        score = sum((x * cfg.weight for x, cfg in zip(votes, configs)), F.lit(0.0)) / total
        signal = F.when((F.abs(score) > 1e-12) & (F.abs(score) >= deadband), F.signum(score)).otherwise(0.0)
    parts = [F.when(x != 0, F.concat(F.lit(f"{cfg.name}="), x.cast("int").cast("string"))) for x, cfg in zip(votes, configs)]
    reason = F.concat_ws("; ", *parts)
    return df.withColumns({"signal": signal, "score": score, "reason": F.when(reason == "", "all_neutral").otherwise(reason)})


def generate_signals(
    bars,
    indicators: list[IndicatorConfig],
    *,
    defaults_csv: str | None = None,
    aggregation: str = "weighted",
    deadband: float = 0.10,
    semantics: str = "reference",
) -> tuple[DataFrame, DataFrame]:
    """(per_indicator, composite) of bars, two projections of one plan.

    `bars` are bars, a table whose columns go by other accepted names, or rows (see as_bars).

    Raises KeyError for unknown indicators and TypeError for unknown parameters. A name may
    come twice in reference semantics (the last one's columns, both weights); intended
    semantics reject that.
    """
    bars = as_bars(bars, SIGNAL_ALIASES)
    defaults = load_default_params(defaults_csv) if defaults_csv else {}
    configs = []
    for cfg in indicators:
        name = cfg.name.lower()
        if name not in POLICIES:
            raise KeyError(f"no policy for {name!r}; known are {sorted(POLICIES)}")
        params = defaults.get(name, {}) | (cfg.params or {})
        if odd := set(params) - set(PARAMETERS[name]):
            raise TypeError(f"'{name}' does not take {sorted(odd)}")
        configs.append(IndicatorConfig(name, params, float(cfg.weight)))
    if semantics != "reference" and len({c.name for c in configs}) < len(configs):
        raise ValueError("an indicator is named twice")
    voted = _apply(bars, configs, semantics == "reference")
    fused = fuse(voted, configs, aggregation, deadband)
    keys = ["series", "ord", "Datetime"]
    own = [c for c in voted.columns if c not in bars.columns]
    return fused.select(*keys, *own), fused.select(*keys, "signal", "score", "reason")
