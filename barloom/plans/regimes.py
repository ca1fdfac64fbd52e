"""Market regimes: features, exclusive primaries, tags, hysteresis."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bars import REGIME_ALIASES
from ..functions import indicators as ind
from ..functions.kernels import back
from ..operators.recurrence import with_recurrences
from ..operators.scan import scan
from ..sources.files import as_bars


@dataclass(frozen=True)
class RegimeConfig:
    """Names and defaults of the public configuration."""

    adx_trend_gate: float = 25.0
    adx_range_gate: float = 18.0
    ema_len_for_slope: int = 20
    atr_len: int = 14
    bb_len: int = 20
    bb_mult: float = 2.0
    kc_len: int = 20
    kc_mult: float = 2.0
    squeeze_min_bars: int = 3
    breakout_atr_pct_gate: float = 2.0
    confirm_bars: int = 2
    exit_bars: int = 2


FEATURES = (
    "adx", "atr_pct", "ema20", "ema20_slope", "bb_up", "bb_lo", "bb_width", "kc_mid", "kc_up", "kc_lo", "squeeze_on", "st_dir", "st_line",
    "macd_line", "macd_sig", "macd_hist", "span_a", "span_b", "above_cloud", "below_cloud", "close",
)
C = F.col


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def compute_features(bars: DataFrame, cfg: RegimeConfig = RegimeConfig(), semantics: str = "reference") -> DataFrame:
    """bars with the 21 feature columns; two window steps and one grouped pass."""
    reference, shared = semantics == "reference", bars.columns
    df = ind.ichimoku(ind.bollinger(bars, reference, cfg.bb_len, cfg.bb_mult), reference)
    df = with_recurrences(
        df,
        [
            ("dmi_adx", {"length": cfg.atr_len}, ""),
            ("atr", {"length": cfg.atr_len}, ""),
            ("ema", {"length": cfg.ema_len_for_slope, "name": "ema20"}, ""),
            ("keltner", {"length": cfg.kc_len, "atr_mult": cfg.kc_mult}, ""),
            ("supertrend", {}, ""),
            ("macd", {}, ""),
        ],
        reference,
    )
    n = cfg.ema_len_for_slope
    spans = C("span_a").isNotNull() & C("span_b").isNotNull()
    df = df.withColumns(
        {
            "atr_pct": 100.0 * C("atr") / F.greatest("Close", F.lit(1e-12)),
            "ema20_slope": (C("ema20") - back("ema20", n)) / n,
            "bb_up": C("bb_upper"), "bb_lo": C("bb_lower"), "kc_mid": C("kc_basis"), "kc_up": C("kc_upper"), "kc_lo": C("kc_lower"),
            "squeeze_on": _flag((C("bb_upper") < C("kc_upper")) & (C("bb_lower") > C("kc_lower"))),
            "st_dir": C("supertrend_dir"), "st_line": C("supertrend"), "macd_sig": C("macd_signal"),
            "above_cloud": _flag(spans & (C("Close") > F.greatest("span_a", "span_b"))),
            "below_cloud": _flag(spans & (C("Close") < F.least("span_a", "span_b"))),
            "close_": C("Close"),
        }
    )
    return df.select(*shared, *[F.col("close_").alias("feature_close") if f == "close" else C(f) for f in FEATURES])


def _scaled(x: Column, name: str) -> Column:
    """x between its series' 5 % and 95 % quantiles, from 0 to 1; 1 if they are equal."""
    lo, hi = C(f"_{name}_q")[0], C(f"_{name}_q")[1]
    out = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), F.when(hi - lo <= 1e-12, 1.0).otherwise(out))


@dataclass(frozen=True)
class Primary:
    """Expressions over features: when it holds, its direction and confidence."""

    key: str
    priority: int
    detect: Callable[[RegimeConfig], tuple[Column, Column, Column]]


PRIMARIES: dict[str, Primary] = {}
TAGS: dict[str, Callable[[RegimeConfig], Column]] = {}


def register_primary(key: str, priority: int):
    """Registers a function of the configuration that returns (active, direction, confidence)."""

    def put(f):
        PRIMARIES[key] = Primary(key, priority, f)
        return f

    return put


def register_tag(key: str):
    """Registers a function of the configuration that returns a boolean expression."""

    def put(f):
        TAGS[key] = f
        return f

    return put


@register_primary("trend_up", 80)
def _trend_up(cfg):
    sure = (C("st_dir") > 0, C("macd_line") > C("macd_sig"), C("above_cloud") > 0)
    return (C("adx") >= cfg.adx_trend_gate) & _any(*sure), F.lit(1.0), _scaled(C("adx"), "adx")


@register_primary("trend_down", 80)
def _trend_down(cfg):
    sure = (C("st_dir") < 0, C("macd_line") < C("macd_sig"), C("below_cloud") > 0)
    return (C("adx") >= cfg.adx_trend_gate) & _any(*sure), F.lit(-1.0), _scaled(C("adx"), "adx")


@register_primary("breakout", 70)
def _breakout(cfg):
    wide = C("atr_pct") >= cfg.breakout_atr_pct_gate
    bull, bear = (F.coalesce(x & wide, F.lit(False)) for x in (C("Close") > C("kc_up"), C("Close") < C("kc_lo")))
    return bull | bear, F.when(bull, 1.0).otherwise(-1.0), _scaled(C("atr_pct"), "atr_pct")


@register_primary("squeeze", 60)
def _squeeze(cfg):
    return C("_run") >= cfg.squeeze_min_bars, F.lit(0.0), 1.0 - _scaled(C("bb_width"), "bb_width")


@register_primary("range", 50)
def _range(cfg):
    slope = F.abs("ema20_slope")
    active = (C("adx") <= cfg.adx_range_gate) & (slope <= C("_slope_q")[3])
    return active, F.lit(0.0), (1.0 - _scaled(C("adx"), "adx")) * (1.0 - _scaled(slope, "slope"))


@register_tag("pullback_up")
def _pullback_up(cfg):
    return (C("st_dir") > 0) & (C("macd_line") < C("macd_sig"))


@register_tag("pullback_down")
def _pullback_down(cfg):
    return (C("st_dir") < 0) & (C("macd_line") > C("macd_sig"))


@register_tag("accumulation")
def _accumulation(cfg):
    return (F.abs("ema20_slope") <= C("_slope_q")[2]) & (C("macd_hist") > 0)


@register_tag("distribution")
def _distribution(cfg):
    return (F.abs("ema20_slope") <= C("_slope_q")[2]) & (C("macd_hist") < 0)


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _hysteresis(confirm_bars: int, exit_bars: int, reference: bool):
    now, confirm, blanks, last = "", 0, 0, ""

    def hold(b):
        """Adopts a key after enough confirmations, clears after enough blanks.

        In reference semantics all candidates share one counter, and blanks in between do
        not reset it; else a key must come in consecutive bars.
        """
        nonlocal now, confirm, blanks, last
        out = []
        for key in b["primary"]:
            if key == "":
                blanks += 1
                if not reference:
                    confirm = 0
                if blanks >= exit_bars:
                    now = ""
            elif key != now:
                confirm = confirm + 1 if reference or key == last else 1
                if not reference:
                    blanks = 0
                if confirm >= confirm_bars:
                    now, confirm, blanks = key, 0, 0
            else:
                confirm = blanks = 0
            last = key
            out.append(now)
        return {"primary": np.array(out, dtype=object)}

    return hold


class RegimeEngine:
    """Detectors in order of priority (ties: of registration), or in a given order."""

    def __init__(self, cfg: RegimeConfig = RegimeConfig(), primary_order: list[str] | None = None, tags: list[str] | None = None, semantics: str = "reference"):
        self.cfg, self.semantics = cfg, semantics
        self.order = list(primary_order) if primary_order is not None else sorted(PRIMARIES, key=lambda k: -PRIMARIES[k].priority)
        self.tags = list(tags) if tags is not None else list(TAGS)

    def winners(self, bars) -> DataFrame:
        """Features with primary, direction, confidence and tags, before hysteresis.

        The quantiles look at the whole series (one aggregation a series, joined back): not
        for streams.
        """
        feats = compute_features(as_bars(bars, REGIME_ALIASES), self.cfg, self.semantics)
        q = feats.groupBy("series").agg(
            *[F.percentile(C(x), F.array(F.lit(0.05), F.lit(0.95))).alias(f"_{x}_q") for x in ("adx", "atr_pct", "bb_width")],
            F.percentile(F.abs("ema20_slope"), F.array(F.lit(0.05), F.lit(0.95), F.lit(0.5), F.lit(0.6))).alias("_slope_q"),
        )
        w = Window.partitionBy("series").orderBy("ord")
        off = F.sum(F.when(C("squeeze_on") > 0, 0).otherwise(1)).over(w)
        df = feats.join(q, "series").withColumn("_island", off)
        run = F.sum(F.when(C("squeeze_on") > 0, 1).otherwise(0)).over(Window.partitionBy("series", "_island").orderBy("ord"))
        df = df.withColumn("_run", run)
        found = []
        for rank, key in enumerate(self.order):
            active, direction, confidence = PRIMARIES[key].detect(self.cfg)
            one = F.struct(F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.lit(-rank).alias("rank"), F.lit(key).alias("key"), direction.cast("double").alias("direction"))
            found.append(F.when(F.coalesce(active, F.lit(False)), one))
        best = F.array_max(F.array_compact(F.array(*found)))
        df = df.withColumn("_best", best)
        tags = [F.when(F.coalesce(TAGS[k](self.cfg), F.lit(False)), F.lit(k)) for k in self.tags]
        return df.withColumns(
            {
                "primary": F.coalesce(C("_best.key"), F.lit("")),
                "direction": F.coalesce(C("_best.direction"), F.lit(0.0)),
                "confidence": F.coalesce(C("_best.confidence"), F.lit(0.0)),
                "tags": F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>"),
            }
        ).drop("_best", "_island", "_run", "_slope_q", "_adx_q", "_atr_pct_q", "_bb_width_q")

    def run(self, bars) -> tuple[DataFrame, DataFrame]:
        """(regimes, features): one primary a bar after hysteresis, with its tags."""
        won = self.winners(bars)
        slim = won.select("series", "ord", "Datetime", "primary", "direction", "confidence", "tags", "adx", "atr_pct", (C("squeeze_on") > 0).alias("squeeze_on"), "bb_width")
        hold = partial(_hysteresis, self.cfg.confirm_bars, self.cfg.exit_bars, self.semantics == "reference")
        return scan(slim, slim.schema, hold), won.select("series", "ord", "Datetime", *[C("feature_close").alias("close") if f == "close" else C(f) for f in FEATURES])


def annotate_regimes(bars, config: dict | None = None, semantics: str = "reference") -> tuple[DataFrame, DataFrame]:
    return RegimeEngine(RegimeConfig(**(config or {})), semantics=semantics).run(bars)
