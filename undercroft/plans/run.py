"""One batch run: forecasts of every direction over its units, merged into cards and work orders.

A direction brings a ``Predictor``.  Directions on the stream's cadence go first.  A run is declarative: it takes the
tables as they are and gives them as they become, so running it again on its own result changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.operators.cards import assign_levels, merge_cards, refresh_taken, without_busy
from undercroft.operators.orders import create_orders, follow_orders
from undercroft.session import stored

Frame = Callable[[DataFrame, str], DataFrame]
Hook = Callable[[str], Column]


@dataclass(frozen=True)
class Predictor:
    """``score(units, at)`` gives ``facility_id, probability`` and what the other hooks read.

    ``applies`` narrows the units, ``prepare`` adds what is known once a run, ``bands`` sets the level bounds of this run
    from its scores.  ``features`` names the columns that ``score`` reads; they must be there.

    Hooks over the scored rows are columns of ``at``: ``level`` grades by rules (else a column ``level`` of the scores, else bounds
    of the probability), ``incident`` is the start of what the forecast is about and keys its card (null: the day),
    ``last_event`` the latest event it stands on, which opens a copy of a card that was finished before it (else a column
    ``event_at``), ``summary`` a line of text.  ``candidates(events, since, at)`` gives the facilities worth a new forecast between
    full runs, ``live_blocks(units, at)`` gives ``facility_id, live_blocks`` that take the place of a card's blocks of their kind.
    """

    score: Frame
    applies: Frame | None = None
    prepare: Frame | None = None
    bands: Callable[[DataFrame, str], Sequence[tuple[str, float]]] | None = None
    features: tuple[str, ...] = ()
    level: Hook | None = None
    incident: Hook | None = None
    last_event: Hook | None = None
    summary: Hook | None = None
    candidates: Callable[[DataFrame, str, str], DataFrame] | None = None
    live_blocks: Frame | None = None


@dataclass
class Predictors:
    """Predictors by direction: a code of no direction, or one that has its predictor, is refused."""

    held: dict[str, Predictor] = field(default_factory=dict)

    def add(self, code: str, predictor: Predictor) -> None:
        if code not in config.DIRECTION:
            raise KeyError(f"{code} is no direction")
        if code in self.held:
            raise ValueError(f"{code} has a predictor")
        self.held[code] = predictor

    def due(self) -> list[str]:
        """Enabled directions with a predictor, those of the stream first."""
        active = [c for c in self.held if config.DIRECTION[c].enabled]
        return sorted(active, key=lambda c: config.DIRECTION[c].cadence != "stream")

    def missing(self) -> list[str]:
        return [d.code for d in config.DIRECTIONS if d.enabled and d.code not in self.held]


def forecasts_of(code: str, predictor: Predictor, units: DataFrame, at: str, run_id: int) -> DataFrame:
    """One forecast per unit of a direction, with its level."""
    now = F.lit(at).cast("timestamp")
    rows = predictor.applies(units, at) if predictor.applies else units
    rows = predictor.prepare(rows, at) if predictor.prepare else rows
    if absent := set(predictor.features) - set(rows.columns):
        raise KeyError(f"{code} reads columns that are not there: {sorted(absent)}")
    scored = predictor.score(rows, at)

    def hook(name: str, kind: str, column: str | None = None) -> Column:
        own = getattr(predictor, name)
        value = own(at) if own else F.col(column) if column in scored.columns else F.lit(None)
        return value.cast(kind)

    day = F.date_trunc("day", now)
    named = scored.select(
        "facility_id", F.lit(code).alias("direction"), F.coalesce(hook("incident", "timestamp"), day).alias("bucket"), now.alias("computed_at"),
        hook("last_event", "timestamp", "event_at").alias("event_at"), "probability", hook("level", "string", "level").alias("level"), hook("summary", "string").alias("summary"))
    bands = predictor.bands(named, at) if predictor.bands else None
    return assign_levels(named, bands).withColumn("run_id", F.lit(run_id).cast("long"))


def with_live_blocks(predictors: Predictors, plan: Mapping[str, tuple[str, DataFrame]], cards: DataFrame, at: str) -> DataFrame:
    """Unfinished cards of the units that ran, with their fresh blocks."""
    live = None
    for code, (moment, units) in plan.items():
        if hook := predictors.held[code].live_blocks:
            part = hook(units, moment).withColumn("direction", F.lit(code))
            live = part if live is None else live.unionByName(part)
    if live is None or "blocks" not in cards.columns:
        return cards
    own = cards.filter(~F.col("status").isin(*config.FINISHED_CARDS)).select("prediction_id", "facility_id", "direction")
    return refresh_taken(cards, own.join(live, ["facility_id", "direction"]).select("prediction_id", "live_blocks"), at)


def run_directions(predictors: Predictors, units: DataFrame, cards: DataFrame, orders: DataFrame, at: str, run_id: int, last_number: int = 0) -> Mapping[str, DataFrame]:
    """A run of every direction over all units at ``at``."""
    return run_planned(predictors, {code: (at, units) for code in predictors.due()}, cards, orders, at, run_id, last_number)


def run_planned(predictors: Predictors, plan: Mapping[str, tuple[str, DataFrame]], cards: DataFrame, orders: DataFrame, at: str, run_id: int, last_number: int = 0) -> Mapping[str, DataFrame]:
    """``cards`` and ``orders`` after the run, ``created`` orders, ``forecasts`` and ``report``: new cards and orders by direction.

    ``plan`` has the moment and the units of each direction.  A facility in work gets no new card (its taken card is
    refreshed), and its forecast opens no order.
    """
    forecasts = None
    for code, (moment, units) in plan.items():
        part = forecasts_of(code, predictors.held[code], units, moment, run_id)
        forecasts = part if forecasts is None else forecasts.unionByName(part)
    if forecasts is None:
        raise ValueError("no direction has a predictor")
    forecasts = stored(forecasts)
    merged = stored(with_live_blocks(predictors, plan, merge_cards(cards, forecasts), at))
    mine = merged.filter(F.col("run_id") == run_id).select("prediction_id", "facility_id", "direction", "level", "computed_at")
    horizon = F.coalesce(*[F.when(F.col("direction") == d.code, d.horizon_hours) for d in config.DIRECTIONS])
    candidates = without_busy(mine, cards).withColumn("horizon_hours", horizon)
    followed = follow_orders(orders, candidates)
    muted = cards if "suppress_until" in cards.columns else cards.withColumn("suppress_until", F.lit(None).cast("timestamp"))
    created = stored(create_orders(orders, candidates, muted, int(at[:4]), last_number))
    counts = merged.groupBy("direction").agg(F.count_if("is_new").alias("new_cards")).join(
        created.groupBy("direction").agg(F.count(F.lit(1)).alias("new_orders")), "direction", "left")
    return {
        "cards": merged.drop("is_new"), "orders": followed.unionByName(created.select(*[c for c in created.columns if c in orders.columns]), allowMissingColumns=True),
        "created": created, "forecasts": forecasts, "report": counts.fillna(0, ["new_orders"]),
    }
