"""Score expressions over plain columns. Times are columns, `now` is always an argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros.cast("double") / 1e6


def clamp(col: Column, low: float, high: float) -> Column:
    """Limit a value to a range; null stays null (least and greatest alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col)))


def settle(col: Column, digits: int) -> Column:
    """Drop the last bits of a double so that the order of a sum cannot decide a tie.

    Unlike `round` this is plain arithmetic and stays inside generated code.
    """
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def hotness(
    reinforcement: Column, updated: Column, now: Column, weight: Column, half_life_days: float = 14.0
) -> Column:
    """Use frequency times age decay; emotional weight stretches the half life by up to a half.

    Without a time of last update the score is 0.
    """
    half_life = F.greatest(half_life_days * (1.0 + 0.5 * clamp(F.coalesce(weight, F.lit(0)), 0, 10) / 10.0), F.lit(0.1))
    frequency = 1.0 / (1.0 + F.exp(-F.log1p(F.greatest(reinforcement, F.lit(0)).cast("double"))))
    age_days = F.greatest(seconds_between(now, updated) / 86400.0, F.lit(0.0))
    return F.when(updated.isNull(), F.lit(0.0)).otherwise(frequency * F.exp(-F.log(F.lit(2.0)) / half_life * age_days))


def energy(last_user: Column, now: Column) -> Column:
    """Three-scale decay of the minutes since the last user message; 0 without one."""
    minutes = F.greatest(seconds_between(now, last_user) / 60.0, F.lit(0.0))
    value = (
        0.50 * F.exp(-minutes / 30.0) + 0.35 * F.exp(-minutes / 240.0) + 0.15 * F.exp(-minutes / 2880.0)
    )
    return F.when(last_user.isNull(), F.lit(0.0)).otherwise(value)


def content_saturation(new_items: Column, half: float = 3.0) -> Column:
    return F.when(new_items <= 0, F.lit(0.0)).otherwise(1.0 - F.exp(-new_items / max(half, 0.1)))


def recent_activity(messages: Column, scale: float = 10.0) -> Column:
    top = F.log1p(F.lit(max(scale, 1.0)))
    return F.when(messages <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.log1p(messages.cast("double")) / top)
    )


def drive(energy_value: Column, new_items: Column, messages: Column) -> Column:
    """Weighted mix of hunger for contact, fresh content and recent talk."""
    hunger = 1.0 - clamp(energy_value, 0.0, 1.0)
    mix = 0.40 * hunger + 0.40 * content_saturation(new_items) + 0.20 * recent_activity(messages)
    return clamp(mix, 0.0, 1.0)


def next_check_seconds(score: Column) -> Column:
    """Wait until the next check, shorter for a higher score."""
    return (
        F.when(score > 0.70, 420).when(score > 0.40, 1080).when(score > 0.20, 2400).otherwise(4800)
    ).cast("bigint")


@dataclass(frozen=True)
class InterruptConfig:
    reply_decay_minutes: float = 120.0
    no_reply_decay_minutes: float = 360.0
    activity_decay_minutes: float = 180.0
    recent_scale: float = 10.0
    fatigue_soft_cap: float = 6.0
    weight_reply: float = 0.35
    weight_activity: float = 0.25
    weight_fatigue: float = 0.15
    floor: float = 0.08


def reply_factor(last_user: Column, last_sent: Column, now: Column, cfg: InterruptConfig) -> Column:
    lag = F.greatest(seconds_between(last_user, last_sent) / 60.0, F.lit(0.0))
    silence = F.greatest(seconds_between(now, last_sent) / 60.0, F.lit(0.0))
    answered = F.exp(-lag / max(cfg.reply_decay_minutes, 1.0))
    ignored = 0.15 + 0.35 * F.exp(-silence / max(cfg.no_reply_decay_minutes, 1.0))
    return (
        F.when(last_sent.isNull(), F.lit(0.6))
        .when(last_user.isNotNull() & (last_user > last_sent), answered)
        .otherwise(ignored)
    )


def activity_factor(last_any_user: Column, messages: Column, now: Column, cfg: InterruptConfig) -> Column:
    idle = F.greatest(seconds_between(now, last_any_user) / 60.0, F.lit(0.0))
    live = F.when(last_any_user.isNull(), F.lit(0.2)).otherwise(F.exp(-idle / max(cfg.activity_decay_minutes, 1.0)))
    return 0.5 * live + 0.5 * recent_activity(messages, cfg.recent_scale)


def fatigue_factor(sent: Column, cfg: InterruptConfig) -> Column:
    return 1.0 / (1.0 + sent / max(cfg.fatigue_soft_cap, 0.1))


def interruptibility(reply: Column, activity: Column, fatigue: Column, cfg: InterruptConfig) -> Column:
    weights = cfg.weight_reply + cfg.weight_activity + cfg.weight_fatigue
    if weights <= 0:
        return F.lit(cfg.floor)
    raw = (cfg.weight_reply * reply + cfg.weight_activity * activity + cfg.weight_fatigue * fatigue) / weights
    return F.greatest(F.lit(cfg.floor), F.least(F.lit(1.0), raw))


@dataclass(frozen=True)
class SendConfig:
    daily_max: int = 8
    urgency_horizon_hours: float = 12.0
    veto_balance_min: float = 0.1
    veto_dim_min: int = 2
    weight_urgency: float = 0.15
    weight_balance: float = 0.10
    weight_dynamics: float = 0.10
    weight_gap: float = 0.25
    weight_relevance: float = 0.20
    weight_impact: float = 0.20
    threshold: float = 0.60


def send_score(
    age_hours: Column,
    sent: Column,
    interrupt: Column,
    gap: Column,
    relevance: Column,
    impact: Column,
    cfg: SendConfig = SendConfig(),
) -> Column:
    """Struct of the dimensions, the veto (if any), the weighted score and the decision."""
    urgency = F.greatest(
        F.lit(0.0), 1.0 - F.greatest(age_hours, F.lit(0.0)) / max(1.0, cfg.urgency_horizon_hours)
    )
    balance = F.greatest(F.lit(0.0), 1.0 - F.greatest(sent, F.lit(0)) / float(max(1, cfg.daily_max)))
    dynamics = 0.6 + 0.4 * clamp(interrupt, 0.0, 1.0)

    def scaled(dim: Column) -> Column:
        return (clamp(F.coalesce(dim.cast("int"), F.lit(2)), 1, 5) - 1) / 4.0

    dims = [scaled(gap), scaled(relevance), scaled(impact)]
    weights = [
        cfg.weight_urgency, cfg.weight_balance, cfg.weight_dynamics,
        cfg.weight_gap, cfg.weight_relevance, cfg.weight_impact,
    ]
    total = F.lit(0.0)
    for weight, value in zip(weights, [urgency, balance, dynamics, *dims]):
        total = total + weight * value
    score = total / sum(weights) if sum(weights) > 0 else F.lit(0.0)
    low = (cfg.veto_dim_min - 1) / 4.0
    veto = (
        F.when(balance < cfg.veto_balance_min, "balance")
        .when((dims[0] < low) | (dims[1] < low) | (dims[2] < low), "llm_dim")
    )
    return F.struct(
        urgency.alias("urgency"), balance.alias("balance"), dynamics.alias("dynamics"),
        veto.alias("vetoed_by"),
        F.when(veto.isNull(), score).otherwise(0.0).alias("score"),
        (veto.isNull() & (score >= cfg.threshold)).alias("send"),
    )


# Reward of a tool call and of a memory event.
THUMBS_UP = ("thumbs_up", "up", "+1", "like")
THUMBS_DOWN = ("thumbs_down", "down", "-1", "dislike")
LOOP_ERRORS = ("tool_loop_guard", "loop_guard")
BLOCK_ERRORS = ("timeout", "safety_denial", "safety", "blocked")
MEMORY_REWARD = {
    "retrieved": 0.05,
    "injected": 0.10,
    "used": 0.50,
    "corrected": -1.00,
    "superseded": -0.75,
    "deleted": -1.00,
    "user_positive": 2.00,
    "user_negative": -2.00,
}
MEMORY_UP = ("thumbs_up", "up", "positive", "like")
MEMORY_DOWN = ("thumbs_down", "down", "negative", "dislike")


def tool_error(status: Column, error: Column) -> Column:
    """The given error, else the status itself when it is not a success."""
    named = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    given = F.coalesce(error, F.lit(""))
    return F.when((given == "") & ~named.isin("", "success"), named).otherwise(given)


def tool_reward(
    status: Column,
    error: Column,
    feedback: Column,
    judge: Column,
    completed: Column,
    latency_ms: Column,
    explicit: Column | None = None,
) -> Column:
    success = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "success"
    fault = F.lower(F.trim(tool_error(status, error)))
    vote = F.lower(F.trim(F.coalesce(feedback, F.lit(""))))
    base = F.when(success, 1.0).otherwise(-1.0)
    base = F.when(fault.isin(*LOOP_ERRORS), -0.5).when(fault.isin(*BLOCK_ERRORS), base - 0.5).otherwise(base)
    vote_part = F.when(vote.isin(*THUMBS_UP), 2.0).when(vote.isin(*THUMBS_DOWN), -2.0).otherwise(0.0)
    judge_part = F.coalesce((clamp(judge, 0.0, 1.0) - 0.5) * 2.0, F.lit(0.0))
    done_part = F.when(completed, 1.0).otherwise(0.0)
    slow_part = F.when(latency_ms > 30_000, -0.25).otherwise(0.0)
    reward = F.round(base + vote_part + judge_part + done_part + slow_part, 6)
    return reward if explicit is None else F.coalesce(explicit, reward)


def memory_reward(event_type: Column, feedback: Column | None = None, explicit: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEMORY_REWARD.items() for x in pair])
    value = F.coalesce(F.try_element_at(table, event_type), F.lit(0.0))
    if feedback is not None:
        vote = F.lower(F.trim(F.coalesce(feedback, F.lit(""))))
        value = (
            F.when(vote.isin(*MEMORY_UP), MEMORY_REWARD["user_positive"])
            .when(vote.isin(*MEMORY_DOWN), MEMORY_REWARD["user_negative"])
            .otherwise(value)
        )
    return value if explicit is None else F.coalesce(explicit, value)
