"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V


def retrieval_strength(strength: Column, turn: Column, now: Column, rate: float = V.RS_RATE) -> Column:
    return F.greatest(F.lit(0.0), strength - F.greatest(F.lit(0), now - turn) * rate)


def base_level(log: Column, now: Column) -> Column:
    """Power-law activation over an access log; beyond 32 entries from their number and span. Empty or null: 0."""
    n = F.size(log)
    exact = F.aggregate(log, F.lit(0.0), lambda a, t: a + F.pow(F.greatest(F.lit(1), now - t).cast("double"), F.lit(-V.DECAY_EXPONENT)))
    span = n / (1 - V.DECAY_EXPONENT) * F.pow(F.greatest(F.lit(1), now - F.array_min(log)).cast("double"), F.lit(-V.DECAY_EXPONENT))
    total = F.when(n > V.LOG_EXACT, span).when(n > 0, exact).otherwise(0.0)
    return V.DECAY_SCALE * F.log(total + 1)


def record_score(overlap: Column, rs: Column, ss: Column, bla: Column, weights: tuple[float, float, float]) -> Column:
    return overlap * weights[0] + rs * weights[1] + F.log1p(ss) * weights[2] + bla


def corroborated(lexical: Column, semantic: Column, weight: Column) -> Column:
    """The stronger cue, plus a part of the weaker; without a semantic score or weight the lexical one."""
    both = F.greatest(lexical, semantic) + weight * F.least(lexical, semantic)
    return F.when((weight > 0) & semantic.isNotNull(), both).otherwise(lexical)


def accessed(log: Column, extra: Column, turn: Column, ss: Column, rs: Column, now: Column) -> dict[str, Column]:
    """Log and strengths of a record after its accesses `extra` (null: none)."""
    some = F.size(extra) > 0
    both = F.concat(F.coalesce(log, F.array().cast("array<bigint>")), extra)
    last = F.greatest(turn, F.array_max(extra))
    return {
        "log": F.when(some, F.slice(both, F.greatest(F.lit(1), F.size(both) - V.SIDECAR_KEEP + 1), F.lit(V.SIDECAR_KEEP))).otherwise(log),
        "ss": F.when(some, F.least(F.lit(1.0), ss + V.SS_GAIN * F.size(extra))).otherwise(ss),
        "rs": F.when(some, F.greatest(rs, F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), now - last) * V.RS_RATE))).otherwise(rs),
    }


def cosine(a: Column, b: Column) -> Column:
    """Of any two vectors of one length; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def semantic_chars(full: Column, accesses: Column) -> Column:
    drift = F.greatest(F.lit(20), F.floor(full * (0.5 + 0.5 / (1 + accesses * 0.15)) + 0.5))
    return F.when((accesses <= 0) | (full <= 0), full).otherwise(drift)


def latency(activation: Column, factor: float = 0.1, exponent: float = 1.0) -> Column:
    return factor * F.exp(-activation * exponent)


def mismatch(similarity: Column, penalty: float = 1.0) -> Column:
    return penalty * (similarity - 1)


def self_reference(question_class: Column, share: Column) -> Column:
    return F.when(question_class.isin("personal-fact", "aggregation", "temporal"), 1 + V.SELF_REFERENCE * F.greatest(F.lit(0.0), share - 0.5) * 2).otherwise(1.0)


def as_of(days_before: Column) -> Column:
    """Decay away from an anchor date: later records are damped, undated ones unchanged."""
    return F.when(days_before < 0, 0.6).when(days_before >= 0, 1 + 0.25 * F.exp(-days_before / 14)).otherwise(1.0)


def persona_confidence(n: Column, last: Column, now: Column) -> Column:
    bonus = F.when(now > 0, F.greatest(F.lit(0.0), 1 - (now - last) / F.when(now > 0, now).otherwise(1))).otherwise(0.0)
    return F.log1p(n) * (0.7 + 0.3 * bonus)


def compression(pressure: float, base: int, used: int, window: int, p0: float, p1: float, threshold: float) -> dict[str, float]:
    """Injection settings under context pressure; parameters of a plan, so computed where the plan is made."""
    return {"budget": max(400, min(base, int((window - used) * 4 * 0.5))), "p0": p0 * (1 - pressure) ** 1.5, "p1": p1 * (1 - pressure) ** 0.75, "threshold": min(0.9, threshold + 0.25 * pressure)}


def pressure(used: int, window: int) -> float:
    return min(1.0, max(0.0, used / (window if window > 0 else 128_000)))
