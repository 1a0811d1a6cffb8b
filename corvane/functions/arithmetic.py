"""Schedules, sizes, token estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def warmup(step: Column, steps: int, peak: float, low: float = 0.0) -> Column:
    """Linear from low to peak over the first steps, then peak."""
    return low + (peak - low) * F.least(F.lit(1.0), step / float(max(steps, 1)))


def cosine_schedule(step: Column, warm: int, total: int, peak: float, final: float) -> Column:
    """Linear warm-up, half a cosine down to final, then final."""
    part = (step - warm) / float(total - warm)
    down = final + (peak - final) * 0.5 * (1 + F.cos(part * math.pi))
    return F.when(step < warm, warmup(step, warm, peak)).when(step > total, F.lit(final)).otherwise(down)


def linear_schedule(step: Column, warm: int, total: int, peak: float, final: float) -> Column:
    """Linear warm-up, linear down to final, then final."""
    part = (step - warm) / float(total - warm)
    return F.when(step < warm, warmup(step, warm, peak)).when(step > total, F.lit(final)).otherwise(peak + (final - peak) * part)


def kv_cache_bytes(layers: Column, kv_heads: Column, head_dim: Column, tokens: Column, width: int = 2) -> Column:
    """Keys and values of all layers, ``width`` bytes each."""
    return layers * kv_heads * head_dim * 2 * width * tokens


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, and one."""
    return (F.floor(F.length(text) / 4) + 1).cast("bigint")


def clamp_probability(logprob: Column, low: float = 0.1) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), F.exp(logprob)))


def grid_ticks(low: float, high: float) -> list[float]:
    """Powers of ten that span a range."""
    return [10.0**k for k in range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1)]


def back_off(attempt: int, most: float = 60.0) -> float:
    """Seconds to wait before a retry."""
    return min(2.0**attempt, most)


def hidden_cache_bytes(layers: Column, hidden: Column, tokens: Column, width: int = 2) -> Column:
    """Keys and values of all layers by the model's hidden size, as if every head had its own."""
    return tokens * 2 * layers * hidden * width
