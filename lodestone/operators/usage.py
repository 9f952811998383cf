"""Model usage: costs, totals, and who may ask again."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.sizing import sized_broadcast


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd from prices (model, input_per_m, output_per_m: a short list); thinking counts as output, unknown models cost nothing."""
    met = usage.join(sized_broadcast(prices), "model", "left")
    cost = (F.col("prompt_tokens") * F.col("input_per_m") + (F.col("output_tokens") + F.coalesce("thoughts_tokens", F.lit(0))) * F.col("output_per_m")) / 1e6
    return met.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("input_per_m", "output_per_m")


def totals(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums for each key and over all of them (null keys)."""
    return usage.rollup(*keys).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


class Window:
    """A sliding window of one key: at most `limit` units in `seconds`; what is refused is not counted."""

    def __init__(self, limit: int, seconds: float, times=()):
        self.limit, self.seconds, self.times = limit, seconds, deque(times)

    def ask(self, now: float, cost: int = 1) -> tuple[bool, float]:
        """Whether `cost` units are allowed, and how long until there is room again."""
        while self.times and self.times[0] <= now - self.seconds:
            self.times.popleft()
        allowed = len(self.times) + cost <= self.limit
        if allowed:
            self.times.extend([now] * cost)
        full = len(self.times) >= self.limit
        return allowed, max(0.0, self.times[0] + self.seconds - now) if full and self.times else 0.0


def decide(requests: DataFrame, limit: int = 20, seconds: float = 60.0) -> DataFrame:
    """user_id, event_id, allowed, retry_after for requests (user_id, event_id, at in seconds, cost), in order of time.

    Refusals don't count, so each decision hangs on those before: one ordered fold per user, and users are apart.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"], kind="stable")
        w = Window(limit, seconds)
        got = [w.ask(t, int(c)) for t, c in zip(pdf["at"], pdf["cost"])]
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": [a for a, _ in got], "retry_after": [round(r, 6) for _, r in got]})

    return requests.select("user_id", "event_id", "at", "cost").groupBy("user_id").applyInPandas(fold, "user_id long, event_id long, allowed boolean, retry_after double")
