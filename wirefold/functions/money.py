"""What reads and model calls cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import col

# --- fixed values: USD per million tokens, and per charged row -------------------
CHEAP = (0.15, 0.60)
PREMIUM = (3.00, 15.00)
CALENDAR_ROW, CALENDAR_RUN = 0.002125, 0.001
SOCIAL_ROW, SOCIAL_RUN, SOCIAL_EMPTY = 0.002, 0.00005, 0.001
TOTAL_CAP, DAILY_CAP = 7.00, 0.50
# --------------------------------------------------------------------------------


def cost(model: Column | str, tokens_in: Column | str, tokens_out: Column | str,
         prices: dict[str, tuple[float, float]]) -> Column:
    """Price of one call. A model with no known price is charged as premium."""
    p_in, p_out = F.lit(PREMIUM[0]), F.lit(PREMIUM[1])
    for name, (i, o) in prices.items():
        p_in = F.when(col(model) == name, F.lit(i)).otherwise(p_in)
        p_out = F.when(col(model) == name, F.lit(o)).otherwise(p_out)
    return (col(tokens_in) * p_in + col(tokens_out) * p_out) / 1_000_000


def estimate(prompt_chars: Column | str, max_tokens: int,
             price: tuple[float, float] = CHEAP) -> Column:
    """Pessimistic: four characters a token, and a full-length answer."""
    tokens = F.greatest(F.lit(1), F.floor(col(prompt_chars) / 4))
    return (tokens * price[0] + max_tokens * price[1]) / 1_000_000


def calendar_charge(rows: Column | str) -> Column:
    return F.round(col(rows) * CALENDAR_ROW + CALENDAR_RUN, 6)


def social_charge(rows: Column | str) -> Column:
    empty = F.when(col(rows) == 0, F.lit(SOCIAL_EMPTY)).otherwise(0.0)
    return F.round(col(rows) * SOCIAL_ROW + SOCIAL_RUN + empty, 6)
