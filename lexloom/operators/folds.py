"""Sequential folds over events: state that each event changes, for each key, in order.

Rows come sorted by key and order and are read as a stream with the state of one key at a time, so the largest key
is bound by time, not by memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], dict],
    step: Callable[[dict, dict], dict],
    schema: str,
) -> DataFrame:
    """One output row for each row: ``step(state, row)`` returns it and changes ``state``; ``start`` makes a key's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                own = tuple(None if row[k] != row[k] else row[k] for k in keys)
                if state is None or own != key:
                    key, state = own, start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(",")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# Bounds and starting weights of the practice model.
BIAS, BIAS_BOUND, PRIOR_WEIGHT, LEVEL_WEIGHT = -0.4, 6.0, 1.4, 1.2
#: Our own choices, as no formula is public: the step of the gradient and the scale of days.
RATE, DAYS_SCALE = 0.05, 7.0


def predictions(events: DataFrame, keys: list[str], order: list[str], correct: str, seconds: str) -> DataFrame:
    """(keys, event_id, p, y): chance of a right answer by online logistic regression, before each answer is seen.

    Features are what was known before the answer: the share of right answers so far, their number (up to 5, a
    level) and the logarithm of the days since the last one. Weights keep their sign: prior and level not negative,
    days not positive, the bias within its bound. ``correct`` is 1, 0 or null; a null answer is not learnt from.
    """

    def start() -> dict:
        return {"b": BIAS, "w": [PRIOR_WEIGHT, LEVEL_WEIGHT, 0.0], "n": 0, "right": 0, "last": None}

    def step(state: dict, row: dict) -> dict:
        n, w = state["n"], state["w"]
        days = 0.0 if state["last"] is None else max(0.0, (row[seconds] - state["last"]) / 86_400)
        x = [state["right"] / n if n else 0.0, min(state["right"], 5) / 5, math.log1p(days) / math.log1p(DAYS_SCALE)]
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, state["b"] + sum(a * b for a, b in zip(w, x))))))
        y = row[correct]
        learnt = y is not None and y == y
        if learnt:
            g = RATE * (float(y) - p)
            state["b"] = max(-BIAS_BOUND, min(BIAS_BOUND, state["b"] + g))
            w = [a + g * b for a, b in zip(w, x)]
            state["w"] = [max(0.0, w[0]), max(0.0, w[1]), min(0.0, w[2])]
            state["n"], state["right"], state["last"] = n + 1, state["right"] + int(y), row[seconds]
        return {**{k: row[k] for k in keys}, "event_id": row["event_id"], "p": p, "y": int(y) if learnt else None}

    kinds = dict(events.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["event_id long", "p double", "y int"])
    return sorted_fold(events, keys, order, start, step, schema)
