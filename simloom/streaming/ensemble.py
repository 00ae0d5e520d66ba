"""Ensembles over time on a stream: an episode's open predictions are kept as state until no later chunk can reach them.

Needs a state store that ``applyInPandasWithState`` can use, as all of Spark's can be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "next long, step array<long>, start array<long>, action array<double>"
_OUT = "episode long, step long, n long, action double"


def ensemble_stream(chunks: DataFrame, decay: float = 0.01) -> DataFrame:
    """As ``sequence.temporal_ensemble``, for a stream of ``(episode, start, actions)``: ``(episode, step, n, action)``, each step once.

    Chunks of an episode come in the order of their starts, over batches; within a batch in any order. A step is done when a chunk that starts
    there or later has come. A chunk without actions (null or empty) ends the episode: what is open is given out, and its state goes. A chunk
    that comes late counts for the steps that are open still. State is one entry for each open prediction: at most half the square of a chunk's
    length for each episode.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        first, step, start, action = state.get if state.exists else (None, [], [], [])
        done, newest = False, None
        step, start, action = list(step), list(start), list(action)
        for part in parts:
            for begin, values in zip(part["start"].tolist(), part["actions"]):
                if values is None or not len(values):
                    done = True
                    continue
                newest = begin if newest is None else max(newest, begin)
                for k, value in enumerate(values):
                    if first is None or begin + k >= first:
                        step.append(begin + k)
                        start.append(begin)
                        action.append(float(value))
        end = math.inf if done else -math.inf if newest is None else newest
        order = sorted(range(len(step)), key=lambda x: (step[x], start[x]))
        rows, k = [], 0
        while k < len(order) and step[order[k]] <= end:
            at, total, weight, n = step[order[k]], 0.0, 0.0, 0
            while k < len(order) and step[order[k]] == at:
                w = math.exp(-decay * n)
                total, weight, n, k = total + w * action[order[k]], weight + w, n + 1, k + 1
            rows.append((key[0], at, n, round(total / weight, 6)))
        if done:
            state.remove()
        else:
            left = order[k:]
            first = max(first if first is not None else -(2**62), (rows[-1][1] + 1) if rows else -(2**62))
            state.update((first, [step[x] for x in left], [start[x] for x in left], [action[x] for x in left]))
        yield pd.DataFrame(rows, columns=["episode", "step", "n", "action"])

    return chunks.groupBy("episode").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
