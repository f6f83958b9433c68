"""Hierarchical compaction of sessions: oldest items are folded into summaries until the session fits its budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SUMMARY_SHARE = 0.35


def compacted(items: DataFrame, budget: int, chunk: int = 4000, tail: int = 8, rounds: int = 10) -> DataFrame:
    """(session_key, first, last, depth, tokens): what is left of items (session_key, ordinal, tokens).

    While a session has more tokens than the budget, its oldest run of items of the
    least depth before the fresh tail, up to ``chunk`` tokens and of two items or
    more, becomes one summary of SUMMARY_SHARE of its size, a level deeper; a
    round that saves nothing ends it.  A session is one state, rows come in order.
    """
    rows = items.select("session_key", "ordinal", "tokens").repartition("session_key").sortWithinPartitions("session_key", "ordinal")

    def fold(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        for _ in range(rounds):
            total = sum(p[3] for p in parts)
            if total <= budget:
                break
            body = parts[: max(0, len(parts) - tail)]
            if not body:
                break
            depth = min(p[2] for p in body)
            start = next(i for i, p in enumerate(body) if p[2] == depth)
            end, size = start, 0
            while end < len(body) and body[end][2] == depth and (end == start or size + body[end][3] <= chunk):
                size += body[end][3]
                end += 1
            merged = max(1, int(size * SUMMARY_SHARE))
            if end - start < 2 or merged >= size:
                break
            parts = [*parts[:start], (parts[start][0], parts[end - 1][1], depth + 1, merged), *parts[end:]]
        return parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(key, *p) for p in fold(held)], columns=["session_key", "first", "last", "depth", "tokens"])

        for pdf in batches:
            for k, o, n in zip(pdf["session_key"], pdf["ordinal"], pdf["tokens"], strict=True):
                if k != key and held:
                    yield flush()
                    held = []
                key = k
                held.append((int(o), int(o), 0, int(n)))
        if held:
            yield flush()

    return rows.mapInPandas(run, "session_key long, first long, last long, depth long, tokens long")
