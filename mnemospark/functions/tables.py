"""Table functions for SQL: ``register`` makes them known to a session.

    SELECT memory_id, s.* FROM memories, LATERAL sections(content) s
    SELECT * FROM extraction_windows(TABLE(messages) PARTITION BY session_key ORDER BY (ts, message_id), 900000, 12, 8000)

Rows go to Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from mnemospark.operators.content import split_sections


@udtf(returnType="place: int, kind: string, text: string", useArrow=True)
class Sections:
    """The sections of a text by tag, numbered from 0; none for a null text."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, s in enumerate(split_sections(text)):
            yield i, s["kind"], s["text"]


@udtf(returnType="message_id: bigint, window_no: bigint, chars: bigint")
class ExtractionWindows:
    """Of each partition's messages, in order, the window that each falls in: cut after a gap, at ``most`` messages and before ``chars`` letters are passed.  Holds four numbers."""

    def __init__(self) -> None:
        self.last, self.n, self.size, self.no = None, 0, 0, 0

    def eval(self, row: Row, gap_ms: int, most: int, chars: int) -> Iterator[tuple[int, int, int]]:
        length = len(row["content"] or "")
        if self.last is not None and (row["ts"] - self.last > gap_ms or self.n >= most or self.size + length > chars):
            self.n, self.size, self.no = 0, 0, self.no + 1
        self.last, self.n, self.size = row["ts"], self.n + 1, self.size + length
        yield row["message_id"], self.no, length


def register(spark: SparkSession) -> None:
    spark.udtf.register("sections", Sections)
    spark.udtf.register("extraction_windows", ExtractionWindows)
