"""Which texts are substrings of others, by suffix automata.

An automaton over the texts to be searched has at most two states a character and answers a question in a step a character
of it, however many texts there are. Both kinds of rows are dealt by key and sorted, so that one pass over the stream
builds a key's automaton and then asks it. What one automaton takes is bounded: a key with more to search has several, and
a key with many questions asks in several parts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Characters that one automaton takes (a longer text is one of its own), and questions that one part of a key has.
BLOCK_CHARS, PART_ROWS = 200_000, 200_000


class SuffixAutomaton:
    """All substrings of the texts added so far."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, c: str, to: int) -> int:
        """The state of at's longest string with ``c`` behind it; a copy of ``to`` if that also stands for longer ones."""
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(c) == to:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def add(self, text: str) -> None:
        last = 0
        for c in text:
            if (to := self.next[last].get(c)) is not None:
                last = self._split(last, c, to)
                continue
            new, at = self._state(self.length[last] + 1, 0, {}), last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, c, self.next[at][c])
            last = new

    def holds(self, text: str) -> bool:
        at, following = 0, self.next
        for c in text:
            to = following[at].get(c)
            if to is None:
                return False
            at = to
        return True


def _asked(n_keys: int):
    """Over rows (key…, part, block, asks, id, text) sorted by all but the last two, what is searched before what asks: ids of the texts that are held."""

    def run(batches):
        now, held = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = []
            for i in range(batch.num_rows):
                at = tuple(c[i] for c in columns[: n_keys + 2])
                if at != now:
                    now, held = at, SuffixAutomaton()
                if not columns[n_keys + 2][i]:
                    held.add(columns[-1][i])
                elif held.holds(columns[-1][i]):
                    found.append(columns[-2][i])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["id"])

    return run


def within(needles: DataFrame, texts: DataFrame, keys: list[str], block_chars: int = BLOCK_CHARS, part_rows: int = PART_ROWS) -> DataFrame:
    """(id) of the rows of ``needles`` (keys…, id: bigint, text) that are substrings of a row of ``texts`` (keys…, text) of equal keys, each id once.

    A null key meets nothing, a null text neither holds nor is held; the empty text is in every other one. Equal texts of
    a key are searched once. Texts of a key are cut in blocks of about ``block_chars`` characters and its needles dealt to
    all of them, in parts of about ``part_rows``; each task builds the automaton of the block it asks.
    """
    some = texts.where(F.col("text").isNotNull()).select(*keys, "text").distinct()
    upto = F.sum(F.length("text")).over(W.partitionBy(*keys).orderBy("text").rowsBetween(W.unboundedPreceding, 0))
    some = checkpointed(some.withColumn("block", F.floor((upto - F.length("text")) / F.lit(block_chars))))
    needles = needles.where(F.col("text").isNotNull()).select(*keys, F.col("id").cast("long").alias("id"), "text")
    blocks = some.groupBy(*keys).agg(F.max("block").alias("blocks"))
    parts = needles.join(blocks, keys, "left_semi").groupBy(*keys).agg(F.floor((F.count(F.lit(1)) - 1) / F.lit(part_rows)).alias("parts"))
    parts = checkpointed(parts.join(blocks, keys))  # a row a key
    asking = needles.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts") + 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
    searched = some.join(parts.drop("blocks"), keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))))
    order = [*keys, "part", "block"]
    rows = searched.select(*order, F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), "text").unionByName(asking.select(*order, F.lit(True).alias("asks"), "id", "text"))
    return rows.repartition(*order).sortWithinPartitions(*order, "asks").mapInArrow(_asked(len(keys)), "id bigint").distinct()
