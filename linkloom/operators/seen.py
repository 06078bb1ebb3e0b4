"""What was seen, as a mergeable Bloom filter that is a table: bitmaps by block, built and probed by Spark's own functions.

A URL belongs to one block, by its hash, and sets a few bits there.  Filters with as many blocks merge by the union of their
bitmaps, so a round adds its arrivals and nothing else; a filter takes about two bytes for each URL that it has room for.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut

#: Fixed value: the bits of one of Spark's bitmaps.
BLOCK_BITS = 1 << 15
_PROBES = 6
_BITS_EACH = 16
#: Filters of up to so many blocks, of 4 KiB each, are broadcast; larger ones are joined by block.
_BROADCAST_BLOCKS = 1 << 14


class SeenFilter:
    """A filter for the column url with room for so many URLs.  What it denies was not added; what it affirms, nearly always was."""

    def __init__(self, room: int, broadcast_blocks: int = _BROADCAST_BLOCKS):
        self.room, self.held = max(1, room), 0
        self.blocks = ceil(self.room * _BITS_EACH / BLOCK_BITS)
        self._broadcast_blocks = broadcast_blocks
        self._table: DataFrame | None = None

    @property
    def full(self) -> bool:
        return self.held > self.room

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.blocks)).cast("int")

    @staticmethod
    def _places() -> list[Column]:
        return [F.pmod(F.xxhash64("url", F.lit(k)), F.lit(BLOCK_BITS)) for k in range(_PROBES)]

    def add(self, urls: DataFrame, n: int) -> None:
        """Adds the n URLs of a table.  Bits are united before the shuffle, into at most a bitmap a block and task."""
        bits = urls.select(self._block().alias("block"), F.explode(F.array(*self._places())).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
        if self._table is not None:
            bits = self._table.unionByName(bits).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        self._table, self.held = cut(bits), self.held + n

    def marked(self, rows: DataFrame, name: str = "maybe") -> DataFrame:
        """rows with whether their url may have been added."""
        if self._table is None:
            return rows.withColumn(name, F.lit(False))
        small = self.blocks <= self._broadcast_blocks
        table = F.broadcast(self._table) if small else self._table
        byte = lambda at: F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = [F.pmod(F.floor(byte(at) / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1 for at in self._places()]
        every = held[0]
        for x in held[1:]:
            every &= x
        joined = rows.withColumn("block", self._block()).join(table, "block", "left")
        return joined.withColumn(name, F.coalesce(every, F.lit(False))).drop("block", "bits")


class Seen:
    """The rounds of a frontier so far, and which URLs of a further one are new.

    From `filter_from` URLs on, arrivals are held against a filter first.  Those that it denies are new.  For the others, a filter of
    themselves picks from what was seen the rows that can be theirs, and an exact join decides; so what is shuffled
    follows the arrivals, however much was seen.  Fewer URLs are joined as they are; the result is the same.
    """

    def __init__(self, first: DataFrame, filter_from: int = 1_000_000, many: int = 16):
        self.rounds, self.n = [first], first.count()
        self.filter_from, self.many = filter_from, many
        self.filter: SeenFilter | None = None

    def table(self) -> DataFrame:
        out = self.rounds[0]
        for r in self.rounds[1:]:
            out = out.unionByName(r)
        return out

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows, one for each url, whose url is in no round."""
        if self.n < self.filter_from:
            return rows.join(self.table().select("url"), "url", "left_anti")
        if self.filter is None or self.filter.full:
            self.filter = SeenFilter(2 * self.n)
            self.filter.add(self.table().select("url"), self.n)
        told = cut(self.filter.marked(rows, "_maybe"))
        known, asked = told.where("not _maybe"), told.where("_maybe")
        own = SeenFilter(asked.count())
        own.add(asked.select("url"), own.room)
        back = own.marked(self.table().select("url"), "_maybe").where("_maybe").select("url")
        return known.unionByName(asked.join(back, "url", "left_anti")).drop("_maybe")

    def add(self, arrived: DataFrame) -> int:
        """Adds a round, which is cut already; its number of rows."""
        n = arrived.count()
        self.n += n
        self.rounds.append(arrived)
        if len(self.rounds) > self.many:
            self.rounds = [cut(self.table())]
        if n and self.filter is not None:
            self.filter.add(arrived.select("url"), n)
        return n
