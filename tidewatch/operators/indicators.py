"""Matching events against indicators of compromise."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import bloom
from tidewatch.session import settled

# Fields compared with indicators, in result order.
MATCH_FIELDS = ("src_endpoint.ip", "dst_endpoint.ip", "file.path", "actor.user.name")

BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(values: DataFrame, column: str, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the column's distinct values may be sent to every executor; measured, not guessed."""
    size = values.agg((F.coalesce(F.sum(F.octet_length(column) + 32), F.lit(0))).alias("bytes")).first().bytes
    return size <= max_bytes


def _field(path: str):
    return F.lower(F.col(path).cast("string"))


def values_present(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """The indicators that occur in the events at all.

    Event values are reduced to distinct ones before the shuffle, so a value that
    fills the data counts once per input partition. They are settled, so Spark knows their size: unless they are many,
    the list is read in place and not shuffled.
    """
    values = events.select(F.explode(F.array(*[_field(p) for p in MATCH_FIELDS])).alias("ioc")).where(
        F.col("ioc").isNotNull()
    )
    return indicators.join(settled(values.distinct(), "event-values"), "ioc", "left_semi")


def _with_matches(events: DataFrame, is_hit: list[Column]) -> DataFrame:
    hits = [F.when(hit, F.col(path).cast("string")) for hit, path in zip(is_hit, MATCH_FIELDS, strict=True)]
    return events.withColumn("ioc_matches", F.array_compact(F.array(*hits)))


def look_up_small(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add ``ioc_matches`` by one broadcast join per field; events never shuffle."""
    marked = events
    for i, path in enumerate(MATCH_FIELDS):
        side = F.broadcast(wanted.select(F.col("ioc").alias(f"_ioc{i}")))
        marked = marked.join(side, _field(path) == F.col(f"_ioc{i}"), "left")
    names = [f"_ioc{i}" for i in range(len(MATCH_FIELDS))]
    return _with_matches(marked, [F.col(n).isNotNull() for n in names]).drop(*names)


def look_up_large(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add ``ioc_matches`` for a list of any size, by one join on values and one back.

    Events are known by a hash of their fields that are compared. Each distinct combination of
    these values meets the list once; only combinations that hit something are joined back, by
    their values, and rows of other combinations are not held up by a hot value.
    """
    fields = [f"_f{i}" for i in range(len(MATCH_FIELDS))]
    valued = events.withColumns({name: _field(path) for name, path in zip(fields, MATCH_FIELDS, strict=True)})
    valued = valued.withColumn("_values", F.xxhash64(*fields))
    combinations = settled(valued.select("_values", *fields).distinct(), "indicator-values")
    places = F.posexplode(F.array(*fields)).alias("at", "ioc")
    hit = (
        combinations.select("_values", *fields, places)
        .where("ioc IS NOT NULL")
        .join(wanted, "ioc")
        .groupBy("_values", *fields)
        .agg(F.collect_set("at").alias("_at"))
    )
    other = hit.select(F.col("_values").alias("_key"), *[F.col(f).alias(f"{f}h") for f in fields], "_at")
    same = [valued[f].eqNullSafe(F.col(f"{f}h")) for f in fields]
    on = reduce(and_, same, valued["_values"] == F.col("_key"))
    marked = valued.join(other, on, "left")
    is_hit = [F.coalesce(F.array_contains("_at", i), F.lit(False)) for i in range(len(MATCH_FIELDS))]
    return _with_matches(marked, is_hit).drop("_values", "_key", "_at", *fields, *[f"{f}h" for f in fields])


class LargeList:
    """An indicator list beyond the size that is broadcast, with a Bloom filter that events are tested against where they are read.

    Only events that may hit something take part in any shuffle. In batch they first cut the list down to the values that
    occur among them; if that is small enough it is broadcast after all. A list too long for the bits of a filter would set
    almost all of them, so it gets none.
    """

    def __init__(self, wanted: DataFrame, max_bytes: int, most_bits: int = bloom.MOST_BITS):
        self.wanted, self.max_bytes = wanted, max_bytes
        self.filter = bloom.build_if_useful(wanted, "ioc", "indicator-bits", most_bits)

    def may_hit(self) -> Column:
        known = [_field(path) for path in MATCH_FIELDS]
        return reduce(or_, [value.isNotNull() if self.filter is None else self.filter.may_contain(value) for value in known])

    def look_up(self, suspects: DataFrame) -> DataFrame:
        """Add ``ioc_matches`` to events that may hit something."""
        if suspects.isStreaming:
            return look_up_streaming(suspects, self.wanted)
        present = settled(values_present(suspects, self.wanted), "indicators-present")
        return look_up_small(suspects, present) if is_small(present, "ioc", self.max_bytes) else look_up_large(suspects, present)

    def mark(self, events: DataFrame) -> DataFrame:
        may = self.may_hit()
        clean = events.where(~may).withColumn("ioc_matches", F.array().cast("array<string>"))
        return self.look_up(events.where(may)).unionByName(clean)

    def hits(self, events: DataFrame) -> DataFrame:
        return self.look_up(events.where(self.may_hit())).where(F.size("ioc_matches") > 0)


def _small_or_large(indicators: DataFrame, max_bytes: int) -> tuple[DataFrame, LargeList | None]:
    # Settled before it is measured, so that making a long list is not done twice.
    wanted = settled(indicators.select("ioc").where("ioc IS NOT NULL").distinct(), "indicator-list")
    return wanted, None if is_small(wanted, "ioc", max_bytes) else LargeList(wanted, max_bytes)


def mark_indicators(events: DataFrame, indicators: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``ioc_matches``: original values of matching fields, in field order; empty without a match.

    Each field is looked up by its lower-cased value. A list of proven small size is broadcast and
    events never shuffle. Against a larger list, see ``LargeList``.
    """
    wanted, large = _small_or_large(indicators, max_bytes)
    return look_up_small(events, wanted) if large is None else large.mark(events)


def look_up_streaming(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """A stream against a large list: one shuffled stream-static join per field.

    Rows without the field would all meet in one shuffle partition, so they get spread keys that match nothing.
    """
    marked = events
    for i, path in enumerate(MATCH_FIELDS):
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("time", "metadata"), F.lit(4096)).cast("string"))
        side = wanted.select(F.col("ioc").alias(f"_ioc{i}"))
        marked = marked.join(side, F.coalesce(_field(path), spread) == F.col(f"_ioc{i}"), "left")
    names = [f"_ioc{i}" for i in range(len(MATCH_FIELDS))]
    return _with_matches(marked, [F.col(n).isNotNull() for n in names]).drop(*names)


def indicator_hits(events: DataFrame, indicators: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The events with a match. Beyond ``max_bytes`` the filter stands in the scan, before any other work."""
    wanted, large = _small_or_large(indicators, max_bytes)
    return look_up_small(events, wanted).where(F.size("ioc_matches") > 0) if large is None else large.hits(events)


def clean_events(events: DataFrame, indicators: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return mark_indicators(events, indicators, max_bytes).where(F.size("ioc_matches") == 0).drop("ioc_matches")
