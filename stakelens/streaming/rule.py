"""A further rule, defined once and run on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .detector import BUCKETS, WATERMARK, as_flags, keyed_flags, of_kinds, slim_events
from .processors import FLAG_OUT, InOrder


@dataclass(frozen=True)
class Rule:
    """Which kinds of events a rule reads, by which keys, and the transition: a processor's ``begin`` and ``step``.

    The transition may keep what it needs in its memory only. It sees the events of a key in order, and starts afresh after
    ``quiet_us`` without one, in a stream as on a table.
    """

    name: str
    kinds: tuple[str, ...]
    keys: tuple[str, ...]
    processor: InOrder

    def stream(self, events: DataFrame, delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
        """The flags of a stream of events."""
        return keyed_flags(of_kinds(events, self.kinds, delay), list(self.keys), self.processor, buckets)

    def batch(self, events: DataFrame) -> DataFrame:
        """The flags of a table of events. For ``run_rules(rules=...)``.

        Rows are sorted by key and time in their partitions and walked with one memory at a time, so a key of any size
        takes no memory; all its events are in one task.
        """
        slim = slim_events(events.filter(F.col("event_type").isin(*self.kinds)), list(self.keys), self.processor)
        dealt = slim.repartition(*self.keys).sortWithinPartitions(*self.keys, "us", "seq", "entity_id")
        return as_flags(dealt.mapInArrow(self._walk, FLAG_OUT))

    def _walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, key, last, memory = self.processor, None, None, None
        event = Row("us", "seq", "entity_id", *processor.columns)
        for batch in batches:
            flags: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("us", "seq", "entity_id", *processor.columns)]
            keys = zip(*(batch.column(c).to_pylist() for c in self.keys), strict=True)
            for now, us, seq, entity, *others in zip(keys, *columns, strict=True):
                if us is None:
                    continue  # an event without a time; a watermark drops it too
                if last is None or now != key or us > last + processor.quiet_us:
                    memory = processor.begin()
                key, last = now, us
                flags += processor.step(memory, event(us, seq, str(entity), *others))
            yield pa.RecordBatch.from_pylist([dict(zip(FLAG_OUT.names, f, strict=True)) for f in flags], schema=_FLAGS)


_FLAGS = pa.schema([(f.name, pa.int64() if f.name.endswith("_us") else pa.string()) for f in FLAG_OUT])
