"""What the stateful streams keep per house, in Spark's own state store."""

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers get the processors with the query; they need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class PreviousBucket(StatefulProcessor):
    """For each bucket of a house, the last value of the bucket before; buckets come in ascending order."""

    def __init__(self, value: T.DataType):
        self._schema = T.StructType([T.StructField("kwh", value)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._last.get() if self._last.exists() else None
        for row in sorted(rows, key=lambda r: r.bucket):
            yield Row(house_id=key[0], bucket=row.bucket, last_kwh=before[0] if before else None)
            before = (row.closing_kwh,)
        self._last.update(before)

    def close(self) -> None:
        pass


class NewestRows(StatefulProcessor):
    """The n newest rows of a house by time, then by row id, as a list."""

    def __init__(self, row: T.StructType, time: str, row_id: str, n: int):
        self._schema, self._n = row, n
        self._order = [row.names.index(time), row.names.index(row_id)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getListState("rows", self._schema)

    def _rank(self, row: tuple) -> tuple:
        # A missing time or id comes before all others.
        return tuple((row[i] is not None, row[i]) for i in self._order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [tuple(r) for r in self._rows.get()] if self._rows.exists() else []
        ranked = {self._rank(tuple(r)): tuple(r) for r in [*known, *map(tuple, rows)]}  # a repeated row counts once
        newest = [ranked[k] for k in sorted(ranked, reverse=True)[:self._n]]
        self._rows.put(newest)
        names = self._schema.names
        yield Row(house_id=key[0], rows=[Row(**dict(zip(names, r))) for r in newest])

    def close(self) -> None:
        pass
