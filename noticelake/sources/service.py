"""A paged JSON service as a Spark data source, read in batches or walked as a stream.

``fetch(filters, offset, rows)`` returns a page as JSON text, ``{"total": n, "<list key>": [...]}`` or ``{"error": ...}``; the
caller gives it, and it runs in the tasks.  ``register`` binds it to a name for ``spark.read.format(name)`` and
``spark.readStream.format(name)``.

Batch: filters on the named columns go with the page request, so rows that no one asks for are never
sent; pages are dealt to tasks in runs, and a run ends at the first empty page.  A page that fails is a row
with its error.

Stream: the walk over the scopes of an archive.  A scope is a set of filters with an offset of its own; the
offsets of all scopes are the stream's offset, so that Spark's checkpoint is the walk's.  A scope of which
the service shows less than it has (its total is over the cap) is walked to the cap and then divided.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, IsNotNull, LessThanOrEqual
from pyspark.sql.types import StructType

Fetch = Callable[[dict, int, int], str]
#: Columns beside those of the filters.
FIXED = ("page long", "record string", "error string")
#: Most rows of an Arrow batch.
BATCH = 10_000
_SIGNS = {EqualTo: "", GreaterThanOrEqual: "_from", LessThanOrEqual: "_to"}


@dataclass
class Service:
    """How a service is asked: the columns it filters by, the key of its list, and its limits.

    ``columns``: names of string columns that a record has and the service filters by, by equality; ``bounds``: those
    it also bounds (``<name>_from``, ``<name>_to``, both inclusive).  ``cap``: the offset that it refuses.  ``divide``: scope -> scopes.
    """

    fetch: Fetch
    columns: tuple[str, ...]
    list_key: str
    bounds: tuple[str, ...] = ()
    rows: int = 100
    cap: int | None = None
    tasks: int = 200
    attempts: int = 3
    scopes: tuple[dict, ...] = ({},)
    divide: Callable[[dict], list[dict]] | None = None
    pages: int = 10

    def page(self, filters: dict, offset: int, rows: int | None = None) -> tuple[list[dict], int | None]:
        """Records of a page and the total, where it is told; raises if no attempt succeeds."""
        problem: Exception | None = None
        for _ in range(self.attempts):
            try:
                found = json.loads(self.fetch(filters, offset, rows or self.rows), strict=False)
                if "error" in found:
                    raise ValueError(str(found["error"]))
                total = found.get("total")
                return list(found.get(self.list_key, [])), int(total) if total is not None else None
            except Exception as e:  # tried again, then told
                problem = e
        raise problem

    def batches(self, offset: int, records: list[dict]) -> Iterator[pa.RecordBatch]:
        """The rows of a page, column by column."""
        for k in range(0, len(records), BATCH):
            part = records[k : k + BATCH]
            values = [[None if x is None else str(x) for x in (r.get(c) for r in part)] for c in self.columns]
            yield self._batch(values, offset, [json.dumps(r) for r in part], [None] * len(part))

    def failed(self, offset: int, problem: Exception) -> pa.RecordBatch:
        return self._batch([[None] for _ in self.columns], offset, [None], [f"{type(problem).__name__}: {problem}"])

    def _batch(self, values: list[list], offset: int, records: list, errors: list) -> pa.RecordBatch:
        text = [pa.array(v, pa.string()) for v in (*values, records, errors)]
        page = pa.array([offset] * len(records), pa.int64())
        return pa.RecordBatch.from_arrays([*text[:-2], page, *text[-2:]], names=[*self.columns, "page", "record", "error"])


@dataclass
class Run(InputPartition):
    """Pages ``first``, ``first + rows``, ... below ``stop`` of one scope."""

    filters: dict
    first: int
    stop: int


class PagedReader(DataSourceReader):
    def __init__(self, service: Service):
        self.service, self.filters = service, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and bounds that the service knows go with the request; the others stay with Spark."""
        left = []
        for f in filters:
            sign = _SIGNS.get(type(f))
            name = ".".join(f.attribute) if sign is not None else ""
            known = name in self.service.columns and (not sign or name in self.service.bounds)
            if known and name + sign not in self.filters and isinstance(f.value, str):
                self.filters[name + sign] = f.value
            else:
                left.append(f)
        sent = {k.removesuffix("_from").removesuffix("_to") for k in self.filters}
        # what meets the others is not null; rows of failed pages are to be seen
        yield from (f for f in left if not (isinstance(f, IsNotNull) and ".".join(f.attribute) in sent))

    def partitions(self) -> list[Run]:
        """The pages up to the total, in runs; one run, up to an empty page, where no total is told."""
        s = self.service
        try:
            _, total = s.page(self.filters, 0, 1)
        except Exception:  # the first page's own task will tell
            total = s.rows
        if total is None:
            return [Run(self.filters, 0, s.cap or 1 << 62)]
        pages = max(1, -(-min(total, s.cap or total) // s.rows))
        each = -(-pages // s.tasks)
        return [Run(self.filters, k * s.rows, min(pages, k + each) * s.rows) for k in range(0, pages, each)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        s = self.service
        for offset in range(run.first, run.stop, s.rows):
            try:
                records, _ = s.page(run.filters, offset)
            except Exception as e:
                yield s.failed(offset, e)
                continue
            if not records:
                return
            yield from s.batches(offset, records)


def _name(scope: dict) -> str:
    return json.dumps(scope, sort_keys=True)


class WalkReader(DataSourceStreamReader):
    """One slice of the walk for each batch: every open scope goes on by some pages."""

    def __init__(self, service: Service):
        self.service, self.at = service, None

    def initialOffset(self) -> dict:
        return {_name(x): {"next": 0, "state": "open"} for x in self.service.scopes}

    def latestOffset(self) -> dict:
        """Offsets after one more slice.  A scope whose page can't be had now stays where it is."""
        s, at = self.service, self.at or self.initialOffset()
        after = {k: dict(v) for k, v in at.items()}
        for key, held in at.items():
            if held["state"] != "open":
                continue
            scope, mine = json.loads(key), after[key]
            try:
                records, total = s.page(scope, held["next"], 1)
            except Exception as e:  # asked for again in the next slice
                mine["problem"] = f"{type(e).__name__}: {e}"
                continue
            mine.pop("problem", None)
            reach = min(x for x in (total, s.cap, 1 << 62) if x is not None)
            if records and held["next"] < reach:
                mine["next"] = min(held["next"] + s.pages * s.rows, -(-reach // s.rows) * s.rows)
            if not records or mine["next"] >= reach:
                parts = s.divide(scope) if s.divide and s.cap is not None and total is not None and total > s.cap else []
                mine["state"] = "divided" if parts else "done"
                for part in parts:
                    after.setdefault(_name(part), {"next": 0, "state": "open"})
        self.at = after
        return after

    def partitions(self, start: dict, end: dict) -> list[Run]:
        # after a restart the engine plans its last batch again, which tells where the walk is
        self.at = self.at or end
        found = []
        for key, held in end.items():
            first = start.get(key, {"next": 0})["next"]
            found += [Run(json.loads(key), k, k + self.service.rows) for k in range(first, held["next"], self.service.rows)]
        return found

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        """A page that fails here stops the batch; it is asked for again when the stream goes on."""
        yield from self.service.batches(run.first, self.service.page(run.filters, run.first)[0])


def register(spark: SparkSession, name: str, service: Service) -> None:
    """Make ``service`` readable under ``name``.  Filters are pushed down where the session allows it."""

    class Bound(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join([*(f"{c} string" for c in service.columns), *FIXED])

        def reader(self, schema: StructType) -> PagedReader:
            return PagedReader(service)

        def streamReader(self, schema: StructType) -> WalkReader:
            return WalkReader(service)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bound)


def walk(spark: SparkSession, name: str, apply, checkpoint: str, slices: int) -> int:
    """Up to ``slices`` slices of the walk, each a batch given to ``apply(rows, number)``; how many there were.

    Stops where nothing moves any more.  With the same checkpoint it goes on where the last call stopped.  The rows of a slice are
    kept while they are applied, so that the service is asked once for a page however often ``apply`` reads them.
    """
    ran: list[int] = []

    def kept(rows, number: int) -> None:
        rows.persist()
        try:
            apply(rows, number)
        finally:
            rows.unpersist()
        ran.append(number)

    for k in range(1, slices + 1):
        stream = spark.readStream.format(name).load()
        query = stream.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if len(ran) < k:
            break
    return len(ran)
