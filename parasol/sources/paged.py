"""A paged table service as a Spark data source: pages are partitions, filters and columns go to the service.

``endpoint`` is ``module:function``; it is called with the parameters $select,
$where, $order, $limit and $offset and headers, and returns a list of rows. The
reader asks for fixed pages up to the number of ``rows`` that the caller expects,
so they are read side by side; the last partition reads on, page by page, until
one is short, so that no row is lost if there are more. Each page is ordered by
a unique column, without which pages may overlap.
"""

from __future__ import annotations

import datetime
import importlib
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

TRIES, WAIT_S = 3, 5.0


class ServiceError(Exception):
    """An answer of the service with a status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call, wait_s: float = WAIT_S, sleep=time.sleep):
    """Calls again after server errors and lost connections, 5, 10, ... seconds apart; client errors are final."""
    for attempt in range(1, TRIES + 1):
        try:
            return call()
        except (ServiceError, ConnectionError, TimeoutError) as e:
            if attempt == TRIES or (isinstance(e, ServiceError) and e.status < 500):
                raise
            sleep(wait_s * 2 ** (attempt - 1))
    return None


class Page(InputPartition):
    def __init__(self, offset: int, last: bool) -> None:
        self.offset, self.last = offset, last


def literal(value) -> str | None:
    """A value in the service's query language; None for what it has no form for."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime.datetime | datetime.date):
        return f"'{value.isoformat()}'"
    return None


def condition(f) -> str | None:
    """A pushed filter in the service's query language, or None."""
    signs = {EqualTo: "=", GreaterThan: ">", LessThan: "<", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
    if len(f.attribute) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL"
    if isinstance(f, In):
        values = [literal(v) for v in f.value]
        return None if None in values or not values else f"{name} IN ({', '.join(values)})"
    value = literal(f.value) if type(f) in signs else None
    return None if value is None else f"{name} {signs[type(f)]} {value}"


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.options, self.columns, self.where = options, [f.name for f in schema], [options["where"]] if options.get("where") else []
        self.size = int(options.get("pagesize", 50000))

    def pushFilters(self, filters):
        for f in filters:
            text = condition(f) if hasattr(f, "attribute") else None
            if text is None:
                yield f
            else:
                self.where.append(text)

    def partitions(self):
        offsets = list(range(0, max(int(self.options["rows"]), 1), self.size))
        return [Page(o, o == offsets[-1]) for o in offsets]

    def read(self, page: Page):
        module, function = self.options["endpoint"].split(":")
        call = getattr(importlib.import_module(module), function)
        headers = {"X-App-Token": self.options["token"]} if self.options.get("token") else {}
        offset = page.offset
        while True:
            params = {"$select": ",".join(self.columns), "$order": self.options["order"], "$limit": self.size, "$offset": offset}
            if self.where:
                params["$where"] = " AND ".join(f"({w})" for w in self.where) if len(self.where) > 1 else self.where[0]
            rows = with_retries(lambda: call(params, headers), float(self.options.get("wait", WAIT_S)))  # noqa: B023
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)
            if not page.last or len(rows) < self.size:
                return
            offset += self.size


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("order"):
            raise ValueError("pages need a unique order")
        return PagedReader(dict(self.options), schema)
