"""A remote catalogue as a data source whose filters become its searches.

    spark.dataSource.register(RemoteCards)
    spark.read.format("remote_cards").option("client", "package.module:function").load().where("name = 'Mew ex'")

The client takes a search, ``{"name": ...}``, ``{"start": ...}`` or ``{"number": ...}``, and returns cards as
dictionaries; None or an exception is a failure, tried again after ``wait`` seconds, then twice as long, and
so on, ``attempts`` times in all. A catalogue that can only be searched can't be listed: reading without such a
filter is an error.

With ``cache`` (a folder that all machines reach) answers are kept, one file for each search, and asked for
only once; failures aren't kept. A search that failed has no cards.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .cards import CARD


@dataclass
class Search(InputPartition):
    """One question to the catalogue; a task asks it."""

    kind: str
    key: str


class RemoteCards(DataSource):
    """Cards (as ``cards.CARD``) that a remote catalogue finds for the filters of the query."""

    @classmethod
    def name(cls) -> str:
        return "remote_cards"

    def schema(self) -> str:
        return CARD

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(dict(self.options), schema)


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.searches = options, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filter that finds least: a name, a number, the start of a name. Spark applies the others."""
        kinds = {("name", EqualTo): "name", ("name", In): "name", ("number", EqualTo): "number", ("number", In): "number", ("name", StringStartsWith): "start"}
        rank = {"name": 0, "number": 1, "start": 2}
        able = []
        for i, f in enumerate(filters):
            column = getattr(f, "attribute", ())
            kind = kinds.get((column[0], type(f))) if len(column) == 1 else None
            if kind:
                able.append((rank[kind], i, kind, f))
        if not able:
            return filters
        _, _, kind, best = min(able, key=lambda x: x[:2])
        values = best.value if isinstance(best, In) else [best.value]
        self.searches = [Search(kind, v) for v in dict.fromkeys(values) if v is not None]
        return [f for f in filters if f is not best]

    def partitions(self) -> list[InputPartition]:
        if self.searches is None:
            raise ValueError("a remote catalogue is only searched: filter by name, by the start of a name, or by number")
        return self.searches

    def read(self, partition: Search) -> Iterator[tuple]:
        for card in self._answer(partition):
            value = card.get("number" if partition.kind == "number" else "name") or ""
            if value.startswith(partition.key) if partition.kind == "start" else value == partition.key:
                yield tuple(card.get(f.name) for f in self.schema.fields)

    def _answer(self, search: Search) -> list[dict]:
        body = json.dumps({search.kind: search.key}, sort_keys=True)
        name = f"{hashlib.sha256(body.encode()).hexdigest()}.json"
        if "cache" in self.options:
            store, base = fs.FileSystem.from_uri(self.options["cache"])
            store.create_dir(base, recursive=True)
            try:
                with store.open_input_stream(f"{base}/{name}") as f:
                    return json.loads(f.read())
            except FileNotFoundError:
                pass
        cards = self._ask({search.kind: search.key})
        if cards is not None and "cache" in self.options:
            own = f"{base}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(own) as f:
                f.write(json.dumps(cards).encode())
            store.move(own, f"{base}/{name}")  # whole, or not there
        return cards or []

    def _ask(self, search: dict) -> list[dict] | None:
        module, _, function = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), function)
        attempts, wait = int(self.options.get("attempts", "3")), float(self.options.get("wait", "0.4"))
        for n in range(attempts):
            try:
                found = client(search)
            except Exception:  # a remote's failures are of any kind
                found = None
            if found is not None:
                return found
            if n + 1 < attempts:
                time.sleep(wait * (n + 1))
        return None


def remote_cards(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """The remote catalogue as a DataFrame, to be filtered by name, start of name or number."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteCards)
    return spark.read.format("remote_cards").options(client=client, **options).load()
