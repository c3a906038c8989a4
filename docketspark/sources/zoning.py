"""Zoning connectors: kinds of services behind one lookup, a Spark data source over their records, and one over static answers.

A kind builds the request for an address, reads the reply, and pages through all records. Sending a request is not part of this engine:
``fetch`` is given, and without it nothing is found.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition


@dataclass(frozen=True)
class Request:
    url: str
    params: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Kind:
    """How a kind of service is asked, how its reply is read, and which parameters page through all of it.

    ``ask``: a request for an address (and the point a geocoder gives), or None where the service cannot be asked about it. ``read``: the
    records of a reply, each the fields of one parcel. ``page``: the names of offset and size. ``exact``: only records count whose address
    is the one asked for.
    """

    needs: tuple[str, ...]
    ask: Callable[[dict, str, tuple[float, float] | None], Request | None]
    read: Callable[[object], list[dict]]
    page: tuple[str, str]

    def sure(self, config: dict) -> float:
        """How sure a single hit is: a point carries the geocoder's error as well."""
        return 1.0 if config.get("address_field") else 0.85


def _arcgis(config: dict, address: str, point: tuple[float, float] | None) -> Request:
    quoted = address.upper().replace("'", "''")
    where = f"UPPER({config['address_field']}) = '{quoted}'" if address else "1=1"
    return Request(f"{config['endpoint']}/query", (("f", "json"), ("outFields", "*"), ("where", where)))


def _opendatasoft(config: dict, address: str, point: tuple[float, float] | None) -> Request | None:
    by = (("dataset", config["dataset"]),)
    if address and config.get("address_field"):
        by = (*by, ("q", f'{config["address_field"]}:"{address}"'))
    elif address and point:  # within a metre: inside the parcel or not
        by = (*by, ("geofilter.distance", f"{point[0]},{point[1]},1"))
    elif address:  # polygons without a geocoder know no address
        return None
    return Request(f"{config['endpoint']}/api/records/1.0/search/", by)


def _socrata(config: dict, address: str, point: tuple[float, float] | None) -> Request:
    by = ((config["address_field"], address.upper()),) if address else ()
    return Request(f"{config['endpoint']}/resource/{config['dataset']}.json", by)


def _listed(payload: object, *path: str) -> list[dict]:
    found = payload if not path else (payload or {}).get(path[0]) if isinstance(payload, dict) else None
    rows = found if isinstance(found, list) else []
    return [r.get(path[1]) or {} for r in rows] if len(path) > 1 else rows


KINDS = {
    "arcgis": Kind(("endpoint", "address_field", "zone_field"), _arcgis, lambda reply: _listed(reply, "features", "attributes"), ("resultOffset", "resultRecordCount")),
    "opendatasoft": Kind(("endpoint", "dataset", "zone_field"), _opendatasoft, lambda reply: _listed(reply, "records", "fields"), ("start", "rows")),
    "socrata": Kind(("endpoint", "dataset", "address_field", "zone_field"), _socrata, lambda reply: _listed(reply), ("$offset", "$limit")),
}

Fetch = Callable[[Request], object]
Geocode = Callable[[str], tuple[float, float] | None]


def build(kind: str, config: dict[str, str]) -> Kind | None:
    """The provider of a configuration, or None if its kind is unknown or a field is missing."""
    found = KINDS.get(kind)
    return found if found and all(config.get(n) for n in found.needs) else None


def zone_of(kind: str, config: dict, address: str, fetch: Fetch, geocode: Geocode | None = None) -> tuple[str, float] | None:
    """Zone and confidence of an address. Two records are asked for, so that an ambiguous address is seen: one record with a zone is an
    answer, none or several are not. A service that fails has no answer, and the lookup goes on."""
    provider = build(kind, config)
    if not provider or not address:
        return None
    by_point = not config.get("address_field")
    try:
        request = provider.ask(config, address, geocode(address) if by_point and geocode else None)
        if request is None:
            return None
        hits = provider.read(fetch(Request(request.url, (*request.params, (provider.page[1], "2")))))
    except Exception:  # noqa: BLE001 - whatever the service or its transport does
        return None
    if not by_point:
        hits = [h for h in hits if str(h.get(config["address_field"], "")).strip().upper() == address.upper()]
    zone = str(hits[0].get(config["zone_field"]) or "").strip() if len(hits) == 1 else ""
    return (zone, provider.sure(config)) if zone else None


def lookup(asked: DataFrame, providers: DataFrame, fetch: Fetch | None = None, geocode: Geocode | None = None) -> DataFrame:
    """asked (municipality_slug, normalized_address) with zone and confidence from each city's verified provider.

    ``providers``: municipality_slug, kind, config map<string,string>, verified.
    """
    rows = asked.join(F.broadcast(providers.filter("verified").select("municipality_slug", "kind", "config")), "municipality_slug", "left")  # a row a city

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zone_of(kind, dict(config or ()), address, fetch, geocode) if kind and fetch else None for kind, config, address in zip(*(batch.column(c).to_pylist() for c in ("kind", "config", "normalized_address")), strict=True)]
            zones, sure = pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("municipality_slug"), batch.column("normalized_address"), zones, sure], names=["municipality_slug", "normalized_address", "zone", "confidence"])

    return rows.select("municipality_slug", "normalized_address", "kind", "config").mapInArrow(run, "municipality_slug string, normalized_address string, zone string, confidence double")


class ZoningRecords(DataSource):
    """``spark.read.format("zoning_records")``: all parcels of some cities' services, a partition a city, page by page.

    Options: ``providers``, a JSON list of {municipality_slug, kind, config}; ``fetch``, the name ``module:function`` of what sends a
    ``Request``; ``page_rows``. A filter on one city leaves the others' partitions out, and one on an address goes into the request, where the
    service has addresses (``spark.sql.python.filterPushdown.enabled``). Spark filters the rows again.
    """

    @classmethod
    def name(cls) -> str:
        return "zoning_records"

    def schema(self) -> str:
        return "municipality_slug string, address string, zone string"

    def reader(self, schema) -> DataSourceReader:
        return _Records(json.loads(self.options["providers"]), self.options["fetch"], int(self.options.get("page_rows", "1000")))


class _Records(DataSourceReader):
    def __init__(self, providers: list[dict], fetch: str, page_rows: int):
        self.providers, self.fetch, self.page_rows, self.asked = providers, fetch, page_rows, {}

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("municipality_slug", "address"):
                self.asked[f.attribute[0]] = f.value
        return filters

    def partitions(self):
        city = self.asked.get("municipality_slug")
        return [InputPartition(p) for p in self.providers if city in (None, p["municipality_slug"]) and build(p["kind"], p["config"])]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        slug, config = partition.value["municipality_slug"], partition.value["config"]
        kind = KINDS[partition.value["kind"]]
        field = config.get("address_field")
        request = kind.ask(config, self.asked.get("address", "") if field else "", None)
        start = 0
        while True:
            hits = kind.read(fetch(Request(request.url, (*request.params, (kind.page[0], str(start)), (kind.page[1], str(self.page_rows))))))
            for h in hits:
                zone = str(h.get(config["zone_field"]) or "").strip()
                yield slug, h.get(field) if field else None, zone or None
            start += len(hits)
            if len(hits) < self.page_rows:
                return


class StaticZoning(DataSource):
    """``spark.read.format("static_zoning")``: answers given in options ``slug|address`` = zone."""

    @classmethod
    def name(cls) -> str:
        return "static_zoning"

    def schema(self) -> str:
        return "municipality_slug string, normalized_address string, zone string"

    def reader(self, schema) -> DataSourceReader:
        rows = [(*k.split("|", 1), v) for k, v in self.options.items() if "|" in k]

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(rows)]

            def read(self, partition):
                yield from partition.value

        return Reader()
