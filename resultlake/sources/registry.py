"""Registry of search sources: a validated dimension table, and stored snapshots as a Spark source."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sources that "all" doesn't stand for.
NOT_IN_ALL = {"cnnews", "searx", "chinaso"}
FIELDS = {"label": str, "fallbacks": list, "aggregateWith": list, "zhOnly": bool, "enOnly": bool, "pageLimit": int, "host": str, "disabled": bool}
DIM = "engine string, ord bigint, label string, zh_only boolean, en_only boolean, page_limit bigint, host string, fallbacks array<string>, aggregate_with array<string>"


def validated(conf: dict, known: set[str] | None = None) -> dict:
    """The configuration; unknown fields, wrong types and unknown partners raise ValueError."""
    for name, engine in conf.items():
        for field, value in engine.items():
            if field not in FIELDS:
                raise ValueError(f"{name}: unknown field {field}")
            if not isinstance(value, FIELDS[field]) or FIELDS[field] is int and isinstance(value, bool):
                raise ValueError(f"{name}: {field} must be {FIELDS[field].__name__}")
        for partner in [*engine.get("fallbacks", []), *engine.get("aggregateWith", [])]:
            if partner not in (known or conf) and partner != "all":
                raise ValueError(f"{name}: unknown source {partner}")
    return conf


def engines(spark: SparkSession, conf: dict, overlay: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """Dimension of the sources that aren't disabled, in configured or given order."""
    merged = {k: {**v, **(overlay or {}).get(k, {})} for k, v in validated(conf).items()}
    on = [k for k in [*(order or []), *(k for k in merged if k not in (order or []))] if k in merged and not merged[k].get("disabled")]
    every = [k for k in on if k not in NOT_IN_ALL]
    rows = []
    for k, name in enumerate(on):
        e = merged[name]
        partners = [p for p in (every if e.get("aggregateWith") == ["all"] else e.get("aggregateWith", [])) if p in on and p != name]
        rows.append((name, k, e.get("label", name), e.get("zhOnly", False), e.get("enOnly", False), e.get("pageLimit"), e.get("host"), [p for p in e.get("fallbacks", []) if p in on], partners))
    return spark.createDataFrame(rows, DIM)


class _Part(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.per = options["path"], int(options.get("filesPerPartition", 64))
        self.engines = None

    def partitions(self):
        files = sorted(str(p) for p in Path(self.folder).glob("*/*.html"))
        return [_Part(files[k : k + self.per]) for k in range(0, len(files), self.per)] or [_Part([])]

    def read(self, partition):
        for p in map(Path, partition.paths):
            yield p.parent.name, p.stem, p.read_text(encoding="utf-8", errors="replace")


class Snapshots(DataSource):
    """Stored result pages: ``folder/<engine>/<query>.html`` in a folder that all executors see.

    ``spark.dataSource.register(Snapshots); spark.read.format("snapshots").load(folder)``.
    """

    @classmethod
    def name(cls):
        return "snapshots"

    def schema(self):
        return "engine string, query string, html string"

    def reader(self, schema):
        return _Reader(self.options)


def load(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
