"""The problem datasets, written and read by a data source of their own, ``fleetpulse_problems``.

Writing takes any rows: CSV with a header, lists joined and structs flattened to dotted names, or JSON, one array of
nested records a file.  Reading gives strings only, as any report reader wants them: CSV by its header; JSON arrays,
single objects and objects of sections (``top_nodes``, ...) flattened, lists joined, and a record's ``drill_down``
exploded into one row each, whose fields go over the record's own.

Each task writes a part under a temporary name; the driver renames all parts once every task has ended and writes the
manifest last, so a reader that finds a manifest reads its parts and no others.  Paths are any that Arrow's file systems
know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

NAME, MANIFEST = "fleetpulse_problems", "_manifest.json"
#: Sections of an object of several record types.
SECTIONS = {"top_nodes": "node", "top_edges": "edge", "method_hotspots": "method", "hot_paths": "path", "heuristic": "finding"}
#: Headers of the datasets.
HEADERS = {
    "code-problems": ["class", "method", "severity", "score", "categories", "problems", "screen", "flow", "step", "route", "evidence", "recommendation"],
    "leaks": ["class", "holder", "screen", "flow", "step", "severity", "score", "count", "max_age_ms", "estimated_retained_kb", "heap_evidence", "gc_root", "gc_root_category", "holder_field", "chain_fingerprint",
              "dominator_path", "alternative_paths", "investigation_steps", "fix_examples", "verification_steps", "evidence", "recommendation"],
    "influence": ["record_type", "from", "to", "severity", "score", "status", "runtime_confirmed", "count", "screens", "flows", "routes", "evidence"],
    "math-findings": ["section", "severity", "title", "detail", "evidence", "recommendation"],
}


# ---- datasets as tables ----------------------------------------------------------------------------------------------


def _text(c: str | Column | None, kind: str = "string") -> Column:
    if c is None:
        return F.lit("")
    col = F.col(c) if isinstance(c, str) else c
    if kind == "score":
        return F.format_string("%.1f", F.coalesce(col.cast("double"), F.lit(0.0)))
    return F.coalesce(F.lower(col.cast("string")) if kind == "flag" else col.cast("string"), F.lit(""))


def _table(df: DataFrame, dataset: str, **values: Column) -> DataFrame:
    return df.select(*[values.get(c, F.lit("")).alias(c) for c in HEADERS[dataset]])


def code_problem_table(registry: DataFrame, drill: DataFrame, advice: DataFrame) -> DataFrame:
    """A row for each place of a registry row (B04, B05), one without places where it has none; with B06's codes."""
    by = ["run_set", "class", "method"]
    j = registry.drop("screens", "flows", "steps", "rank").join(drill.select(*by, "screen", "flow", "step", "route"), by, "left").join(advice.select(*by, "impact", "advice"), by, "left")
    measured = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("problem_count", "log_spam", "retained", "memory_kb", "calls", "call_ms", "max_ms")])
    return _table(j, "code-problems", **{c: _text(c) for c in ("class", "method", "severity", "categories", "problems", "screen", "flow", "step", "route")}, score=_text("score", "score"), evidence=measured, recommendation=_text("advice"))


def leak_table(scored: DataFrame, advised: DataFrame | None = None) -> DataFrame:
    """Scored suspects (L03); with L08's advice where it is given."""
    key = ["run_set", "class", "holder", "screen", "flow", "step"]
    j = scored if advised is None else scored.join(advised.select(*key, "actions", "investigation", "fix_examples", "verification"), key, "left")
    own = {c: _text(c) for c in ("class", "holder", "screen", "flow", "step", "severity", "count", "max_age_ms", "evidence")}
    more = {} if advised is None else {"investigation_steps": _text("investigation"), "fix_examples": _text("fix_examples"), "verification_steps": _text("verification"), "recommendation": _text("actions")}
    return _table(j, "leaks", **own, **more, score=_text("score", "score"), estimated_retained_kb=_text("retained_kb"), heap_evidence=_text(F.col("evidence") == "confirmed_path", "flag"), chain_fingerprint=_text("chain"))


def influence_table(nodes: DataFrame, edges: DataFrame, methods: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, method hotspots and hot paths of the influence graph under one header, told apart by record_type."""
    lit = F.lit
    parts = [_table(nodes, "influence", record_type=lit("node"), **{"from": _text("class")}, severity=_text("severity"), score=_text("score", "score"), status=_text("status"), runtime_confirmed=_text(F.col("status") == "runtime", "flag"),
                    count=_text("problems"), screens=_text("screens"), flows=_text("flows"), evidence=_text("reasons")),
             _table(edges, "influence", record_type=lit("edge"), **{"from": _text("from_class"), "to": _text("to_class")}, score=_text("influence", "score"), runtime_confirmed=_text("confirmed", "flag"), count=_text("count"), evidence=_text("reason"))]
    if methods is not None:
        parts.append(_table(methods, "influence", record_type=lit("method"), **{"from": _text("class"), "to": _text("method")}, score=_text("heat", "score"), status=_text("role"), count=_text("calls"), evidence=lit("method_hotspot")))
    if paths is not None:
        parts.append(_table(paths, "influence", record_type=lit("path"), **{"from": F.regexp_replace("path", ">", " -> ")}, score=_text("weight", "score"), runtime_confirmed=_text("runtime", "flag")))
    return reduce(DataFrame.unionByName, parts)


def finding_table(sections: DataFrame) -> DataFrame:
    """Findings of the maths sections."""
    return _table(sections, "math-findings", section=_text("section"), severity=_text("status"), title=_text("top"), detail=F.concat(F.lit("findings="), F.col("findings").cast("string")))


# ---- the data source --------------------------------------------------------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def plain(value: object) -> str:
    """A value as reports show it: nothing for null, small letters for booleans, lists joined."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)) and not isinstance(value, Row):
        return " | ".join(plain(v) for v in value)
    if isinstance(value, Row):
        value = value.asDict(True)
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


def flat(record: dict, prefix: str = "", skip: frozenset = frozenset()) -> dict[str, str]:
    """Nested objects under dotted names; everything else as text."""
    out: dict[str, str] = {}
    for key, value in record.items():
        if key in skip:
            continue
        value = value.asDict(True) if isinstance(value, Row) else value
        out |= flat(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": plain(value)}
    return out


def json_records(root: object) -> Iterator[dict[str, str]]:
    """Rows of a JSON document."""
    if isinstance(root, dict):
        named = [(kind, r) for section, kind in SECTIONS.items() for r in (root.get(section) if isinstance(root.get(section), list) else [])]
        if named:
            for kind, record in named:
                for row in json_records([record]):
                    yield {"record_type": kind} | row
            return
        yield flat(root)
        return
    for record in root if isinstance(root, list) else []:
        if not isinstance(record, dict):
            yield {"value": plain(record)}
            continue
        base, places = flat(record, skip=frozenset({"drill_down"})), record.get("drill_down")
        if not isinstance(places, list) or not places:
            yield base
            continue
        for place in places:
            yield base | (flat(place) if isinstance(place, dict) else {"drill_down": plain(place)})


def _records(text: str, kind: str) -> Iterator[dict[str, str]]:
    if kind == "csv":
        rows = csv.reader(io.StringIO(text, newline=""))
        header = next(rows, [])
        for row in rows:
            yield dict(zip(header, row + [""] * (len(header) - len(row))))
    elif text.strip():
        yield from json_records(json.loads(text))


def _files(path: str) -> list[str]:
    """Parts of the manifest; without one the file itself, or all files of the folder."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    manifest = f"{at}/{MANIFEST}"
    if store.get_file_info(manifest).type == fs.FileType.File:
        with store.open_input_stream(manifest) as f:
            return [f"{at}/{p['file']}" for p in json.loads(f.read())["parts"]]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _kind(options: dict, file: str = "") -> str:
    return options.get("kind") or ("json" if file.endswith(".json") else "csv")


@dataclass
class _Part(InputPartition):
    file: str


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    rows: int


class ProblemsSource(DataSource):
    """format("fleetpulse_problems"), options path and kind (csv or json)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """All columns of all files, in order of first sight; give a schema to read without this look at them."""
        seen: dict[str, None] = {}
        store, _ = _store(self.options["path"])
        for file in _files(self.options["path"]):
            with store.open_input_stream(file) as f:
                text = f.read().decode()
            names = next(csv.reader(io.StringIO(text, newline="")), []) if _kind(self.options, file) == "csv" else [c for r in _records(text, "json") for c in r]
            seen |= dict.fromkeys(names)
        return StructType([StructField(c, StringType()) for c in seen])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.names, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names = options, names

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in _files(self.options["path"])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        with store.open_input_stream(partition.file) as f:
            text = f.read().decode()
        for record in _records(text, _kind(self.options, partition.file)):
            yield tuple(record.get(c, "") for c in self.names)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.options, self.names, self.overwrite, self.run = options, names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, at = _store(self.options["path"])
        store.create_dir(at, recursive=True)
        kind, temporary, n = _kind(self.options), f"_{self.run}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{at}/{temporary}") as f:
            def put(text: str) -> None:
                f.write(text.encode())

            for n, row in enumerate(iterator, 1):
                record = dict(zip(self.names, row))
                if kind == "csv":
                    cells = flat(record)
                    line = io.StringIO(newline="")
                    out = csv.writer(line, lineterminator="\n")
                    if n == 1:
                        out.writerow(cells)
                    out.writerow(cells.values())
                    put(line.getvalue())
                else:
                    nested = {k: v.asDict(True) if isinstance(v, Row) else [x.asDict(True) if isinstance(x, Row) else x for x in v] if isinstance(v, list) else v for k, v in record.items()}
                    put(("[\n" if n == 1 else ",\n") + json.dumps(nested, ensure_ascii=False))
            if kind == "json" and n:
                put("\n]\n")
        return _Written(temporary, n)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.options["path"])
        store.create_dir(at, recursive=True)
        before = [] if self.overwrite else _files(self.options["path"])
        kind = _kind(self.options)
        parts = [{"file": f.rsplit("/", 1)[1], "rows": None} for f in before]
        for i, m in enumerate(m for m in messages if m):
            if m.rows:
                name = f"part-{self.run}-{i:05d}.{kind}"
                store.move(f"{at}/{m.temporary}", f"{at}/{name}")
                parts.append({"file": name, "rows": m.rows})
            else:
                store.delete_file(f"{at}/{m.temporary}")
        with store.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"parts": parts}).encode())
        if self.overwrite:
            kept = {p["file"] for p in parts} | {MANIFEST}
            for old in store.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File and old.base_name not in kept and not old.base_name.startswith("_"):
                    store.delete_file(old.path)

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.options["path"])
        for m in messages:
            if m and store.get_file_info(f"{at}/{m.temporary}").type == fs.FileType.File:
                store.delete_file(f"{at}/{m.temporary}")


def write_dataset(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ProblemsSource)
    df.write.format(NAME).mode(mode).option("kind", kind).save(path)


def read_dataset(spark: SparkSession, path: str, schema: str | None = None, kind: str | None = None) -> DataFrame:
    spark.dataSource.register(ProblemsSource)
    r = spark.read.format(NAME)
    r = r.schema(schema) if schema else r
    return (r.option("kind", kind) if kind else r).load(path)
