"""YAML and JSON workflow definitions as a Spark data source.

``spark.read.format("workflow_definitions").load(folder)`` gives one row per
definition: name, entry, exit, its nodes and edges as arrays, and for a bad
one an ``error`` (kind, line, column, message) in their place, so a bad file is
a row and not a failed job. ``workflow_rows``, ``node_rows``, ``edge_rows`` and
``reject_rows`` are the flat tables.

The reader's partitions are groups of files of about ``groupBytes`` (or, where
files are few, single files). A file is one definition; with option
``documents = many`` it is a stream of YAML documents, each begun by a line
``---``, and read one document at a time. Files ending in ``.json`` are JSON.
The folder's file system is opened by Arrow, on the driver to list it and in
the tasks to read; ``parse_files`` does the same for texts that Spark has read.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

try:
    import yaml
except ImportError:  # YAML files are rejected then; JSON files need nothing
    yaml = None

def _struct(**fields: str) -> pa.StructType:
    return pa.struct([(k, {"s": pa.string(), "i": pa.int32(), "l": pa.int64()}[v]) for k, v in fields.items()])


_ARROW = pa.schema([
    *_struct(file="s", document="i", first_line="l", name="s", version="i"), ("tags", pa.list_(pa.string())), *_struct(entry="s", exit="s"),
    ("nodes", pa.list_(_struct(pos="i", slug="s", type="s", execution_mode="s", label="s", config="s"))),
    ("edges", pa.list_(_struct(pos="i", src="s", dst="s", type="s", condition="s"))),
    ("error", _struct(kind="s", line="i", col="i", message="s"))])
SCHEMA = from_arrow_schema(_ARROW)

MAX_VALUES = 5_000_000  # values of one definition once its aliases are written out

_JSON = json.JSONEncoder(ensure_ascii=False, default=str, separators=(",", ":"))
_DOCUMENT = re.compile(r"---(?=\s|$)")


class Bad(Exception):
    """A definition that cannot be read: kind, message, line and column (from 1)."""

    def __init__(self, kind: str, message: str, line: int | None = None, col: int | None = None):
        super().__init__(kind, message, line, col)


class _Other(Exception):
    """A YAML text with more than plain values: anchors, tags, merges, keys that are no scalars, deep nesting."""


PLAIN_DEPTH = 50

# Lines of a simple text: keys, values on one line, list items. Anything else, such as comments
# behind a value, block texts or plain texts over several lines, is left to the parser.
_ODD = re.compile("[^\n\x20-\x7e\xa1-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]")
_LINE = re.compile(r"( *)(- +)?(?:([A-Za-z_][\w./-]{0,99}):(?: +(.*))?|(.+))", re.ASCII)
_BARE = re.compile(r"(?:[A-Za-z0-9_./]|-[A-Za-z0-9.])(?:[^#:]|:(?=[^ ]))*(?<!:)")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\["\\nrtbf])*"')
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_PART = re.compile(r"""([\[\]{},])|((?:[A-Za-z0-9_./]|-[A-Za-z0-9.])[^\[\]{},:#?"']*)|("(?:[^"\\]|\\["\\nrtbf])*")|('(?:[^']|'')*')""")


@lru_cache(1 << 14)
def _scalar(text: str) -> object:
    """The value of a plain (unquoted) scalar, as the safe loader has it."""
    rules = yaml.SafeLoader.yaml_implicit_resolvers
    tag = next((tag for tag, pattern in [*rules.get(text[:1], ()), *rules.get(None, ())] if pattern.match(text)), None)
    if tag is None:
        return text
    if tag in ("tag:yaml.org,2002:merge", "tag:yaml.org,2002:value"):
        raise _Other
    return yaml.constructor.SafeConstructor().construct_object(yaml.ScalarNode(tag, text))


def _on_one_line(text: str) -> object:
    """The value of a scalar, list or mapping that is written on one line."""
    start = text[0]
    if start == '"':
        if _DOUBLE.fullmatch(text):
            return json.loads(text)
    elif start == "'":
        if _SINGLE.fullmatch(text):
            return text[1:-1].replace("''", "'")
    elif start in "[{":
        value, at = _flow(text, 0, 0)
        if at == len(text):
            return value
    elif _BARE.fullmatch(text):
        return _scalar(text)
    raise _Other


def _flow(text: str, at: int, depth: int) -> tuple[object, int]:
    """A value within brackets at a place of the line, and the place behind it and its blanks."""
    m = _PART.match(text, at)
    if m is None or depth > PLAIN_DEPTH:
        raise _Other
    mark, bare, double, single = m.groups()
    end = m.end()
    if mark is None:
        value = _scalar(bare.rstrip(" ")) if bare is not None else json.loads(double) if double is not None else single[1:-1].replace("''", "'")
        while text[end : end + 1] == " ":
            end += 1
        return value, end
    if mark not in "[{":
        raise _Other
    while text[end : end + 1] == " ":
        end += 1
    found, close = ([], "]") if mark == "[" else ({}, "}")
    if text[end : end + 1] != close:
        while True:
            if mark == "{":
                if text[end : end + 1] in ("[", "{") or (key := _flow(text, end, depth + 1)) is None or key[1] - end > 100 or text[key[1] - 1] == " " or text[key[1] : key[1] + 2] != ": ":
                    raise _Other
                end = key[1] + 2
                while text[end : end + 1] == " ":
                    end += 1
                found[key[0]], end = _flow(text, end, depth + 1)
            else:
                value, end = _flow(text, end, depth + 1)
                found.append(value)
            mark_here = text[end : end + 1]
            end += 1
            if mark_here == close:
                break
            if mark_here != ",":
                raise _Other
            while text[end : end + 1] == " ":
                end += 1
    else:
        end += 1
    while text[end : end + 1] == " ":
        end += 1
    return found, end


def _simple(text: str) -> object:
    """The value of one YAML document of simple lines, read line by line; ``_Other`` if there is more in it."""
    if _ODD.search(text):
        raise _Other
    lines = []
    for line in text.split("\n"):
        line = line.rstrip(" ")
        if line:
            m = _LINE.fullmatch(line)
            if m is None:
                raise _Other
            blanks, dash, key, value, alone = m.groups()
            # a list item on a key's line is two parts: the item, and the first key of its mapping
            indent = len(blanks)
            if dash is not None:
                if alone is not None:
                    lines.append((indent, True, None, alone))
                    continue
                lines.append((indent, True, None, None))
                indent += len(dash)
            elif alone is not None:
                raise _Other
            lines.append((indent, False, key, value))
    if not lines:
        raise _Other
    lines.append((-1, False, None, None))
    value, at = _block(lines, 0, 0)
    if at != len(lines) - 1:
        raise _Other
    return value


def _block(lines: list[tuple], at: int, depth: int) -> tuple[object, int]:
    """The list or mapping that begins at a line, and the number of the line behind it."""
    indent, dash, _, _ = lines[at]
    if depth > PLAIN_DEPTH:
        raise _Other
    found = [] if dash else {}
    while True:
        here, item, key, value = lines[at]
        if here != indent or item != dash:
            if here > indent or (here == indent and not dash):
                raise _Other
            return found, at  # a list may stand at its key's own indent: the next key is behind it
        at += 1
        following = lines[at]
        if value is not None:
            if following[0] > indent:
                raise _Other
            value = _on_one_line(value)
        elif following[0] > indent or (not dash and following[0] == indent and following[1]):
            value, at = _block(lines, at, depth + 1)
        elif dash:
            raise _Other
        if dash:
            found.append(value)
        else:
            found[_scalar(key)] = value


def _plain(text: str) -> object:
    """The value of one YAML document of mappings, lists and scalars, made from the parser's events; ``_Other`` if there is more in it."""
    loader = yaml.CSafeLoader(text)
    event = loader.get_event
    try:
        event()
        if type(event()) is not yaml.DocumentStartEvent:
            raise _Other
        # an open part: its value, whether it is a mapping, and the key that waits
        top: list = []
        part, mapping, key, waits, open_ = top, False, None, False, []
        while True:
            e = event()
            kind = type(e)
            if kind is yaml.ScalarEvent:
                if e.anchor is not None or e.tag is not None:
                    raise _Other
                value = _scalar(e.value) if e.implicit[0] else e.value
            elif kind is yaml.MappingStartEvent or kind is yaml.SequenceStartEvent:
                if e.anchor is not None or e.tag is not None or len(open_) >= PLAIN_DEPTH or (mapping and not waits):
                    raise _Other
                value = {} if kind is yaml.MappingStartEvent else []
            elif kind is yaml.MappingEndEvent or kind is yaml.SequenceEndEvent:
                part, mapping, key, waits = open_.pop()
                continue
            elif kind is yaml.DocumentEndEvent:
                break
            else:
                raise _Other
            if not mapping:
                part.append(value)
            elif waits:
                part[key], waits = value, False
            else:
                key, waits = value, True
            if kind is not yaml.ScalarEvent:
                open_.append((part, mapping, key, waits))
                part, mapping, key, waits = value, kind is yaml.MappingStartEvent, None, False
        if type(event()) is not yaml.StreamEndEvent:
            raise _Other
        return top[0]
    finally:
        loader.dispose()


def load(text: str, is_json: bool) -> object:
    """The value of one definition text."""
    if is_json:
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise Bad("syntax", e.msg, e.lineno, e.colno) from None
        except RecursionError:
            raise Bad("syntax", "nested too deeply") from None
    if yaml is None:
        raise Bad("syntax", "no YAML library here")
    try:
        try:
            if hasattr(yaml, "CSafeLoader"):
                try:
                    return _simple(text)
                except (_Other, ValueError):
                    pass
                try:
                    return _plain(text)
                except (_Other, ValueError):
                    return yaml.load(text, yaml.CSafeLoader)
            return yaml.load(text, yaml.SafeLoader)
        except yaml.YAMLError:
            return yaml.safe_load(text)  # its messages are the ones that users know
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise Bad("syntax", getattr(e, "problem", None) or str(e), mark and mark.line + 1, mark and mark.column + 1) from None
    except (RecursionError, ValueError) as e:  # nesting, impossible dates
        raise Bad("syntax", str(e) or "nested too deeply") from None


def written_out(value: object) -> int:
    """Number of values when every alias is written out; more than ``MAX_VALUES`` or a loop is a schema error."""
    known: dict[int, int] = {}
    open_: set[int] = set()
    todo: list[tuple[object, bool]] = [(value, False)]
    while todo:
        v, done = todo.pop()
        if not isinstance(v, (dict, list)):
            continue
        parts = v.values() if isinstance(v, dict) else v
        if done:
            open_.discard(id(v))
            known[id(v)] = 1 + sum(known.get(id(p), 1) for p in parts)
            if known[id(v)] > MAX_VALUES:
                raise Bad("schema", f"more than {MAX_VALUES} values")
        elif id(v) in open_:
            raise Bad("schema", "a value contains itself")
        elif id(v) not in known:
            open_.add(id(v))
            todo.append((v, True))
            todo += [(p, False) for p in parts]
    return known.get(id(value), 1)


def _text(value: object, place: str, errors: list[str], needed: bool = True) -> str | None:
    if isinstance(value, str):
        return value
    if value is not None or needed:
        errors.append(f"{place}: {'Field required' if value is None else 'Input should be a valid string'}")
    return None


def shaped(value: object, aliases: bool = True) -> dict:
    """Columns of one definition; ``Bad`` lists every field that is missing or of the wrong kind. ``aliases``: whether values may be shared."""
    if not isinstance(value, dict):
        raise Bad("schema", "a definition is a mapping")
    if aliases:
        written_out(value)
    errors: list[str] = []
    row = {k: _text(value.get(k), k, errors) for k in ("name", "entry", "exit")}
    row["version"] = value.get("version", 1)
    if not isinstance(row["version"], int) or isinstance(row["version"], bool) or abs(row["version"]) >= 1 << 31:
        errors.append("version: Input should be a valid integer")
    row["tags"] = value.get("tags", [])
    if not isinstance(row["tags"], list) or not all(isinstance(t, str) for t in row["tags"]):
        errors.append("tags: Input should be a list of strings")
    nodes, edges = value.get("nodes"), value.get("edges")
    row["nodes"], row["edges"] = [], []
    for name, part, kind in (("nodes", nodes, dict), ("edges", edges, list)):
        if part is None:
            errors.append(f"{name}: Field required")
        elif not isinstance(part, kind):
            errors.append(f"{name}: Input should be a {'mapping' if kind is dict else 'list'}")
    for i, (slug, node) in enumerate(nodes.items() if isinstance(nodes, dict) else ()):
        place = f"nodes -> {slug}"
        if not isinstance(slug, str) or not isinstance(node, dict):
            errors.append(f"{place}: Input should be a mapping under a string")
            continue
        config = node.get("config")
        if config is not None and not isinstance(config, dict):
            errors.append(f"{place} -> config: Input should be a mapping")
        row["nodes"].append({"pos": i, "slug": slug, "type": _text(node.get("type"), f"{place} -> type", errors), "execution_mode": _text(node.get("execution_mode"), f"{place} -> execution_mode", errors, False),
                             "label": _text(node.get("label"), f"{place} -> label", errors, False), "config": _JSON.encode(config or {})})
    for i, edge in enumerate(edges if isinstance(edges, list) else ()):
        place = f"edges -> {i}"
        if not isinstance(edge, dict):
            errors.append(f"{place}: Input should be a mapping")
            continue
        row["edges"].append({"pos": i, "src": _text(edge.get("from"), f"{place} -> from", errors), "dst": _text(edge.get("to"), f"{place} -> to", errors),
                             "type": _text(edge.get("type", "STATIC"), f"{place} -> type", errors), "condition": _text(edge.get("condition"), f"{place} -> condition", errors, False)})
    if errors:
        raise Bad("schema", "\n".join(errors))
    return row


def definition(file: str, document: int, first_line: int, text: str) -> dict:
    """One row of ``SCHEMA``."""
    place = {"file": file, "document": document, "first_line": first_line}
    try:
        # without an alias a text has no more values than characters
        row = shaped(load(text, file.lower().endswith(".json")), "*" in text or len(text) > MAX_VALUES)
        "".join([row["name"], row["entry"], row["exit"], *row["tags"], *(str(v) for part in (row["nodes"], row["edges"]) for x in part for v in x.values())]).encode()
        return place | row
    except Bad as e:
        kind, message, line, col = e.args
    except (RecursionError, TypeError, UnicodeError) as e:  # keys that JSON cannot hold, lone surrogates
        kind, message, line, col = "schema", str(e) or "nested too deeply", None, None
    return place | {"error": {"kind": kind, "line": line, "col": col, "message": message.encode("utf-8", "replace").decode()}}


def documents(file: str, lines: Iterator[str], many: bool) -> Iterator[dict]:
    """Rows of one file. A document is held at a time; what comes before the first ``---`` counts if it is not blank."""
    if not many:
        yield definition(file, 0, 1, "".join(lines))
        return
    held: list[str] = []
    number, first = 0, 1
    for at, line in enumerate(lines, 1):
        if _DOCUMENT.match(line):
            if "".join(held).strip():
                yield definition(file, number, first, "".join(held))
                number += 1
            held, first = [line[3:]], at
        else:
            held.append(line)
    if "".join(held).strip():
        yield definition(file, number, first, "".join(held))


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("workflow_definitions needs a path")
        self.many = options.get("documents", "one") == "many"
        self.group = int(options.get("groupBytes", 8 << 20))

    def _open(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        fs, base = self._open(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        found = sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        groups: list[list[str]] = []
        size = self.group
        for f in found:
            if size >= self.group:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size or 0
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open(self.path)
        for path in partition.files:
            with fs.open_input_stream(path, compression=None) as stream:
                yield from _batches(documents(path.rpartition("/")[2], _lines(stream), self.many))


def _lines(stream, chunk: int = 1 << 20) -> Iterator[str]:
    """Text lines with their ends; bytes that are no UTF-8 become U+FFFD."""
    parts: list[bytes] = []
    while data := stream.read(chunk):
        *whole, rest = data.split(b"\n")
        for line in whole:
            yield b"".join([*parts, line, b"\n"]).decode("utf-8", "replace")
            parts = []
        parts.append(rest)
    if last := b"".join(parts):
        yield last.decode("utf-8", "replace")


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array; the fields of listed records column by column."""
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return pa.array(values, kind)
    flat, fields = list(chain.from_iterable(v for v in values if v)), list(kind.value_type)
    records = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in fields], fields=fields)
    offsets = pa.array([0, *accumulate(len(v) if v else 0 for v in values)], pa.int32())
    return pa.ListArray.from_arrays(offsets, records, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _batches(rows: Iterator[dict], size: int = 256) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([_array([r.get(f.name) for r in part], f.type) for f in _ARROW], schema=_ARROW)


class DefinitionSource(DataSource):
    """Batch source of workflow definitions; options ``path``, ``documents`` (one or many), ``groupBytes``."""

    @classmethod
    def name(cls) -> str:
        return "workflow_definitions"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_definitions(spark: SparkSession, path: str, many: bool = False, group_bytes: int = 8 << 20) -> DataFrame:
    """All definitions under ``path``, by the data source."""
    spark.dataSource.register(DefinitionSource)
    return spark.read.format(DefinitionSource.name()).option("documents", "many" if many else "one").option("groupBytes", str(group_bytes)).load(path)


def parse_files(files: DataFrame, many: bool = False) -> DataFrame:
    """``file, value`` texts (say, of ``spark.read.text(..., wholetext=True)``) -> the rows of the data source; a null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _batches(documents(file, _lines(io.BytesIO(value.as_py() or b"")), many))

    return files.select(F.coalesce("file", F.lit("")).alias("file"), F.col("value").cast("binary")).mapInArrow(run, SCHEMA)


def workflow_rows(definitions: DataFrame) -> DataFrame:
    return definitions.where("error is null").select("file", "document", "name", "version", "tags", "entry", "exit", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


def node_rows(definitions: DataFrame) -> DataFrame:
    return definitions.where("error is null").select("file", "document", "name", F.inline("nodes"))


def edge_rows(definitions: DataFrame) -> DataFrame:
    return definitions.where("error is null").select("file", "document", "name", F.inline("edges"))


def reject_rows(definitions: DataFrame) -> DataFrame:
    """One row per bad definition; ``line`` counts from the definition's first line."""
    return definitions.where("error is not null").select("file", "document", "first_line", "error.*")
