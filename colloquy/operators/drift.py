"""Schemas that drift between the files of a feed.

Every JSON document is profiled: the paths of its members, their JSON types and a sketch of their values (the least hashes of the
values seen). Profiles are unions of sets: each batch makes one of every file that it meets, a row of arrays, and these meet by feed, in order of files, where they are
put together and each file is compared with the one before; a task holds two files' profiles at a time. Between
a file and its predecessor, the fields that went and the fields that came under one parent form a bipartite graph, weighed by
type, by likeness of the names and by overlap of the value sketches; an optimal matching of it proposes the renames. As a
change, a proposal stands where it is unambiguous: one field went, one came, of the same type. Columns are unified into one name, the
newest of their chain, by these and, where several fields went or came, by the pairs of the matching that score ``LIKELY`` or more.

Defined results: documents that are no JSON object are left out, as are rows without feed or file number; members that are only
ever null do not exist; an object without members and an empty list are fields, not parents. A feed's first file drifts from nothing.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.matching import best_assignment

SKETCH = 8
TAG = "schema"
LIKELY = 1.5  # the type, and half of what a like name or like values can add
FEW = 4  # sketches of fewer values agree by chance


def _no(constant: str) -> None:
    raise ValueError(constant)


def parse(payload: str | None) -> dict | None:
    """The object that a payload holds, or None."""
    try:
        value = json.loads(payload, parse_constant=_no) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "object"


def members(document: dict) -> Iterator[tuple[str, str, object]]:
    """path, JSON type and value of every named member that is not null, at any depth."""
    stack: list[tuple[str, object]] = [("", document)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            for name, inner in value.items():
                if inner is not None:
                    own = f"{path}.{name}" if path else name
                    yield own, kind_of(inner), inner
                    stack.append((own, inner))
        elif isinstance(value, list):
            stack += [(f"{path}[]", x) for x in value if isinstance(x, (dict, list))]


KINDS = {str: 1, bool: 2, int: 4, float: 4, list: 8, dict: 16}  # one bit for each JSON type


def _profile(documents: list[dict]) -> dict[str, tuple[int, bytes]]:
    """path -> JSON types and sketch of the members of the documents."""
    seen: dict[str, list] = {}

    stack: list[tuple[dict | list, str]] = [(d, "") for d in documents]
    while stack:  # however deep
        whole, under = stack.pop()
        if type(whole) is list:
            stack += [(x, under + "." if type(x) is dict else under + "[]") for x in whole if type(x) in (dict, list)]
            continue
        for name, value in whole.items():
            if value is None:
                continue
            path, kind = under + name, type(value)
            field = seen.get(path)
            if field is None:
                field = seen[path] = [0, set()]
            field[0] |= KINDS[kind]
            if kind is dict:
                stack.append((value, path + "."))
            elif kind is list:
                stack.append((value, path + "[]"))
            else:
                field[1].add(value)
    return {path: (kinds, _sketch(values)) for path, (kinds, values) in seen.items()}


def _sketch(values: set) -> bytes:
    """The least hashes of the values, as 32-bit numbers."""
    if not values:
        return b""
    hashes = [zlib.crc32(v.encode("utf-8", "surrogatepass") if type(v) is str else repr(v).encode()) for v in values]
    return array("I", hashes if len(hashes) == 1 else sorted(set(hashes))[:SKETCH]).tobytes()


def profile(df: DataFrame, feed: str, file_no: str, payload: str) -> DataFrame:
    """feed, file_no, paths, kinds, sketches, tags: the profile of the documents of a file that a batch holds, so a file may have several rows."""
    shape = "feed string, file_no int, paths array<string>, kinds array<int>, sketches array<binary>, tags array<string>"
    schema = pa.schema([("feed", pa.string()), ("file_no", pa.int32()), ("paths", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("sketches", pa.list_(pa.binary())), ("tags", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files: dict[tuple[str, int], list[dict]] = {}
            for f, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (document := parse(body)) is not None:
                    files.setdefault((f, n), []).append(document)
            if files:
                fields = [_profile(documents) for documents in files.values()]
                columns = [
                    [f for f, _ in files], [n for _, n in files], [list(x) for x in fields], [[k for k, _ in x.values()] for x in fields], [[s for _, s in x.values()] for x in fields],
                    [sorted({json.dumps(d[TAG], sort_keys=True) for d in documents if d.get(TAG) is not None}) for documents in files.values()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.types)], schema=schema)

    rows = df.filter(F.col(feed).isNotNull() & F.col(file_no).isNotNull()).select(F.col(feed).cast("string"), F.col(file_no).cast("int"), payload)
    return rows.mapInArrow(run, shape)


class File:
    """The profile of a whole file: path -> JSON types and sketches of its parts."""

    def __init__(self, feed: str, file_no: int):
        self.feed, self.file_no, self.tags, self.fields = feed, file_no, set(), {}

    def add(self, paths: list[str], kinds: list[int], sketches: list[bytes], tags: list[str]) -> None:
        self.tags.update(tags)
        for path, kind, sketch in zip(paths, kinds, sketches):
            field = self.fields.get(path)
            if field is None:
                self.fields[path] = [kind, [sketch]]
            else:
                field[0] |= kind
                field[1].append(sketch)
                if len(field[1]) > 4 * SKETCH:
                    field[1] = [np.array(least(field[1]), dtype=np.uint32).tobytes()]


def least(sketches: list[bytes]) -> list[int]:
    """The sketch of all values of the parts."""
    return np.unique(np.frombuffer(b"".join(sketches), dtype=np.uint32))[:SKETCH].tolist()


def parent(path: str) -> str:
    return path.rpartition(".")[0]


def _bigrams(name: str) -> set[str]:
    name = f"^{name.lower()}$"
    return {name[i : i + 2] for i in range(len(name) - 1)}


def likeness(went: tuple[str, int, list], came: tuple[str, int, list]) -> float:
    """How well one field (path, types, sketches) may be another's successor: 0 for another type, else by name and values."""
    (a, ka, sa), (b, kb, sb) = went, came
    if ka != kb:
        return 0.0
    x, y = _bigrams(a.rpartition(".")[2]), _bigrams(b.rpartition(".")[2])
    p, q = least(sa), least(sb)
    both = sorted({*p, *q})[:SKETCH]
    shared = sum(h in p and h in q for h in both) / len(both) if both else 0.0
    return 1.0 + len(x & y) / len(x | y) + shared


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """The matching of greatest total score of rows to columns; pairs of score 0 are left out."""
    return [(i, j) for i, j in best_assignment(score) if score[i, j] > 0]


def likely(went: tuple[str, int, list], came: tuple[str, int, list]) -> float:
    """``likeness`` without sketches of few values."""
    told = min(len(least(went[2])), len(least(came[2]))) >= FEW
    return likeness(*((path, kinds, sketch if told else []) for path, kinds, sketch in (went, came)))


def compare(before: dict[str, list], now: dict[str, list], proposals: bool = False) -> list[tuple[str, str, str, float | None]]:
    """kind, path, old path and, of renames, score of each change; both sides: path -> types, sketches. With ``proposals`` also, as ``proposed``, the likely
    pairs of the matching where several fields went or came; they stay removed and added."""
    went, came = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
    retyped = sorted(p for p in now.keys() & before.keys() if now[p][0] != before[p][0])
    changed = {*went, *came, *retyped}

    def below(path: str) -> bool:
        at = parent(path)
        while at:
            if at in changed or at.rstrip("[]") in changed:
                return True
            at = parent(at)
        return False

    went, came = [p for p in went if not below(p)], [p for p in came if not below(p)]
    out: list[tuple] = [("retyped", p, "", None) for p in retyped if not below(p)]
    renamed: dict[str, str] = {}
    scores: dict[str, float] = {}
    for under in sorted({parent(p) for p in went} & {parent(p) for p in came}):
        a, b = [p for p in went if parent(p) == under], [p for p in came if parent(p) == under]
        alone = len(a) == 1 and len(b) == 1
        score = np.array([[(likeness if alone else likely)((x, *before[x]), (y, *now[y])) for y in b] for x in a])
        for i, j in assignment(score):
            if alone:
                renamed[b[j]], scores[b[j]] = a[i], float(score[i, j])
            elif proposals and score[i, j] >= LIKELY:
                out.append(("proposed", b[j], a[i], float(score[i, j])))
    out += [("renamed", new, old, scores[new]) for new, old in renamed.items()]
    gone = set(renamed.values())
    out += [("removed", p, "", None) for p in went if p not in gone]
    return out + [("added", p, "", None) for p in came if p not in renamed]


def changes(profiles: DataFrame, proposals: bool = False) -> DataFrame:
    """feed, file_no, drift_kind, field_path, old_path, score of every change from a feed's file to its next; ``proposals`` as in ``compare``.

    What meets by feed are profiles, as large as schemas whatever the number of documents, at most one for each file and batch.
    """
    schema = pa.schema([("feed", pa.string()), ("file_no", pa.int32()), ("drift_kind", pa.string()), ("field_path", pa.string()), ("old_path", pa.string()), ("score", pa.float64())])

    def between(last: File | None, file: File | None) -> list[tuple]:
        if last is None or file is None or last.feed != file.feed:
            return []
        out = [(file.feed, file.file_no, *c) for c in compare(last.fields, file.fields, proposals)]
        return out + [(file.feed, file.file_no, "retagged", TAG, "", None)] if last.tags != file.tags else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = file = None
        for batch in batches:
            out = []
            for feed, file_no, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None or (feed, file_no) != (file.feed, file.file_no):
                    out += between(last, file)
                    last, file = file, File(feed, file_no)
                file.add(*part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if out := between(last, file):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    files = profiles.repartition("feed").sortWithinPartitions("feed", "file_no")
    return files.mapInArrow(run, "feed string, file_no int, drift_kind string, field_path string, old_path string, score double")


def unified_names(drift: DataFrame, profiles: DataFrame) -> DataFrame:
    """feed, file_no, path, unified: the name of each file's field in the feed's one table, the newest of its chain of renames, with
    the proposed ones if ``drift`` has them.

    Renames are followed inside a feed, file by file; what is handled at once is a feed's renames and paths, not its rows.
    """
    renames = drift.filter("drift_kind in ('renamed', 'proposed')").groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_no", "old_path", "field_path"))).alias("steps"))
    fields = profiles.select("feed", "file_no", F.explode("paths").alias("path")).distinct().join(renames, "feed", "left")

    def moved(path, step):
        old, new = step["old_path"], step["field_path"]
        return F.when(path == old, new).when(path.startswith(F.concat(old, F.lit("."))) | path.startswith(F.concat(old, F.lit("[]"))), F.concat(new, F.substring(path, F.length(old) + 1, F.lit(1 << 30)))).otherwise(path)

    later = F.filter(F.coalesce("steps", F.array().cast("array<struct<file_no:int,old_path:string,field_path:string>>")), lambda s: s["file_no"] > F.col("file_no"))
    return fields.select("feed", "file_no", "path", F.aggregate(later, F.col("path"), moved).alias("unified"))


def unify(df: DataFrame, names: DataFrame, feed: str, file_no: str, payload: str, key: str) -> DataFrame:
    """key, feed, file_no and values: each document as one map from the unified field names to JSON text."""
    per_file = names.groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_set(F.struct("path", "unified"))).alias("names"))
    kind = df.schema
    shape = f"`{key}` {kind[key].dataType.simpleString()}, feed string, file_no int, values map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, known in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                lookup, row = dict(known or []), {}
                for path, _, value in members(parse(body) or {}):
                    if not isinstance(value, (dict, list)) or not value or all(not isinstance(x, (dict, list)) for x in value) and isinstance(value, list):
                        row.setdefault(lookup.get(path, path), []).append(value)
                out.append([(k, json.dumps(v[0] if len(v) == 1 else v, ensure_ascii=False)) for k, v in sorted(row.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, type=pa.map_(pa.string(), pa.string()))], names=[key, "feed", "file_no", "values"])

    rows = df.select(F.col(key), F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(payload).alias("body"))
    return rows.join(per_file, ["feed", "file_no"]).select(key, "feed", "file_no", "body", "names").mapInArrow(run, shape)
