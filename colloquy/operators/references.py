"""References to records that do not exist, from change deltas.

Every change is a delta on a key: a record that arrives adds one to the key's existence, a deletion takes one away, a row that
refers to the key adds one to its references. The deltas are summed per key (map-side first, so that a key with most of the
references moves one row per task) into a state, which new deltas can be merged into (``merged``) without reading the old ones; keys with references and
no existence are the current orphans. For the report by row, a reference is held against the key's signed count of existence as it stood when the row arrived.
References inside a row, as those of segments to the row's own speakers, are deltas too, on keys of that row, and are summed there.

A null key refers to nothing. Missing times: a record without arrival was always there, one without deletion was never deleted,
and a row without arrival is only ever ``missing``. Repeated records of a key must have been reduced to one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.labels import entry_keys, label_keys

HEAVY = 1000  # how many of the keys with the most references are broadcast; each other one has less than a thousandth of all


def deltas(records: DataFrame, references: DataFrame) -> DataFrame:
    """key, at, exists, refers of every change; records: key, arrived, deleted; references: key, arrived."""
    none = F.lit(0)
    came = records.select("key", F.col("arrived").alias("at"), F.lit(1).alias("exists"), none.alias("refers"))
    went = records.filter("deleted is not null").select("key", F.col("deleted").alias("at"), F.lit(-1).alias("exists"), none.alias("refers"))
    refers = references.select("key", F.col("arrived").alias("at"), none.alias("exists"), F.lit(1).alias("refers"))
    return reduce(DataFrame.unionByName, [came, went, refers]).filter("key is not null")


def signed_counts(changes: DataFrame) -> DataFrame:
    """The state after all changes: key, existing, referring, and the instants at which the existence of a key first rose and first fell."""
    up, down = F.col("exists") > 0, F.col("exists") < 0
    return changes.groupBy("key").agg(
        F.sum("exists").alias("existing"), F.sum("refers").alias("referring"), F.count(F.when(up, 1)).alias("came"),
        F.min(F.when(up, F.col("at"))).alias("arrived"), F.min(F.when(down, F.col("at"))).alias("deleted"),
    )


def merged(state: DataFrame, more: DataFrame) -> DataFrame:
    """The state that another one, as of new deltas, is added to; either may be empty."""
    return state.unionByName(more).groupBy("key").agg(
        F.sum("existing").alias("existing"), F.sum("referring").alias("referring"), F.sum("came").alias("came"), F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"),
    )


def orphans(state: DataFrame) -> DataFrame:
    """key, existing, referring of the current orphans of a state."""
    return state.filter("referring > 0 and existing <= 0").select("key", "existing", "referring")


def orphan_keys(records: DataFrame, references: DataFrame) -> DataFrame:
    return orphans(signed_counts(deltas(records, references)))


def orphan_references(records: DataFrame, references: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The references, with all their columns, whose key did not exist when they arrived, and their kind: missing, deleted or late.

    The ``heavy`` keys with the most references meet them by broadcast, so that no key gathers its references in one task; the others
    are joined by key.
    """
    state = signed_counts(deltas(records, references)).filter("referring > 0")
    state = state.select(F.col("key").alias("__k"), F.col("arrived").alias("__came"), F.col("deleted").alias("__went"), F.col("came").alias("__n"), F.col("referring").alias("__r"))
    top = state.orderBy(F.desc("__r"), "__k").limit(heavy)
    kind = F.when(F.col("__n") == 0, "missing").when(F.col("__went") < F.col("arrived"), "deleted").when(F.col("__came") > F.col("arrived"), "late")
    judged = lambda met: met.withColumn("__kind", kind).filter("__kind is not null").select(*references.columns, F.col("__kind").alias("kind"))
    known = references.filter("key is not null")
    often = known.join(F.broadcast(top), F.col("key") == F.col("__k"))
    seldom = known.join(F.broadcast(top.select("__k")), F.col("key") == F.col("__k"), "left_anti").join(state, F.col("key") == F.col("__k"))
    return judged(often).unionByName(judged(seldom))


def _speaker_deltas(people: list | None, labels: list | None) -> Iterator[tuple[str | int, int, int, int]]:
    """key, existence, reference and place of every change that a transcript makes: an entry exists under each of its forms, a label refers to its own."""
    for own in people or []:
        if own:
            for key in entry_keys(own["id"], own["display_name"]):
                yield key, 1, 0, -1
    for place, label in enumerate(labels or []):
        if label is not None and label.strip():
            for key in label_keys(label):
                yield key, 0, 1, place


def _loose_places(people: list | None, labels: list | None) -> list[int]:
    """The places whose label has references under some key and existence under none."""
    existing: dict[str | int, int] = {}
    places: dict[int, list[str | int]] = {}
    for key, exists, refers, place in _speaker_deltas(people, labels):
        existing[key] = existing.get(key, 0) + exists
        if refers:
            places.setdefault(place, []).append(key)
    return [place for place, keys in places.items() if all(existing[k] <= 0 for k in keys)]


def dangling_positions(table: DataFrame, key: str, arrived: str, entries: str = "speakers", items: str = "segments") -> DataFrame:
    """key, arrival and, of each row, the places in ``items`` whose speaker is not blank and stands for no entry of ``entries``. The deltas of a row are on
    keys of its own, so their signed counts need no shuffle."""
    kind = table.schema
    own = f"`{key}` {kind[key].dataType.simpleString()}, `{arrived}` {kind[arrived].dataType.simpleString()}, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_loose_places(people, labels) for people, labels in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.list_(pa.int32()))], names=[key, arrived, "places"])

    return table.select(key, arrived, entries, F.col(f"{items}.speaker").alias("labels")).mapInArrow(run, own)
