"""Streams: utterances with end points, sessions and running reports, each equal to its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UTTERANCE = "track string, from_ms long, to_ms long, n long, reason string"


def _close(track: str, s: tuple, reason: str) -> dict:
    return {"track": track, "from_ms": s[0], "to_ms": s[1], "n": s[2], "reason": reason}


def step(track: str, s: tuple | None, events: list[tuple[int, bool, bool]], silences: tuple[int, int], longest: int) -> tuple[tuple | None, list[dict]]:
    """The open utterance (from, to, n, spoken) after more events (time, spoken, finished), and those that ended: by a silence before the next event longer than
    the first of ``silences``, or than the second once anything was spoken; because they would last longer than ``longest``; or since the input is finished."""
    out = []
    for t, spoken, finished in events:
        if s is not None and t - s[1] > silences[s[3]]:
            out.append(_close(track, s, "silence"))
            s = None
        elif s is not None and t - s[0] > longest:
            out.append(_close(track, s, "length"))
            s = None
        if finished:
            if s is not None:
                out.append(_close(track, s, "finished"))
            s = None
        else:
            s = (t, t, 1, spoken) if s is None else (s[0], max(s[1], t), s[2] + 1, s[3] or spoken)
    return s, out


def _events(df: DataFrame, spoken: str | None, finished: str | None) -> DataFrame:
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c else F.lit(other)
    return df.select(F.col("track").cast("string").alias("track"), "ts", F.unix_millis("ts").alias("t"), flag(spoken, True).alias("spoken"), flag(finished, False).alias("finished"))


def utterances(stream: DataFrame, silences: tuple[int, int], longest: int, spoken: str | None = None, finished: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Utterances of a stream of track, ts (timestamp): each is emitted once it is certain, at the latest when the watermark passes the silence
    after it, or at a row that says the track is ``finished``. Rows of a track in one trigger are taken in time order, the finishing row last; what comes later than the
    watermark is dropped. ``spoken``: a column that says whether a row has decoded text; all have unless given."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = key[0]
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([_close(track, held, "silence")])
            return
        events = sorted((int(t), bool(f), bool(s)) for x in frames for t, s, f in zip(x["t"], x["spoken"], x["finished"]))
        held, out = step(track, held, [(t, s, f) for t, f, s in events], silences, longest)
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + silences[held[3]] + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out)

    rows = _events(stream.withWatermark("ts", watermark), spoken, finished)
    return rows.groupBy("track").applyInPandasWithState(update, UTTERANCE, "from_ms long, to_ms long, n long, spoken boolean", "append", GroupStateTimeout.EventTimeTimeout)


def utterances_of(batch: DataFrame, silences: tuple[int, int], longest: int, spoken: str | None = None) -> DataFrame:
    """The same over a table, at whose end every track is finished; the rows of a track stream by in time order."""
    import pyarrow as pa

    schema = pa.schema([("track", pa.string()), ("from_ms", pa.int64()), ("to_ms", pa.int64()), ("n", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            out: list[dict] = []
            for track, t, s in zip(*(c.to_pylist() for c in b.columns)):
                if track != at:
                    if held is not None:
                        out.append(_close(at, held, "finished"))
                    at, held = track, None
                held, more = step(track, held, [(t, s, False)], silences, longest)
                out += more
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([_close(at, held, "finished")], schema=schema)

    rows = _events(batch, spoken, None).filter("track is not null and t is not null").select("track", "t", "spoken")
    return rows.repartition("track").sortWithinPartitions("track", "t", "spoken").mapInArrow(run, UTTERANCE)


def sessions(df: DataFrame, gap: str) -> DataFrame:
    """track, from, to, n of each session, for a stream (with a watermark on ts) or a table alike."""
    s = df.groupBy("track", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("track", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def report(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total, top: the running report; the same expression serves a stream in complete mode and a table."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 1000).cast("long")).alias("total"), F.max(value).alias("top"))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is available now of a stream, through files in ``folder``, as a table."""
    spark = stream.sparkSession
    out, marks = f"{folder}/out", f"{folder}/marks"
    if mode == "complete":
        put = lambda df, _: df.write.mode("overwrite").parquet(out)
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
