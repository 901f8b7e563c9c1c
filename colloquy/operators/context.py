"""Visible text from several sources: candidates in order, duplicates and conflicts, reading order, budgets and latency reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import normalize_text
from colloquy.operators.joins import overlapping_boxes
from colloquy.operators.scan import running
from colloquy.operators.walks import walk


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def first_accepted(blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """capture, seq, into: the block that each block is a duplicate of, itself where none. Blocks of one capture and normalized text are walked by
    priority and seq; one goes into the first accepted block whose bounds fit: both missing, or overlapping by ``least``. Memory is the
    accepted blocks of one text of one capture. blocks: capture, seq, priority, text, x, y, width, height (null bounds are missing)."""

    def step(accepted: list, row: tuple) -> list[tuple]:
        seq, box = row[0], None if row[1] is None else tuple(row[1:])
        for other, where in accepted:
            if where is None and box is None or where is not None and box is not None and _iou(where, box) >= least:
                return [(seq, other)]
        accepted.append((seq, box))
        return [(seq, seq)]

    keyed = blocks.withColumn("key", normalize_text(F.col("text"))).filter("key <> ''")
    arrow = pa.schema([("capture", pa.int64()), ("key", pa.string()), ("seq", pa.int64()), ("into", pa.int64())])
    boxes = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    rows = keyed.select(F.col("capture").cast("long"), "key", F.col("seq").cast("long"), "priority", *boxes)
    return walk(rows, ["capture", "key"], [F.col("priority"), F.col("seq")], ["seq", "x", "y", "width", "height"], "capture long, key string, seq long, into long", arrow, list, step).drop("key")


def fuse(blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """capture, seq, place, n_refs, duplicate, conflict of each accepted block: how many blocks went into it, and the group of blocks with other
    text that it overlaps (named by its least member)."""
    into = first_accepted(blocks, least)
    refs = into.groupBy("capture", F.col("into").alias("seq")).agg(F.count("*").alias("n_refs"))
    kept = refs.join(blocks.withColumns({"capture": F.col("capture").cast("long"), "seq": F.col("seq").cast("long")}), ["capture", "seq"])
    kept = kept.withColumn("box", F.when(F.col("x").isNotNull(), F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])))
    place = F.row_number().over(Window.partitionBy("capture").orderBy("priority", "seq")) - 1
    kept = kept.select("capture", "seq", place.alias("place"), "n_refs", "text", "box")
    pairs = overlapping_boxes(kept, "capture", "seq", "box", least)
    texts = kept.select("capture", "seq", normalize_text(F.col("text")).alias("t"))
    pairs = pairs.join(texts.select("capture", F.col("seq").alias("left"), F.col("t").alias("lt")), ["capture", "left"]).join(texts.select("capture", F.col("seq").alias("right"), F.col("t").alias("rt")), ["capture", "right"]).filter("lt <> rt")
    marked = pairs.select("capture", F.explode(F.array("left", "right")).alias("seq"), F.least("left", "right").alias("g")).groupBy("capture", "seq").agg(F.min("g").alias("conflict"))
    return kept.join(marked, ["capture", "seq"], "left").select("capture", "seq", "place", "n_refs", (F.col("n_refs") > 1).alias("duplicate"), "conflict")


def reading_order(boxes: DataFrame) -> DataFrame:
    """page, text: boxes by falling middle then x; a box joins the line before it within 0.6 of the larger height (0.012 at least) of the line's
    running middle; lines are read by x. Memory is one page's text. boxes: page, x, y, h, text."""

    def step(state: dict, row: tuple) -> list[tuple]:
        x, y, h, text = row
        mid, lines = y + h / 2, state.setdefault("lines", [])
        if lines and abs(lines[-1][0] - mid) <= max(max(lines[-1][1], h) * 0.6, 0.012):
            line = lines[-1]
            n = len(line[2])
            line[0], line[1] = (line[0] * n + mid) / (n + 1), max(line[1], h)
            line[2].append((x, len(line[2]), text.strip()))
        else:
            lines.append([mid, h, [(x, 0, text.strip())]])
        return []

    def end(state: dict) -> list[tuple]:
        return [("\n".join(t for line in state["lines"] for _, _, t in sorted(line[2])),)] if state.get("lines") else []

    rows = boxes.filter(F.trim("text") != "").select(F.col("page").cast("long"), *[F.col(c).cast("double").alias(c) for c in "xyh"], "text")
    arrow = pa.schema([("page", pa.int64()), ("text", pa.string())])
    return walk(rows, ["page"], [F.desc(F.col("y") + F.col("h") / 2), F.col("x")], ["x", "y", "h", "text"], "page long, text string", arrow, dict, step, end)


def within_budget(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """key, order, kept, left: in order, a payload larger than what is left of the budget is rejected whole; smaller ones may still fit."""

    def step(state: list, row: tuple) -> list[tuple]:
        at, n = row
        kept = n <= state[0]
        state[0] -= n if kept else 0
        return [(at, kept, state[0])]

    arrow = pa.schema([(key, pa.int64()), (order, pa.int64()), ("kept", pa.bool_()), ("left", pa.int64())])
    rows = df.select(F.col(key).cast("long"), F.col(order).cast("long"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    return walk(rows, [key], [F.col(order)], [order, "size"], f"`{key}` long, `{order}` long, kept boolean, left long", arrow, lambda: [budget], step)


def nearest_rank(df: DataFrame, key: str, value: str, percents: list[int], bucket: float) -> DataFrame:
    """key, n, top, and for each percent p the value of rank ceil(n * p / 100). Values are counted first; ranks run over ranges of values of the
    width ``bucket``, so that a key with most of the rows is many tasks and no list of its values is held."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    sized = counts.groupBy(key).agg(F.sum("c").alias("n"), F.max(value).alias("top"))
    ranked = running(counts, [key], value, [value], {"rank": ("sum", F.col("c"))}, inclusive=True, bucket=bucket).join(sized, key)
    hit = [F.min(F.when(F.col("rank") >= F.ceil(F.col("n") * p / F.lit(100)), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(key).agg(F.first("n").alias("n"), F.first("top").alias("top"), *hit)


def state_histogram(df: DataFrame, source: str, state: str, late: str, going_on: list[str]) -> DataFrame:
    """key (``source.state`` in lower case), n, n_terminal (samples whose state is not one of ``going_on``), n_late (terminal ones that came late)."""
    ended = ~F.col(state).isin(going_on)
    return df.groupBy(F.lower(F.concat_ws(".", source, state)).alias("key")).agg(F.count("*").alias("n"), F.count(F.when(ended, 1)).alias("n_terminal"), F.count(F.when(ended & F.col(late), 1)).alias("n_late"))


def budgeted_preorder(df: DataFrame, key: str, order: str, text: str, nodes: int, chars: int, depth: str | None = None, deepest: int | None = None) -> DataFrame:
    """key, order, taken: the first ``nodes`` nodes of a tree in pre-order, each with the characters that the budget has left for it. Nodes below
    ``deepest`` (``depth``: how deep each lies) are not visited and take nothing."""
    if depth is not None:
        df = df.filter(F.col(depth) <= deepest)
    w = Window.partitionBy(key).orderBy(order)
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.select(key, order, F.row_number().over(w).alias("k"), F.least(n, F.greatest(F.lit(chars) - before, F.lit(0))).alias("taken")).filter(F.col("k") <= nodes).drop("k")


def global_box(box: Column, image: Column) -> Column:
    """A box given as parts of an image, y upwards, in the image's coordinates, y downwards."""
    return F.struct(
        (image["x"] + box["x"] * image["width"]).alias("x"), (image["y"] + (F.lit(1.0) - box["y"] - box["height"]) * image["height"]).alias("y"),
        (box["width"] * image["width"]).alias("width"), (box["height"] * image["height"]).alias("height"),
    )


def closure(requests: DataFrame, edges: dict[str, list[str]]) -> DataFrame:
    """id, kinds: each requested set of kinds with all that they depend on. The graph is a few fixed kinds, so every kind's closure is found here."""
    whole: dict[str, set[str]] = {}

    def reach(kind: str) -> set[str]:
        if kind not in whole:
            whole[kind] = {kind}
            for d in edges.get(kind, []):
                whole[kind] |= reach(d)
        return whole[kind]

    for k in edges:
        reach(k)
    lookup = F.create_map(*[x for k, v in whole.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    every = F.flatten(F.transform("kinds", lambda k: F.coalesce(F.try_element_at(lookup, k), F.array(k))))
    return requests.select("id", F.array_sort(F.array_distinct(every)).alias("kinds"))
