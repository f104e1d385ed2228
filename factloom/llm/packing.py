"""Filling containers of fixed capacity with texts: best-fit planned over a length histogram.

Lengths are tokens of a public tokenizer. A text longer than a container is cut into full pieces and a rest; all other
texts stay whole. The plan is made on counts per length, of which there are at most as many as the capacity has tokens,
whatever the number of texts: best-fit decreasing, where all items of one length that meet bins with one free space are
placed in one step. A plan row says: items of this length with ranks from a to b go, m to a bin, into the bins from s on,
at this offset. Texts then take their planned slots by their rank within their length.

Ranks need no sort of one length in one task: items are counted per (length, block), blocks of hashed pieces are
offset against each other by a window over the counts, and only blocks are numbered. The plan is broadcast; its size is
bounded by the capacity.

Defined results: null and empty texts have no tokens and come without a container (container_id null); repeated rows are
items of their own; ties within a length go by block and document id; empty tables and no capacities give no rows;
capacities below one are refused.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spans import map_rows
from factloom.llm.tokens import DEFAULT_VOCAB, encoding
from factloom.session import cut

#: length, first rank, items, first bin, items a bin, offset of the first item in a bin
Plan = list[tuple[int, int, int, int, int, int]]


def plan(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """Best-fit decreasing over counts: the plan rows and the number of bins."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs of bins (first, how many)
    levels: list[int] = []  # the free spaces there are, ascending
    out: Plan = []
    bins = 0

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in free:
                levels.insert(_at(levels, space), space)
            free[space].append((first, n))

    for length in sorted((x for x in histogram if 0 < x <= capacity), reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            i = _at(levels, length)
            if i < len(levels):
                space = levels[i]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    levels.pop(i)
            else:
                space, first, n = capacity, bins, math.ceil(left / (capacity // length))
                bins += n
            m = space // length
            full, rest = min(n, left // m), 0
            if full < n and left - full * m:
                rest = left - full * m
            take = full * m + rest
            if full:
                out.append((length, rank, full * m, first, m, capacity - space))
                put(space - m * length, first, full)
            if rest:
                out.append((length, rank + full * m, rest, first + full, rest, capacity - space))
                put(space - rest * length, first + full, 1)
            used = full + (1 if rest else 0)
            put(space, first + used, n - used)
            left -= take
            rank += take
    return out, bins


def _at(levels: list[int], x: int) -> int:
    from bisect import bisect_left

    return bisect_left(levels, x)


def lengths(documents: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts."""

    def rows(d, t):
        return [(d, len(encoding(vocab).encode_ordinary(t)) if t else 0)]

    return map_rows(documents.select("doc_id", "text"), "doc_id long, n_tokens int", rows)


def pack(documents: DataFrame, sizes: DataFrame, vocab: str = DEFAULT_VOCAB, rows_per_block: int = 250_000) -> DataFrame:
    """One row per piece: pack_id, capacity_tokens, container_id, slot_offset, doc_id, piece_no, token_start, token_count."""
    spark = documents.sparkSession
    caps = sorted((r.pack_id, r.capacity_tokens) for r in sizes.select("pack_id", "capacity_tokens").where("capacity_tokens is not null").distinct().collect())  # a handful
    if any(c < 1 for _, c in caps):
        raise ValueError("capacity must be at least 1")
    counted = cut(lengths(documents, vocab))
    stated = F.array(*(F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity_tokens")) for p, c in caps)) if caps else F.array().cast("array<struct<pack_id:int,capacity_tokens:int>>")
    cap = F.col("capacity_tokens")
    # identical rows of one id differ by nothing, so any order between them gives the same result; one oversized text may have most pieces
    most = counted.select(*(F.sum(F.ceil(F.greatest("n_tokens", F.lit(1)) / c)).alias(f"n{i}") for i, (_, c) in enumerate(caps))).first() if caps else ()
    blocks = max(1, *(math.ceil((n or 0) / rows_per_block) for n in most)) if caps else 1
    pieces = F.when(F.col("n_tokens") <= cap, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / cap).cast("int")))
    items = (
        counted.withColumn("size", F.explode(stated))  # each text once per stated capacity
        .select("doc_id", "n_tokens", "size.*")
        .withColumn("piece_no", F.explode(pieces))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).cast("int"))
        .withColumn("token_start", F.col("piece_no") * cap)
        .withColumn("length", F.least(F.col("n_tokens") - F.col("token_start"), cap))
    )
    per_block = items.where("length > 0").groupBy("pack_id", "length", "block").agg(F.count("*").alias("n"))
    offsets = cut(per_block.withColumn("before", F.sum("n").over(Window.partitionBy("pack_id", "length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]))
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in offsets.groupBy("pack_id", "length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most capacity rows each
        histogram[r.pack_id][r.length] = r["n"]
    by_pack = {p: _lookup(plan(histogram.get(p, {}), c)[0]) for p, c in caps}
    held = spark.sparkContext.broadcast(by_pack)

    @F.pandas_udf("container_id long, slot_offset int")
    def slot(pack_id: pd.Series, length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        import numpy as np

        bins, at = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for p in pack_id.unique():
            mine = (pack_id == p).to_numpy()
            starts, cols = held.value[int(p)]
            ln, rk = length[mine].to_numpy().astype(np.int64), rank[mine].to_numpy()
            i = np.searchsorted(starts, (ln << 44) + rk, side="right") - 1
            inside = rk - cols[1][i]
            bins[mine] = cols[3][i] + inside // cols[4][i]
            at[mine] = cols[5][i] + (inside % cols[4][i]) * ln
        return pd.DataFrame({"container_id": bins, "slot_offset": at.astype("int32")})

    within = Window.partitionBy("pack_id", "length", "block").orderBy("doc_id", "piece_no")
    placed = (
        items.where("length > 0")
        .withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets.select("pack_id", "length", "block", "before"), ["pack_id", "length", "block"])
        .withColumn("s", slot("pack_id", "length", F.col("rank") + F.col("before")))
    )
    cols = ["pack_id", "capacity_tokens", "container_id", "slot_offset", "doc_id", "piece_no", "token_start", "token_count"]
    full = placed.select("pack_id", "capacity_tokens", "s.container_id", "s.slot_offset", "doc_id", "piece_no", "token_start", F.col("length").alias("token_count"))
    empty = items.where("length = 0").select(
        "pack_id", "capacity_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("slot_offset"), "doc_id", "piece_no", "token_start", F.col("length").alias("token_count"))
    return full.unionByName(empty).select(*cols)


def _lookup(rows: Plan):
    import numpy as np

    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return (a[:, 0] << 44) + a[:, 1], a.T


def report(packed: DataFrame) -> DataFrame:
    """Per capacity: pieces, tokens, containers, the least number there could be, and the part of the space filled."""
    used = packed.where("container_id is not null").groupBy("pack_id", "capacity_tokens", "container_id").agg(F.sum("token_count").alias("t"), F.count("*").alias("n"))
    return used.groupBy("pack_id", "capacity_tokens").agg(
        F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.count("*").alias("containers"),
        F.ceil(F.sum("t") / F.first("capacity_tokens")).alias("lower_bound"), F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled"))
