"""Items of varying length in containers of fixed capacity, with little space left.

Hierarchical residual packing. Each partition packs its own items best-fit in decreasing order and emits its bins.
Nearly full bins are final. The underfull ones meet as items in a tree of nodes, a few nodes to a parent, for further
best-fit rounds. After best-fit no two bins of a node fit together, so at most one of them is at most half full:
only that one can still move into another bin, and a parent needs, of every fill, no more receivers than it has
children. What climbs the tree is therefore bounded by the number of partitions, never by the number of items.

Defined results: null, empty and blank texts of no token are items of size 0 and lie in the container "0" of their own;
an item over the capacity is cut into pieces of the capacity and a rest, no other item is cut; repeated keys are
packed as often as they stand; a null key is kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.cluster import cut
from notaflux.llm.encoding import DEFAULT_TOKENIZER, TOKENIZER_DIR, encoder, few_rows

PLACED = "key bigint, piece int, pieces int, size int, bin string, fill int, node int"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(bin of each item, fill of each bin): largest first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the distinct rooms of open bins, sorted: at most ``capacity`` of them
    for i in order:
        s = int(sizes[i])
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            own = open_by_room[room]
            b = heapq.heappop(own)
            if not own:
                del open_by_room[room]
                rooms.pop(at)
            fills[b] += s
        else:
            b = len(fills)
            fills.append(s)
        where[i] = b
        left = capacity - fills[b]
        if left > 0:
            if left not in open_by_room:
                open_by_room[left] = []
                insort(rooms, left)
            heapq.heappush(open_by_room[left], b)
    return where, fills


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, tokens) of each text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory, name)._core_bpe.encode_ordinary
        for b in few_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int32())], names=["key", "tokens"])

    return texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).mapInArrow(count, "key bigint, tokens int")


def _meeting(capacity: int, limit: int):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Small bins into the fullest bins that take them; what can still meet others goes on, moves come out."""
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True]).reset_index(drop=True)
        fill, name, moves = pdf.fill.to_numpy().copy(), pdf.bin.to_numpy(), []
        alive = np.ones(len(pdf), bool)
        for i in np.nonzero(fill * 2 <= capacity)[0][::-1]:
            room = np.nonzero(alive & (fill + fill[i] <= capacity) & (np.arange(len(fill)) != i))[0]
            if len(room):
                to = room[np.argmax(fill[room])]
                fill[to] += fill[i]
                alive[i] = False
                moves.append((name[i], name[to]))
        node = int(pdf.node.iloc[0])
        out = pd.DataFrame({"bin": name, "fill": fill, "node": node, "into": ""})[alive]
        out = out.groupby("fill", sort=False).head(limit)  # of one fill no more can receive than nodes are left
        return pd.concat([out, pd.DataFrame({"bin": [a for a, _ in moves], "fill": 0, "node": node, "into": [b for _, b in moves]})])[["bin", "fill", "node", "into"]]

    return meet


def pack(sizes: DataFrame, capacity: int = 4096, full: float = 0.995, fan_in: int = 8, key: str = "key", size: str = "tokens") -> DataFrame:
    """(key, piece, pieces, size, bin, fill): the container of every piece, and what the container holds in all.

    ``full``: share of the capacity from which a bin is final without meeting others; ``fan_in``: children of a node.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        got = list(batches)
        if not got:
            return
        items = pd.concat(got)
        n = items["size"].fillna(0).to_numpy(np.int64)
        k = items["key"].to_numpy()
        order = np.argsort(k, kind="stable")  # the same bins whatever the order of arrival
        n, k = n[order], k[order]
        pieces = np.maximum(1, -(-n // capacity))
        key_of, piece = np.repeat(k, pieces), np.concatenate([np.arange(p) for p in pieces]) if len(pieces) else np.zeros(0, int)
        of = np.repeat(n, pieces)
        piece_size = np.minimum(capacity, of - piece * capacity)
        where, fills = best_fit(piece_size, capacity)
        fill = np.array(fills, np.int64)[where]
        label = np.array([f"{node}-{i}" for i in range(len(fills))], object)[where] if len(fills) else np.zeros(0, object)
        yield pd.DataFrame({"key": key_of, "piece": piece, "pieces": np.repeat(pieces, pieces), "size": piece_size, "bin": np.where(piece_size == 0, "0", label), "fill": np.where(piece_size == 0, 0, fill), "node": node})

    no_key = F.lit(-(2**63)).cast("bigint")  # nulls would turn a column of integers into one of floats on the way
    placed = cut(sizes.select(F.coalesce(F.col(key).cast("bigint"), no_key).alias("key"), F.col(size).cast("bigint").alias("size")).mapInPandas(local, PLACED))
    nodes = (placed.agg(F.max("node")).first()[0] or 0) + 1  # one number
    bins = placed.where(f"fill > 0 and fill < {int(capacity * full)}").groupBy("bin").agg(F.first("fill").alias("fill"), F.first("node").alias("node")).select("bin", "fill", "node", F.lit("").alias("into"))
    moved: DataFrame | None = None
    width = nodes
    while width > 1:
        level = cut(bins.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("node").applyInPandas(
            _meeting(capacity, width), "bin string, fill int, node int, into string"))
        gone = level.where("into <> ''").select("bin", "into")
        moved = gone if moved is None else moved.unionByName(gone)
        bins = level.where("into = ''")
        width = -(-width // fan_in)
    if moved is not None:
        for _ in range(max(1, int(np.ceil(np.log(max(nodes, 2)) / np.log(fan_in))))):  # a bin may move once a level
            step = moved.select(F.col("bin").alias("into"), F.col("into").alias("further"))
            moved = moved.join(step, "into", "left").select("bin", F.coalesce("further", "into").alias("into"))
        placed = placed.join(moved, "bin", "left").withColumn("bin", F.coalesce("into", "bin")).drop("into")
    # what takes no room lies in one container, however many they are, and needs no sum
    empty, filled = placed.where("size = 0"), placed.where("size > 0").drop("fill", "node")
    total = filled.groupBy("bin").agg(F.sum("size").cast("int").alias("fill"))
    columns = [F.nullif(F.col("key"), no_key).alias("key"), "piece", "pieces", "size", "bin", "fill"]
    return filled.join(total, "bin").select(*columns).unionByName(empty.select(*columns))
