"""Filling fixed-capacity containers with items (problem 8): hierarchical multi-length packing.

Documents, measured in tokens of a public tokenizer, are routed to the smallest context tier that holds them. Each
tier is packed by best fit, longest first; gaps of long windows are then filled from shorter tiers. Containers of a
tier are finally dealt into step groups of equal work. A document is split only if it exceeds the largest tier.

Packing needs only ids and lengths. They are spread by a hash over shards of bounded size, each packed by one
task, so no task sees all documents; a shard wastes at most a few containers.

Null and empty texts have no tokens and go into no container; equal texts are packed on their own; an empty table
gives no rows. Ties between lengths go by id. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (512, 2048, 8192)
SHARD = 50_000
GROUP = 8

_ENCODERS: dict[str, object] = {}


#: How texts are cut before byte pairs are merged, as published with byte-level byte-pair encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> object:
    """The byte-pair encoder of a ranks file, built once per process."""
    if path not in _ENCODERS:
        import tiktoken

        lines = open(path, "rb").read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, id_col: str, text: str, tokenizer: str) -> DataFrame:
    """(id, n_tokens) of all documents with at least one token, whole texts counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(count, "id bigint, n_tokens bigint").where("n_tokens > 0")


class BestFit:
    """Open containers of one capacity by free space; the fullest that still fits is found by bit search."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free, self.by_free, self.mask = capacity, [], [], {}, 0

    def place(self, size: int) -> int | None:
        """The container for ``size``, or None where no open one has room."""
        fits = self.mask >> size
        if not fits:
            return None
        free = size + (fits & -fits).bit_length() - 1
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self._keep(at, free - size)
        return at

    def open(self, size: int) -> int:
        self.bins.append([])
        self.free.append(0)
        self._keep(len(self.bins) - 1, self.capacity - size)
        return len(self.bins) - 1

    def _keep(self, at: int, free: int) -> None:
        self.free[at] = free
        if free:
            self.by_free.setdefault(free, []).append(at)
            self.mask |= 1 << free


def pack(items: list[tuple[int, int]], tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> list[tuple[int, int, int, int, int, int, int]]:
    """(id, piece, n, tier, container, offset, step_group) for items (id, tokens).

    A container number is unique within its tier. Offsets are tokens from the container's start."""
    tiers = tuple(sorted(tiers))
    top = tiers[-1]
    pieces: list[tuple[int, int, int]] = []
    for i, n in items:
        whole, rest = divmod(n, top)
        pieces += [(top, i, k) for k in range(whole)]
        if rest:
            pieces.append((rest, i, whole))
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for p in pieces:
        routed[next(t for t in tiers if p[0] <= t)].append(p)
    out = []
    for t in reversed(tiers):
        bins = BestFit(t)
        for p in sorted(routed[t], key=lambda x: (-x[0], x[1], x[2])):
            at = bins.place(p[0])
            bins.bins[bins.open(p[0]) if at is None else at].append(p)
        for shorter in [s for s in reversed(tiers) if s < t]:
            left = []
            for p in sorted(routed[shorter], key=lambda x: (-x[0], x[1], x[2])):
                at = bins.place(p[0])
                if at is None:
                    left.append(p)
                else:
                    bins.bins[at].append(p)
            routed[shorter] = left
        groups = step_groups([sum(n * n for n, _, _ in b) for b in bins.bins], group)
        for c, b in enumerate(bins.bins):
            offset = 0
            for n, i, k in b:
                out.append((i, k, n, t, c, offset, groups[c]))
                offset += n
    return out


def step_groups(work: list[int], size: int) -> list[int]:
    """Containers dealt into groups of at most ``size`` with nearly equal attention work, the heaviest first to the lightest group."""
    n = -(-len(work) // size)
    heap = [(0, g, 0) for g in range(n)]
    out = [0] * len(work)
    for c in sorted(range(len(work)), key=lambda c: (-work[c], c)):
        load, g, count = heapq.heappop(heap)
        out[c] = g
        if count + 1 < size:
            heapq.heappush(heap, (load + work[c], g, count + 1))
    return out


_PACKED = "doc_id bigint, piece int, n_tokens int, tier int, container_id string, token_off int, step_group string"


def containers(counts: DataFrame, tiers: tuple[int, ...] = TIERS, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """The container of each document or piece: (doc_id, piece, n_tokens, tier, container_id, token_off, step_group)."""
    parts = max(1, -(-counts.count() // shard))

    def pack_shard(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pack(list(zip(pdf["id"].tolist(), pdf["n_tokens"].tolist())), tiers, group)
        return pd.DataFrame(
            [(i, k, n, t, f"{key[0]}-{t}-{c}", off, f"{key[0]}-{t}-{g}") for i, k, n, t, c, off, g in rows],
            columns=["doc_id", "piece", "n_tokens", "tier", "container_id", "token_off", "step_group"],
        )

    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(pack_shard, _PACKED)
