"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over the byte positions of a piece holds, for the
pair that starts at each live position, rank * 2^32 + position; its root is the leftmost pair of least rank. A merge sets
three leaves (the pair itself, its dead right neighbour, the pair before it) and repairs their ancestors, so it costs
O(log n). Short pieces of a batch are merged side by side, one tree per array column; long pieces get a tree of their own.
Finished pieces are kept in a bounded per-task table, which saves work and never changes results.

Cases: null text is the empty text (0 tokens, digests of no bytes); ties of rank go to the leftmost pair; repeated rows
give repeated rows; an empty table gives an empty table; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import chunks, table, tidy

INF = np.int64(1) << 62
LOW = np.int64((1 << 32) - 1)
#: Pieces of at most so many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Pieces a task remembers.
REMEMBERED = 300_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """Ranks (bytes to rank, which is the id) and a split pattern; encode() as the ordinary-text encoder of those ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.base = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.base
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, INF for pairs that don't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], INF)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of pieces of at most SIDE_BY_SIDE bytes each, all of one power-of-two size class."""
        n, width = len(pieces), max(map(len, pieces))
        leaves = 1 << max(0, (width - 1).bit_length())
        lens = np.fromiter(map(len, pieces), np.int64, n)
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tok = np.ascontiguousarray(self.byte[grid].T)  # position x piece
        nxt = np.repeat(np.arange(1, width + 1, dtype=np.int64)[:, None], n, 1)
        prv = nxt - 2
        tree = np.full((2 * leaves, n), INF, np.int64)
        for p in range(width - 1):
            r = self.rank(tok[p], tok[p + 1])
            tree[leaves + p] = np.where((p + 1 < lens) & (r < INF), (r << 32) + p, INF)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        cols = np.arange(n)
        alive = np.arange(width)[:, None] < lens
        while True:
            root = tree[1, cols]
            keep = root < INF
            if not keep.all():
                cols, root = cols[keep], root[keep]
            if not len(cols):
                break
            pos = root & LOW
            tok[pos, cols] = root >> 32
            dead = nxt[pos, cols]
            after = nxt[dead, cols]
            nxt[pos, cols] = after
            alive[dead, cols] = False
            inside = after < lens[cols]
            prv[after[inside], cols[inside]] = pos[inside]
            before = prv[pos, cols]
            first = before < 0
            here = tok[pos, cols]
            r = np.where(inside, self.rank(here, tok[np.minimum(after, width - 1), cols]), INF)
            at = np.maximum(before, 0)
            q = np.where(first, INF, self.rank(tok[at, cols], here))
            tree[leaves + dead, cols] = INF
            tree[leaves + pos, cols] = np.where(r < INF, (r << 32) + pos, INF)
            has = ~first
            tree[leaves + at[has], cols[has]] = np.where(q < INF, (q << 32) + at, INF)[has]
            up = (leaves + dead, leaves + pos, leaves + at)
            while up[0][0] > 1:
                up = tuple(u >> 1 for u in up)
                for u in up:
                    tree[u, cols] = np.minimum(tree[2 * u, cols], tree[2 * u + 1, cols])
        flat = tok.T[alive.T].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(0)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, base, pairs = len(piece), self.base, self.pairs
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << max(0, (n - 1).bit_length())
        none = int(INF)
        tree = [none] * (2 * leaves)

        def leaf(p: int) -> int:
            r = pairs.get(tok[p] * base + tok[nxt[p]]) if nxt[p] < n else None
            return none if r is None else (r << 32) + p

        for p in range(n - 1):
            tree[leaves + p] = leaf(p)
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(p: int, value: int) -> None:
            node = leaves + p
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            pos, tok_id = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            dead = nxt[pos]
            tok[pos], tok[dead], nxt[pos] = tok_id, -1, nxt[dead]
            if nxt[dead] < n:
                prv[nxt[dead]] = pos
            put(dead, none)
            put(pos, leaf(pos))
            if prv[pos] >= 0:
                put(prv[pos], leaf(prv[pos]))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Puts the ids of pieces into the table."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) > SIDE_BY_SIDE:
                self.known[piece] = self.merge_one(raw)
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in classes.values():
            for i in range(0, len(group), 10_000):
                part = group[i : i + 10_000]
                self.known.update(zip([p for p, _ in part], self.merge_many([r for _, r in part]), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers, in order."""
        for start, end in chunks(texts, 1_000_000):
            split = [self.split(t) for t in texts[start:end]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(list(set().union(*split).difference(self.known)))
            get = self.known.__getitem__
            for pieces in split:
                yield b"".join(map(get, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBPE:
    """Once for each worker. path: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.known.clear()
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of rows doc_id, ids (array of int); null ids are no ids."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: token count, digest of its ids, digest of the bytes decoded from those ids."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b = [], [], []
            for ids in bpe.encode_batch(texts):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.known.clear()
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
