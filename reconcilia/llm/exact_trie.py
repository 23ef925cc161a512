"""Exact deduplication: compressed radix (Patricia) tries whose terminal nodes name a text's owner.

Texts are dealt to partitions by length and content hash. Within a partition the full byte strings
are inserted into a compressed trie; equal texts end in the same terminal node, which keeps the
owner's id and the number of rows. Equality is therefore decided byte by byte; the hash only deals.

Before the shuffle each task runs a trie over its own rows, so a text with billions of copies sends
one record a task. A trie counts its edges and nodes. Over its limit it spills its heaviest subtrees below the
prefix that all of its texts share, until it holds half, to unnamed temporary files of the task; a spilled subtree
is later built anew by a trie with the same limit, at any depth.

Nulls count as empty text. Rows with a null id belong to a group but never own it while another row
has an id. Repeated ids are separate rows. Of ties, as equal ids are, either owns the group. Texts of any length are
compared whole. An empty table gives an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import attach, saved

#: Bytes that a task's trie holds before it spills (or, before the shuffle, empties): edges, and so much for each node.
TRIE_BYTES, NODE_BYTES = 96 << 20, 240


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by comparing halves."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("children", "edge", "owner", "rows")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.children, self.owner, self.rows = edge, None, None, 0

    def below(self) -> dict[int, Node]:
        if self.children is None:
            self.children = {}
        return self.children


class Patricia:
    """Byte strings with an owner and a row count each; ``better(a, b)`` chooses between two ids."""

    def __init__(self, better, limit: int | None = TRIE_BYTES) -> None:
        self.better, self.limit, self.size = better, limit, 0
        self.root, self.spilled = Node(b""), {}

    def add(self, text: bytes, owner: int | None, rows: int = 1) -> None:
        node, rest, fresh = self.root, text, 0
        while rest:
            child = node.below().get(rest[0])
            if child is None:
                child = node.children[rest[0]] = Node(rest)
                fresh, rest = fresh + len(rest) + NODE_BYTES, b""
            elif rest.startswith(child.edge):
                rest = rest[len(child.edge):]
            else:
                k = shared_prefix(rest, child.edge)
                fork = node.children[rest[0]] = Node(child.edge[:k])
                child.edge = child.edge[k:]
                fork.below()[child.edge[0]] = child
                child, rest, fresh = fork, rest[k:], fresh + NODE_BYTES
            node = child
        node.owner = owner if not node.rows or node.owner is None else node.owner if owner is None else self.better(node.owner, owner)
        node.rows += rows
        self.size += fresh
        if fresh and self.limit and self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        """The heaviest subtrees go, until half of the limit is held; what is one text alone stays."""
        node, prefix = self.root, b""
        while not node.rows and node.children and len(node.children) == 1:
            (node,) = node.children.values()
            prefix += node.edge
        held = {first: sum(len(n.edge) + NODE_BYTES for n, _ in self._nodes(child, b"")) for first, child in (node.children or {}).items()}
        for first in sorted(held, key=held.get, reverse=True):
            if self.size <= self.limit // 2:
                break
            out = self._file(prefix + bytes([first]))
            for item in self._walk(node.children.pop(first), prefix):
                pickle.dump(item, out)
            self.size -= held[first]

    def _file(self, prefix: bytes):
        """The file of a spilled prefix: that of a shorter one if there is one."""
        for k in sorted({len(p) for p in self.spilled}):
            if k < len(prefix) and prefix[:k] in self.spilled:
                return self.spilled[prefix[:k]]
        if prefix not in self.spilled:
            self.spilled[prefix] = tempfile.TemporaryFile()
        return self.spilled[prefix]

    @staticmethod
    def _nodes(top: Node, before: bytes) -> Iterator[tuple[Node, bytes]]:
        stack = [(top, before)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.edge
            yield node, text
            stack += [(c, text) for c in (node.children or {}).values()]

    @classmethod
    def _walk(cls, top: Node, before: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        return ((text, node.owner, node.rows) for node, text in cls._nodes(top, before) if node.rows)

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every distinct text with its owner and rows; spilled subtrees one after the other. The trie is empty afterwards."""
        lengths = sorted({len(p) for p in self.spilled})
        for item in self._walk(self.root, b""):
            top = next((item[0][:k] for k in lengths if item[0][:k] in self.spilled), None)
            if top is None:
                yield item
            else:
                pickle.dump(item, self.spilled[top])
        self.root, self.size = Node(b""), 0
        for top in sorted(self.spilled):  # a prefix comes before those that it starts
            if top not in self.spilled:
                continue
            part = Patricia(self.better, self.limit)
            for prefix in [p for p in self.spilled if p.startswith(top)]:
                with self.spilled.pop(prefix) as file:
                    file.seek(0)
                    while True:
                        try:
                            text, owner, rows = pickle.load(file)
                        except EOFError:
                            break
                        part.add(text[len(top):], owner, rows)
            for text, owner, rows in part.items():
                yield top + text, owner, rows


SENT = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
OWNED = pa.schema([f for f in SENT if f.name != "body"])
SENT_DDL = "n_bytes long, sha string, body binary, keep_id long, group_size long"
OWNED_DDL = "n_bytes long, sha string, keep_id long, group_size long"


def _emit(trie: Patricia, shas: dict[bytes, str] | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import hashlib

    rows, held = [], 0
    for text, owner, n in trie.items():
        rows.append((len(text), hashlib.sha256(text).hexdigest(), text, owner, n))
        held += len(text)
        if len(rows) >= 5000 or held > 8 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(SENT.names, r, strict=True)) for r in rows], schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(SENT.names, r, strict=True)) for r in rows], schema)


def _gather(better, limit: int):
    """Before the shuffle: the distinct texts of a task's own rows, at most ``limit`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(better, None)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.add(body.as_py(), doc)
                if trie.size > limit:
                    yield from _emit(trie, None, SENT)
                    trie = Patricia(better, None)
        yield from _emit(trie, None, SENT)

    return run


def _settle(better, limit: int):
    """After the shuffle: all records of a text are in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(better, limit)
        for batch in batches:
            for body, owner, rows in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                trie.add(body.as_py(), owner, rows)
        yield from _emit(trie, None, OWNED)

    return run


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", limit: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: n_bytes, sha (hex), keep_id, group_size. ``keep``: max or min."""
    better = {"max": max, "min": min}[keep]
    bodies = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "utf-8").alias("body"))
    sent = bodies.mapInArrow(_gather(better, limit), SENT_DDL)
    return sent.repartition("n_bytes", "sha").mapInArrow(_settle(better, limit), OWNED_DDL)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Where the kept id occurs on several equal rows, each of them is marked as kept.
    """
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "utf-8")
    rows = saved(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha")))
    groups = saved(exact_groups(docs, text, doc_id, keep))
    out = attach(rows, groups, ["n_bytes", "sha"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
