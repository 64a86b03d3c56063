"""Bounded-space online packing of token sequences into fixed-length windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import bound_batches, tidy

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenWindows:
    """At most ``k`` open windows of ``capacity`` tokens.

    A piece goes to the window it leaves least room in; when it fits none and no further window
    may be opened, the fullest is emitted. ``finish`` merges what is still open into full windows
    and cuts the last, shorter one into powers of two, which need no padding. A piece is
    (doc_id, start, bytes, doc_tokens).
    """

    def __init__(self, capacity: int, k: int, first_sequence: int):
        if capacity < 1 or k < 1:
            raise ValueError("capacity and k must be positive")
        self.capacity, self.k, self.next = capacity, k, first_sequence
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.windows: dict[int, list] = {}
        self._made = 0

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at, seq = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, ids, total, seq, at
            at += n

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, cap = len(ids) // 4, self.capacity
        whole = total - total % cap
        for s in range(0, whole, cap):
            yield from self._emit([(doc, s, ids[4 * s : 4 * (s + cap)], total)])
        rest = total - whole
        if not rest:
            return
        piece = (doc, whole, ids[4 * whole :], total)
        i = bisect_left(self.free, (rest, -1))
        if i < len(self.free):
            room, w = self.free.pop(i)
            self.windows[w].append(piece)
            room -= rest
        else:
            if len(self.free) >= self.k:
                _, full = self.free.pop(0)
                yield from self._emit(self.windows.pop(full))
            w, room = self._made, cap - rest
            self._made += 1
            self.windows[w] = [piece]
        if room:
            insort(self.free, (room, w))
        else:
            yield from self._emit(self.windows.pop(w))

    def finish(self) -> Iterator[tuple]:
        pieces = [p for _, w in self.free for p in self.windows[w]]
        self.free, self.windows = [], {}
        left = sum(len(p[2]) for p in pieces) // 4
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        queue = pieces[::-1]
        for size in sizes:
            out = []
            while size:
                doc, start, ids, total = queue.pop()
                n = len(ids) // 4
                if n > size:
                    queue.append((doc, start + size, ids[4 * size :], total))
                    ids, n = ids[: 4 * size], size
                out.append((doc, start, ids, total))
                size -= n
            yield from self._emit(out)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, open_windows: int = 128, end_id: int = 1) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack them; one row per piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Each partition packs its own
    rows in one pass with ``open_windows`` open windows, so nothing is shuffled and a lost task
    is redone alone. ``sequence_id`` is partition << 40 plus a counter.

    Null or empty texts are documents of the end id only; repeated rows are packed once each;
    null ids stay null; an empty table gives no rows; columns other than doc_id and text are
    ignored.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer_path or tokens.default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = tokens.encoder(path)
        box = OpenWindows(capacity, open_windows, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0

        def flush():
            cols = zip(*rows) if rows else [[]] * len(_ARROW)
            out = pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in tokens.batches_of_texts(batch):
                for i, coded in enumerate(enc.encode(texts), first):
                    rows.extend(box.add(ids[i], coded + end))
                    held += len(coded)
                    if held >= 1 << 20:
                        yield flush()
                        held = 0
        rows.extend(box.finish())
        yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(run, "tokens"), SCHEMA)
