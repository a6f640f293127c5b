"""Order-preserving packing by dynamic programming.

Documents follow one another as a stream of tokens, each closed by an end
token. Sequences are consecutive windows of the stream; a window may end at
the end of a document (free), at the end of a sentence (``SENTENCE``) or, where
a sentence is longer than ``STRIDE`` tokens, within it (``INSIDE``). The cuts
are those with the least sum of padding and such penalties: padding fills a
window up to the capacity, except one whose length is a power of two; of equal
plans the one with fewer windows.

The cheapest plan up to a cut comes from the cheapest predecessor within one
capacity: the least (cost + position), which a monotone queue holds at its
front, each cut entering and leaving it once; or one of the few at a distance
of a power of two. So the work is linear in the cuts.

Each task solves its own rows in their order, in stretches of about
``STRETCH`` tokens that end with a document: a stretch's last window is all
that more tasks cost. No text and no token moves between tasks.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.packing import encoder

SENTENCE, INSIDE = 16, 64  # penalties, in tokens of padding
STRIDE = 32
STRETCH = 1 << 18
#: What ends a sentence, closing marks, and what may stand before the next.
STOPS, CLOSERS, OPENERS = ".!?…。！？", "\"'’”)]»", " \t\n\r\v\f"


@lru_cache(maxsize=2)
def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every id: whether its token ends like a sentence, begins with white
    space, or ends with a line feed."""
    own = encoder(path).own
    shown = own.decode_batch([[i] for i in range(own.get_vocab_size())], skip_special_tokens=False)
    return (np.array([(t.rstrip(CLOSERS)[-1:] or " ") in STOPS for t in shown]),
            np.array([t[:1] != "" and t[:1] in OPENERS for t in shown]), np.array([t[-1:] == "\n" for t in shown]))


def sentence_ends(ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions within a document after which a sentence or a line ends."""
    if len(ids) < 2:
        return np.zeros(0, dtype=np.int64)
    stops, opens, lines = tables
    before, after = ids[:-1], ids[1:]
    return np.flatnonzero(lines[before] | stops[before] & opens[after]) + 1


def cut_points(documents: list[tuple[int, np.ndarray]], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and their penalties, from the length
    (1 or more) and the sentence ends of each document."""
    base, at, cost = 0, [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for length, inner in documents:
        own = np.append(inner, length)
        gaps = np.diff(own, prepend=0)
        penalty = np.full(len(own), SENTENCE, dtype=np.int64)
        penalty[-1] = 0
        if (long := np.flatnonzero(gaps > stride)).size:
            more = np.concatenate([np.arange(own[i] - gaps[i] + stride, own[i], stride) for i in long])
            own, penalty = np.append(own, more), np.append(penalty, np.full(len(more), INSIDE))
            order = np.argsort(own, kind="stable")
            own, penalty = own[order], penalty[order]
        at.append(own + base)
        cost.append(penalty)
        base += length
    return np.concatenate(at), np.concatenate(cost)


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Positions of the windows' ends with the least padding and penalties.

    Neighbouring cuts are at most ``capacity`` apart. Costs are whole numbers:
    tokens times ``unit``, plus one a window to prefer fewer.
    """
    unit = 1 << 32
    powers = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    pos, toll = at.tolist(), (penalty * unit + 1).tolist()
    index = {p: j for j, p in enumerate(pos)}
    cost, back = [0], [0]
    queue = deque([(0, 0, 0)])  # (cost + unit * position, position, number): both rise
    find, full = index.get, capacity * unit
    for j in range(1, len(pos)):
        p = pos[j]
        while queue[0][1] < p - capacity:
            queue.popleft()
        key, _, i = queue[0]
        best = key + full - p * unit
        for s in powers:
            k = find(p - s)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += toll[j]
        cost.append(best)
        back.append(i)
        key = best + p * unit
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def windows(lengths: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """``(document, start, length, window, offset)`` of every piece, in order:
    the stream is cut where a document or a window ends."""
    ends = np.cumsum(lengths)
    stops = np.union1d(ends, np.asarray(cuts, dtype=np.int64))
    begins = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(ends, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    first = np.concatenate([[0], cuts])[window]
    return [doc, begins - (ends - lengths)[doc], stops - begins, window, begins - first]


_SCHEMA = ("doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0,
         order: str | None = None) -> DataFrame:
    """Every piece of every row: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.

    The order is that of the rows as they are stored, which needs no shuffle;
    with ``order`` the rows are first ranged and sorted by that column. Rising
    sequence numbers follow the order (a task's number above, its own windows'
    below). Null and empty texts are the end token alone; repeated rows and ids
    are documents of their own; a document of any length is held by one task as
    its ids (four bytes a token) and cut like a sentence too long for a window;
    ties go to the fewest windows, then to the earliest cut found; an empty
    table gives no rows. Only ``doc_id``, ``text`` and ``order`` are read.
    """
    if capacity < STRIDE:
        raise ValueError(f"capacity below {STRIDE}")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tables = encoder(tokenizer_path), sentence_tables(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def stretch(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence, names, held, tokens
            lengths = np.array([len(ids) for ids in held])
            cuts = best_cuts(*cut_points([(len(ids), sentence_ends(ids, tables)) for ids in held]), capacity)
            doc, start, length, window, offset = windows(lengths, cuts)
            crc = [zlib.crc32(held[d][a:a + n]) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            numbers = (start, length, crc, lengths[doc], sequence + window, offset)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, id_type).take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in numbers]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += len(cuts)
            names, held, tokens = [], [], 0
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(name)
                held.append(np.array([*enc.ids(text or ""), end_id], dtype="<u4"))
                tokens += len(held[-1])
                if tokens >= STRETCH:
                    yield stretch(id_type)
        if held:
            yield stretch(id_type)

    rows = docs.repartitionByRange(F.col(order)).sortWithinPartitions(order) if order else docs
    return rows.select("doc_id", "text").mapInArrow(
        solve, _SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString()))
