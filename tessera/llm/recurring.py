"""Which of the keys that tasks hold recur anywhere, told back to each task's own data.

A task sends a message: its distinct keys with their counts go to shards by the
keys' upper bits (SENT), and what it needs to use the answers goes along to any
shard (OWN). A shard answers each message with the keys that recur (BACK). Both
meet again by message, so nothing is kept between the steps and a lost executor
only costs its share. A shard compares the 32 bits of a key that follow its upper
20: now and then a key seems to recur that does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "box int, msg long, kind int, start int, a binary, b binary, c binary, d binary, e binary"
OWN, SENT, BACK = 0, 1, 2


def message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["box", "msg", "kind", "start", *"abcde"])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, and how often each stands there."""
    head = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def sent(msg: int, key: np.ndarray, count: np.ndarray, own: tuple[bytes, ...], shards: int) -> Iterator[pa.RecordBatch]:
    """A message with sorted distinct keys of 64 bits, and up to five byte strings of the task's own."""
    yield message([(msg % shards, msg, OWN, 0, *own, *[None] * (5 - len(own)))])
    if not len(key):
        return
    box = (key >> np.uint64(44)).astype(np.int64) * shards >> 20
    rem = ((key >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    few = np.minimum(count, 255).astype(np.uint8)
    edge = np.flatnonzero(np.diff(box, prepend=-1))
    rows = [(int(box[a]), msg, SENT, int(a), rem[a:b].tobytes(), few[a:b].tobytes(), None, None, None) for a, b in zip(edge, [*edge[1:], len(key)], strict=True)]
    yield message(rows)


def _answered(box: int, rows: list[tuple]) -> pa.RecordBatch | None:
    rem = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    n = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(np.int64)
    order = np.argsort(rem, kind="stable")
    head = np.flatnonzero(np.diff(rem[order].astype(np.int64), prepend=-1))
    total = np.add.reduceat(n[order], head)
    every = np.empty(len(rem), np.int64)
    every[order] = np.repeat(total, np.diff(np.append(head, len(rem))))
    code = np.minimum(255, 8 * np.log2(every)).astype(np.uint8)
    out, at = [], 0
    for msg, start, own, _ in rows:
        size = len(own) // 4
        hit = np.flatnonzero(every[at : at + size] > 1)
        if len(hit):
            out.append((box, msg, BACK, start, (start + hit).astype(np.uint32).tobytes(), rem[at + hit].tobytes(), code[at + hit].tobytes(), None, None))
        at += size
    return message(out) if out else None


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by box and kind: OWN goes through, SENT of a box is answered."""
    box, held = None, []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == OWN).any():
            yield batch.filter(pa.array(kind == OWN))
            batch = batch.filter(pa.array(kind == SENT))
        for r in zip(*(batch.column(x).to_pylist() for x in ("box", "msg", "start", "a", "b")), strict=True):
            if held and r[0] != box:
                if (made := _answered(box, held)) is not None:
                    yield made
                held = []
            box = r[0]
            held.append(r[1:])
    if held and (made := _answered(box, held)) is not None:
        yield made


#: use(own, key, token, code): the OWN row; places in its list of keys of those that recur; a number for each such key, the same in all messages; eighths of doublings in its count.
Use = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def used(use: Use) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by message and kind: what use() makes of each message and its answers."""

    def done(own: dict, backs: list[dict]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(b["a"], np.uint32) for b in backs] or [np.empty(0, np.uint32)]).astype(np.int64)
        token = np.concatenate([(b["box"] << 32) + np.frombuffer(b["b"], np.uint32).astype(np.int64) for b in backs] or [np.empty(0, np.int64)])
        code = np.concatenate([np.frombuffer(b["c"], np.uint8) for b in backs] or [np.empty(0, np.uint8)])
        return use(own, key, token, code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, backs = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == OWN:
                    if own is not None:
                        yield from done(own, backs)
                    own, backs = r, []
                else:
                    backs.append(r)
        if own is not None:
            yield from done(own, backs)

    return run


def exchange(messages: DataFrame, shards: int, use: Use, schema: str) -> DataFrame:
    """What use() makes of messages and their answers; to be run with a few rows an Arrow batch, as rows hold megabytes."""
    back = messages.repartition(shards, "box").sortWithinPartitions("box", "kind").mapInArrow(answered, MESSAGE)
    return back.repartition(shards, "msg").sortWithinPartitions("msg", "kind").mapInArrow(used(use), schema)


def occurrences(count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys with count entries each in a row: which of the asked keys and which entry, for every entry of those asked."""
    start, many = np.cumsum(count) - count, count[key]
    of = np.repeat(np.arange(len(key)), many)
    return of, start[key][of] + np.arange(len(of)) - (np.cumsum(many) - many)[of]
