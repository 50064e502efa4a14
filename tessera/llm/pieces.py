"""Op 10. SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is parsed here, and its parts rebuilt: the normaliser with
its character map, the marker for spaces, unigram scores or ranked merges, and
byte fallback. Texts are encoded in batches on several threads. Where no piece
holds the space marker after another character, texts are cut before each run
of markers first, as no piece can cross there; each distinct cut is then
encoded once and texts are put together from cuts. Else this is done text by
text. Texts are decoded from their ids, piece by piece, or by the tokenizers
library where they hold unknown pieces or bytes of no character. Parity: the sentencepiece library encodes every
whole text, and its ids are compared with these.

Null text: null ids, no tokens. Empty text: no ids. Repeated rows are encoded
each. Control pieces in a text are ordinary text.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text_kernels as tk
from tessera.llm.repeats import numbered
from tessera.llm.shared import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: kinds of pieces and of models, and the space marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Threads of a Python worker; several workers share an executor.
THREADS = 2
EMPTY = pa.scalar("", pa.large_string())


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    no_extra_spaces: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


def parse(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(raw):
        own = dict(_fields(value)) if isinstance(value, bytes) and number <= 3 else {}
        if number == 1:
            spec.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            spec.kind, spec.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            spec.charsmap = own.get(2, b"")
            spec.dummy_prefix, spec.no_extra_spaces, spec.escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """Pairs that join to a piece, the best score first."""
    ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    out = []
    for piece, score, kind in spec.pieces:
        if kind in (NORMAL, USER_DEFINED):
            pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
            out += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in pairs]
    return [(x[4], x[5]) for x in sorted(out)]


def build(spec: Spec):
    """A tokenizer of the tokenizers library with the same ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unk, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges_of(spec), unk_token=None if unk is None else spec.pieces[unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind} is neither unigram nor byte-pair")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.no_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind == NORMAL):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    own = [p for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens([AddedToken(p, normalized=False) for p in own])
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(parts)
    return t


@lru_cache(maxsize=2)
def _loaded(raw: bytes) -> Coder:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Coder(raw)


class Store:
    """Distinct cuts with their ids, one after another in a flat array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)  # where the ids of each cut begin
        self.ids = np.empty(0, np.int32)

    def add(self, cuts: list[str], ids: list[list[int]]) -> None:
        n = len(self.known)
        self.known.update(zip(cuts, range(n, n + len(cuts)), strict=True))
        flat, first = _flat(ids)
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.ids = np.concatenate([self.ids, flat])


class Coder:
    """Encodes and decodes whole texts. Where texts can be cut before space markers, each distinct cut is encoded once."""

    KEPT = 500_000

    def __init__(self, raw: bytes):
        import sentencepiece

        self.spec = parse(raw)
        self.tokenizer, self.reference = build(self.spec), sentencepiece.SentencePieceProcessor(model_proto=raw)
        own = any(k == USER_DEFINED for _, _, k in self.spec.pieces)
        self.cuts = self.tokenizer.pre_tokenizer is not None and self.spec.escape and not own and not self.spec.charsmap
        self.store = Store()
        # what each id adds to a text; rows with unknown pieces are left to the library's decoder
        self.plain = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.spec.pieces], pa.large_binary())
        self.unknown = np.array([k == UNKNOWN for _, _, k in self.spec.pieces])
        if self.cuts:
            self.bare = build(self.spec)
            self.bare.pre_tokenizer = self.bare.normalizer = None

    def learn(self, cuts: list[str]) -> None:
        """Encode cuts that are not known yet; a cut holds spaces where the model has markers."""
        made = self.bare.encode_batch_fast([c.replace(" ", MARK) for c in cuts], add_special_tokens=False)
        self.store.add(cuts, [e.ids for e in made])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The text of each run of ids."""
        raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), self.plain.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))
        hard = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.unknown[ids])])[first]))
        try:
            back = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that make no character, which no text gives
            back, hard = pa.nulls(len(raw), pa.large_string()), np.arange(len(raw))
        if self.spec.dummy_prefix:  # one space goes, as the decoder's last step says
            back = pc.replace_substring_regex(back, "\\A ", "")
        if not len(hard):
            return back
        own = self.tokenizer.decode_batch([ids[first[i] : first[i + 1]].tolist() for i in hard], skip_special_tokens=False)
        at = np.arange(len(back))
        at[hard] = len(back) + np.arange(len(hard))
        return pa.concat_arrays([back, pa.array(own, pa.large_string())]).take(pa.array(at))

    def from_cuts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, and where each text's begin."""
        plain = pc.replace_substring(text, MARK, " ")
        if self.spec.no_extra_spaces:
            plain = pc.utf8_trim(pc.replace_substring_regex(plain, " {2,}", " "), " ")
        if self.spec.dummy_prefix:
            plain = pc.if_else(pc.equal(plain, EMPTY), EMPTY, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, EMPTY))
        data, bounds = tk.column_bytes(plain)
        space = np.concatenate([[False], data == 32])
        begins = space[1:] & ~space[:-1]
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        start = np.flatnonzero(begins)
        edge = np.concatenate([start, [len(data)]]).astype(np.int64)
        cuts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        own = cuts.dictionary.to_pylist()
        if len(self.store.known) > self.KEPT:
            self.store = Store()
        known = len(self.store.known)
        found = np.fromiter(map(self.store.known.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(found < 0)
        if len(new):
            self.learn([own[i] for i in new.tolist()])
            found[new] = known + np.arange(len(new))
        at = found[cuts.indices.to_numpy()]
        rows = np.searchsorted(start, bounds)
        first, size = self.store.first[at], np.diff(self.store.first)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat((first - ends[:-1]).astype(np.int32), size)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = self.store.ids[place]
        return ids, ends[rows]

    def __call__(self, text: pa.Array, parity: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray | None]:
        """from_cuts() or the same text by text, and whether the reference gives the same ids for each whole text."""
        text = pc.fill_null(text.cast(pa.large_string()), EMPTY)
        whole = text.to_pylist() if parity or not self.cuts else []
        if self.cuts:
            ids, first = self.from_cuts(text)
            back = self.decode(ids, first)
        else:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            ids, first = _flat(made)
            back = pa.array(self.tokenizer.decode_batch(made, skip_special_tokens=False), pa.large_string())
        if not parity:
            return ids, first, back, None
        mine, edge = ids.tolist(), first.tolist()
        theirs = self.reference.encode(whole, num_threads=1)
        return ids, first, back, np.array([x == mine[a:b] for x, a, b in zip(theirs, edge[:-1], edge[1:], strict=True)], bool)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def normal_form(text: pa.Array, spec: Spec) -> pa.Array:
    """What decoding must give back; null where the model's own character map decides."""
    if spec.charsmap:
        return pa.nulls(len(text), pa.large_string())
    if spec.no_extra_spaces:
        text = pc.utf8_trim(pc.replace_substring_regex(text, " {2,}", " "), " ")
    return pc.replace_substring(text, MARK, " ")


def encode(docs: DataFrame, model: bytes, text: str = "text", parity: bool = True) -> DataFrame:
    """docs without the text, with ids, n_tokens, decoded, round_trip and parity (null where not asked for or no text).

    These names win over columns of docs with the same name.
    """
    made = ("ids", "n_tokens", "decoded", "round_trip", "parity")
    small_batches(docs.sparkSession)
    rows = numbered(docs, text).select("text", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(model)
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            ids, first, back, same = coder(column, parity)
            null = column.is_null()
            none = null.to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(none, False)), pa.array(ids, pa.int32()))
            back = pc.if_else(null, pa.scalar(None, pa.large_string()), back)
            trip = pc.equal(back, normal_form(column, coder.spec))
            cols = [batch.column("rest"), lists, pa.array(np.diff(first)), back.cast(pa.string()), trip, pa.nulls(len(none), pa.bool_()) if same is None else pa.array(same, mask=none)]
            tk.trimmed(column.nbytes)
            yield pa.RecordBatch.from_arrays(cols, ["rest", *made])

    schema = rows.select("rest").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("decoded", "string").add("round_trip", "boolean").add("parity", "boolean")
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c != text and c not in made), *made)


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with open(model, "rb") as f:
        raw = f.read()
    done = encode(docs, raw)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "parity")
