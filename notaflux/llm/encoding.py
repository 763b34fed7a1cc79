"""Encoding of a corpus with a public byte-level BPE tokenizer, long texts in overlapping chunks.

A text over ``chunk_chars`` is cut into chunks that overlap; the chunks are encoded in parallel, wherever they land.
Pre-tokenising from the middle of a text agrees with pre-tokenising from its start from the first place at which both
must have a boundary, in any script: the end of a run of letters or digits, or of anything before white space. Each chunk
owns the text from the first such place at or after its start to the first such place at or after its end, both found in
the overlap, so the pieces meet exactly and their ids are joined in order. Where an overlap holds no such place the two
chunks stay one stretch of text, which is encoded when the pieces are joined; the rest of the text is not touched.
Decoding concatenates the raw bytes of the ids.

Defined results: null and empty texts give the empty list; strings that look like special tokens are ordinary text;
no text is cut short; repeated rows are encoded as often as they stand.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "byte_bpe_50k"
TOKENIZER_DIR = os.environ.get("NOTAFLUX_TOKENIZERS", "/opt/tokenizers")
# The fixed pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters of blocks in which every engine knows the same letters.
_KNOWN = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u024f\u0370-\u06ff\u0900-\u0e7f\u1e00-\u1fff\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3"
# Places that are pre-token boundaries whatever stands before: no pre-token holds white space after anything else, or
# anything but letters after a letter, or anything but digits after a digit.
_SURE = regex.compile(
    r"(?V1)(?<=[^\s\p{Z}\p{C}])(?=[ \n\t])"
    rf"|(?<=[\p{{L}}&&[{_KNOWN}]])(?=[!-@\[-`{{-~]|[\p{{P}}\p{{Nd}}\p{{Mn}}\p{{Mc}}&&[\u00a1-\u0e7f\u2010-\u2027\u3001-\u301f\uff01-\uff5e]])"
    rf"|(?<=[0-9])(?=[!-/:-@]|[\p{{L}}&&[{_KNOWN}]])"
)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that what is worked out at once stays small; Spark bounds the bytes of a batch itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@cache
def _ranks(directory: str, name: str) -> dict[bytes, int]:
    with open(f"{directory}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER):
    """The tokenizer of a vocabulary file of ranks, one for each worker process."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(directory, name), special_tokens={})


@cache
def token_bytes(directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER) -> list[bytes]:
    """The raw bytes of every id."""
    ranks = _ranks(directory, name)
    out = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        out[i] = raw
    return out


@cache
def _token_store(directory: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, where each begins, and how many each has."""
    raw = token_bytes(directory, name)
    sizes = np.array([len(t) for t in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def encode_arrays(texts: list[str | None], directory: str, name: str) -> list[np.ndarray]:
    """Ids of each text as arrays; empty for null and empty texts."""
    encode = encoder(directory, name)._core_bpe.encode_ordinary
    empty = np.zeros(0, np.int32)
    return [np.array(encode(t), np.int32) if t else empty for t in texts]


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def chunks_of(text: str, size: int, overlap: int) -> Iterator[tuple[str, bool, bool]]:
    """(chunk, first, last): one character of context (but for the first), ``size`` own characters, then the overlap."""
    for at in range(0, len(text), size):
        yield text[max(0, at - 1) : at + size + overlap], at == 0, at + size >= len(text)


def owned(chunk: str, first: bool, last: bool, size: int, overlap: int) -> tuple[int, int, bool, bool]:
    """(from, to, synced before, synced after) of the part of a chunk that it owns. Where nothing resynchronises, that end
    is the chunk's own edge, and the chunk beside it, which looks at the same overlap, finds nothing either."""
    edge = 0 if first else 1

    def place(at: int) -> int | None:
        m = _SURE.search(chunk, at, at + overlap)
        return m.start() if m else None

    start, end = (0 if first else place(edge)), (len(chunk) if last else place(edge + size))
    begin = edge if start is None else start
    return begin, max(begin, edge + size if end is None else end), start is not None, end is not None


def joined_ids(parts: list[dict], directory: str, name: str) -> np.ndarray:
    """The ids of a text from its parts (no, before, after, ids, raw) in order; stretches that did not synchronise are
    encoded here, as one text each."""
    out: list[np.ndarray] = []
    stretch: list[str] = []
    for p in parts:
        if p["ids"] is not None:
            out.append(np.asarray(p["ids"], np.int32))
            continue
        stretch.append(p["raw"])
        if p["after"]:
            out.extend(encode_arrays(["".join(stretch)], directory, name))
            stretch = []
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def encode(
    texts: DataFrame, key: str = "doc_id", text: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 512,
    directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """(key, ids) of every row; ``key`` must be distinct among the texts over ``chunk_chars``."""
    if overlap_chars > chunk_chars:
        raise ValueError("an overlap is no longer than a chunk")
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            ids = _list_array(encode_arrays(b.column(1).to_pylist(), directory, name))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["k", "ids"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, 1):
            found = list(chunks_of(b.column(1)[0].as_py(), chunk_chars, overlap_chars))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([0] * n)), pa.array(range(n), pa.int32()), *(pa.array([c[i] for c in found]) for i in range(3))], names=["k", "no", "chunk", "first", "last"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            own = [owned(c, first, last, chunk_chars, overlap_chars) for c, first, last in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            parts = [c[s:e] for c, (s, e, *_) in zip(b.column(2).to_pylist(), own, strict=True)]
            alone = [before and after for *_, before, after in own]
            ids = encode_arrays([p if a else None for p, a in zip(parts, alone, strict=True)], directory, name)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[2] for x in own]), pa.array([x[3] for x in own]), pa.array([x if a else None for x, a in zip(ids, alone, strict=True)], pa.list_(pa.int32())),
                 pa.array([None if a else p for p, a in zip(parts, alone, strict=True)], pa.string())], names=["k", "no", "before", "after", "ids", "raw"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, 16):
            ids = _list_array([joined_ids(parts, directory, name) for parts in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["k", "ids"])

    long = F.length("t") > chunk_chars
    short_ids = rows.where(F.coalesce(~long, F.lit(True))).mapInArrow(whole, f"k {kind}, ids array<int>")
    chunks = rows.where(long).mapInArrow(cut_up, f"k {kind}, no int, chunk string, first boolean, last boolean")
    spread = chunks.repartition("k", "no").mapInArrow(pieces, f"k {kind}, no int, before boolean, after boolean, ids array<int>, raw string")
    stitched = spread.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("no", "before", "after", "ids", "raw"))).alias("parts"))
    return short_ids.unionByName(stitched.mapInArrow(join, f"k {kind}, ids array<int>")).select(F.col("k").alias(key), "ids")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, text) by concatenation of raw bytes; bytes that are no UTF-8 come out as the replacement character."""
    kind = encoded.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, starts, sizes = _token_store(directory, name)
        for b in few_rows(batches):
            lists = b.column(1)
            values = np.asarray(lists.flatten())
            of_list = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
            size = sizes[values]
            ends = np.concatenate([[0], np.cumsum(size)])
            # byte n of the output is byte n - (end before its token) of the bytes of the token
            raw = store[np.repeat(starts[values] - ends[:-1], size) + np.arange(ends[-1])]
            offsets = ends[of_list].astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            if lists.null_count:
                found = pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), found)
            try:
                text = found.cast(pa.string())
            except pa.ArrowInvalid:  # ids that are no whole characters
                text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["k", "text"])

    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(read, f"k {kind}, text string").select(F.col("k").alias(key), "text")
