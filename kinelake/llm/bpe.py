"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are first cut where no match of the tokenizer's pattern can span: before
a blank that follows a visible ASCII character. Every alternative of the pattern has
blanks at its start only, or is all blanks, and its one lookahead is about the character
after a run of blanks, so encoding the pieces in turn equals encoding the whole.

Cases: a null or empty text has no tokens; a text without a safe boundary stays whole, a very long
text with boundaries is encoded piece by piece and its ids are kept as flat integers;
repeated rows are encoded alike; an empty table gives no rows; other columns are ignored,
whatever their names, but for those that ``encode_columns`` is told to keep.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.scratch import map_batches

#: The pattern that splits texts before merging, as the rank files' publisher gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rank files are broadcast; a larger one is refused.
MAX_RANK_BYTES = 64 << 20
#: Texts are cut at the first safe boundary after so many characters.
PIECE_CHARS = 1 << 16

_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Codec:
    """Encodes to ids and decodes to raw bytes; built once in each Python worker."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        return [token for piece in pieces(text) for token in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _codec(shared, pattern: str) -> Codec:
    return Codec(shared.value, pattern)


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id, token ids) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, rank_path: str, ids_col: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, raw bytes) of each row of token ids; null ids decode to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            raw = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return map_batches(tokens.select("doc_id", F.col(ids_col)), run, f"doc_id {kind}, raw binary")


def encode_columns(docs: DataFrame, rank_path: str, keep: list[str], text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` of each row, with n_tokens, ids, and whether the ids decode to the text's bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ends, flat, same = [0], [], []
                for text in part.column(len(keep)):
                    text = text.as_py() or ""
                    ids = codec.encode(text)
                    flat.append(np.array(ids, dtype=np.int32))
                    ends.append(ends[-1] + len(ids))
                    same.append(codec.decode(ids) == text.encode())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends), pa.int64()), ids, pa.array(same, pa.bool_())], [*keep, "n_tokens", "ids", "lossless"])

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in [*keep, text_col]]), run, f"{kinds}, n_tokens long, ids array<int>, lossless boolean")


def round_trip(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless.

    Only digests leave the worker, so memory holds one document's ids at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            counts, of_ids, of_bytes, same = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = codec.encode(text)
                raw = codec.decode(ids)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == text.encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, schema)
