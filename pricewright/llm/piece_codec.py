"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character,
so merges never cross the start of a marked word. A text is cut at its markers
(and around line feeds, which no piece contains), each distinct chunk of a task
is segmented once, and the ids are joined back by position. The chunk table
lives as long as its task and is emptied when it reaches ``table_size``; that
only costs repeated work. Texts never leave their partition: no shuffle.

Defined cases: a null text counts as empty and encodes to the begin and end ids;
other columns pass through, columns named like an output are replaced; repeated
rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .textbytes import give_back

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
TABLE_SIZE = 200_000
ROWS = 256


class ChunkCodec:
    """Encodes and decodes texts exactly as the library does with ``model``."""

    def __init__(self, model: bytes, table_size: int = TABLE_SIZE):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("chunks need a model that leaves texts as they are")
        for piece in proto.pieces:
            if piece.type in (1, 4, 5) and (MARK in piece.piece.lstrip(MARK) or "\n" in piece.piece):
                raise ValueError(f"the piece {piece.piece!r} crosses a chunk's end")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.whole = sp.SentencePieceProcessor(model_proto=model)
        spec.add_dummy_prefix = False
        self.chunk = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.whole.bos_id(), self.whole.eos_id()))
        self.table: dict[str, bytes] = {}
        self.table_size = table_size

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian 32-bit numbers."""
        cut = [CHUNKS.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = list({c for chunks in cut for c in chunks if c not in self.table})
        if len(self.table) + len(missing) > self.table_size:
            self.table.clear()
            missing = list({c for chunks in cut for c in chunks})
        for chunk, ids in zip(missing, self.chunk.encode(missing, num_threads=1), strict=True):
            self.table[chunk] = np.array(ids, "<u4").tobytes()
        of = self.table.__getitem__
        return [self.begin + b"".join(map(of, chunks)) + self.end for chunks in cut]

    def decode(self, ids: bytes) -> str:
        return self.whole.decode(np.frombuffer(ids, "<u4").tolist())


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (binary, little-endian 32-bit) and ``decoded``.

    The model file (its size is bounded by its vocabulary) is read by the
    driver and travels with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    outputs = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.StringType()} if decode else {})
    plain = [c for c in docs.columns if c not in outputs and c != text]
    # The text goes under a name of its own, as it may itself be named like an output.
    given = docs.select(*plain, F.col(text).alias("__text"))
    kept = [f for f in given.schema if f.name != "__text"]
    if text not in outputs:
        kept = [*kept, T.StructField(text, T.StringType())]
    schema = T.StructType([*kept, *[T.StructField(n, k) for n, k in outputs.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                given = part.column(part.num_columns - 1)
                ids = codec.encode([t or "" for t in given.to_pylist()])
                new = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    new.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                old = part.columns if text not in outputs else part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*old, *new], names=schema.names)
        del codec
        give_back()

    return given.mapInArrow(work, schema)
