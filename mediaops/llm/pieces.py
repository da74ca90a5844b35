"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .hashing import slices

MARK = "▁"
#: Chunks after which a worker begins a new table (the one before is still asked), and the longest one remembered.
REMEMBERED, LONGEST = 150_000, 64
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Encodes and decodes whole texts chunk by chunk.

    No piece of the model crosses from another character to a white space mark, so a text (its spaces as marks, one
    mark put before it) falls into chunks, marks and what follows them, that are segmented independently.
    Each distinct chunk is segmented and decoded by the library once and looked up by position after that.
    A model with other pieces or another normalization is refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        if crossing or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("pieces of this model cross white space marks, or it normalizes texts")
        self._alone = self._library.piece_to_id(MARK)
        self._begins = np.array([p.piece.startswith(MARK) for p in model.pieces])
        self._known: dict[str, tuple[str, str]] = {}
        self._before: dict[str, tuple[str, str]] = {}

    def _segmented(self, chunks: list[str]) -> dict[str, tuple[str, str]]:
        """Ids as text and the decoded text of each chunk; the library itself puts the first mark."""
        out = {}
        # Words with one mark go as one text: a chunk's first piece is its only one that begins with a mark.
        words = [c for c in chunks if len(c) > 1 and c.rfind(MARK) == 0]
        if words:
            ids = self._library.encode(" ".join([c[1:] for c in words]), num_threads=1)
            at, texts = np.flatnonzero(self._begins[ids]).tolist(), self._library.decode(ids).split(" ")
            if len(at) == len(texts) == len(words):
                numbers = list(map(str, ids))
                out = {c: (",".join(numbers[x:y]), " " + t) for c, x, y, t in zip(words, at, [*at[1:], len(ids)], texts, strict=True)}
        for chunk in chunks:
            if chunk not in out:
                ids = [self._alone] if chunk == MARK else self._library.encode(chunk[1:], num_threads=1)
                out[chunk] = (",".join(map(str, ids)), " " + self._library.decode(ids))
        return out

    def all_chunks(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """The table's entries (ids as text, decoded text) for the chunks of each text, in order."""
        parts = []
        for text in texts:
            words = text.replace(MARK, " ").split(" ") if text else []
            parts.append([MARK + w for w in words] if all(words) else _CHUNKS.findall(MARK + MARK.join(words)))
        known, before = self._known, self._before
        missing = set().union(*parts) - known.keys()
        known.update((c, before[c]) for c in missing & before.keys())
        known.update(self._segmented([c for c in missing if c not in known]))
        out = [list(map(known.__getitem__, p)) for p in parts]
        for chunk in [c for c in missing if len(c) > LONGEST]:
            del known[chunk]
        if len(known) > REMEMBERED:
            self._before, self._known = known, {}
        return out

    def chunks(self, text: str) -> list[tuple[str, str]]:
        return self.all_chunks([text])[0]

    def encode(self, text: str) -> list[int]:
        return _ids(self.chunks(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self._library.decode(ids)


def _ids(entries: list[tuple[str, str]]) -> np.ndarray:
    return np.array(",".join([e[0] for e in entries]).split(","), np.int32) if entries else np.zeros(0, np.int32)


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's table for a model file: tasks of the same worker share it."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_pieces(documents: DataFrame, model: str, *, text_column: str = "text") -> DataFrame:
    """``documents`` with ``ids``, the piece ids of each whole text, and ``decoded``, the text they decode to.

    A null text is empty and has no ids; every row is kept, columns of these names are replaced.
    """
    documents = documents.drop("ids", "decoded")
    schema = StructType([*documents.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches):
        table = pieces(model)
        for batch in slices(batches, text_column, 1 << 20):
            entries = table.all_chunks([t or "" for t in batch.column(text_column).to_pylist()])
            ids = pa.array([_ids(row) for row in entries], pa.list_(pa.int32()))
            decoded = pa.array(["".join([e[1] for e in row])[1:] for row in entries], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], names=[*batch.schema.names, "ids", "decoded"])

    return documents.mapInArrow(run, schema)


def digest(documents: DataFrame, model: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the id, the number of ids, and hashes of the ids (decimal, joined by commas) and of the decoded text."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        table = pieces(model)
        for batch in slices(batches, "text", 1 << 20):
            counts, ids, decoded = [], [], []
            for entries in table.all_chunks([t or "" for t in batch.column("text").to_pylist()]):
                written = ",".join([e[0] for e in entries])
                counts.append(written.count(",") + 1 if entries else 0)
                ids.append(sha256(written.encode()).hexdigest())
                decoded.append(sha256("".join([e[1] for e in entries])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=names)

    return rows.mapInArrow(run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
