"""Token ids as binary shards with a minimal perfect hash index, and reading them back."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import mix, slices, strings
from .work import spread

#: Token ids a shard holds before the next one begins (a longer document is a shard of its own).
SHARD_IDS = 1 << 20
END_ID = 0
#: Chunks a worker remembers (one a slot), and their longest bytes and most ids; other chunks are remembered by a small table of their own.
SLOTS = 1 << 19
CHUNK_BYTES, CHUNK_IDS = 16, 6
OTHERS, OTHER_BYTES = 50_000, 64

_MARKS = b".,;:!?#*$%&|()"
#: White space is cut before only where the character before it surely is none, and letters are those of ASCII and Latin-1.
_LETTER, _MARK, _SOLID = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(_MARKS)] = True
_SOLID[0x21:0x7F] = True
_CLEAR = np.ones(256, bool)
_CLEAR[[0xC2, 0x80, 0x81, 0x9A]] = False
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PLAIN = re.compile(r" ?\S+")
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GAMMA = 2
_NONE = np.int64(-0x6A09E667F3BCC909)


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write bytes as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte whether a chunk begins there: at rows, at a space or line end after other characters, between letters and marks, after a lone line end.

    At these places the tokenizer cuts whatever else the text holds.
    """
    two_byte = np.zeros(len(data), bool)
    two_byte[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    solid = _SOLID[data]
    high = data >= 0x80
    if high.any():
        solid[1:] |= high[1:] & _CLEAR[data[:-1]]
    letter_ends = _LETTER[data] | two_byte
    letter_begins = _LETTER[data]
    letter_begins[:-1] |= two_byte[1:]
    mark, line = _MARK[data], data == 0x0A
    out = np.zeros(len(data), bool)
    out[1:] = solid[:-1] & (line[1:] | (data[1:] == 0x20))
    out[1:] |= (letter_ends[:-1] & mark[1:]) | (mark[:-1] & letter_begins[1:])
    out[2:] |= line[1:-1] & solid[:-2] & (_SOLID[data[2:]] | (data[2:] == 0xC3))
    out[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return out


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers.

    The string of a special token in a text is ordinary text, or with ``special_as_text`` off, the library's default, that token.

    The tokenizer cuts texts before it merges anything (:func:`chunk_starts` finds such places). The chunks between them are encoded each on
    its own, by the library, once as long as they are remembered: in a table of fixed size, whole columns looked up at a time, each
    slot of which holds the last chunk that fell there with its bytes, so that a chunk is known by all of them.
    """

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = special_as_text
        self._model = self._library.model
        added = self._library.get_added_tokens_decoder().values()
        self._whole = [t.content.encode() for t in added if t.content and not (special_as_text and t.special)]
        self._line = self._library.token_to_id(chr(_BYTE_LETTERS[0x0A]))
        # The bytes of a chunk as two numbers, its length and count of ids, and the ids.
        self._slots = np.zeros((SLOTS, 3 + CHUNK_IDS // 2), np.uint64)
        self._others: dict[bytes, list[int]] = {}

    def _by_library(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of distinct chunks."""
        words = [c for c in chunks if _WORD.fullmatch(c)]
        letters = b"\n".join(words).decode("latin-1").translate(_BYTE_LETTERS).split(chr(_BYTE_LETTERS[0x0A])) if words else []
        found = {c: [t.id for t in self._model.tokenize(x)] for c, x in zip(words, letters, strict=True)}
        others = [c for c in chunks if c not in found]
        if others:
            texts = [c.decode() for c in others]
            # Between line ends, chunks without further white space stay what they are.
            plain = [self._line is not None and _PLAIN.fullmatch(t) is not None and not any(w in c for w in self._whole) for c, t in zip(others, texts, strict=True)]
            joined = [t for t, p in zip(texts, plain, strict=True) if p]
            ids = np.array(self._library.encode("\n".join(joined), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self._line) if joined else np.zeros(0, np.int64)
            if joined and len(cuts) == len(joined) - 1:
                parts = zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)
                found.update((c, ids[slice(*next(parts))].tolist()) for c, p in zip(others, plain, strict=True) if p)
            for c, t in zip(others, texts, strict=True):
                if c not in found:
                    found[c] = self._library.encode(t, add_special_tokens=False).ids
        return [found[c] for c in chunks]

    @staticmethod
    def _slot(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + lengths.astype(np.uint64))) % np.uint64(SLOTS)).astype(np.int64)

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first 16 bytes of each chunk as two numbers; ``data`` goes 16 bytes on."""
        keys = np.lib.stride_tricks.sliding_window_view(data, CHUNK_BYTES)[start].view(np.uint64)
        keys[:, 0] &= _HEAD[np.minimum(lengths, 8)]
        keys[:, 1] &= _HEAD[np.clip(lengths - 8, 0, 8)]
        return keys

    def _rows(self, keys: np.ndarray, lengths: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        rows = np.zeros((len(keys), self._slots.shape[1]), np.uint64)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        rows[:, :2] = keys
        rows[:, 2] = lengths + (counts << 32)
        places = np.zeros((len(keys), CHUNK_IDS), np.uint32)
        places[np.arange(CHUNK_IDS) < counts[:, None]] = np.fromiter(chain.from_iterable(ids), np.uint32)
        rows[:, 3:] = places.view(np.uint64)
        return rows

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's ids begin (with an end); null is empty."""
        data, offsets = strings(texts)
        raw, data = data.tobytes(), np.concatenate([data, np.zeros(CHUNK_BYTES, np.uint8)])
        begins = chunk_starts(data[:len(raw)], offsets)
        for whole in self._whole:
            at = raw.find(whole)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                begins[offsets[row] + 1:offsets[row + 1]] = False
                at = raw.find(whole, int(offsets[row + 1]))
        start = np.flatnonzero(begins)
        lengths = np.diff(np.append(start, len(raw)))
        keys = self._keys(data, start, lengths)
        rows = self._slots[self._slot(keys, lengths)]
        known = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & ((rows[:, 2] & np.uint64(0xFFFFFFFF)) == lengths.astype(np.uint64))
        counts = (rows[:, 2] >> np.uint64(32)).astype(np.int64)
        missed = np.flatnonzero(~known)
        long: dict[int, list[int]] = {}
        if len(missed):
            chunks = [raw[a:a + n] for a, n in zip(start[missed].tolist(), lengths[missed].tolist(), strict=True)]
            distinct = dict.fromkeys(chunks)
            ids_of = {c: ids for c in distinct if (ids := self._others.get(c)) is not None}
            new = [c for c in distinct if c not in ids_of]
            ids_of.update(zip(new, self._by_library(new), strict=True))
            short = [c for c in new if len(c) <= CHUNK_BYTES and len(ids_of[c]) <= CHUNK_IDS]
            number = {c: i for i, c in enumerate(short)}
            place = np.array([number.get(c, -1) for c in chunks], np.int64)
            if short:
                sizes = np.array([len(c) for c in short], np.int64)
                flat = np.frombuffer(b"".join(short) + bytes(CHUNK_BYTES), np.uint8)
                short_keys = self._keys(flat, np.cumsum(sizes) - sizes, sizes)
                filled = self._rows(short_keys, sizes, [ids_of[c] for c in short])
                self._slots[self._slot(short_keys, sizes)] = filled
                rows[missed[place >= 0]] = filled[place[place >= 0]]
                counts[missed] = (rows[missed, 2] >> np.uint64(32)).astype(np.int64)
            for k in np.flatnonzero(place < 0).tolist():
                long[int(missed[k])] = ids_of[chunks[k]]
            if len(self._others) > OTHERS:
                self._others = {}
            self._others.update((c, ids_of[c]) for c in new if c not in number and len(c) <= OTHER_BYTES)
        places = np.ascontiguousarray(rows[:, 3:]).view(np.uint32)
        if long:
            at = np.array(list(long), np.int64)
            counts[at] = 0
            out = places[np.arange(CHUNK_IDS) < counts[:, None]]
            counts[at] = [len(x) for x in long.values()]
            in_slot = np.ones(len(counts), bool)
            in_slot[at] = False
            held, ids = np.repeat(in_slot, counts), np.zeros(int(counts.sum()), np.uint32)
            ids[held], ids[~held] = out, np.fromiter(chain.from_iterable(long.values()), np.uint32)
        else:
            ids = places[np.arange(CHUNK_IDS) < counts[:, None]]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(start, offsets)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, by the library's defaults: tasks of the same worker share it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, special_as_text=False)
    return _encoders[path]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays, collisions pass to the next level."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self._before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self._ranks = [np.cumsum(x, dtype=np.int64) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(8, _GAMMA * len(keys))
            at = cls._slot(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places in 0..n-1; of keys that were not built in, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        for i, (bits, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            todo = np.flatnonzero(out < 0)
            at = self._slot(keys[todo], i, len(bits))
            hit = bits[at]
            out[todo[hit]] = self._before[i] + ranks[at[hit]] - 1
        return out


def document_keys(ids: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Keys of documents in file order: the id, and for repeated rows of an id how often it came before."""
    values = np.where(missing, _NONE, ids)
    repeat = np.zeros(len(values), bool)
    repeat[1:] = (values[1:] == values[:-1]) & (missing[1:] == missing[:-1])
    before = np.arange(len(values)) - np.maximum.accumulate(np.where(repeat, 0, np.arange(len(values))))
    return mix(mix(values.view(np.uint64)) + before.astype(np.uint64)) ^ missing.astype(np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.array([x.nbytes], "<u8").tobytes() + x.tobytes() for x in arrays)


def _unpack(blob) -> Iterator[memoryview]:
    view, at = memoryview(blob), 0
    while at < len(view):
        n = int(np.frombuffer(view[at:at + 8], "<u8")[0])
        yield view[at + 8:at + 8 + n]
        at += 8 + n


def shard_index(ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray) -> bytes:
    """The index of a shard: the perfect hash, and by its places fingerprints, offsets and lengths; then the ids in file order."""
    keys = document_keys(ids, missing)
    hashed = PerfectHash.build(keys)
    at = hashed(keys)
    prints, offsets, counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<i8")
    prints[at] = (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")
    offsets[at] = np.cumsum(lengths) - lengths
    counts[at] = lengths
    sizes = np.array([len(x) for x in hashed.levels], "<i8")
    bits = np.packbits(np.concatenate(hashed.levels)) if len(sizes) else np.zeros(0, np.uint8)
    return _pack(sizes, bits, prints, offsets, counts, ids.astype("<i8"), missing)


class Shard:
    """A shard read back: documents by key in constant time, and the list of them in file order."""

    def __init__(self, index, payload) -> None:
        sizes, bits, prints, offsets, counts, ids, missing = _unpack(index)
        sizes = np.frombuffer(sizes, "<i8")
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[:int(sizes.sum())]
        self._hash = PerfectHash(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self._prints, self._offsets, self._counts = np.frombuffer(prints, "<u4"), np.frombuffer(offsets, "<i8"), np.frombuffer(counts, "<i8")
        self.ids, self.missing = np.frombuffer(ids, "<i8"), np.frombuffer(missing, bool)
        self.payload = payload

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is here (by fingerprint), and its offset and count of ids."""
        at = self._hash(keys)
        prints = (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")
        here = (at >= 0) & (len(self._prints) > 0)
        here[here] = self._prints[at[here]] == prints[here]
        return here, np.where(here, self._offsets[at] if len(self._offsets) else 0, -1), np.where(here, self._counts[at] if len(self._counts) else 0, 0)

    def tokens(self, offset: int, count: int) -> memoryview:
        return memoryview(self.payload)[4 * offset:4 * (offset + count)]


FILE_TYPES = "part int, shard int, first_id long, last_id long, n_docs long, n_ids long, index binary, payload binary"


def _shards(path: str, shard_ids: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        encode, part, shard = encoder(path).encode_column, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def written() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in texts], np.int64)
            known = [i for i in ids if i is not None]
            index = shard_index(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), lengths)
            row = [part, shard, min(known, default=None), max(known, default=None), len(ids), int(lengths.sum()), index, b"".join(texts)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in FILE_TYPES.split(", ")])

        for batch in slices(batches, "text", 1 << 19):
            tokens, at = encode(batch.column("text"))
            raw = tokens.astype("<u4").tobytes()
            for i, a, b in zip(batch.column("id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                blob = raw[4 * a:4 * b] + end
                # Rows of one id stay together, so that their keys can count them.
                if ids and size + len(blob) // 4 > shard_ids and i != ids[-1]:
                    yield written()
                    ids, texts, size, shard = [], [], 0, shard + 1
                ids.append(i)
                texts.append(blob)
                size += len(blob) // 4
        if ids:
            yield written()
    return run


def write_token_files(documents: DataFrame, path: str, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text",
                      shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> None:
    """Encode every text, end it with ``end_id`` and write all ids in ascending order of the documents' ids.

    The format: rows of one shard each (Parquet, so any store Spark writes to will do and failed tasks
    leave nothing behind). ``payload`` is the raw ids, 32 bits little-endian; ``index`` a minimal perfect hash from
    document keys to offsets with a fingerprint per document; ``part`` and ``shard`` order the shards, ``first_id`` and
    ``last_id`` let a reader skip. Null texts are empty, null ids come first, and repeated rows of an id follow each other.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange(spread(documents), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    # Row groups of a few shards: neither writer nor reader holds a whole file of them.
    (ordered.mapInArrow(_shards(tokenizer, shard_ids, end_id), FILE_TYPES).write
     .options(**{"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"})
     .parquet(path))


def _starts(files: DataFrame) -> DataFrame:
    """(part, shard, base): the ids before each shard; parts are summed first, then shards within their part."""
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    inside = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    return inside.join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            payload = batch.column("payload")[i].as_buffer()
            shard = Shard(batch.column("index")[i].as_buffer(), payload)
            here, offsets, counts = shard.find(document_keys(shard.ids, shard.missing))
            if not here.all():
                raise ValueError("a document of the shard is not in its index")
            n = len(offsets)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("part")[i].as_py(), n), pa.int32()), pa.array(np.repeat(batch.column("shard")[i].as_py(), n), pa.int32()),
                pa.array(shard.ids, pa.int64(), mask=shard.missing), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([zlib.crc32(shard.tokens(a, c)) for a, c in zip(offsets.tolist(), counts.tolist(), strict=True)], pa.int64())],
                names=["part", "shard", "id", "offset", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, *, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, each looked up through its shard's index."""
    files = spark.read.parquet(path)
    found = files.select("part", "shard", "index", "payload").mapInArrow(
        _documents, "part int, shard int, id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(_starts(files), ["part", "shard"]).select(
        F.col("id").alias(id_column), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(id, tokens) of a few documents: shards that cannot hold them are skipped, the others answer by index."""
    wanted = np.array(sorted(set(ids)), np.int64)
    keys = document_keys(wanted, np.zeros(len(wanted), bool))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("index")[i].as_buffer(), batch.column("payload")[i].as_buffer())
                here, offsets, counts = shard.find(keys)
                # A fingerprint may agree by chance: the stored id decides.
                at = [k for k in np.flatnonzero(here) if wanted[k] in shard.ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array(wanted[at], pa.int64()),
                    pa.array([np.frombuffer(shard.tokens(offsets[k], counts[k]), "<u4").astype(np.int64) for k in at], pa.list_(pa.int64()))], names=["id", "tokens"])

    near = F.lit(False)
    for i in wanted.tolist():
        near = near | F.lit(i).between(F.col("first_id"), F.col("last_id"))
    return spark.read.parquet(path).where(near).select("index", "payload").mapInArrow(run, "id long, tokens array<long>")
