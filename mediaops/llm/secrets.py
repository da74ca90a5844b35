"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .hashing import slices

_ASSIGN = re.compile(r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the models judge, whatever it is made of; rules drawn with a repeated mark count as one mark.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DRAWN = re.compile(r"([+/_=-])\1+")
SMOOTHING = 0.2
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = {c: i for i, c in enumerate(ALPHABET)}
SPAN_TYPES = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@dataclass(frozen=True)
class Models:
    """``ratio[a, b]``: log P(b after a | random) - log P(b after a | ordinary), the last row for beginnings."""
    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character; above the threshold the token looks random."""
        at = np.array([_AT[c] for c in token])
        return float(self.ratio[np.concatenate([[len(ALPHABET)], at[:-1]]), at].mean())


def random_strings(count: int, seed: int = 7) -> Iterator[str]:
    """Labelled examples of random strings in the shapes keys come in."""
    draw = random.Random(seed)
    shapes = (ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], "0123456789abcdef", ALPHABET)
    for i in range(count):
        yield "".join(draw.choices(shapes[i % len(shapes)], k=draw.randint(16, 64)))


def ordinary_strings(texts: DataFrame, text_column: str = "text", rows: int = 20_000) -> DataFrame:
    """(token): words of at most ``rows`` rows, drawn by a hash of the text, and identifiers made of them, as examples that are no secrets."""
    words = F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    word = F.col("word")
    number = F.pmod(F.xxhash64(word), F.lit(2100)).cast("string")
    made = F.array(word, F.upper(word), F.concat(word, F.initcap(word)), F.concat(word, F.lit("_"), number), F.concat(F.upper(word), F.lit("-"), number))
    # Of more rows than that, those of the least hashes: the same ones in every run.
    some = texts.orderBy(F.xxhash64(F.col(text_column).cast("string")), F.col(text_column).cast("string")).limit(rows)
    return some.select(F.explode(words).alias("word")).select(F.explode(made).alias("token"))


def train(samples: DataFrame, threshold: float = 0.8) -> Models:
    """Fit the two models to labelled ``samples`` (token string, random boolean).

    Transitions are counted by Spark; what the driver sees is at most one count per label and
    pair of characters. Counts start at a small number, so without samples all ratios are 0.
    """
    size = len(ALPHABET)
    token = F.concat(F.lit("^"), F.col("token"))
    pairs = samples.where("token is not null and random is not null").select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substr(token, i, F.lit(2)))).alias("pair"))
    counts = np.full((2, size + 1, size), SMOOTHING)
    for label, pair, n in pairs.groupBy("random", "pair").count().collect():
        if len(pair) == 2 and pair[1] in _AT and (pair[0] in _AT or pair[0] == "^"):
            counts[int(label), _AT.get(pair[0], size), _AT[pair[1]]] += n
    chance = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Models(chance[1] - chance[0], threshold)


def default_models(spark: SparkSession, ordinary: DataFrame, strings: int = 4000) -> Models:
    """Models from seeded random strings against ``ordinary`` (token)."""
    made = spark.createDataFrame([(s, True) for s in random_strings(strings)], "token string, random boolean")
    return train(made.unionByName(ordinary.select("token", F.lit(False).alias("random"))))


def spans_of(text: str, models: Models | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret in code points, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if models is not None:
        taken = sorted((a, b) for a, _, b in found)
        k = 0
        for m in _CANDIDATE.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            token = _DRAWN.sub(r"\1", m[0])
            free = k == len(taken) or taken[k][0] >= m.end()
            # A token of four or fewer different characters repeats itself: chance makes one in millions.
            if free and len(set(token)) > 4 and models.score(token) > models.threshold:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[kind], b) for a, kind, b in sorted(found)]


def find_secrets(documents: DataFrame, models: Models | None, *, text_column: str = "text") -> DataFrame:
    """``documents`` with the array ``secrets`` of (kind, start, end) in code points, by start.

    Kinds ``assign``, ``access`` and ``hex`` are fixed patterns; ``markov`` are further tokens of at least
    16 characters, outside those, that the random-string model explains better by more than the
    threshold per character. A null text has no secrets; every row is kept, a column named ``secrets`` is replaced.
    """
    documents = documents.drop("secrets")
    schema = StructType([*documents.schema.fields, StructField("secrets", SPAN_TYPES)])

    def run(batches):
        for batch in slices(batches, text_column):
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in spans_of(t or "", models)] for t in batch.column(text_column).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "secrets"])

    return documents.mapInArrow(run, schema)


def digest(documents: DataFrame, models: Models | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the id, spans per kind, a hash of the fixed patterns' spans, and all spans as text."""
    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = spans_of(text or "", models)
                kinds = [k for _, k, _ in spans]
                written = [f"{k}:{a}:{b}" for a, k, b in spans]
                base = ",".join(w for w, k in zip(written, kinds, strict=True) if k != "markov")
                rows.append((*(kinds.count(k) for k in KINDS[:3]), sha256(base.encode()).hexdigest(), ",".join(written), kinds.count("markov")))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    names = [id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(documents: DataFrame, models: Models | None, *, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``documents`` with every secret in the text replaced by ``mark``; overlapping ones by one mark."""
    schema = documents.schema

    def hidden(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in spans_of(text, models) if text else ():
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return text if at == 0 else "".join([*out, text[at:]])

    def run(batches):
        for batch in slices(batches, text_column):
            k = batch.schema.get_field_index(text_column)
            yield batch.set_column(k, batch.schema.field(k), pa.array([hidden(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type))

    return documents.mapInArrow(run, schema)
