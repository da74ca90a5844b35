"""Passages of many words that stand in more than one document, by anchored runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .hashing import Sequences, Spans, slices, strings, words
from .work import keep

#: Words of the gram that anchors a window.
GRAM = 8


def _word_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a batch and each row's first word (with an end)."""
    data, offsets = strings(batch.column("text"))
    start, end, rows = words(data, offsets)
    return Spans(data).hash(start, end), rows


def _found_runs(least: int):
    def run(batches):
        for batch in slices(batches, "text"):
            word, rows = _word_hashes(batch)
            row, first, last, _, gram, form = runs(word, rows, least, min(GRAM, least), Sequences)
            begin = rows[row]
            ids, marks = (batch.column(c).to_numpy()[row] for c in ("id", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids, marks, gram.view(np.int64), form.view(np.int64), first - begin, last - begin)],
                names=["id", "mark", "key", "form", "first", "last"])
    return run


WINDOWS = ["window", "id", "mark", "at", "low", "high"]
WINDOW_TYPES = "window long, id long, mark long, at long, low long, high long"


def _windows(least: int):
    """The hash of every window of the wanted runs."""
    def run(batches):
        for batch in slices(batches, "text"):
            word, rows = _word_hashes(batch)
            sequences = Sequences(word)
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            first, last, low, high = (wanted.flatten().field(c).to_numpy() for c in ("first", "last", "low", "high"))
            count = last - first + 1
            of = np.repeat(np.arange(len(first)), count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            start = at + rows[row[of]]
            window = sequences.hash(start, start + least).view(np.int64)
            ids, marks = (batch.column(c).to_numpy()[row[of]] for c in ("id", "mark"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window, ids, marks, at, low[of], high[of])], names=WINDOWS)
    return run


def shared_ranges(documents: DataFrame, least: int = 51) -> DataFrame:
    """(id, mark, first, last): words at which a sequence of ``least`` words begins that another document has too.

    ``documents`` has (id, mark, text), id and mark naming a document. As in ``repeats``, windows fall into runs with a
    common anchor. Only runs whose anchor gram several documents have go on. A form of a run that several documents have is
    shared as a whole; the windows of forms that one document alone has are counted with one row of each other form of the gram.
    """
    found = documents.mapInArrow(_found_runs(least), "id long, mark long, key long, form long, first long, last long")
    who = F.xxhash64("id", "mark")
    low, high = F.min(who).alias("low"), F.max(who).alias("high")
    met = keep(found.groupBy("key").agg(low, high).where("low < high").select("key"), "grams")
    some = keep(found.join(met, "key"), "passages")
    forms = keep(some.groupBy("key", "form").agg(low, high, *[F.first(c).alias(c) for c in ("id", "mark", "first", "last")]), "passage_forms")
    whole = some.join(forms.where("low < high").select("key", "form"), ["key", "form"]).select("id", "mark", "first", "last")
    alone = some.join(forms.where("low = high").select("key", "form", "low", "high"), ["key", "form"])
    others = forms.where("low < high").join(forms.where("low = high").select("key").distinct(), "key")
    columns = ["id", "mark", "first", "last", "low", "high"]
    wanted = alone.select(*columns).union(others.select(*columns)).groupBy("id", "mark").agg(
        F.collect_set(F.struct("first", "last", "low", "high")).alias("wanted"))
    windows = keep(documents.join(wanted, ["id", "mark"]).mapInArrow(_windows(least), WINDOW_TYPES), "passage_windows")
    shared = windows.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("window")
    single = windows.where("low = high").join(shared, "window").select("id", "mark", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.union(single)


def shared_words(documents: DataFrame, least: int = 51) -> DataFrame:
    """(id, mark, n_shared_words): how many words of a document lie in passages of ``least`` words that another document has too.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. Another document has another id or another text, so repeated rows
    of one document do not share with each other. Documents that share nothing have no row.
    """
    ranges = F.array_sort(F.collect_set(F.struct("first", "last")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))

    def add(done, r):
        end = r["last"] + F.lit(least).cast("long")
        return F.struct((done["n"] + F.greatest(end - F.greatest(r["first"], done["until"]), F.lit(0).cast("long"))).alias("n"),
                        F.greatest(end, done["until"]).alias("until"))

    counts = shared_ranges(documents, least).groupBy("id", "mark").agg(F.aggregate(ranges, start, add, lambda x: x["n"]).alias("n_shared_words"))
    return keep(counts, "shared_words")
