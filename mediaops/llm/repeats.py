"""Repeated byte strings across all documents, by column-wise sorting of aligned suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .hashing import Spans, mix, slices, strings
from .passages import shared_words
from .work import keep, spread

#: Windows of one part when a group of aligned strings is large, and how many strings make it so.
PART, LARGE = 32, 256
#: Aligned strings that a task sorts at a time (more only to finish a group).
SORTED_ROWS = 8192


def repeated_columns(group: np.ndarray, low: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray,
                     length: int) -> Iterator[tuple[np.ndarray, int]]:
    """Column by column, the strings whose ``length`` bytes from there stand in another string of their group too.

    String ``i`` has ``size[i]`` bytes at ``start[i]`` of ``data`` and begins in column ``low[i]``; groups are sorted. From the last
    column to the first, each round puts one symbol before every string. The suffixes stay sorted by a stable sort on
    that symbol, and what neighbours have in common is one more than the least they had between their old places.
    """
    last = low + size - 1
    entering = np.argsort(-last, kind="stable")
    entered, order, common = 0, np.zeros(0, np.int64), np.zeros(0, np.int32)
    for column in range(int(last.max(initial=-1)), int(low.min(initial=0)) - 1, -1):
        until = entered
        while until < len(entering) and last[entering[until]] == column:
            until += 1
        if until > entered:
            new, entered = entering[entered:until], until
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), common])
            at = np.argsort(group[order], kind="stable")
            order, common = order[at], common[at]
        place = np.flatnonzero(low[order] <= column)
        alive = order[place]
        symbol = group[alive] * 256 + data[start[alive] + (column - low[alive])]
        at = np.argsort(symbol, kind="stable")
        place, symbol = place[at], symbol[at]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        spans = np.empty(2 * len(same), np.int64)
        spans[0::2], spans[1::2] = place[same] + 1, place[same + 1] + 1
        order, before = order[place], np.append(common, np.int32(0))
        common = np.zeros(len(order), np.int32)
        if len(same):
            common[same + 1] = np.minimum.reduceat(before, spans)[0::2] + 1
        found = common >= length
        if found.any():
            found[:-1] |= found[1:]
            yield order[found], column


RANGE_TYPES = "id long, mark long, first long, last long"


def _ranges(ids: np.ndarray, marks: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (ids, marks, first, last)], names=["id", "mark", "first", "last"])


def _sorted_groups(length: int):
    """Ranges of repeated windows from rows sorted by ``key``; whole groups are sorted together."""
    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        number = lambda c: rows.column(c).to_numpy()
        key, low = number("key"), number("first") - number("anchor")
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        data, offsets = _bytes(rows.column("bytes").combine_chunks())
        members, columns = [], []
        for some, column in repeated_columns(group, low, data, offsets[:-1], np.diff(offsets), length):
            members.append(some)
            columns.append(np.full(len(some), column))
        if not members:
            return None
        member, column = np.concatenate(members), np.concatenate(columns)
        at = np.lexsort((column, member))
        member, column = member[at], column[at]
        begins = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (column[1:] != column[:-1] + 1)]))
        ends = np.append(begins[1:], len(member)) - 1
        who = member[begins]
        return _ranges(number("id")[who], number("mark")[who], column[begins] + number("anchor")[who], column[ends] + number("anchor")[who])

    def run(batches):
        waiting, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            count += batch.num_rows
            if count >= SORTED_ROWS:
                rows = pa.Table.from_batches(waiting)
                keys = rows.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    if (out := solve(rows.slice(0, cut))) is not None:
                        yield out
                    waiting, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if waiting and (out := solve(pa.Table.from_batches(waiting))) is not None:
            yield out
    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return strings(column.cast(pa.large_binary()).view(pa.large_string()))


def _found_runs(length: int):
    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            row, first, last, anchor, gram, form = runs(data, offsets, length)
            begin = offsets[row]
            ids, marks = (batch.column(c).to_numpy()[row] for c in ("id", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids, marks, gram.view(np.int64), form.view(np.int64), first - begin, last - begin, anchor - begin)],
                names=["id", "mark", "key", "form", "first", "last", "anchor"])
    return run


def _cut_out(length: int):
    """The bytes of the wanted runs of each document."""
    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for id_, mark, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "text", "wanted")), strict=True):
                raw = text.encode()
                out += [(w["key"], w["form"], id_, mark, w["first"], w["last"], w["anchor"], w["forms"], raw[w["first"]:w["last"] + length]) for w in wanted]
            yield _aligned(out)
    return run


ALIGNED = ["key", "form", "id", "mark", "first", "last", "anchor", "forms", "bytes"]
ALIGNED_TYPES = "key long, form long, id long, mark long, first long, last long, anchor long, forms long, bytes binary"


def _aligned(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(ALIGNED)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for n, c in zip(ALIGNED, columns, strict=True)], names=ALIGNED)


def _parts(length: int, part: int):
    """Aligned strings cut into parts of ``part`` windows, keyed by what all windows of the part have in common."""
    def run(batches):
        for batch in slices(batches, "bytes", 1 << 18):
            data, offsets = _bytes(batch.column("bytes"))
            spans = Spans(data)
            key, id_, mark, first, last, anchor = (batch.column(c).to_numpy() for c in ("key", "id", "mark", "first", "last", "anchor"))
            block_low, block_high = (first - anchor) // part, (last - anchor) // part
            count = block_high - block_low + 1
            row = np.repeat(np.arange(len(key)), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + block_low[row]
            since = np.maximum(first[row], block * part + anchor[row])
            until = np.minimum(last[row], block * part + part - 1 + anchor[row])
            at = offsets[row] - first[row]
            shared = spans.hash(at + anchor[row] + block * part + part - 1, at + anchor[row] + block * part + length)
            own = mix(spans.hash(at + since, at + until + length) + (since - anchor[row]).astype(np.uint64))
            new = mix(mix(key[row].view(np.uint64) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ shared)
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip((at + since).tolist(), (at + until + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (new.view(np.int64), own.view(np.int64), id_[row], mark[row], since, until, anchor[row], np.zeros(len(row), np.int64))),
                 pa.array(cut, pa.binary())], names=ALIGNED)
    return run


def _repeated_rows(rows: DataFrame) -> DataFrame:
    """Ranges of the rows whose ``key`` and ``form`` stand in more than one row."""
    twice = keep(rows.groupBy("key", "form").count().where("count > 1").select("key", "form"), "twice")
    return rows.join(twice, ["key", "form"]).select("id", "mark", "first", "last")


def _sort(aligned: DataFrame, length: int) -> DataFrame:
    dealt = aligned.select("key", "id", "mark", "first", "anchor", "bytes").repartition(spread(aligned), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_sorted_groups(length), RANGE_TYPES)


def repeated_ranges(documents: DataFrame, length: int = 400) -> DataFrame:
    """(id, mark, first, last): places where a string of ``length`` bytes begins that also begins elsewhere.

    ``documents`` has (id, mark, text), id and mark naming a text. Windows fall into runs with a common anchor (see ``runs``),
    and equal windows into runs with equal anchor grams:

    * runs that are equal as a whole are found by counting their hashes, so copies cost one row each and
      only the different forms of a gram go on;
    * the forms of a gram, aligned at it, are sorted column by column, and neighbours with ``length`` bytes
      in common are repeated (``repeated_columns``);
    * where more than ``LARGE`` forms meet, they are cut into parts of ``PART`` windows keyed by the bytes all of these
      contain: parts equal as a whole are counted, small groups are sorted, and in groups that are large even so single
      windows are counted. No group is met by one task whole, whatever its size, and none is cut short.
    """
    found = keep(documents.mapInArrow(_found_runs(length), "id long, mark long, key long, form long, first long, last long, anchor long"), "runs")
    columns = ["id", "mark", "first", "last", "anchor"]
    forms = keep(found.groupBy("key", "form").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in columns]), "forms")
    copies = found.join(forms.where("times > 1").select("key", "form"), ["key", "form"]).select("id", "mark", "first", "last")
    several = forms.groupBy("key").agg(F.count("*").alias("forms")).where("forms > 1")
    wanted = (forms.join(several, "key").groupBy("id", "mark")
              .agg(F.collect_list(F.struct("key", "form", "first", "last", "anchor", "forms")).alias("wanted")))
    aligned = keep(documents.join(wanted, ["id", "mark"]).mapInArrow(_cut_out(length), ALIGNED_TYPES), "aligned")
    near = _sort(aligned.where(F.col("forms") <= LARGE), length)

    parts = keep(aligned.where(F.col("forms") > LARGE).mapInArrow(_parts(length, PART), ALIGNED_TYPES), "parts")
    same_parts = _repeated_rows(parts)
    shapes = keep(parts.groupBy("key", "form").count().groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "shapes")
    met = parts.join(shapes, "key")
    small = met.where(F.col("met") <= LARGE).dropDuplicates(["key", "form"])
    windows = keep(met.where(F.col("met") > LARGE).select(*ALIGNED).mapInArrow(_parts(length, 1), ALIGNED_TYPES).drop("bytes"), "windows")
    ranges = [copies, near, same_parts, _sort(small, length), _repeated_rows(windows)]
    whole = ranges[0]
    for more in ranges[1:]:
        whole = whole.unionByName(more)
    return keep(whole, "ranges")


def _removed(length: int, more: list[str]):
    def run(batches):
        for batch in slices(batches, "text"):
            sizes, removed, spans, kept = [], [], [], []
            for text, firsts, lasts in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "lasts")), strict=True):
                raw = text.encode()
                pieces, at, gone, count = [], 0, 0, 0
                covered = -1
                for first, last in sorted(zip(firsts or (), lasts or (), strict=True)):
                    if first > covered:
                        pieces.append(raw[at:first])
                        count += 1
                        gone -= first
                        covered = at = last + length
                        gone += covered
                    elif last + length > covered:
                        gone += last + length - covered
                        covered = at = last + length
                pieces.append(raw[at:])
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(count)
                kept.append(sha256(b"".join(pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept), *map(batch.column, more)],
                                             names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more])
    return run


def remove_repeats(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = 400,
                   passage_words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row, without bytes lying in a repeated string of ``length`` bytes.

    Texts are UTF-8 bytes and matches never cross documents; strings are judged on the input. A null text is
    empty; rows without id count like others, and repeated rows of a document repeat each other, so all of
    a text of ``length`` bytes or more goes in each. An empty table gives no rows. With ``passage_words``, the column
    n_shared_words counts the words in passages of so many words that another document has too, whatever their bytes
    (``passages.shared_words``); nothing is removed for it.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("id"),
                            F.xxhash64(F.col(id_column).isNull(), text).alias("mark"), text.alias("text"))
    texts = docs.select("id", "mark", "text")
    more = [] if passage_words is None else ["n_shared_words"]
    shared = [shared_words(texts, passage_words) for _ in more]
    ranges = repeated_ranges(texts, length)
    by_doc = ranges.distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = docs.join(by_doc.select("id", "mark", F.col("ranges.first").alias("firsts"), F.col("ranges.last").alias("lasts")), ["id", "mark"], "left")
    for counts in shared:
        joined = joined.join(counts, ["id", "mark"], "left").fillna(0, more)
    out = joined.select("doc", "text", "firsts", "lasts", *more).mapInArrow(
        _removed(length, more), ", ".join(["doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(f"{c} long" for c in more)]))
    return out.withColumnRenamed("doc", id_column)
