"""Quality rules: text statistics and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_text import SPACES, count_of, evaluated_once, normal_line, word_array, word_count
from .work import keep

SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
KEY = ["_host", "_id", "_hash"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _repeated_words(words: Column) -> Column:
    """Words lying in a 3-word window that occurs at least twice in ``words``."""
    def covered(windows: Column) -> Column:
        sort = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = evaluated_once(sort, lambda placed: F.filter(placed, lambda x, k: (
            (k > 0) & (x.h == F.get(placed, k - 1).h)) | F.coalesce(x.h == F.get(placed, k + 1).h, F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    # Most texts repeat no window: only those that do pay for sorting their windows by position.
    return F.when(F.size(words) > 3, evaluated_once(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))).otherwise(0)


def text_statistics(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. A null text has none of anything."""
    text = _text(text_column)
    of_words = evaluated_once(word_array(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = evaluated_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return documents.withColumns({"_words": of_words, "n_dup_lines": of_lines.cast("long")}).withColumns({
        "n_words": F.col("_words.n_words"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS),
        "n_repeat_words": F.col("_words.n_repeat_words"),
    }).drop("_words")


def _keys(id_column: str, text_column: str, host_column: str) -> list[Column]:
    """Columns ``KEY``: rows with equal ones have the same id, host and text, so they get the same verdict.

    To be selected from the documents themselves, among whose columns may be some of these names.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return [named(host_column).alias("_host"), named(id_column).alias("_id"), F.xxhash64(_text(text_column)).alias("_hash")]


def _found_lines(documents: DataFrame, id_column: str, text_column: str, host_column: str, share: float, least: int) -> DataFrame:
    """(_host, _id, _hash, at, line, words): the lines of documents that their host repeats."""
    rows = documents.select(*_keys(id_column, text_column, host_column), F.posexplode(F.split(_text(text_column), "\n")).alias("at", "line"))
    lines = keep(rows.select(*KEY, "at", normal_line(F.col("line")).alias("line")).where("line <> ''")
                 .select(*KEY, "at", F.xxhash64("line").alias("line"), word_count(F.col("line")).alias("words")), "lines")
    hosts = lines.groupBy("_host").agg(F.countDistinct("_hash").alias("texts"))
    spread = lines.groupBy("_host", "line").agg(F.countDistinct("_hash").alias("in_texts"))
    common = (spread.where(F.col("in_texts") > least).join(hosts, "_host")
              .where(F.col("in_texts") > share * F.col("texts")).select("_host", "line"))
    # Repeated rows of a document bring the same lines at the same places.
    return lines.join(common, ["_host", "line"]).dropDuplicates([*KEY, "at"])


def _removals(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.collect_set("line").alias("lines"), F.sum("words").alias("n_removed_words"))


def line_removals(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                  host_column: str = "source", share: float = 0.01, least: int = 3) -> DataFrame:
    """(_host, _id, _hash, lines, n_removed_words): what documents lose to lines their host repeats.

    A line (normalised: spaces squeezed, A-Z lowered, compared by a 64-bit hash) goes when more than
    ``share`` of the host's documents hold it and more than ``least`` do, which small hosts reach as large ones do. Documents are counted as
    distinct texts, so copies of a text count once: a text repeated as a whole is for deduplication, not for this rule. Rows without host are a host of their own.
    """
    return _removals(_found_lines(documents, id_column, text_column, host_column, share, least))


def _spared(documents: DataFrame, found: DataFrame, id_column: str, text_column: str, host_column: str, depleted: float) -> DataFrame:
    """(_host, _id, _hash, line): lines that stay in a depleted document because no earlier depleted one holds them.

    Near copies deplete each other. Of each common line the depleted document of the smallest id is the first
    holder; a document that its first-held lines lift to the limit again keeps those. So the smallest id of a
    group of near copies survives, and what it shares with earlier, unlike documents still counts against it.
    """
    lost = found.groupBy(*KEY).agg(F.sum("words").alias("n_removed_words"))
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.xxhash64(_text(text_column)).alias("hash")).alias("_order")
    keyed = documents.select(*_keys(id_column, text_column, host_column), order, _text(text_column).alias("text"))
    measured = _judged(text_statistics(keyed.join(lost, KEY)), depleted).where("not base_failed and not kept")
    held = keep(found.join(measured.select(*KEY, "_order", "n_words", "n_removed_words").dropDuplicates(KEY), KEY), "depleted")
    first = held.groupBy("_host", "line").agg(F.min("_order").alias("_first"))
    own = held.join(first, ["_host", "line"]).where(F.col("_order") == F.col("_first"))
    lifted = own.groupBy(*KEY, "n_words", "n_removed_words").agg(F.sum("words").alias("own"), F.collect_set("line").alias("lines"))
    return lifted.where(F.col("n_removed_words") - F.col("own") <= depleted * F.col("n_words")).select(*KEY, F.explode("lines").alias("line"))


def quality_verdicts(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                     share: float = 0.01, least: int = 3, depleted: float = 0.7) -> DataFrame:
    """Per row: the id, the statistics, ``base_failed``, ``n_removed_words`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. ``kept``:
    not that, and at most the share ``depleted`` of the words lies in lines that go. Null and empty
    texts fail; repeated rows each give a row; other columns of ``documents`` play no part.
    """
    removals = line_removals(documents, id_column=id_column, text_column=text_column, host_column=host_column,
                             share=share, least=least)
    keyed = documents.select(F.col(id_column).alias("_own"), *_keys(id_column, text_column, host_column), _text(text_column).alias("_body"))
    measured = text_statistics(keyed, "_body").select("_own", *KEY, *STATISTICS)
    judged = _judged(measured.join(removals.select(*KEY, "n_removed_words"), KEY, "left"), depleted).drop(*KEY)
    return judged.select(F.col("_own").alias(id_column), *[c for c in judged.columns if c != "_own"])


def quality_filter(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                   share: float = 0.01, least: int = 3, depleted: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that are kept, without the lines their host repeats too often.

    One more document of each group of near copies than ``quality_verdicts`` keeps stays: see ``_spared``.
    """
    found = keep(_found_lines(documents, id_column, text_column, host_column, share, least), "found")
    spared = _spared(documents, found, id_column, text_column, host_column, depleted)
    removals = _removals(found.join(spared, [*KEY, "line"], "left_anti"))
    # The rows travel as one column, so that no column of theirs meets one of the statistics.
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    keyed = documents.select(*_keys(id_column, text_column, host_column), row, _text(text_column).alias("text"))
    kept = _judged(text_statistics(keyed.join(removals, KEY, "left"), "text"), depleted).where("kept")
    rest = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("lines", F.xxhash64(normal_line(x))))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return kept.select(*[text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in documents.columns])


def _judged(measured: DataFrame, depleted: float) -> DataFrame:
    lost = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"n_removed_words": lost, "base_failed": failed}).withColumn(
        "kept", ~failed & (F.col("n_removed_words") <= depleted * F.col("n_words")))
