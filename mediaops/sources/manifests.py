"""Programs out of the manifest blocks of scripts, and blocks out of programs.

A block is fenced by two comment lines; between them every comment line says one thing about the program:
``# name: ...``, ``# schedule: ...``, ``# src: ...``, ``# ext: a,b`` and, in order, ``# rule: ...``. All else in a script is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.rules import parse_rule_lines, render_rule_line
from .programs import DEFAULT_EXTENSIONS

OPEN, CLOSE = "# >>> mediaops:manifest v1 >>>", "# <<< mediaops:manifest <<<"
#: What a manifest says; of those that are repeated the last counts.
FIELDS = ["name", "schedule", "src", "ext"]
_BLANK = r"^\s+|\s+$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def manifest_lines(scripts: DataFrame, script: str = "script_id", text: str = "text", *, opens: str = OPEN, closes: str = CLOSE) -> DataFrame:
    """(script, line_no, field, value, fence) of the first block of each script.

    The block begins at the first opening fence and ends at the first closing one after it. ``line_no`` counts the script's
    lines from 1. Each script has one more row, without field, whose ``fence`` says what is wrong with the block: ``no_block``,
    ``block_not_closed`` or NULL.
    """
    placed = scripts.select(F.col(script).alias("_script"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "_open", F.locate(opens, F.col("_text"))).withColumn(
        "_after", F.substr(F.col("_text"), F.col("_open") + len(opens))).withColumn("_close", F.when(F.col("_open") > 0, F.locate(closes, F.col("_after"))))
    fence = F.when(F.col("_open") == 0, F.lit("no_block")).when(F.col("_close") == 0, F.lit("block_not_closed"))
    first = F.size(F.split(F.substr(F.col("_text"), F.lit(1), F.col("_open")), "\n"))
    inside = F.when(F.col("_close") > 0, F.split(F.substr(F.col("_after"), F.lit(1), F.col("_close") - 1), "\n")).otherwise(F.array().cast("array<string>"))
    listed = placed.select("_script", fence.alias("fence"), first.alias("_first"),
                           F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("raw"))),
                                              F.transform(inside, lambda raw, at: F.struct(at.alias("at"), raw.alias("raw"))))).alias("_line"))
    comment = _trim(F.regexp_replace(_trim(F.col("_line.raw")), "^#", ""))
    colon = F.instr(F.col("_comment"), ":")
    told = listed.withColumn("_comment", comment).select(
        F.col("_script").alias(script), F.when(F.col("_line.at") >= 0, F.col("_first") + F.col("_line.at")).alias("line_no"),
        F.when(colon > 0, _trim(F.substr(F.col("_comment"), F.lit(1), colon - 1))).otherwise(F.col("_comment")).alias("field"),
        F.when(colon > 0, _trim(F.substr(F.col("_comment"), colon + 1))).otherwise(F.lit("")).alias("value"),
        "fence", F.col("_line.raw").alias("_raw"))
    return told.filter(F.col("_raw").isNull() | _trim(F.col("_raw")).startswith("#")).drop("_raw")


def parse_manifests(scripts: DataFrame, script: str = "script_id", text: str = "text", *, opens: str = OPEN, closes: str = CLOSE) -> DataFrame:
    """One row per script: (script, name, schedule, src, ext, rules, errors), ready to assign and run.

    ``errors`` lists (line_no, error, text) of all that is wrong, in order of the lines; a script is a program only where the list is empty. What concerns no line
    comes first, with a NULL line: ``no_block``, ``block_not_closed``, ``missing_src``. Rules in error are not among ``rules``, which are as
    ``read_programs`` gives them. An absent or empty ``ext`` means the default extensions. A NULL text has no block; rows of one
    script id are one script and should be one row.
    """
    lines = manifest_lines(scripts, script, text, opens=opens, closes=closes)
    parsed = parse_rule_lines(lines, "value")
    is_rule = F.col("field") == "rule"

    def last(field: str) -> Column:
        return F.max_by(F.when(F.col("field") == field, F.col("value")), F.when((F.col("field") == field) & ((F.col("value") != "") | (F.lit(field) != "ext")), F.col("line_no")))

    rule = F.struct("line_no", F.struct("when", F.struct("cmd", "args").alias("do")).alias("rule"))
    problem = F.when(F.col("field").isNull(), F.col("fence")).when(is_rule, F.col("error"))
    located = F.struct(F.col("line_no"), problem.alias("error"), F.when(is_rule, F.col("value")).alias("text"))
    found = parsed.groupBy(script).agg(
        *[last(f).alias(f) for f in FIELDS],
        F.sort_array(F.collect_list(F.when(is_rule & F.col("error").isNull(), rule))).alias("_rules"),
        F.sort_array(F.collect_list(F.when(problem.isNotNull(), located))).alias("errors"), F.max("fence").alias("_fence"))
    unplaced = F.when(F.col("_fence").isNull() & (F.coalesce("src", F.lit("")) == ""), F.array(
        F.struct(F.lit(None).cast("int").alias("line_no"), F.lit("missing_src").alias("error"), F.lit(None).cast("string").alias("text"))))
    extensions = F.split(F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lit(DEFAULT_EXTENSIONS)), ",")
    return found.select(
        script, *[F.coalesce(f, F.lit("")).alias(f) for f in ("name", "schedule", "src")], extensions.alias("ext"),
        F.transform("_rules", lambda r: r["rule"]).cast(schemas.RULES).alias("rules"),
        F.when(unplaced.isNull(), F.col("errors")).otherwise(F.concat(unplaced, "errors")).alias("errors"))


def manifest_errors(parsed: DataFrame, script: str = "script_id") -> DataFrame:
    """(script, line_no, error, text): a row for each thing wrong with a manifest."""
    return parsed.select(script, F.explode("errors").alias("_e")).select(script, "_e.line_no", "_e.error", "_e.text")


def render_manifest(name: Column, schedule: Column, src: Column, ext: Column, rules: Column, *, opens: str = OPEN, closes: str = CLOSE) -> Column:
    """The block of a program; ``parse_manifests`` gives the same program back. NULL texts are empty."""
    said = lambda field, value: F.concat(F.lit(f"# {field}: "), F.coalesce(value, F.lit("")))
    lines = F.transform(rules, lambda r: F.concat(F.lit("# rule: "), render_rule_line(
        F.coalesce(r["when"], F.array().cast(schemas.CONDITIONS)), r["do"]["cmd"], F.coalesce(r["do"]["args"], F.array().cast(schemas.TEXTS)))))
    head = F.array(F.lit(opens), said("name", name), said("schedule", schedule), said("src", src), said("ext", F.array_join(ext, ",")))
    return F.array_join(F.concat(head, lines, F.array(F.lit(closes))), "\n")
