"""Rule programs: ordered conditions, the first full match decides.

A program known to the job is compiled into one CASE expression
(:func:`apply_program`). Programs that are data, one per row, are evaluated by
higher-order functions over their rules array (:func:`apply_rules_column`), so a
file meets its program in an equi-join and never every rule in a product.

Attributes are NULL after a failed probe. SQL's unknown then means *no match*,
also for ``ne``, while an empty codec is a value that ``ne`` does match.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.columns import all_of, as_column, is_true, parse_decimal, parse_integer
from ..schemas import CONDITIONS
from .joins import lookup_join

# The comparisons each field supports, and the column it reads.
VALID_OPS = {
    "codec": ["eq", "ne"],
    "audio": ["eq", "ne"],
    "ext": ["eq", "ne"],
    "height": ["ge", "gt", "le", "lt"],
    "width": ["gt", "lt"],
    "bitrate": ["gt", "lt"],
    "duration": ["gt", "lt"],
}
FIELD_COLUMNS = {
    "codec": "video_codec",
    "audio": "audio_codec",
    "ext": "ext",
    "height": "height",
    "width": "width",
    "bitrate": "bitrate",
    "duration": "duration",
}
TEXT_FIELDS = ["codec", "audio", "ext"]
INTEGER_FIELDS = ["height", "width", "bitrate"]
TRACKED_ACTIONS = ["transcode"]
RUN_ACTIONS = ["transcode", "check"]

COMPARISONS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "ge": lambda a, b: a >= b,
    "le": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Rule:
    cmd: str
    args: list[str] = field(default_factory=list)
    when: list[Cond] = field(default_factory=list)


def rules_from_json(text: str | None) -> list[Rule]:
    """Rules of a stored program; empty text or ``[]`` mean no rules."""
    parsed = json.loads(text) if text else []
    return [
        Rule(r["do"]["cmd"], r["do"].get("args") or [], [Cond(**c) for c in r.get("when") or []])
        for r in parsed or []
    ]


def cond(field_name: str, op: str, value: str) -> Column:
    """One condition as a boolean Column over the attribute columns."""
    if op not in VALID_OPS.get(field_name, []):
        raise ValueError(f"condition {field_name!r} {op!r} is not supported; supported: {VALID_OPS}")
    compare = COMPARISONS[op]
    attribute = F.col(FIELD_COLUMNS[field_name])
    literal = F.lit(str(value))
    if field_name == "ext":
        return compare(F.lower(attribute), F.lower(literal))
    if field_name in TEXT_FIELDS:
        return compare(attribute, literal)
    number = parse_integer(literal) if field_name in INTEGER_FIELDS else parse_decimal(literal)
    return compare(attribute, number)


def match_all(conditions: list[Cond]) -> Column:
    """AND of the conditions, true when there are none."""
    return is_true(all_of(cond(c.field, c.op, c.value) for c in conditions))


def action_outcome(cmd: Column) -> Column:
    """What becomes of a file's job: run and tracked, run only, or left untouched."""
    return (
        F.when(cmd.isin(TRACKED_ACTIONS), F.lit("tracked"))
        .when(cmd.isin(RUN_ACTIONS), F.lit("untracked"))
        .otherwise(F.lit("skipped"))
    )


def apply_program(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule_ix``, ``cmd`` and ``args`` of the first rule that fully matches.

    A rule without conditions matches everything and ends the program. Files that
    nothing matches keep NULLs. One projection, no shuffle.
    """
    chosen: Column | None = None
    for ix, rule in enumerate(rules):
        matched = match_all(rule.when)
        chosen = F.when(matched, F.lit(ix)) if chosen is None else chosen.when(matched, F.lit(ix))
        if not rule.when:
            break
    rule_ix = F.lit(None).cast("int") if chosen is None else chosen
    if not rules:
        return files.withColumns({
            "rule_ix": rule_ix, "cmd": F.lit(None).cast("string"), "args": F.lit(None).cast("array<string>"),
        })
    commands = F.array(*[F.lit(r.cmd) for r in rules])
    arguments = F.array(*[as_column(list(r.args)) for r in rules])
    return files.withColumn("rule_ix", rule_ix).withColumns({
        "cmd": F.get(commands, F.col("rule_ix")),
        "args": F.get(arguments, F.col("rule_ix")),
    })


def prepare_rules(rules: Column) -> Column:
    """Parsed rules with their numbers read once, ready for :func:`apply_rules_column`.

    Belongs on the program side of a join, where there is one row per program.
    """
    def prepared(c: Column) -> Column:
        text = F.when(c["field"] == "ext", F.lower(c["value"])).otherwise(c["value"])
        return F.struct(
            F.concat_ws(" ", c["field"], c["op"]).alias("test"), text.alias("text"),
            parse_integer(c["value"]).alias("whole"), parse_decimal(c["value"]).alias("real"),
        )

    return F.transform(rules, lambda rule, ix: F.struct(
        ix.cast("int").alias("rule_ix"), rule["do"]["cmd"].alias("cmd"),
        F.coalesce(rule["do"]["args"], F.array().cast("array<string>")).alias("args"),
        F.transform(F.coalesce(rule["when"], F.array().cast(CONDITIONS)), prepared).alias("tests"),
    ))


def _test_holds(c: Column) -> Column:
    """A prepared condition against the attribute columns of the same row."""
    picked = None
    for name, ops in VALID_OPS.items():
        attribute = F.lower("ext") if name == "ext" else F.col(FIELD_COLUMNS[name])
        value = c["text"] if name in TEXT_FIELDS else c["whole"] if name in INTEGER_FIELDS else c["real"]
        for op in ops:
            this, hit = c["test"] == f"{name} {op}", COMPARISONS[op](attribute, value)
            picked = F.when(this, hit) if picked is None else picked.when(this, hit)
    return picked


def apply_rules_column(files: DataFrame, rules: str = "rules") -> DataFrame:
    """Like :func:`apply_program`, with each row's prepared program in its own array."""
    matching = F.filter(F.col(rules), lambda rule: is_true(F.forall(rule["tests"], _test_holds)))
    return files.withColumn("_first", F.get(matching, F.lit(0))).select(
        *[c for c in files.columns if c != rules],
        F.col("_first.rule_ix").alias("rule_ix"), F.col("_first.cmd").alias("cmd"), F.col("_first.args").alias("args"),
    )


def rule_violations(programs: DataFrame, rules: str = "rules") -> DataFrame:
    """Conditions with an unknown field or a comparison the field does not support.

    ``programs`` needs ``id`` and the parsed rules array; all violations are listed.
    """
    listed = programs.select("id", F.posexplode(rules).alias("rule_ix", "_rule")).select(
        "id", "rule_ix", F.posexplode("_rule.when").alias("cond_ix", "_cond")
    )
    checked = listed.select(
        "id", "rule_ix", "cond_ix", "_cond.field", "_cond.op", "_cond.value",
        condition_problem(F.col("_cond.field"), F.col("_cond.op")).alias("problem"),
        valid_ops(F.col("_cond.field")).alias("valid_ops"),
    )
    return checked.filter(F.col("problem").isNotNull())


def program_violations(programs: DataFrame, rules: str = "rules") -> DataFrame:
    """All that keeps programs from being stored: (id, rule_ix, cond_ix, problem), in place of the first.

    ``missing_src`` and, where the rules text was no JSON, ``corrupt_rules`` concern the program as a whole.
    """
    whole = F.array_compact(F.array(
        F.when(F.coalesce("src", F.lit("")) == "", F.lit("missing_src")), F.when(F.col(rules).isNull(), F.lit("corrupt_rules"))))
    of_programs = programs.select("id", F.lit(None).cast("int").alias("rule_ix"), F.lit(None).cast("int").alias("cond_ix"), F.explode(whole).alias("problem"))
    return of_programs.unionByName(rule_violations(programs, rules).select("id", "rule_ix", "cond_ix", "problem"))


def valid_ops(field_name: Column) -> Column:
    """Comma list of the comparisons a field supports, sorted; NULL for an unknown field."""
    picked = None
    for name, ops in VALID_OPS.items():
        listed = F.lit(", ".join(ops))
        picked = F.when(field_name == name, listed) if picked is None else picked.when(field_name == name, listed)
    return picked


def condition_problem(field_name: Column, op: Column) -> Column:
    """``unknown_field``, ``invalid_op`` or NULL."""
    allowed = [f"{name} {o}" for name, ops in VALID_OPS.items() for o in ops]
    known = is_true(field_name.isin(list(VALID_OPS)))
    valid = is_true(F.concat_ws(" ", field_name, op).isin(allowed))
    return F.when(~known, F.lit("unknown_field")).when(~valid, F.lit("invalid_op"))


def parse_rule_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Rule text ``[when F O V [and F O V ...]] do ACTION [args ...]`` into structs.

    Adds ``when``, ``cmd``, ``args`` and ``error`` (the first thing wrong, else NULL).
    """
    blank = r"^\s+|\s+$"
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    text = F.regexp_replace(F.col(line), blank, "")
    conditional = F.col("_text").startswith("when ")
    rest = F.substr(F.col("_text"), F.lit(6))
    do_at = F.instr(rest, " do ")
    parsed = df.withColumn("_text", text).withColumns({
        "_conditional": conditional,
        "_do_at": F.when(conditional, do_at).otherwise(F.lit(0)),
        "_clauses": F.when(
            conditional & (do_at > 0),
            F.transform(F.split(F.substr(rest, F.lit(1), do_at - 1), " and "), words),
        ),
        "_action": F.when(conditional & (do_at > 0), F.substr(rest, do_at + 4))
        .when(~conditional & F.col("_text").startswith("do "), F.substr(F.col("_text"), F.lit(4))),
    })
    clause_errors = F.filter(
        F.transform(
            F.col("_clauses"),
            lambda w: F.when(F.size(w) != 3, F.lit("bad_condition")).otherwise(
                condition_problem(F.get(w, F.lit(0)), F.get(w, F.lit(1)))
            ),
        ),
        lambda e: e.isNotNull(),
    )
    action = words(F.col("_action"))
    error = (
        F.when(F.col("_conditional") & (F.col("_do_at") == 0), F.lit("missing_do"))
        .when(F.size(clause_errors) > 0, F.get(clause_errors, F.lit(0)))
        .when(F.col("_action").isNull(), F.lit("expected_do"))
        .when(F.size(action) == 0, F.lit("missing_action"))
    )
    conditions = F.transform(
        F.col("_clauses"),
        lambda w: F.struct(
            F.get(w, F.lit(0)).alias("field"), F.get(w, F.lit(1)).alias("op"), F.get(w, F.lit(2)).alias("value")
        ),
    )
    no_conditions = F.array().cast(CONDITIONS)
    good = F.col("error").isNull()
    return parsed.withColumn("error", error).select(
        *df.columns,
        F.when(good, F.coalesce(conditions, no_conditions)).alias("when"),
        F.when(good, F.get(action, F.lit(0))).alias("cmd"),
        F.when(good, F.slice(action, F.lit(2), F.greatest(F.size(action) - 1, F.lit(0)))).alias("args"),
        "error",
    )


def render_rule_line(when: Column, cmd: Column, args: Column) -> Column:
    """A rule back as one line of text."""
    clauses = F.array_join(
        F.transform(when, lambda c: F.concat_ws(" ", c["field"], c["op"], c["value"])), " and "
    )
    head = F.when(F.size(when) > 0, F.concat(F.lit("when "), clauses, F.lit(" "))).otherwise(F.lit(""))
    return F.concat(head, F.lit("do "), F.array_join(F.concat(F.array(cmd), args), " "))


def parse_manifest_lines(df: DataFrame, text: str = "line") -> DataFrame:
    """The ``# rule: ...`` lines of a program manifest, parsed."""
    rule = F.regexp_extract(text, r"^\s*#\s*rule\s*:\s*(.*?)\s*$", 1)
    listed = df.filter(F.col(text).rlike(r"^\s*#\s*rule\s*:"))
    return parse_rule_lines(listed.withColumn(text, rule), text)


#: Bits of the filter of program roots: a fixed size whatever the number of programs.
ROOT_BITS = 1 << 16


def _bit(root: Column) -> Column:
    return F.pmod(F.xxhash64(root), F.lit(ROOT_BITS)).cast("int")


def _root_filter(roots: DataFrame) -> DataFrame:
    """One row with a bit for each hash of a root, as an array of 64-bit words."""
    words = roots.groupBy(F.shiftright(_bit(F.col("_root")), 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("_root")).bitwiseAND(F.lit(63)))).alias("bits"))
    every = roots.sparkSession.range(ROOT_BITS // 64).select(F.col("id").cast("int").alias("id")).join(words, "id", "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(pairs, lambda p: p["bits"]).alias("words"))


def assign_programs(files: DataFrame, programs: DataFrame) -> DataFrame:
    """Pair each file with every program that scans it.

    A program scans the tree under its ``src`` for the extensions in its ``ext``
    array. "Lies under" is turned into equality by listing the directories above
    each file, so this is an equi-join and not a comparison of all pairs. Of those directories only the ones that
    pass a small filter of all roots become rows, about as many as there are matches; they are joined on root and extension, and the
    rules are attached to what is left.
    """
    scanned = programs.select(
        F.col("id").alias("program_id"), paths.normalize_root(F.col("src")).alias("_root"),
        F.explode(F.array_distinct(F.transform("ext", lambda e: F.lower(F.ltrim(F.trim(e), F.lit("."))))))
        .alias("_ext"))
    roots = programs.select(paths.normalize_root(F.col("src")).alias("_root")).filter("_root IS NOT NULL")
    words = _root_filter(roots).scalar()

    def known(directory: Column) -> Column:
        word = F.get(F.col("_roots"), F.shiftright(_bit(directory), 6))
        return F.call_function("shiftright", word, _bit(directory).bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1

    placed = files.withColumn("_roots", words).withColumn("_root", F.explode(F.filter(paths.ancestors(F.col("path")), known))).drop("_roots").withColumn("_ext", F.col("ext"))
    paired = lookup_join(placed, scanned, ["_root", "_ext"], spread_by=["path"], how="inner").drop("_root", "_ext")
    ruled = programs.select(F.col("id").alias("program_id"), prepare_rules(F.col("rules")).alias("rules"))
    return lookup_join(paired, ruled, ["program_id"], spread_by=["path"], how="inner")


def run_programs(files: DataFrame, programs: DataFrame) -> DataFrame:
    """Every program over the files it scans: one row per (program, file) with its action."""
    return apply_rules_column(assign_programs(files, programs))


def rule_counts(decided: DataFrame) -> DataFrame:
    """Files per rule and action, unmatched files included."""
    return decided.groupBy("rule_ix", "cmd").agg(F.count(F.lit(1)).alias("files"))
