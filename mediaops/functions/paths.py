"""Path arithmetic on string columns (``/`` separated, case kept)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An extension is the last dot of the last path element and what follows it.
_EXT = r"\.[^./]*$"

#: Marks the file an interrupted encode leaves behind.
TRANSIENT_MARK = ".transcoded"


def dotted_ext(path: Column) -> Column:
    """``.MKV`` for ``/a/b.MKV``; ``''`` when there is none."""
    return F.regexp_extract(path, f"({_EXT})", 1)


def bare_ext(path: Column) -> Column:
    """``mkv`` for ``/a/b.MKV``."""
    return F.lower(F.ltrim(dotted_ext(path), F.lit(".")))


def strip_ext(path: Column) -> Column:
    return F.regexp_replace(path, _EXT, "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without directory and extension."""
    return strip_ext(base_name(path))


def dir_name(path: Column) -> Column:
    """``/`` for a file in the root, ``.`` for a bare name."""
    head = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(path, "/") == 0, F.lit(".")).when(head == "", F.lit("/")).otherwise(head)


def join_path(directory: Column, name: Column) -> Column:
    trimmed = F.rtrim(directory, F.lit("/"))
    return F.when(directory.isin("", "."), name).otherwise(F.concat(trimmed, F.lit("/"), name))


def ancestors(path: Column) -> Column:
    """Every directory above ``path``, the root first: ``/``, ``/a``, ``/a/b``."""
    parts = F.split(path, "/")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    listed = F.transform(heads, lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(F.size(parts) > 1, listed).otherwise(F.array().cast("array<string>"))


def normalize_root(root: Column) -> Column:
    """Drop trailing slashes but keep the root itself."""
    trimmed = F.rtrim(root, F.lit("/"))
    return F.when((trimmed == "") & root.startswith("/"), F.lit("/")).otherwise(trimmed)


def walk_order(path: Column) -> Column:
    """Sort key of a depth-first directory walk: compare name by name, not as one string."""
    return F.split(path, "/")


def output_path(path: Column, rel_path: Column, *, inplace: Column, output_dir: Column,
                suffix: Column, container: Column) -> Column:
    """Where a finished encode goes: the file itself, a mirrored tree, or alongside."""
    def target_ext(src: Column) -> Column:
        return F.when(container != "", F.concat(F.lit("."), container)).otherwise(dotted_ext(src))

    mirrored = join_path(output_dir, F.concat(strip_ext(rel_path), target_ext(path)))
    alongside = F.concat(strip_ext(path), suffix, target_ext(path))
    return F.when(inplace, path).when(output_dir != "", mirrored).otherwise(alongside)


def transient_path(destination: Column, source: Column) -> Column:
    """Name used while encoding: in the destination's directory, after the source's stem."""
    folder = F.regexp_extract(destination, "^(.*/)", 1)
    return F.concat(folder, stem(source), F.lit(TRANSIENT_MARK), dotted_ext(destination))


def is_own_output(path: Column, suffix: Column) -> Column:
    name = stem(path)
    return name.endswith(TRANSIENT_MARK) | ((suffix != "") & name.endswith(suffix))
