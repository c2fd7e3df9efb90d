"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.schemas import MOUNT_ROOT


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot, empty for none; a leading or a final dot starts no suffix."""
    last = F.substring_index(name, ".", -1)
    has_one = (F.length(last) > 0) & (F.length(name) - F.length(last) > 1)
    return F.when(has_one, F.concat(F.lit("."), last)).otherwise("")


def extension(name: Column) -> Column:
    """Lower-cased suffix, null for none."""
    return F.nullif(F.lower(suffix(name)), F.lit(""))


def stem(name: Column) -> Column:
    """Name without its last suffix."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def parent(path: Column) -> Column:
    """Everything up to and including the last slash."""
    return F.left(path, F.length(path) - F.length(file_name(path)))


def rel_path(abs_path: Column, root_path: Column) -> Column:
    return F.ltrim(F.substring(abs_path, F.length(root_path) + 1, F.length(abs_path)), F.lit("/"))


def numbered_path(path: Column, n: Column) -> Column:
    """``dir/stem.N.suffix``; N = 0 means the path itself."""
    name = file_name(path)
    return F.when(n == 0, path).otherwise(
        F.concat(parent(path), stem(name), F.lit("."), n.cast("string"), suffix(name))
    )


def normalized(path: Column) -> Column:
    """POSIX path without ``.``, ``..``, repeated and trailing slashes."""
    rooted = path.startswith("/")
    lead = (
        F.when(path.startswith("//") & ~path.startswith("///"), "//").when(rooted, "/").otherwise("")
    )

    def step(kept, part):
        climb = (part == "..") & (F.size(kept) > 0)
        climb = climb & (F.element_at(kept, -1) != "..")
        return (
            F.when(part.isin("", "."), kept)
            .when(climb, F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when((part == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(lead, F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_under(path: Column, folder: str) -> Column:
    """True for the folder itself and everything below it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def canonical_root(path: Column) -> Column:
    """Normalized root path, null unless it is absolute and below the mount point."""
    clean = normalized(stripped(path))
    single = F.regexp_replace(clean, "^//", "/")
    return F.when((stripped(path) != "") & is_under(single, MOUNT_ROOT), clean)


def root_error(path: Column) -> Column:
    """Why :func:`canonical_root` rejects a path, null when it accepts it."""
    clean = normalized(stripped(path))
    single = F.regexp_replace(clean, "^//", "/")
    return (
        F.when(stripped(path) == "", "path must not be empty")
        .when(~clean.startswith("/"), "path must be absolute")
        .when(~is_under(single, MOUNT_ROOT), f"path must be under '{MOUNT_ROOT}'")
    )


def trash_path(abs_path: Column, trash_dir: str) -> Column:
    """Default place of a file in the trash, null for an empty path."""
    inner = F.ltrim(abs_path, F.lit("/"))
    return F.when(inner != "", F.concat(F.lit(trash_dir.rstrip("/") + "/"), inner))


def inside_trash(path: Column, trash_dir: str) -> Column:
    return is_under(path, trash_dir)


def short_path(path: Column) -> Column:
    """At most 72 characters, keeping the end of the path."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "-")
        .when(F.length(path) > 72, F.concat(F.lit("..."), F.right(path, F.lit(69))))
        .otherwise(path)
    )
