"""File-path predicates and path arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import contains_any, extract, lookup, uni


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    return lookup(extension(path), fixed.LANGUAGE_BY_EXTENSION)


def route_language(path: Column) -> Column:
    return lookup(extension(path), fixed.ROUTE_LANGUAGE_BY_EXTENSION)


def padded(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(path), F.lit("/"))


def is_vendored(path: Column) -> Column:
    return contains_any(padded(path), fixed.VENDOR_MARKERS)


def is_noise(path: Column) -> Column:
    return contains_any(padded(path), fixed.NOISE_MARKERS)


def is_generated(path: Column) -> Column:
    name = F.lower(basename(path))
    tails = "|".join(s.replace(".", r"\.") for s in fixed.GENERATED_SUFFIXES)
    return name.isin(*fixed.GENERATED_NAMES) | name.rlike(f"(?:{tails})$")


def is_pruned(path: Column, dirs=fixed.PRUNE_DIRS) -> Column:
    """Some directory on the way to the file is never walked."""
    names = "|".join(d.replace(".", r"\.") for d in dirs)
    return path.rlike(f"(^|/)(?:{names})/")


def is_test_path(path: Column) -> Column:
    return path.rlike(uni(fixed.TEST_PATH))


def is_binary(content: Column, head: int = 8192) -> Column:
    """NUL byte among the first *head* bytes of a binary column."""
    return F.instr(F.substring(content, 1, head).cast("string"), "\x00") > 0


def is_included(path: Column, size: Column, binary: Column,
                cap: int = fixed.MAX_REVIEW_BYTES) -> Column:
    return (~binary & ~is_vendored(path) & ~is_noise(path) & ~is_generated(path)
            & language(path).isNotNull() & (size <= cap))


def is_archive(path: Column, head_hex: Column) -> Column:
    """Archive by extension, or by zip / 7z magic bytes (hex of the head)."""
    tails = "|".join(s.replace(".", r"\.") for s in fixed.ARCHIVE_EXTENSIONS)
    return (F.lower(path).rlike(f"(?:{tails})$") | head_hex.startswith("504B0304")
            | head_hex.startswith("377ABCAF271C"))


def escapes_root(member: Column) -> Column:
    """The normalised member path leaves (or names) the extraction root."""
    parts = F.filter(F.split(member, "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, s: F.struct(
            (a["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"),
            F.least(a["low"], a["d"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return member.startswith("/") | (depth["low"] < 0) | (depth["d"] <= 0)


def in_selection(path: Column, selections: list[str]) -> Column:
    """Equals a selected path or lies below it."""
    return F.exists(F.array(*[F.lit(s) for s in selections]),
                    lambda p: (path == p) | path.startswith(
                        F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))))


def in_prefix_scope(path: Column, include: Column, exclude: Column) -> Column:
    """Include list empty or a prefix matches, and no excluded prefix matches."""
    p = F.coalesce(path, F.lit(""))
    inc = F.filter(F.coalesce(include, F.array()), lambda x: x != "")
    exc = F.filter(F.coalesce(exclude, F.array()), lambda x: x != "")
    return ((F.size(inc) == 0) | F.exists(inc, lambda x: p.startswith(x))) \
        & ~F.exists(exc, lambda x: p.startswith(x))


def ancestors(path: Column) -> Column:
    """Every directory above a file, the root as ''."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))


def repair_candidates(path: Column) -> Column:
    """Clean path, then the path without 1..5 leading segments."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
                     lambda s: ~s.isin("", ".", ".."))
    n = F.least(F.size(parts), F.lit(6))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(
        F.slice(parts, i + 1, F.size(parts)), "/"))


def clean_citation(path: Column) -> Column:
    """Forward slashes, no leading dots or slashes."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, '' when there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))


def declared_host(entry: Column) -> Column:
    """Host of an allow-list entry given as a URL or a bare host."""
    h = F.lower(F.btrim(F.coalesce(entry, F.lit(""))))
    bare = F.split_part(F.split_part(h, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.when(h.contains("//"), host_of(h)).otherwise(bare)


def allowed_hosts(base_url: Column, declared: Column) -> Column:
    """Sorted distinct hosts a run may contact."""
    hosts = F.concat(F.array(host_of(base_url)),
                     F.transform(F.coalesce(declared, F.array()), declared_host))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment, '/' when empty."""
    rest = F.when(F.locate("://", url) > 0,
                  F.substr(url, F.locate("://", url) + 3)).otherwise(url)
    path = F.when(F.locate("/", rest) > 0, F.substr(rest, F.locate("/", rest)))
    return F.coalesce(extract(path, r"^([^?#]*)", 1), F.lit("/"))
