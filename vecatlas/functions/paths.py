"""Column functions on '/'-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted image suffixes.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tiff", "bmp", "gif", "webp")


def is_image_path(path: Column) -> Column:
    """The last component has an accepted suffix, and not only a suffix ('/d/.png' has none)."""
    return F.lower(path).rlike(r"[^/]\.(" + "|".join(IMAGE_SUFFIXES) + r")$")


def normalize_path(path: Column) -> Column:
    """Lexical normal form: no empty, '.' or resolvable '..' component, no trailing '/'."""
    absolute = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = (F.size(done) > 0) & (last != "..")
        up = (
            F.when(climbs, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.array_append(done, part))
        )
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def directory_key(path: Column) -> Column:
    """A directory as it appears among ancestors: no trailing '/', so the root is the empty string."""
    return F.regexp_replace(path, "/+$", "")


def ancestors(path: Column) -> Column:
    """All proper ancestor directories: '/a/b/c.png' gives ['', '/a', '/a/b']."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.when(depth > 0, prefixes).otherwise(F.array().cast("array<string>"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """'.png' of 'a.b.png'; empty for 'a', '.a' and 'a.'."""
    return F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))
