"""Canonical file paths as a pure column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.binding import let


def canonical_path(path: Column, root: str = "/srv/speech") -> Column:
    """The absolute path that ``path`` means; null for null and blank paths.

    Surrounding white space is dropped, backslashes separate like slashes, a ``file:`` scheme with
    or without a local host is removed, percent escapes are decoded, a relative path starts at
    ``root``, and empty, ``.`` and ``..`` steps are resolved. Case is kept. A damaged percent
    escape is left as it stands.
    """
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    def decoded(p: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
        return F.when(p.contains("%"), plain).otherwise(p)

    def absolute(p: Column) -> Column:
        return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))

    def resolved(p: Column) -> Column:
        walked = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(p, "/"), none, step), "/"))
        return F.when(p.rlike(r"//|/\.{1,2}(/|$)|/$"), walked).otherwise(p)

    bare = F.translate(F.regexp_replace(path, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), "\\", "/")
    bare = F.regexp_replace(bare, r"(?i)^file:(//(localhost)?(?=/))?", "")
    odd = let(bare, lambda b: F.when(b != "", let(decoded(b), lambda d: let(absolute(d), resolved))))
    # Most paths are canonical already; they skip the interpreted branch.
    return F.when(path.rlike(r"^(/(?!\.{1,2}(/|$))[^/\\%\s\u00a0]+)+$"), path).otherwise(odd)
