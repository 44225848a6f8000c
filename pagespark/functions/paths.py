"""Path sandbox checks as column expressions (pure text; no file system access)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(base: Column, path: Column) -> Column:
    return normalize(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def sandbox_paths(
    df: DataFrame,
    path: str = "path",
    profile: str = "profile",
    base: str = "/srv/pages",
    root: str = "downloads",
    allow_any: bool = False,
    cwd: str = "/",
) -> DataFrame:
    """Add ``resolved``, ``ok`` and ``reason`` for a path of a profile's sandbox.

    Relative paths start at ``<base>/<root>/<profile>`` (blank profile: ``default``); what
    leaves that folder is refused unless ``allow_any``. A name that merely starts with two
    dots right below the sandbox is refused too.
    """
    if allow_any:
        free = resolve(F.lit(cwd), F.col(path))
        return df.select("*", free.alias("resolved"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    who = F.when(F.coalesce(F.col(profile), F.lit("")) == "", "default").otherwise(F.col(profile))
    box = normalize(F.concat(F.lit(f"{base}/{root}/"), who))
    out = resolve(box, F.col(path))
    below = F.substr(out, F.length(box) + 2)
    inside = (out == box) | (out.startswith(F.concat(box, F.lit("/"))) & ~below.startswith(".."))
    what = "path '" if root == "downloads" else "upload path '"
    kind = "download" if root == "downloads" else "upload"
    why = F.concat(F.lit(what), F.col(path), F.lit(f"' escapes the {kind} sandbox ("), box, F.lit(")."))
    return df.select(
        "*", F.when(inside, out).alias("resolved"), inside.alias("ok"), F.when(~inside, why).alias("reason")
    )


def check_manifest(manifest: DataFrame, listing: DataFrame, base: str = "/srv/pages", allow_any: bool = False) -> DataFrame:
    """Upload manifest: sandbox check, then existence and kind from a file listing (path, is_file)."""
    judged = sandbox_paths(manifest, base=base, root="uploads", allow_any=allow_any)
    known = listing.select(F.col("path").alias("resolved"), "is_file")
    found = judged.join(known, "resolved", "left")
    problem = (
        F.when(~F.col("ok"), F.col("reason"))
        .when(F.col("is_file").isNull(), F.concat(F.lit("file not found: "), F.col("resolved")))
        .when(~F.col("is_file"), F.concat(F.lit("not a regular file: "), F.col("resolved")))
    )
    return found.select(*manifest.columns, "resolved", problem.isNull().alias("ok"), problem.alias("reason"))


def resolve_target(save_to: Column, suggested: Column) -> Column:
    """A folder target (ending in a slash or backslash) gets the suggested file name."""
    as_dir = save_to.endswith("/") | save_to.endswith("\\")
    return F.when(
        as_dir, F.concat(save_to, F.coalesce(F.nullif(suggested, F.lit("")), F.lit("download")))
    ).otherwise(save_to)
