"""Script corpora: pinned ordering, include references, allowed roots,
entry classification (O1, F3, P5, F6).

Files of one include group are ordered: pinned-first files (pin order,
then include-dir order), regular files (include-dir order, then name),
inline SQL, pinned-last files (pin order, then dir order). A pinned name
takes its match in every include dir of the group; a pin that matches
nothing, or that an earlier pin of the same name already took, is unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.functions.refs import ref_name, ref_rest
from revledger.operators.joins import fits, maybe_broadcast
from revledger.operators.sequence import number_rows
from revledger.session import written

# fixed values: position of each file kind in a group's sequence
BUCKET = {"first": 0, "regular": 1, "inline": 2, "last": 3}


def _pin_rank():
    return F.when(F.col("which") == "first", F.lit(0)).otherwise(F.lit(1))


def _winning_pins(pins: DataFrame, grp: str) -> DataFrame:
    """One pin per (group, name): first-list pins beat last-list pins, then
    the earlier position wins."""
    best = pins.groupBy(grp, "name").agg(
        F.min(F.struct(_pin_rank().alias("r"), F.col("pin_pos").alias("p"))).alias("_w"))
    return best.select(grp, "name", F.col("_w.r").alias("_pin_rank"), F.col("_w.p").alias("_pin_pos"))


def pinned_order(files: DataFrame, pins: DataFrame, inline: DataFrame | None = None,
                 grp: str = "grp", out: str = "seq") -> DataFrame:
    """Number every file of every group 1..n in install order (O1).

    ``files``: grp, dir, dir_pos, name. ``pins``: grp, name, which
    ('first' / 'last'), pin_pos. ``inline`` (optional): grp, name, dir_pos
    rows placed after the regular files."""
    w = maybe_broadcast(_winning_pins(pins, grp))
    f = files.join(w, [grp, "name"], "left")
    bucket = (F.when(F.col("_pin_rank") == 0, F.lit(BUCKET["first"]))
              .when(F.col("_pin_rank") == 1, F.lit(BUCKET["last"]))
              .otherwise(F.lit(BUCKET["regular"])))
    f = f.withColumn("bucket", bucket).withColumn("pin_key", F.coalesce("_pin_pos", F.lit(0)))
    f = f.drop("_pin_rank", "_pin_pos")
    if inline is not None:
        i = inline.withColumn("bucket", F.lit(BUCKET["inline"])).withColumn("pin_key", F.lit(0))
        f = f.unionByName(i, allowMissingColumns=True)
    f = f.withColumn("pin_key", F.col("pin_key").cast("long"))
    return number_rows(f, [grp], ["bucket", "pin_key", "dir_pos", "name"], out)


def duplicate_paths(files: DataFrame, grp: str = "grp", path: str = "path", pos: str = "dir_pos") -> DataFrame:
    """Files that the include directories of a group list more than once, by
    real path (O1): how often, and the first and the second directory that
    does. Counted in parts, so one file listed everywhere is no hot row."""
    twice = files.groupBy(grp, path).agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_dir"), F.max(pos).alias("last_dir"))
    return twice.filter("n > 1")


def unused_pins(files: DataFrame, pins: DataFrame, grp: str = "grp") -> DataFrame:
    """Pins that take no file: ``not_found`` when no include dir of the
    group has the name, ``shadowed`` when an earlier pin took it."""
    present = files.select(grp, "name").distinct()
    missing = (pins.join(present, [grp, "name"], "left_anti").select(*pins.columns)
               .withColumn("reason", F.lit("not_found")))
    w = _winning_pins(pins, grp)
    found = (pins.join(present, [grp, "name"], "left_semi").select(*pins.columns)
             .join(w, [grp, "name"]))
    shadowed = (found.filter((_pin_rank() != F.col("_pin_rank"))
                             | (F.col("pin_pos") != F.col("_pin_pos")))
                .select(*pins.columns).withColumn("reason", F.lit("shadowed")))
    return missing.unionByName(shadowed)


def resolve_refs(includes: DataFrame, refs: DataFrame, col: str = "include") -> DataFrame:
    """Expand a leading ``${name}`` / ``$name`` (F3). Adds ref_name,
    resolved (NULL when undefined) and status plain / resolved / undefined."""
    r = maybe_broadcast(refs.select(F.col("ref_name").alias("_rn"), F.col("ref_value").alias("_rv")))
    x = includes.withColumn("ref_name", ref_name(col)).withColumn("_rest", ref_rest(col))
    j = x.join(r, x["ref_name"] == r["_rn"], "left")
    status = (F.when(F.col("ref_name").isNull(), F.lit("plain"))
              .when(F.col("_rn").isNull(), F.lit("undefined")).otherwise(F.lit("resolved")))
    resolved = (F.when(F.col("ref_name").isNull(), F.col(col))
                .when(F.col("_rn").isNotNull(), F.concat(F.col("_rv"), F.col("_rest"))))
    return j.withColumn("resolved", resolved).withColumn("status", status).drop("_rn", "_rv", "_rest")


def outside_roots(files: DataFrame, roots: DataFrame, path: str = "path",
                  root: str = "root") -> DataFrame:
    """Files under none of the allowed roots, by path component (P5): a root
    'a/b' allows 'a/b' and 'a/b/…' but not 'a/bc'.

    The roots are a trie taken level by level: those of d components can only
    allow a file by its own first d, so the files are anti-joined with them on
    that prefix, once for each depth that roots have (a handful). Files that
    pass one level go on to the next in the same stage while the roots are
    small enough to be broadcast; they are read once and never joined back."""
    r = written(roots.select(F.regexp_replace(F.col(root), "/+$", "").alias("_root")).dropna().distinct().select(
        "_root", F.size(F.split("_root", "/")).alias("_depth")), "roots")
    sizes = r.groupBy("_depth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_root") + 8).alias("bytes"))
    for row in sizes.orderBy("_depth").collect():
        level = r.filter(F.col("_depth") == row["_depth"]).select("_root")
        level = F.broadcast(level) if fits(files.sparkSession, row["n"], row["bytes"]) else level
        prefix = F.array_join(F.slice(F.split(files[path], "/"), 1, row["_depth"]), "/")
        files = files.join(level, prefix == level["_root"], "left_anti")
    return files


def marker_flags(files: DataFrame, dir_col: str = "dir", name_col: str = "name") -> DataFrame:
    """One row per directory with ``has_<kind>`` for every marker file it
    holds (a partial aggregate per directory)."""
    from revledger.functions.classify import MARKERS
    return files.groupBy(dir_col).agg(
        *[F.bool_or(F.col(name_col) == F.lit(fname)).alias(f"has_{kind}") for fname, kind in MARKERS])


def entry_kinds(flags: DataFrame) -> DataFrame:
    """Kind of a directory from its marker flags, first match wins (F6):
    init > schema > late > safeguard; NULL when it has none."""
    from revledger.functions.classify import entry_kind
    has = {k: F.coalesce(F.col(f"has_{k}"), F.lit(False))
           for k in ("init", "schema", "late", "safeguard")}
    return flags.withColumn("kind", entry_kind(has))
