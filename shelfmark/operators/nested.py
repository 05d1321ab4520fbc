"""Output paths of members of nested archives, from a table of entries and the archive each lies in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.text import basename, dirname, without_extension
from shelfmark.operators.members import archive_facts, is_archive_like, is_nested_archive, with_clean_names
from shelfmark.operators.stable import pinned


def _joined(*parts):
    """A path of its non-empty parts."""
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])


def with_logical_names(entries: DataFrame) -> DataFrame:
    """``entries`` (archive, node, parent, name, is_dir) with ``logical``, the name below the archive's common root, and ``alone``:
    whether it is the only regular file of its container, and an archive."""
    rows = with_clean_names(entries.withColumn("is_dir", F.coalesce("is_dir", F.lit(False))))
    regular = ~F.col("is_dir")
    holders = rows.groupBy("archive", F.coalesce("parent", F.lit(-1)).alias("_holder")).agg(
        ((F.count_if(regular) == 1) & F.max(F.when(regular, is_archive_like(F.col("name"))))).alias("_single")
    )
    roots = archive_facts(
        entries.where("parent IS NULL").select("archive", "name", "is_dir", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("size"))
    ).select("archive", "common_root")
    out = rows.withColumn("_holder", F.coalesce("parent", F.lit(-1))).join(holders, ["archive", "_holder"], "left").join(roots, "archive", "left")
    root = F.concat("common_root", F.lit("/"))
    stripped = F.col("parent").isNull() & (F.coalesce("common_root", F.lit("")) != "") & F.startswith("clean", root)
    return out.withColumns({
        "logical": F.when(stripped, F.substr("clean", F.length(root) + 1)).otherwise(F.col("clean")),
        "alone": F.coalesce("_single", F.lit(False)) & regular,
    }).drop("_holder", "_single", "common_root")


def container_prefixes(rows: DataFrame, depth: int = fv.MAX_DEPTH) -> DataFrame:
    """(archive, node, prefix, level, unsafe, lost) of every nested archive: the folder its members go to.

    Each archive adds its folder and stem, or its folder alone where it is all that its container holds.  The links
    to the outer archives are followed by pointer doubling: a round puts an archive's steps behind those of the archive it
    points to and points on to where that one points, so d levels take log2(d) rounds.  ``level`` is NULL beyond twice
    the allowed depth, on links that lead in a circle and where ``lost`` marks a parent that is no nested archive."""
    nested = rows.where(~F.col("is_dir") & is_nested_archive(F.col("logical")))
    folder = F.when(F.col("logical").contains("/"), dirname(F.col("logical"))).otherwise("")
    step = F.when(F.col("alone"), folder).otherwise(_joined(folder, without_extension(basename(F.col("logical")))))
    links = pinned(nested.select(
        "archive", "node", F.col("parent").alias("up"), step.alias("prefix"), F.lit(1).alias("level"), "unsafe", F.lit(False).alias("lost"),
    ))
    for _ in range(max(depth, 1).bit_length()):
        if links.where("up IS NOT NULL").isEmpty():
            break
        outer = links.select(
            "archive", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("prefix").alias("_prefix"), F.col("level").alias("_level"),
            F.col("unsafe").alias("_unsafe"), F.col("lost").alias("_lost"),
        )
        links = pinned(links.join(outer, ["archive", "up"], "left").select(
            "archive", "node", F.col("_up").alias("up"), _joined(F.coalesce("_prefix", F.lit("")), F.col("prefix")).alias("prefix"),
            (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), (F.col("unsafe") | F.coalesce("_unsafe", F.lit(False))).alias("unsafe"),
            (F.col("lost") | F.coalesce("_lost", F.lit(False)) | (F.col("up").isNotNull() & F.col("_level").isNull())).alias("lost"),
        ))
    return links.select("archive", "node", "prefix", F.when(F.col("up").isNull() & ~F.col("lost"), F.col("level")).alias("level"), "unsafe", "lost")


def nested_outputs(entries: DataFrame, depth: int = fv.MAX_DEPTH) -> DataFrame:
    """(archive, node, level, path, error): where each regular member that is no nested archive goes.  Every member has a row; one
    that can't be put out has the first reason in ``error`` and no path."""
    rows = pinned(with_logical_names(entries))
    holders = container_prefixes(rows, depth).select(
        "archive", F.col("node").alias("parent"), "prefix", "level", F.col("unsafe").alias("_unsafe"), F.col("lost").alias("_lost"), F.lit(True).alias("_there")
    )
    leaves = rows.where(~F.col("is_dir") & ~is_nested_archive(F.col("logical"))).join(holders, ["archive", "parent"], "left")
    inside = F.col("parent").isNotNull()
    error = (
        F.when(inside & (F.col("_there").isNull() | F.col("_lost")), "unknown container")
        .when(inside & (F.col("level").isNull() | (F.col("level") > depth)), "too deep")
        .when(F.col("unsafe") | F.coalesce("_unsafe", F.lit(False)), "unsafe path")
        .when(is_archive_like(F.col("logical")), "unsupported archive")
    )
    return leaves.select(
        "archive", "node", F.coalesce("level", F.when(~inside, F.lit(0))).alias("level"),
        F.when(error.isNull(), _joined(F.coalesce("prefix", F.lit("")), F.col("logical"))).alias("path"), error.alias("error"),
    )
