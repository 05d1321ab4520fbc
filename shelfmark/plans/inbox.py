"""The inbox flow: fresh archives -> name evidence -> plan -> destination -> outputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import naming as N
from shelfmark.functions.text import computed_here, extension


def reused_folders(series: DataFrame, files: DataFrame, output_root: str, shared: bool = False) -> DataFrame:
    """``series`` -> adds ``folder``: an existing output folder with the same canonical key is
    reused, the best rated spelling first, so that new volumes join it.  With ``shared``, spellings of a series that has no
    folder yet agree on one of themselves by the same rule."""
    there = (
        files.where((F.col("root") == output_root) & F.col("rel").contains("/"))
        .select(F.substring_index("rel", "/", 1).alias("there")).where("NOT startswith(there, '.')").distinct()
    )
    there = N.with_profile(there, "there", "t").select("there", "t")
    if shared:
        fresh = N.with_profile(series.select("series").distinct(), "series", "t")
        known = there.select(F.col("t.key").alias("_known"))
        there = there.unionByName(
            fresh.join(known, F.col("t.key") == F.col("_known"), "left_anti").select(F.col("series").alias("there"), "t")
        )
    best = there.groupBy(F.col("t.key").alias("_key")).agg(
        F.min_by(F.struct("there", "t"), F.struct((-F.col("t.rank.count")).alias("c"), F.col("there"))).alias("b")
    )
    keyed = N.with_profile(series, "series", "s").withColumn("_key", F.col("s.key"))
    stronger = F.col("b.t.rank.count") >= F.col("s.rank.count")
    return keyed.join(best, "_key", "left").withColumn(
        "folder",
        F.when(F.col("b").isNull(), F.col("series")).when(stronger, F.col("b.there"))
        .otherwise(N.with_rating(F.col("b.there"), F.col("s.rank"))),
    ).drop("_key", "s", "b")


def destination(output_root: str, series: Column, name: Column) -> Column:
    return F.concat(F.lit(output_root + "/"), series, F.lit("/"), N.output_name(name))


def plan_action(name: Column, single_nested_zip: Column) -> Column:
    return (
        F.when(extension(name) != ".rar", "rename-zip").when(single_nested_zip, "unwrap-nested-zip").otherwise("rar-to-zip")
    )


def needs_review(confidence: Column) -> Column:
    return confidence < fv.REVIEW_BELOW


def executable(plans: DataFrame, allow_review: bool = False) -> DataFrame:
    ok = plans.where("error IS NULL AND NOT skipped")
    return ok if allow_review else ok.where("NOT needs_review")


def group_series(group: Column) -> Column:
    """The text of an output group without its trailing coverage range."""
    from shelfmark.functions import rx
    from shelfmark.functions.text import trimmed

    return F.regexp_replace(trimmed(group), rx.jvm(rx.OUTPUT_RANGE_TAIL, True), "")


def with_group_series(groups: DataFrame, group: str = "group", out: str = "group_series") -> DataFrame:
    df = computed_here(groups, _stripped=group_series(F.col(group)))
    df = N.with_parsed_name(df, "_stripped", "_gp")
    return df.withColumn(out, F.col("_gp.series")).drop("_gp", "_stripped")


def one_work(groups: DataFrame) -> DataFrame:
    """(plan, is_one_work): every named output group is usable and agrees with the first one.
    ``groups`` has (plan, position, group)."""
    named = with_group_series(groups.where("trim(group) <> ''"))
    named = N.with_profile(named, "group_series", "g")
    first = named.groupBy("plan").agg(F.min_by("g", "position").alias("f"))
    scored = computed_here(named.join(first, "plan"), s=N.pair_score(F.col("f"), F.col("g")))
    agreed = scored.groupBy("plan").agg(
        F.bool_and(F.col("g.usable") & ((F.col("s.score") >= fv.UNION_AT) | (F.col("g.name") == F.col("f.name")))).alias("ok")
    )
    plans = groups.select("plan").distinct()
    return plans.join(agreed, "plan", "left").select("plan", F.coalesce("ok", F.lit(False)).alias("is_one_work"))


def routed_groups(plans: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """(plan, group, belongs): whether an output group goes to the plan's own series folder.

    ``plans`` (plan, series, needs_review), ``aliases`` (plan, alias), ``groups`` (plan, position,
    group).  Names and groups meet on the plan, as distinct pairs."""
    verdict = one_work(groups)
    known = plans.select("plan", F.col("series").alias("name")).unionByName(
        aliases.select("plan", F.col("alias").alias("name"))
    ).distinct()
    known = N.with_profile(known, "name", "k")
    named = N.with_profile(with_group_series(groups.select("plan", "group").distinct()), "group_series", "g")
    hits = computed_here(named.select("plan", "group", "g").join(known.select("plan", "k"), "plan"), s=N.pair_score(F.col("k"), F.col("g")))
    matched = hits.groupBy("plan", "group").agg(F.bool_or(F.col("s.score") >= fv.UNION_AT).alias("matched"))
    usable = computed_here(plans, _ok=N.series_usable(F.col("series")))
    return (
        groups.select("plan", "group").distinct().join(usable.select("plan", "needs_review", "_ok"), "plan")
        .join(verdict, "plan").join(matched, ["plan", "group"], "left")
        .select(
            "plan", "group",
            (
                (F.trim("group") == "") | (~F.col("needs_review") & F.col("_ok") & F.col("is_one_work"))
                | F.coalesce("matched", F.lit(False))
            ).alias("belongs"),
        )
    )


def with_output_target(groups: DataFrame, output_root: str) -> DataFrame:
    """``groups`` (group, destination) -> adds ``target``: the archive a member folder becomes,
    in the folder of its own series."""
    df = N.with_parsed_name(groups, "group", "_op")
    base = N.safe_folder_name(F.col("group"))
    base = F.when(base == "Unknown", F.lit("archive")).otherwise(base)
    df = computed_here(df, _base=base)
    series = F.when(F.col("_op.series") == "Unknown", F.col("_base")).otherwise(F.col("_op.series"))
    return df.withColumn(
        "target",
        F.when(F.trim("group") == "", F.col("destination"))
        .otherwise(F.concat(F.lit(output_root + "/"), series, F.lit("/"), "_base", F.lit(".zip"))),
    ).drop("_op", "_base")


def output_collisions(outputs: DataFrame) -> DataFrame:
    """(plan, target): outputs that share their path, case-insensitively, with another output.  ``outputs``
    is (plan, target), one row per predicted output."""
    keyed = outputs.select("plan", F.lower("target").alias("target"))
    shared = keyed.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(shared, "target", "left_semi").distinct()


def collision_notes(collisions: DataFrame) -> DataFrame:
    """(plan, first, others): one note for each plan with a collision, however many it has."""
    return collisions.groupBy("plan").agg(F.min("target").alias("first"), (F.count("*") - 1).alias("others"))


def resolved_series(plans: DataFrame, resolved: DataFrame) -> DataFrame:
    """A later single-file plan takes the series the last full scan settled on."""
    known = resolved.where("series <> ''").select("name", F.col("series").alias("_resolved"))
    return plans.join(known, "name", "left").withColumns(
        {
            "series": F.coalesce("_resolved", "series"),
            "evidence": F.when(F.col("_resolved").isNotNull(), F.lit("scan cluster")),
        }
    ).drop("_resolved")
