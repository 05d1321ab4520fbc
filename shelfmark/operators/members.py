"""Archive member operators: safety, facts, groups, name candidates and name consensus.

An archive may hold a third of all entries: numbering by entry order is range partitioned, the winner of a
consensus is an aggregate, and only lists with a fixed length (ten names) are collected.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import naming as N
from shelfmark.functions import rx
from shelfmark.functions.text import basename, clean_path, computed_here, extension, has_japanese, trimmed, whole_number, without_extension
from shelfmark.operators.ordered import row_numbers, running_total, with_previous
from shelfmark.operators.stable import pinned, stored


# --- predicates ---------------------------------------------------------------------------
def is_nested_archive(name: Column) -> Column:
    return extension(basename(name)).isin(fv.NESTED_EXTENSIONS)


def is_archive_like(name: Column) -> Column:
    return extension(basename(name)).isin(fv.ARCHIVE_LIKE_EXTENSIONS)


def clean_member(name: Column) -> Column:
    return clean_path(F.translate(name, "\\", "/"))


def is_unsafe(clean: Column) -> Column:
    return (
        clean.contains("\0") | clean.isin("", ".", "..") | F.startswith(clean, F.lit("/")) | F.startswith(clean, F.lit("../"))
    )


def compression_class(name: Column, mode: str = "balanced") -> Column:
    stored = extension(basename(name)).isin(fv.STORED_EXTENSIONS)
    return F.lit("store") if mode == "fast" else F.when(stored, "store").otherwise("deflate")


def _max_long() -> Column:
    return F.lit((1 << 63) - 1)


def _div(a: Column, b: int) -> Column:
    """Whole division; the remainder is taken off first, so the quotient is exact at any size."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def output_bytes_estimate(unpacked: Column, source: Column) -> Column:
    base = F.when(unpacked > 0, unpacked).otherwise(source * 2)
    safety = F.greatest(F.lit(256 * fv.MIB), _div(base, 20))
    return F.when(base > _max_long() - safety, _max_long()).otherwise(base + safety)


def rewrite_bytes_estimate(source: Column) -> Column:
    base = F.when(source <= F.lit(((1 << 63) - 1) // 2), source * 2).otherwise(_max_long())
    safety = F.greatest(F.lit(256 * fv.MIB), _div(source, 10))
    return (
        F.when(source <= 0, F.lit(512 * fv.MIB)).when(base > _max_long() - safety, _max_long()).otherwise(base + safety)
    )


# --- per-archive facts --------------------------------------------------------------------------
def with_clean_names(entries: DataFrame) -> DataFrame:
    df = computed_here(entries, clean=clean_member(F.col("name")))
    return df.withColumn("unsafe", is_unsafe(F.col("clean")))


def archive_facts(entries: DataFrame) -> DataFrame:
    """One row per archive: counts, bytes, nested archives, the common root folder, and whether
    it wraps exactly one ZIP."""
    e = with_clean_names(entries.where("depth = 0"))
    regular = ~F.coalesce("is_dir", F.lit(False))
    first, depth = F.substring_index("clean", "/", 1), F.size(F.split("clean", "/"))
    roots = F.min(F.when(regular, first)), F.max(F.when(regular, first))
    common = (
        (F.min(F.when(regular, depth)) >= 2) & (roots[0] == roots[1]) & ~F.max(F.when(regular, F.col("unsafe")).otherwise(False))
    )
    one_zip = extension(basename(F.max(F.when(regular, F.col("name"))))).isin(".zip", ".cbz")
    return e.groupBy("archive").agg(
        F.count("*").alias("entries"), F.count_if(regular).alias("regular_files"),
        F.coalesce(F.sum(F.when(regular & (F.col("size") > 0), F.col("size"))), F.lit(0)).alias("unpacked_bytes"),
        F.count_if(regular & is_archive_like(F.col("name"))).alias("nested_archives"),
        F.when(common, roots[0]).otherwise("").alias("common_root"),
        F.coalesce((F.count_if(regular) == 1) & one_zip, F.lit(False)).alias("single_nested_zip"),
    )


def archive_limits(entries: DataFrame, depth: int = fv.MAX_DEPTH, nested: int = fv.MAX_NESTED_ARCHIVES,
                   count: int = fv.MAX_ENTRIES, expanded: int = fv.MAX_EXPANDED_BYTES) -> DataFrame:
    """(archive, violation): the first safety limit an archive breaks, NULL when none."""
    regular = ~F.coalesce("is_dir", F.lit(False))
    facts = entries.groupBy("archive").agg(
        F.max("depth").alias("d"), F.count_if(regular & is_archive_like(F.col("name"))).alias("n"),
        F.count_if(regular).alias("c"), F.sum(F.when(regular, F.col("size"))).alias("b"),
    )
    return facts.select(
        "archive",
        F.when(F.col("d") > depth, "depth").when(F.col("n") > nested, "nested archives").when(F.col("c") > count, "entries")
        .when(F.col("b") > expanded, "expanded bytes").alias("violation"),
    )


def split_groups(entries: DataFrame) -> DataFrame:
    """(archive, group, files, bytes): files by first folder below the common root; '' are root
    files.  Root files alone take the name of the stripped root."""
    facts = archive_facts(entries).select("archive", "common_root")
    e = with_clean_names(entries).where("NOT coalesce(is_dir, false) AND NOT unsafe").join(facts, "archive")
    prefix = F.concat("common_root", F.lit("/"))
    inner = F.when(
        (F.col("common_root") != "") & F.startswith("clean", prefix), F.substr("clean", F.length(prefix) + 1)
    ).otherwise(F.col("clean"))
    e = e.withColumn("_in", inner).withColumn("group", F.when(F.col("_in").contains("/"), F.substring_index("_in", "/", 1)).otherwise(""))
    groups = e.groupBy("archive", "common_root", "group").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    alone = groups.groupBy("archive").agg(F.max("group").alias("_top"))
    return groups.join(alone, "archive").select(
        "archive", F.when((F.col("_top") == ""), F.col("common_root")).otherwise(F.col("group")).alias("group"), "files", "bytes"
    )


#: Trailing numbers that the rule itself makes: from 2, without leading zeros.
_MADE = r"(?: \((?:[2-9]|[1-9][0-9]{1,4})\))"


def _number_slots(over: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Numbers for the entries ``over`` (archive, key, at) whose key is taken, in order of ``at``; ``wanted`` (archive, key, n, at) are the
    numbered names that entries ask for themselves, with the first of each.  Gives ``over`` with ``n`` and ``wanted`` with ``taken``: an entry of
    ``over`` was there before.

    Each takes the least number that is free when it comes, so the numbers of one key grow.  The j-th would get j + 1 and
    is moved up by one for each wanted number on its way that is held already.  Whether a wanted number is held
    when its turn comes depends on how many before it are; with r entries of ``over`` before its first asker that is so if
    fewer than n - 1 - r are.  The counts are bounded from both sides by running totals until every number is decided."""
    group = ["archive", "key"]
    if wanted.isEmpty():
        return row_numbers(over, group, [F.col("at")], "n").withColumn("n", F.col("n") + 1), None
    both = over.select(*group, "at", F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("n")).unionByName(
        wanted.select(*group, "at", F.lit(0).alias("one"), "n")
    )
    both = pinned(running_total(both, group, [F.col("at")], F.col("one"), "j"))
    slots = both.where("one = 0").select(*group, "n", "at", (F.col("n") - 1 - F.col("j")).alias("room"))

    def before(rows: DataFrame, flag: Column, out: str) -> DataFrame:
        rows = running_total(rows.withColumn("_flag", flag.cast("int")), group, [F.col("n")], F.col("_flag"), out)
        return rows.withColumn(out, F.col(out) - F.col("_flag")).drop("_flag")

    slots = before(slots.withColumn("low", F.lit(0)), F.lit(True), "high")
    while True:
        slots = pinned(slots)
        if slots.where("low < room AND room <= high").isEmpty():
            break
        held, free = F.col("high") < F.col("room"), F.col("low") >= F.col("room")
        slots = before(slots.withColumns({"_held": held, "_free": free}).drop("low", "high"), F.col("_held"), "low")
        slots = before(slots, ~F.col("_free"), "high").drop("_held", "_free")
    slots = pinned(before(slots.withColumn("held", F.col("high") < F.col("room")), F.col("held"), "held_before"))
    turn = (F.col("n") - 1 - F.col("held_before")).alias("j")
    merged = both.where("one = 1").select(*group, "at", "j", F.lit(0).alias("step")).unionByName(
        slots.where("held").select(*group, "at", turn, F.lit(1).alias("step"))
    )
    moved = running_total(merged, group, [F.col("j"), F.desc("step"), F.col("at")], F.col("step"), "up").where("step = 0")
    return moved.select(*group, "at", (F.col("j") + 1 + F.col("up")).alias("n")), slots.select(*group, "n", (~F.col("held")).alias("taken"))


def unique_members(entries: DataFrame) -> DataFrame:
    """(archive, ordinal, unique_name): later entries whose name is taken (case-insensitively) become
    ``stem (n).ext`` with the least n from 2 that is free in entry order.  Ordinals are unique in an archive.

    A made name can be one that other entries ask for, so names are settled by the count of their made numbers: those without
    any first, then those with one, which entries of the first kind may have taken, and so on.  Everything is a
    grouped minimum, a join or a running total over ranges, so a name may have any share of the entries."""
    ext = F.regexp_extract("name", r"\.[^./]*\z", 0)
    stem = F.substr("name", F.lit(1), F.length("name") - F.length("_ext"))
    rows = computed_here(entries.select("archive", "ordinal", "name"), _ext=ext).withColumn("_stem", stem)
    tail = F.regexp_extract(F.lower("_stem"), rf"({_MADE}*)\z", 1)
    rows = rows.withColumns({"low": F.lower("name"), "_tail": tail})
    bare = F.regexp_replace(F.lower("_stem"), rf"{_MADE}\z", "")
    rows = pinned(rows.withColumns({
        "level": F.regexp_count("_tail", F.lit(r"\(")),
        "parent": F.when(F.col("_tail") != "", F.concat(bare, F.lower("_ext"))),
        "number": whole_number(F.regexp_extract("_tail", r"([0-9]+)\)\z", 1)),
    }).drop("_tail"))
    deepest = rows.agg(F.max("level")).first()[0]
    done, taken = [], None
    for level in range(0 if deepest is None else deepest + 1):
        own = rows.where(F.col("level") == level)
        first = own.groupBy("archive", "low").agg(F.min("ordinal").alias("first"), F.min("parent").alias("key"), F.min("number").alias("n"))
        if taken is not None:
            first = first.join(taken, ["archive", "key", "n"], "left").withColumn(
                "first", F.when(F.coalesce("taken", F.lit(False)), F.lit(None)).otherwise(F.col("first"))
            )
        own = pinned(own.join(first.select("archive", "low", "first"), ["archive", "low"]).withColumn("keeps", F.coalesce(F.col("ordinal") == F.col("first"), F.lit(False))))
        done.append(own.where("keeps").select("archive", "ordinal", F.col("name").alias("unique_name")))
        over = own.where("NOT keeps").select("archive", F.col("low").alias("key"), F.col("ordinal").alias("at"))
        below = rows.where(F.col("level") == level + 1).groupBy("archive", F.col("parent").alias("key"), F.col("number").alias("n")).agg(F.min("ordinal").alias("at"))
        wanted = pinned(below.join(over.select("archive", "key").distinct(), ["archive", "key"], "left_semi"))
        numbered, taken = _number_slots(over, wanted)
        names = own.where("NOT keeps").select("archive", "ordinal", "_stem", "_ext").join(
            numbered.select("archive", F.col("at").alias("ordinal"), "n"), ["archive", "ordinal"]
        )
        done.append(names.select("archive", "ordinal", F.concat("_stem", F.lit(" ("), F.col("n").cast("string"), F.lit(")"), "_ext").alias("unique_name")))
    out = entries.sparkSession.createDataFrame([], f"archive {rows.schema['archive'].dataType.simpleString()}, ordinal {rows.schema['ordinal'].dataType.simpleString()}, unique_name string")
    for part in done:
        out = out.unionByName(part)
    return out


# --- multipart sets ---------------------------------------------------------------------------------
def multipart_parts(files: DataFrame) -> DataFrame:
    """(folder, base, part, path): every part of every ``*.partN.rar`` set, base case-folded."""
    name = basename(F.col("path"))
    part = whole_number(F.regexp_extract(name, rx.jvm(rx.MULTIPART, True), 2))
    return files.select(
        F.regexp_replace("path", r"/[^/]*\z", "").alias("folder"),
        F.lower(F.regexp_extract(name, rx.jvm(rx.MULTIPART, True), 1)).alias("base"), part.alias("part"), "path",
    ).where("part >= 1")


def multipart_sets(parts: DataFrame) -> DataFrame:
    """(folder, base, primary, parts, last_part, missing): one row per set."""
    return parts.groupBy("folder", "base").agg(
        F.min(F.when(F.col("part") == 1, F.col("path"))).alias("primary"), F.count("*").alias("parts"),
        F.max("part").alias("last_part"), (F.max("part") - F.count_distinct("part")).alias("missing"),
    )


def missing_parts(parts: DataFrame) -> DataFrame:
    """(folder, base, first, last): the gaps of each set as ranges."""
    numbers = parts.select("folder", "base", "part").distinct()
    stepped = with_previous(numbers, ["folder", "base"], [F.col("part")], ["part"])
    before = F.coalesce("prev_part", F.lit(0))
    return stepped.where(F.col("part") - before > 1).select(
        "folder", "base", (before + 1).alias("first"), (F.col("part") - 1).alias("last")
    )


# --- name candidates ----------------------------------------------------------------------------------
def is_numeric_like(s: Column) -> Column:
    return s.rlike(rx.jvm(r"\A[<d>\-_.()\[\] ]*\z"))


def is_useful_directory(s: Column) -> Column:
    n = F.lower(trimmed(s))
    return (n != "") & ~n.isin(fv.GENERIC_DIRECTORIES) & ~is_numeric_like(n)


def is_useful_image(stem: Column) -> Column:
    n = trimmed(stem)
    camera = F.lower(n).rlike(rx.jvm(r"\A(?:" + "|".join(fv.CAMERA_PREFIXES) + r")[<u>]*[<d>\-_.()\[\] ]*[<u>]*\z"))
    return (F.length(n) >= 3) & ~is_numeric_like(n) & ~camera


def name_candidates(entries: DataFrame) -> DataFrame:
    """(archive, pos, kind, name): ``placed_candidates``, numbered per archive."""
    order = [F.col(f"pos.{c}") for c in ("late", "_n", "name")]
    return row_numbers(placed_candidates(entries), ["archive"], order, "_i").select("archive", F.col("_i").alias("pos"), "kind", "name")


def placed_candidates(entries: DataFrame) -> DataFrame:
    """(archive, pos, kind, name): naming evidence of all entries, of which ``pos`` gives the order: that of the entries, folders last and
    sorted; the first of equal names per kind."""
    e = entries.withColumn("_n", F.col("ordinal"))
    e = computed_here(e, clean=F.regexp_replace(clean_path(F.concat(F.lit("/"), trimmed(F.translate("name", "\\", "/")))), r"\A/", ""))
    e = e.where("clean NOT IN ('', '.')")
    is_dir, parts = F.coalesce("is_dir", F.lit(False)), F.split("clean", "/")
    base = basename(F.col("clean"))
    stem = trimmed(without_extension(base))
    kind = F.when(extension(base).isin(fv.NESTED_EXTENSIONS), "nested-archive").when(
        extension(base).isin(fv.IMAGE_EXTENSIONS) & is_useful_image(without_extension(base)), "named-image"
    )
    file_rows = e.where(~is_dir).select("archive", "_n", kind.alias("kind"), stem.alias("name")).where("kind IS NOT NULL AND name <> ''")
    firsts = file_rows.groupBy("archive", "kind", F.lower("name").alias("low")).agg(
        F.min("_n").alias("_n"), F.min_by("name", "_n").alias("name")
    )
    top = trimmed(parts[0])
    dirs = e.where((F.size(parts) > 1) | is_dir).where(is_useful_directory(parts[0])).select("archive", top.alias("name")).distinct()
    # Folders come in byte order; of names that differ in case only the first stays.
    dirs = dirs.groupBy("archive", F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    both = firsts.select("archive", "kind", "name", F.lit(0).alias("late"), F.col("_n").cast("bigint").alias("_n")).unionByName(
        dirs.select("archive", F.lit("top-directory").alias("kind"), "name", F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("_n"))
    )
    return both.select("archive", F.struct("late", "_n", "name").alias("pos"), "kind", "name")


# --- consensus --------------------------------------------------------------------------------------------
def kind_bonus(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, bonus in fv.KIND_BONUS.items():
        out = F.when(kind == name, F.lit(bonus)).otherwise(out)
    return out


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their parse, group key and score; unusable names drop out."""
    df = N.with_parsed_name(candidates.where(~F.col("name").contains("�")), "name", "c")
    df = computed_here(df, series_ok=N.series_usable(F.col("c.series")), gkey=N.group_key(F.col("c.series")), jp=has_japanese(F.col("name")))
    df = N.with_coverage(df.where("series_ok"), "name").drop("series_ok")
    score = F.col("c.confidence") + kind_bonus(F.col("kind")) + F.when(F.col("jp"), fv.JAPANESE_BONUS).otherwise(0.0)
    df = stored(df)
    sizes = df.groupBy("archive", "gkey").agg(F.count("*").alias("n"))
    df = df.join(sizes, ["archive", "gkey"])
    n = F.col("n")
    bonus = F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(0.24), F.lit(0.08) * (F.col("n") - 1)))
    return df.withColumn("score0", score).withColumn("score", F.col("score0") + bonus)


def name_consensus(archives: DataFrame, candidates: DataFrame, names: bool = True) -> DataFrame:
    """(archive, series, author, volume, has_volume, confidence, source, candidates, group_size,
    coverage, multi_volume) per archive: the winning member name, or the archive's own name.  ``pos`` of the candidates is anything
    that orders them; without ``names`` the column ``candidates``, the first ten that speak for it, is left out."""
    outer = N.with_coverage(N.with_parsed_name(archives.select("archive"), "archive", "o"), "archive", "ocov")
    outer = computed_here(outer, o_ok=N.series_usable(F.col("o.series")), okey=N.group_key(F.col("o.series")))
    s = scored_candidates(candidates)
    # The best score to four places, then Japanese names, then the kind, then the earliest.
    rank = F.struct((-F.round("score", 4)).alias("score"), (~F.col("jp")).alias("latin"), (-kind_bonus(F.col("kind"))).alias("bonus"), "pos")
    winner = s.groupBy("archive").agg(F.min_by(F.struct("score", "jp", "kind", "name", "gkey", "n", "c"), rank).alias("w"))
    group = s.groupBy("archive", "gkey").agg(
        N.merged_coverage(F.col("coverage")).alias("cov"),
        F.count_distinct(F.when(F.col("c.has_volume"), F.col("c.volume"))).alias("volumes"),
    )
    shown = ["names"] if names else []
    if names:
        first = s.groupBy("archive", "gkey", "name").agg(F.min("pos").alias("pos"))
        nth = F.row_number().over(W.partitionBy("archive", "gkey").orderBy("pos"))  # cut down before the shuffle
        ten = first.withColumn("_i", nth).where("_i <= 10").groupBy("archive", "gkey").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda r: r["name"]).alias("names")
        )
        group = group.join(ten, ["archive", "gkey"])
    df = outer.join(winner, "archive", "left").join(
        group.select(F.col("archive").alias("_a"), F.col("gkey").alias("_g"), "cov", "volumes", *shown),
        (F.col("archive") == F.col("_a")) & (F.col("w.gkey") == F.col("_g")), "left",
    )
    lone = F.col("w.n") < 2
    weak = (F.col("w.score") < F.col("o.confidence") + 0.08) & ~F.col("w.jp") & lone
    keep_outer = F.col("w").isNull() | (F.col("o_ok") & (((F.col("w.kind") == "named-image") & lone) | weak))
    df = df.withColumn("outer_wins", F.coalesce(keep_outer, F.lit(True)))
    cov = F.when(F.col("cov.kind") == "unknown", F.col("ocov")).otherwise(F.col("cov"))
    df = df.withColumn("coverage", F.when(F.col("outer_wins"), F.col("ocov")).otherwise(cov))
    multi = ~F.col("outer_wins") & (
        ((F.col("coverage.volume_start") > 0) & (F.col("coverage.volume_end") > F.col("coverage.volume_start"))) | (F.col("volumes") > 1)
    )
    df = df.withColumn("multi_volume", F.coalesce(multi, F.lit(False)))
    inherit = F.col("o.has_volume") & ~F.col("w.c.has_volume") & (F.col("okey") == F.col("w.gkey"))
    volume = F.when(F.col("outer_wins"), F.col("o.volume")).when(F.col("multi_volume"), None).when(inherit, F.col("o.volume")).otherwise(F.col("w.c.volume"))
    conf = F.least(F.lit(0.99), F.greatest(F.col("w.c.confidence"), F.least(F.lit(0.99), F.col("w.score"))))
    pick = lambda f: F.when(F.col("outer_wins"), F.col(f"o.{f}")).otherwise(F.col(f"w.c.{f}"))
    return df.select(
        "archive", pick("series").alias("series"), pick("author").alias("author"), volume.alias("volume"),
        volume.isNotNull().alias("has_volume"),
        F.when(F.col("outer_wins"), F.col("o.confidence")).otherwise(conf).alias("confidence"),
        F.when(F.col("outer_wins"), "outer-filename").otherwise(F.col("w.kind")).alias("source"),
        *[F.when(~F.col("outer_wins"), F.col(c)).alias("candidates") for c in shown],
        F.when(F.col("outer_wins"), 0).otherwise(F.col("w.n")).alias("group_size"),
        "coverage", "multi_volume",
    )


def capacity_plan(archives: DataFrame, capacity: DataFrame) -> DataFrame:
    """(destination_volume, required, available, fits): bytes needed per destination volume.
    ``archives`` has (destination_volume, unpacked_bytes, source_bytes)."""
    need = F.greatest(
        output_bytes_estimate(F.col("unpacked_bytes"), F.col("source_bytes")), rewrite_bytes_estimate(F.col("source_bytes"))
    )
    total = archives.groupBy("destination_volume").agg(F.sum(need).alias("required"))
    return total.join(capacity, "destination_volume", "left").select(
        "destination_volume", "required", "available", F.coalesce(F.col("available") >= F.col("required"), F.lit(False)).alias("fits")
    )
