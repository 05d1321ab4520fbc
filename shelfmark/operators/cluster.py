"""Series clustering: which spellings are one series, and what the series is called."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import naming as N
from shelfmark.functions.text import computed_here, has_japanese, has_latin
from shelfmark.operators import pairs as P
from shelfmark.operators.components import components
from shelfmark.operators.ordered import row_numbers, running_total
from shelfmark.operators.stable import pinned, stored


# --- saved aliases -----------------------------------------------------------------------
def alias_index(aliases: DataFrame) -> DataFrame:
    """(key, canonical): one row per canonical key of the alias names.  The canonical name of
    the first alias wins, the strongest rating of all of them is kept."""
    rated = aliases.select(
        N.canonical_key(F.col("alias")).alias("key"), "alias", "canonical",
        F.greatest(
            N.rating_rank(N.rating_split(F.col("alias"))), N.rating_rank(N.rating_split(F.col("canonical")))
        ).alias("rank"),
    ).where("key <> ''")
    return rated.groupBy("key").agg(
        F.min_by("canonical", "alias").alias("first_canonical"), F.max("rank").alias("rank")
    ).select("key", N.with_rating(F.col("first_canonical"), F.col("rank")).alias("canonical"))


def with_alias(df: DataFrame, index: DataFrame, series: str = "series", out: str = "alias_canonical") -> DataFrame:
    """Left join on the canonical key; ``out`` carries the stronger of both ratings.  The index
    is broadcast by AQE while it is small and shuffled when it is not."""
    keyed = computed_here(df, _key=N.canonical_key(F.col(series)))
    hit = index.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
    return (
        keyed.join(hit, "_key", "left")
        .withColumn(
            out,
            F.when(
                F.col("_canonical").isNotNull(),
                N.with_rating(F.col("_canonical"), N.rating_rank(N.rating_split(F.col(series)))),
            ),
        )
        .drop("_key", "_canonical")
    )


# --- names and profiles ----------------------------------------------------------------------
def distinct_names(rows: DataFrame) -> DataFrame:
    """(series, ord, files, key, spin, jp, latin, pid, p): one row per distinct spelling.  ``pid``
    identifies all spellings that every rule treats alike.  ``rows`` may be counted ahead (``files``)."""
    files = F.sum("files") if "files" in rows.columns else F.count("*")
    names = rows.groupBy("series").agg(F.min("ord").alias("ord"), files.alias("files"))
    flag = lambda f: F.col(f"p.{f}").cast("int")
    return N.with_profile(names, "series", "p").select(
        "series", "ord", "files", "p.key", "p.spin", "p.jp", "p.latin",
        F.concat_ws("\x01", "p.key", flag("spin"), flag("jp"), flag("latin")).alias("pid"), "p",
    )


def author_evidence(rows: DataFrame) -> DataFrame:
    """(series, token): every creator name seen with a spelling.  Spellings and authors are far fewer than files."""
    seen = rows.select("series", "author").distinct()
    tokens = computed_here(seen.select("author").distinct(), tokens=N.author_tokens(F.col("author"))).withColumnRenamed("author", "_a")
    return seen.join(tokens, F.col("author") == F.col("_a")).select("series", F.explode("tokens").alias("token")).distinct()


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.lit("").alias("scope"), F.col("key").alias("text")).distinct()


def _to_profiles(found: DataFrame, left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """Key pairs -> profile pairs (a key has at most eight profiles)."""
    lhs = left.select(F.col("key").alias(x), F.col("pid").alias("px"))
    rhs = right.select(F.col("key").alias(y), F.col("pid").alias("py"))
    return found.join(lhs, x).join(rhs, y)


def profile_pairs(names: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All matching profile pairs with different keys.

    Returns ``pairs`` (px, py, rank, score, reason), one row per unordered pair, and ``shared``
    (px, py, token): for pairs that need a common creator, the creators they share."""
    profiles = names.select("pid", "key", "spin", "jp", "latin").where("key <> ''").distinct()
    plain = profiles.where("NOT spin")

    def rule(df, rank, score, reason, *more):
        return df.select(
            "px", "py", F.lit(rank).alias("rank"), score.cast("double").alias("score"), F.lit(reason).alias("reason"), *more
        )

    spin = profiles.where("spin")
    derived = _to_profiles(
        P.prefix_pairs(_texts(profiles), _texts(spin), 6), profiles, spin, "short", "long"
    )
    r2 = rule(derived, 2, F.lit(0.97), fv.SPIN_OFF_REASON)

    one_script = plain.where("jp <> latin")
    mixed = plain.where(has_japanese(F.col("key")) & has_latin(F.col("key")))
    framed = P.prefix_pairs(_texts(one_script), _texts(mixed), 4).withColumn(
        "rest", F.expr("substr(long, length(short) + 1)")
    ).unionByName(
        P.prefix_pairs(_texts(one_script), _texts(mixed), 4, from_end=True)
        .where("NOT startswith(long, short)")
        .withColumn("rest", F.expr("left(long, length(long) - length(short))"))
    )
    bilingual = _to_profiles(
        framed, one_script, mixed, "short", "long"
    ).join(one_script.select(F.col("pid").alias("px"), "jp"), "px")
    crossed = F.when(F.col("jp"), has_latin(F.col("rest"))).otherwise(has_japanese(F.col("rest")))
    r3 = rule(bilingual.where(crossed), 3, F.lit(0.98), fv.BILINGUAL_REASON)

    # One pass over all keys serves both bounds: names of one creator may differ a little more.
    close = pinned(P.near_pairs(_texts(plain), 0.86))
    minor = close.where(F.col("sim") >= 0.90).select(F.col("a").alias("short"), F.col("b").alias("long"), "sim")
    r4 = rule(_to_profiles(minor, plain, plain, "short", "long"), 4, F.col("sim"), fv.MINOR_REASON)

    by_token = names.join(evidence, "series").select("pid", "key", "spin", "token").distinct()
    scoped = by_token.select(F.col("token").alias("scope"), F.col("key").alias("text")).distinct()
    scoped_plain = by_token.where("NOT spin").select(F.col("token").alias("scope"), F.col("key").alias("text")).distinct()

    def scoped_profiles(found, keep):
        lhs = keep.select(F.col("token").alias("scope"), F.col("key").alias("short"), F.col("pid").alias("px"))
        rhs = keep.select(F.col("token").alias("scope"), F.col("key").alias("long"), F.col("pid").alias("py"))
        return found.join(lhs, ["scope", "short"]).join(rhs, ["scope", "long"])

    subtitle = P.prefix_pairs(scoped, scoped, 6).where("length(long) - length(short) >= 2")
    r5 = rule(scoped_profiles(subtitle, by_token), 5, F.lit(0.96), fv.SUBTITLE_REASON, F.col("scope").alias("token"))

    inserted = P.inserted_pairs(scoped_plain).withColumn("s", F.lit(0.95))
    near = (
        close.select("a", "b", F.col("sim").alias("s")).join(scoped_plain.select("scope", F.col("text").alias("a")), "a")
        .join(scoped_plain.select("scope", F.col("text").alias("b")), ["scope", "b"])
        .select("scope", F.col("a").alias("short"), F.col("b").alias("long"), "s")
    )
    kept = by_token.where("NOT spin")
    r6 = rule(
        scoped_profiles(inserted, kept), 6, F.col("s"), fv.AUTHOR_VARIATION_REASON, F.col("scope").alias("token")
    ).unionByName(
        rule(scoped_profiles(near, kept), 7, F.col("s"), fv.AUTHOR_VARIATION_REASON, F.col("scope").alias("token"))
    )

    everything = (
        r2.unionByName(r3).unionByName(r4).withColumn("token", F.lit(None).cast("string"))
        .unionByName(r5).unionByName(r6)
        .withColumns({"px": F.least("px", "py"), "py": F.greatest("px", "py")})
    )
    everything = pinned(everything)
    best = everything.groupBy("px", "py").agg(F.min(F.struct("rank", "score", "reason")).alias("best")).select(
        "px", "py", "best.*"
    )
    shared = everything.where("token IS NOT NULL").select("px", "py", "token").distinct()
    return best, shared


def name_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, score, reason) for every two spellings that match, a before b.  This is the full
    pair list for inspection; clustering itself works on profile pairs."""
    names = pinned(distinct_names(rows))
    evidence = pinned(author_evidence(rows))
    best, shared = profile_pairs(names, evidence)
    n = names.select("series", "pid", "ord")
    x = n.select(F.col("series").alias("a"), F.col("pid").alias("px"), F.col("ord").alias("oa"))
    y = n.select(F.col("series").alias("b"), F.col("pid").alias("py"), F.col("ord").alias("ob"))
    free = best.where("rank <= 4").join(x, "px").join(y, "py")
    ex = evidence.select(F.col("series").alias("a"), "token")
    ey = evidence.select(F.col("series").alias("b"), "token")
    tied = (
        best.where("rank > 4").join(shared, ["px", "py"]).join(x.join(ex, "a"), ["px", "token"])
        .join(y.join(ey, "b"), ["py", "token"])
    )
    different = free.unionByName(tied, allowMissingColumns=True).select("a", "b", "oa", "ob", "score", "reason")
    k = names.where("key <> ''")
    same = k.select(F.col("series").alias("a"), "key", F.col("ord").alias("oa")).join(
        k.select(F.col("series").alias("b"), "key", F.col("ord").alias("ob")), "key"
    ).where("oa < ob").select(
        "a", "b", "oa", "ob", F.lit(1.0).alias("score"), F.lit(fv.EXACT_REASON).alias("reason")
    )
    swap = F.col("oa") > F.col("ob")
    return different.unionByName(same).select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        "score", "reason",
    ).distinct()


def name_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``name_pairs`` without writing them out: ``members`` (series, class, key, links), a row for each spelling with
    the number of spellings that it matches, and ``pairs`` (a, b, score, reason) of classes.

    A class holds the spellings that no rule tells apart: those of one profile with the same creators.  Spellings of two classes
    match if the classes are a pair, and all spellings of one key match each other, so a key with n spellings costs n rows and not
    n squared."""
    names = pinned(distinct_names(rows))
    evidence = pinned(author_evidence(rows))
    best, shared = profile_pairs(names, evidence)
    tokens = evidence.groupBy("series").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    placed = names.select("series", "pid", "key").join(tokens, "series", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    placed = pinned(placed.withColumn("class", F.concat_ws("\x02", "pid", F.array_join("tokens", "\x03"))))
    classes = pinned(placed.groupBy("class", "pid", "tokens").agg(F.count("*").alias("spellings")))
    side = lambda p, c: classes.select(F.col("pid").alias(p), F.col("class").alias(c))
    free = best.where("rank <= 4").join(side("px", "a"), "px").join(side("py", "b"), "py")
    made = classes.select("pid", "class", F.explode("tokens").alias("token"))
    known = lambda p, c: made.select(F.col("pid").alias(p), F.col("class").alias(c), "token")
    tied = best.where("rank > 4").join(shared, ["px", "py"]).join(known("px", "a"), ["px", "token"]).join(known("py", "b"), ["py", "token"])
    pairs = pinned(free.unionByName(tied, allowMissingColumns=True).select("a", "b", "score", "reason").distinct())
    sizes = classes.select(F.col("class").alias("other"), "spellings")
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    across = both.join(sizes, "other").groupBy("class").agg(F.sum("spellings").alias("_across"))
    within = placed.where("key <> ''").groupBy("key").agg((F.count("*") - 1).alias("_within"))
    links = F.coalesce("_across", F.lit(0)) + F.coalesce("_within", F.lit(0))
    members = placed.join(across, "class", "left").join(within, "key", "left").select("series", "class", "key", links.cast("bigint").alias("links"))
    return members, pairs


# --- clusters -----------------------------------------------------------------------------------
def _first_matches(names: DataFrame, evidence: DataFrame, best: DataFrame, shared: DataFrame) -> DataFrame:
    """(series, reason, score) of each spelling's earliest matching partner."""
    hit = lambda o: F.struct(F.col(o).alias("ord"), "reason", "score")
    # Same key: the first spelling of the key, or the second one for the first itself.
    firsts = names.where("key <> ''").groupBy("key").agg(
        F.min("ord").alias("first"), F.count("*").alias("spellings"), F.min_by("series", "ord").alias("lead")
    )
    seconds = (
        names.join(firsts.select("key", F.col("first")), "key").where("ord > first").groupBy("key").agg(F.min("ord").alias("second"))
    )
    key_partner = firsts.join(seconds, "key")
    profile_first = names.groupBy("pid").agg(F.min("ord").alias("pord"))
    both = best.select("px", "py", "rank", "score", "reason").unionByName(
        best.select(F.col("py").alias("px"), F.col("px").alias("py"), "rank", "score", "reason")
    )
    free = (
        both.where("rank <= 4").join(profile_first.withColumnRenamed("pid", "py"), "py")
        .groupBy("px").agg(F.min(hit("pord")).alias("free"))
    )
    token_first = names.join(evidence, "series").groupBy("pid", "token").agg(F.min("ord").alias("pord"))
    links = shared.unionByName(shared.select(F.col("py").alias("px"), F.col("px").alias("py"), "token"))
    tied_by_token = (
        both.where("rank > 4").join(links, ["px", "py"])
        .join(token_first.withColumnRenamed("pid", "py"), ["py", "token"])
        .groupBy("px", "token").agg(F.min(hit("pord")).alias("tied"))
    )
    tied = (
        names.join(evidence, "series").select("series", F.col("pid").alias("px"), "token")
        .join(tied_by_token, ["px", "token"]).groupBy("series").agg(F.min("tied").alias("tied"))
    )
    same = F.struct(
        F.when(F.col("ord") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("ord"),
        F.lit(fv.EXACT_REASON).alias("reason"), F.lit(1.0).alias("score"),
    )
    return (
        names.join(key_partner.drop("lead", "spellings"), "key", "left")
        .join(free.withColumnRenamed("px", "pid"), "pid", "left")
        .join(tied, "series", "left")
        .select(
            "series",
            F.array_min(
                F.array_compact(F.array(F.when(F.col("first").isNotNull(), same), F.col("free"), F.col("tied")))
            ).alias("hit"),
        )
        .select("series", F.col("hit.reason").alias("reason"), F.col("hit.score").alias("score"))
    )


def _canonical(members: DataFrame, bilingual: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(cluster, canonical): alias first, then the most frequent key, then the display order;
    the strongest rating of the cluster is put in front."""
    per_key = members.groupBy("cluster", "key").agg(F.sum("files").alias("key_files"))
    most = per_key.groupBy("cluster").agg(F.max("key_files").alias("key_files"))
    tied = members.join(per_key.join(most, ["cluster", "key_files"]), ["cluster", "key"]).select(
        "cluster", "series", "pid", "ord", "spin", "p", N.display_rank(F.col("p")).alias("r")
    )
    main = tied.groupBy("cluster").agg(F.min("spin").alias("spin"))
    tied = tied.join(main, ["cluster", "spin"])
    # The display order is a plain minimum unless two tied names are one title in two scripts;
    # then the shorter of the two wins first and the order of appearance matters.
    linked = bilingual.select(F.explode(F.array("px", "py")).alias("pid")).distinct()
    marked = tied.join(linked.withColumn("linked", F.lit(True)), "pid", "left").withColumn(
        "linked", F.coalesce("linked", F.lit(False))
    )
    state = marked.groupBy("cluster").agg(F.max("linked").alias("any_linked"), F.min_by("series", F.struct("r", "ord")).alias("pick"))
    plain = state.where("NOT any_linked").select("cluster", "pick")
    ordered = marked.join(state.where("any_linked").select("cluster"), "cluster", "left_semi")
    # Between two linked names only the best unlinked one can matter: reduce each such run.
    runs = running_total(ordered, ["cluster"], [F.col("ord")], F.col("linked").cast("int"), "run")
    reduced = runs.groupBy("cluster", "run", "linked").agg(F.min_by(F.struct("ord", "p"), F.struct("r", "ord")).alias("c"))
    picked = plain.unionByName(display_fold(reduced.select("cluster", "c.ord", "c.p")))
    if aliases is not None:
        hits = members.join(aliases, "key").where(N.series_usable(F.col("canonical"))).groupBy("cluster").agg(
            F.min_by("canonical", "ord").alias("saved")
        )
        picked = picked.join(hits, "cluster", "left").select("cluster", F.coalesce("saved", "pick").alias("pick"))
    ranks = members.groupBy("cluster").agg(F.max("p.rank").alias("rank"))
    return picked.join(ranks, "cluster").select("cluster", N.with_rating(F.col("pick"), F.col("rank")).alias("canonical"))


FOLD_SLICE = 256


def display_fold(rows: DataFrame) -> DataFrame:
    """(cluster, pick): the name that stays when the names of a cluster (cluster, ord, p) are compared one after the other.

    The comparison is not transitive, so the order matters and no aggregate will do.  The names of a cluster are numbered
    over ranges and folded in slices of ``FOLD_SLICE``, each of which starts with what the slice before left: a row holds one slice,
    and all clusters take their k-th slice in one round."""
    if rows.isEmpty():
        return rows.select("cluster", F.col("p.name").alias("pick"))
    numbered = row_numbers(rows, ["cluster"], [F.col("ord")], "_n").withColumn("_slice", F.floor((F.col("_n") - 1) / FOLD_SLICE))
    slices = pinned(numbered.groupBy("cluster", "_slice").agg(F.array_sort(F.collect_list(F.struct("_n", "p"))).alias("cs")))
    better = lambda best, c: F.when(N.is_better_display(c["p"], best), c["p"]).otherwise(best)
    first = slices.where("_slice = 0")
    state = pinned(first.select("cluster", F.aggregate(F.slice("cs", F.lit(2), F.size("cs")), F.col("cs")[0]["p"], better).alias("best")))
    for k in range(1, slices.agg(F.max("_slice")).first()[0] + 1):
        more = slices.where(F.col("_slice") == k).select("cluster", "cs")
        state = pinned(state.join(more, "cluster", "left").select(
            "cluster", F.when(F.col("cs").isNull(), F.col("best")).otherwise(F.aggregate("cs", F.col("best"), better)).alias("best")
        ))
    return state.select("cluster", F.col("best.name").alias("pick"))


def cluster_names(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(series, cluster, canonical, reason, score, files): the verdict for every spelling.

    ``rows`` has (series, author, ord), one row per file, usable series only; ``aliases`` is an
    ``alias_index``.  Clusters of one file keep their spelling and carry no reason."""
    names = pinned(distinct_names(rows))
    evidence = pinned(author_evidence(rows))
    best, shared = profile_pairs(names, evidence)
    best = pinned(best)
    key_lead = names.where("key <> ''").groupBy("key").agg(F.min("pid").alias("px"))
    key_edges = names.join(key_lead, "key").select("px", F.col("pid").alias("py")).where("px <> py")
    roots = components(best.select("px", "py").unionByName(key_edges), "px", "py")
    members = (
        names.join(roots.withColumnRenamed("node", "pid"), "pid", "left")
        .withColumn("cluster", F.coalesce("root", "pid"))
        .drop("root")
    )
    sizes = members.groupBy("cluster").agg(F.sum("files").alias("cluster_files"))
    grouped = pinned(members.join(sizes.where("cluster_files > 1"), "cluster"))
    canonical = _canonical(grouped, best.where("rank = 3"), aliases)
    matches = _first_matches(names, evidence, best, shared)
    return (
        members.join(canonical, "cluster", "left")
        .join(matches, "series", "left")
        .select(
            "series", "cluster", "files",
            F.coalesce("canonical", "series").alias("canonical"),
            F.when(F.col("canonical").isNotNull(), F.coalesce("reason", F.lit("series cluster"))).alias("reason"),
            F.when(F.col("canonical").isNotNull(), F.coalesce("score", F.lit(0.95))).alias("score"),
        )
    )


def clustered(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``rows`` with the clustered ``series`` and ``cluster`` (canonical, reason, score).  Rows
    whose series is unusable pass through.  Saved aliases apply before clustering.  Spellings are far fewer than files: each
    is looked up and judged once, and a file only meets the verdict of its own."""
    counted = stored(rows.groupBy("series", "author").agg(F.min("ord").alias("ord"), F.count("*").alias("files")))
    names = counted.select("series").distinct()
    names = with_alias(names, aliases) if aliases is not None else names.withColumn("alias_canonical", F.lit(None).cast("string"))
    hit = N.series_usable(F.col("series")) & F.col("alias_canonical").isNotNull()
    names = computed_here(names, _saved=hit)
    names = names.select("series", "_saved", F.when(F.col("_saved"), F.col("alias_canonical")).otherwise(F.col("series")).alias("_name"))
    names = stored(computed_here(names, _ok=N.series_usable(F.col("_name"))))
    known = counted.join(names.where("_ok"), "series").select(F.col("_name").alias("series"), "author", "ord", "files")
    verdict = cluster_names(known, aliases).select(
        F.col("series").alias("_spelling"), F.col("canonical").alias("_canonical"), F.col("reason").alias("_reason"),
        F.col("score").alias("_score"),
    )
    verdict = stored(names.join(verdict, F.col("_name") == F.col("_spelling"), "left").withColumnRenamed("series", "_series").drop("_spelling", "_ok"))
    joined = rows.join(verdict, F.col("series") == F.col("_series"), "left")
    shown = F.coalesce("_canonical", "_name", "series")
    reason = F.when(F.col("_saved"), F.lit("saved alias")).otherwise(F.col("_reason"))
    score = F.when(F.col("_saved"), F.lit(1.0)).otherwise(F.col("_score"))
    return joined.withColumns(
        {
            "cluster": F.when(
                reason.isNotNull(),
                F.struct(shown.alias("canonical"), reason.alias("reason"), score.alias("score")),
            ),
            "series": shown,
        }
    ).drop("_series", "_name", "_canonical", "_reason", "_score", "_saved")


def cluster_aliases(verdict: DataFrame) -> DataFrame:
    """(canonical, alias, position) of clusters with several spellings, alias order by lower case.
    A table, not an array: a cluster may hold any number of spellings."""
    from shelfmark.operators.ordered import row_numbers

    rows = verdict.where("reason IS NOT NULL").select("cluster", "canonical", F.col("series").alias("alias"))
    return row_numbers(
        rows.withColumn("low", F.lower("alias")), ["cluster"], [F.col("low"), F.col("alias")], "position"
    ).select("canonical", "alias", "position")
