"""Queries of archive members and inbox plans, over member lists derived from pages and documents."""

from pyspark.sql import functions as F

from checks import sql_flow as X
from checks import sql_naming as S
from checks import views as V
from checks.memo import own_work, stage
from shelfmark.functions import fixed_values as fv
from shelfmark.functions import naming as N
from shelfmark.functions import rx
from shelfmark.functions import text as T
from shelfmark.operators import members as M
from shelfmark.operators.stable import pinned, stored
from shelfmark.plans import inbox as I
from shelfmark.sources import reports as P

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


def shelf(spark, sf):
    return stage(spark, sf, "shelf", lambda: stored(V.shelf(spark, sf)))


SHELF = f"SELECT *, ends_with(name, '/') AS is_dir, regexp_replace(name, '(.)/$', '\\1') AS clean FROM ({V.SHELF_SQL})"
_UNSAFE = "(clean IN ('', '.', '..') OR starts_with(clean, '/') OR starts_with(clean, '../'))"
_EXT = S.extension(S.base("clean"))
_LIKE = S.isin(S.extension(S.base("name")), fv.ARCHIVE_LIKE_EXTENSIONS)


# --- predicates ----------------------------------------------------------------------------
@query("nested_filter", f"SELECT ordinal, {S.isin(S.extension(S.base('name')), fv.NESTED_EXTENSIONS)} AS nested, {_LIKE} AS archive_like FROM ({V.SHELF_SQL})")
def nested_filter(spark, sf):
    n = F.col("name")
    return shelf(spark, sf).select("ordinal", M.is_nested_archive(n).alias("nested"), M.is_archive_like(n).alias("archive_like"))


@query("unsafe_entries", f"SELECT archive, ordinal, name FROM ({SHELF}) WHERE {_UNSAFE}")
def unsafe_entries(spark, sf):
    return M.with_clean_names(shelf(spark, sf)).where("unsafe").select("archive", "ordinal", "name")


@query("climbing_entries", f"SELECT archive, ordinal, name FROM ({V.DEEP_SQL}) WHERE climbs")
def climbing_entries(spark, sf):
    return M.with_clean_names(V.deep(spark, sf)).where("unsafe").select("archive", "ordinal", "name")


@query("compression_class", f"SELECT ordinal, CASE WHEN {S.isin(S.extension(S.base('name')), fv.STORED_EXTENSIONS)} THEN 'store' ELSE 'deflate' END AS method FROM ({V.SHELF_SQL})")
def compression_class(spark, sf):
    return shelf(spark, sf).select("ordinal", M.compression_class(F.col("name")).alias("method"))


_OUTB = "(CASE WHEN u > 0 THEN u ELSE b * 2 END + greatest(268435456, (CASE WHEN u > 0 THEN u ELSE b * 2 END) // 20))"
_REWB = "(CASE WHEN b <= 0 THEN 536870912 ELSE b * 2 + greatest(268435456, b // 10) END)"
_SPACE = "SELECT o_orderkey AS id, o_custkey % 5 AS destination_volume, CAST(floor(o_totalprice) AS BIGINT) * 20000 AS b, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) * 50000 END AS u FROM {orders}"


@query("space_estimate", f"SELECT id, {_OUTB} AS output_bytes, {_REWB} AS rewrite_bytes FROM ({_SPACE.format(orders='orders')})")
def space_estimate(spark, sf):
    s = spark.sql(_SPACE, orders=V.table(spark, sf, "orders"))
    return s.select("id", M.output_bytes_estimate(F.col("u"), F.col("b")).alias("output_bytes"), M.rewrite_bytes_estimate(F.col("b")).alias("rewrite_bytes"))


@query(
    "capacity_plan",
    f"SELECT destination_volume, required, available, available >= required AS fits FROM (SELECT destination_volume, sum(greatest({_OUTB}, {_REWB}))::BIGINT AS required, sum(b)::BIGINT * 3 AS available FROM ({_SPACE.format(orders='orders')}) GROUP BY 1)",
)
def capacity_plan(spark, sf):
    s = spark.sql(_SPACE, orders=V.table(spark, sf, "orders"))
    capacity = s.groupBy("destination_volume").agg((F.sum("b") * 3).alias("available"))
    return M.capacity_plan(s.select("destination_volume", F.col("u").alias("unpacked_bytes"), F.col("b").alias("source_bytes")), capacity)


# --- facts and groups -------------------------------------------------------------------------
def _facts(src):
    return (
        "SELECT archive, count(*) AS entries, count_if(NOT is_dir) AS regular_files, coalesce(sum(CASE WHEN NOT is_dir AND size > 0 THEN size END), 0)::BIGINT AS unpacked_bytes, "
        f"count_if(NOT is_dir AND {_LIKE}) AS nested_archives, CASE WHEN min(CASE WHEN NOT is_dir THEN len(string_split(clean, '/')) END) >= 2 AND count(DISTINCT CASE WHEN NOT is_dir THEN split_part(clean, '/', 1) END) = 1 "
        f"AND NOT bool_or(NOT is_dir AND {_UNSAFE}) THEN min(CASE WHEN NOT is_dir THEN split_part(clean, '/', 1) END) ELSE '' END AS common_root, "
        f"(count_if(NOT is_dir) = 1 AND coalesce({S.isin(S.extension(S.base('max(CASE WHEN NOT is_dir THEN name END)')), ['.zip', '.cbz'])}, false)) AS single_nested_zip FROM ({src}) GROUP BY archive"
    )


# One archive per document language and source, so that some have a single root folder.
_BOX = "SELECT * REPLACE (archive || '/' || CAST(ordinal % 9 AS VARCHAR) AS archive) FROM ({src})"


def boxes(spark, sf):
    return shelf(spark, sf).withColumn("archive", F.concat("archive", F.lit("/"), (F.col("ordinal") % 9).cast("string")))


BOXES = _BOX.format(src=SHELF)


@query("archive_facts", _facts(BOXES))
def archive_facts(spark, sf):
    return M.archive_facts(boxes(spark, sf))


@query("archive_limits", f"SELECT archive, CASE WHEN n > 3 THEN 'nested archives' WHEN c > 40 THEN 'entries' WHEN b > 100000 THEN 'expanded bytes' END AS violation FROM (SELECT archive, count_if(NOT is_dir AND {_LIKE}) AS n, count_if(NOT is_dir) AS c, sum(CASE WHEN NOT is_dir THEN size END) AS b FROM ({BOXES}) GROUP BY 1)")
def archive_limits(spark, sf):
    return M.archive_limits(boxes(spark, sf), nested=3, count=40, expanded=100_000)


@query(
    "split_groups",
    f"WITH f AS ({_facts(BOXES)}), e AS (SELECT b.archive, common_root, size, CASE WHEN common_root <> '' AND starts_with(clean, common_root || '/') THEN substr(clean, length(common_root) + 2) ELSE clean END AS inn "
    f"FROM ({BOXES}) b JOIN f USING (archive) WHERE NOT is_dir AND NOT {_UNSAFE}), g AS (SELECT archive, common_root, CASE WHEN contains(inn, '/') THEN split_part(inn, '/', 1) ELSE '' END AS grp, count(*) AS files, sum(size)::BIGINT AS bytes FROM e GROUP BY ALL) "
    "SELECT archive, CASE WHEN max(grp) OVER (PARTITION BY archive) = '' THEN common_root ELSE grp END AS \"group\", files, bytes FROM g",
)
def split_groups(spark, sf):
    return M.split_groups(boxes(spark, sf))


_DUPES = "SELECT archive, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'cover.jpg' WHEN ordinal % 7 = 1 THEN 'Cover.JPG' WHEN ordinal % 7 = 2 THEN clean ELSE 'p/' || CAST(ordinal % 2 AS VARCHAR(3)) || '.png' END AS name FROM ({src})"


@query(
    "unique_members",
    f"SELECT archive, ordinal, CASE WHEN k = 1 THEN name ELSE {S.stem('name')} || ' (' || k || ')' || {S.ext('name', rx.EXTENSION)} END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY archive, lower(name) ORDER BY ordinal) AS k FROM ({_DUPES.format(src=SHELF)}))",
)
def unique_members(spark, sf):
    src = shelf(spark, sf).withColumn("clean", M.clean_member(F.col("name"))).select("archive", "ordinal", "clean")
    return M.unique_members(spark.sql(_DUPES.replace("{src}", "{src}").replace("({src})", "{src}"), src=src)).select("archive", "ordinal", "unique_name")


# --- multipart -----------------------------------------------------------------------------------
_RARS = "SELECT '/in/' || source || '/' || CASE doc_id % 2 WHEN 0 THEN 'Set ' ELSE 'SET ' END || lang || '.part' || CAST(doc_id % 50 + 1 AS VARCHAR(9)) || '.rar' AS path FROM {documents}"
_RP = f"SELECT regexp_replace(path, '/[^/]*$', '') AS folder, lower({S.ext(S.base('path'), rx.MULTIPART, 1, True)}) AS base, CAST({S.ext(S.base('path'), rx.MULTIPART, 2, True)} AS BIGINT) AS part, path FROM (SELECT DISTINCT path FROM ({_RARS.format(documents='documents')}))"


def rar_parts(spark, sf):
    return M.multipart_parts(spark.sql(_RARS, documents=V.table(spark, sf, "documents")).distinct())


@query("multipart_sets", f"SELECT folder, base, min(CASE WHEN part = 1 THEN path END) AS primary, count(*) AS parts, max(part) AS last_part, max(part) - count(DISTINCT part) AS missing FROM ({_RP}) GROUP BY 1, 2")
def multipart_sets(spark, sf):
    return M.multipart_sets(rar_parts(spark, sf))


@query(
    "missing_parts",
    f"SELECT folder, base, p + 1 AS first, part - 1 AS last FROM (SELECT folder, base, part, coalesce(lag(part) OVER (PARTITION BY folder, base ORDER BY part), 0) AS p FROM (SELECT DISTINCT folder, base, part FROM ({_RP}))) WHERE part - p > 1",
)
def missing_parts(spark, sf):
    return M.missing_parts(rar_parts(spark, sf))


# --- name evidence -----------------------------------------------------------------------------------
_NUM = rx.re2(r"\A[<d>\-_.()\[\] ]*\z")


def _useful_dir(c):
    n = f"lower({S.trim_u(c)})"
    return f"({n} <> '' AND NOT ({S.isin(n, fv.GENERIC_DIRECTORIES)}) AND NOT regexp_matches({n}, {S.q(_NUM)}))"


def _useful_image(c):
    n = S.trim_u(c)
    camera = S.has(f"lower({n})", r"\A(?:" + "|".join(fv.CAMERA_PREFIXES) + r")[<u>]*[<d>\-_.()\[\] ]*[<u>]*\z")
    return f"(length({n}) >= 3 AND NOT regexp_matches({n}, {S.q(_NUM)}) AND NOT {camera})"


_CLEAN = "regexp_replace(regexp_replace(trim(name), '/$', ''), '^(\\.\\./)+', '')"
_CE = f"SELECT archive, ordinal, is_dir, {_CLEAN} AS c FROM ({SHELF})"
_CB = S.base("c")
CAND = (
    f"WITH e AS ({_CE}), f AS (SELECT archive, ordinal, CASE WHEN {S.isin(S.extension(_CB), fv.NESTED_EXTENSIONS)} THEN 'nested-archive' WHEN {S.isin(S.extension(_CB), fv.IMAGE_EXTENSIONS)} AND {_useful_image(S.stem(_CB))} THEN 'named-image' END AS kind, "
    f"{S.trim_u(S.stem(_CB))} AS name FROM e WHERE NOT is_dir), g AS (SELECT archive, kind, lower(name) AS low, min(ordinal) AS n, arg_min(name, ordinal) AS name FROM f WHERE kind IS NOT NULL AND name <> '' GROUP BY 1, 2, 3), "
    f"d AS (SELECT archive, min({S.trim_u(S.q('') + ' || top')}) AS name FROM (SELECT archive, is_dir, c, split_part(c, '/', 1) AS top FROM e) WHERE (contains(c, '/') OR is_dir) AND {_useful_dir('top')} GROUP BY archive, lower(top)), "
    "u AS (SELECT archive, kind, name, 0 AS late, n FROM g UNION ALL SELECT archive, 'top-directory', name, 1, 0 FROM d), "
    "cand AS (SELECT archive, kind, name, row_number() OVER (PARTITION BY archive ORDER BY late, n, name) AS pos FROM u) "
)


@query("name_candidates", CAND + "SELECT archive, pos, kind, name FROM cand")
def name_candidates(spark, sf):
    return M.name_candidates(shelf(spark, sf)).select("archive", "pos", "kind", "name")


def _consensus_sql():
    sc = S.coverage(S.parsed("SELECT * FROM cand", "name", p="c_"), "name")
    sc = S.stage(sc, ok=S.usable("c_series"), gk=S.group_key("c_series"), jp=S.japanese("name"))
    bonus = "CASE kind WHEN 'nested-archive' THEN CAST(0.2 AS DOUBLE) WHEN 'top-directory' THEN CAST(0.16 AS DOUBLE) ELSE CAST(0.07 AS DOUBLE) END"
    o = S.parsed(f"SELECT DISTINCT archive FROM ({V.SHELF_SQL})", "archive", p="o_")
    o = S.coverage(o, "archive", "k_")
    o = S.stage(o, o_ok=S.usable("o_series"), okey=S.group_key("o_series"))
    return (
        CAND
        + f", s0 AS ({sc}), s1 AS (SELECT *, {bonus} AS bonus, count(*) OVER (PARTITION BY archive, gk) AS n FROM s0 WHERE ok), "
        "s AS (SELECT *, c_confidence + bonus + CASE WHEN jp THEN CAST(0.34 AS DOUBLE) ELSE 0 END + CASE WHEN n < 2 THEN CAST(0 AS DOUBLE) ELSE least(CAST(0.24 AS DOUBLE), CAST(0.08 AS DOUBLE) * (n - 1)) END AS score FROM s1), "
        "w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY archive ORDER BY round(score, 4) DESC, jp DESC, bonus DESC, pos) = 1), "
        f"gg AS (SELECT archive, gk, {S.merged()}, count(DISTINCT CASE WHEN c_has_volume THEN c_volume END) AS volumes FROM s GROUP BY 1, 2), "
        f"o AS ({o}), j AS (SELECT o.archive, o_series, o_author, o_volume, o_has_volume, o_confidence, o_ok, okey, k_kind, k_vs, k_ve, w.score, w.jp, w.n, w.kind AS wkind, w.gk, w.c_series, w.c_author, w.c_volume, w.c_has_volume, w.c_confidence, "
        "gg.kind AS gkind, gg.volume_start, gg.volume_end, gg.volumes FROM o LEFT JOIN w ON w.archive = o.archive LEFT JOIN gg ON gg.archive = w.archive AND gg.gk = w.gk), "
        "r AS (SELECT *, coalesce(score IS NULL OR (o_ok AND ((wkind = 'named-image' AND n < 2) OR (score < o_confidence + CAST(0.08 AS DOUBLE) AND NOT jp AND n < 2))), true) AS ow FROM j), "
        "t AS (SELECT *, CASE WHEN ow OR gkind = 'unknown' THEN k_vs ELSE volume_start END AS fvs, CASE WHEN ow OR gkind = 'unknown' THEN k_ve ELSE volume_end END AS fve FROM r), "
        "v AS (SELECT *, coalesce(NOT ow AND ((fvs > 0 AND fve > fvs) OR volumes > 1), false) AS mv FROM t) "
        "SELECT archive, CASE WHEN ow THEN o_series ELSE c_series END AS series, CASE WHEN ow THEN o_author ELSE c_author END AS author, "
        "CASE WHEN ow THEN o_volume WHEN mv THEN NULL WHEN o_has_volume AND NOT c_has_volume AND okey = gk THEN o_volume ELSE c_volume END AS volume, "
        "round(CASE WHEN ow THEN o_confidence ELSE least(CAST(0.99 AS DOUBLE), greatest(c_confidence, least(CAST(0.99 AS DOUBLE), score))) END, 6) AS confidence, "
        "CASE WHEN ow THEN 'outer-filename' ELSE wkind END AS source, CASE WHEN ow THEN 0 ELSE n END AS group_size, mv AS multi_volume, fvs AS volume_start, fve AS volume_end FROM v"
    )


CONSENSUS = _consensus_sql()


def consensus(spark, sf, names=False):
    entries = shelf(spark, sf)
    return M.name_consensus(entries.select("archive").distinct(), M.placed_candidates(entries), names)


@query("name_consensus", f"SELECT archive, series, author, volume, confidence, source, group_size FROM ({CONSENSUS})")
def name_consensus(spark, sf):
    return consensus(spark, sf).select("archive", "series", "author", "volume", F.round("confidence", 6).alias("confidence"), "source", "group_size")


@query("multi_volume", f"SELECT archive, multi_volume, volume_start, volume_end FROM ({CONSENSUS})")
def multi_volume(spark, sf):
    return consensus(spark, sf).select("archive", "multi_volume", F.col("coverage.volume_start").alias("volume_start"), F.col("coverage.volume_end").alias("volume_end"))


_SHOWN = CONSENSUS[: CONSENSUS.rindex("SELECT archive, CASE WHEN ow THEN o_series")]


@query(
    "consensus_candidates",
    _SHOWN + ", names AS (SELECT archive, gk, array_to_string(list(name ORDER BY pos)[1:10], chr(10)) AS names FROM (SELECT archive, gk, name, min(pos) AS pos FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2) "
    "SELECT v.archive, names AS candidates FROM v LEFT JOIN names ON names.archive = v.archive AND names.gk = v.gk AND NOT v.ow",
)
def consensus_candidates(spark, sf):
    """The first ten names that speak for a consensus, one below the other."""
    return consensus(spark, sf, names=True).select("archive", F.array_join("candidates", "\n").alias("candidates"))


# --- outputs -----------------------------------------------------------------------------------------
# Every part name with its types as output groups of one plan per brand.
_GROUPS = (
    "SELECT DISTINCT p_brand AS plan, CASE p_size % 5 WHEN 0 THEN p_name || ' story v' || CAST(p_size AS VARCHAR(9)) WHEN 1 THEN p_name || ' story ' || CAST(p_size AS VARCHAR(9)) || '-' || CAST(p_size + 3 AS VARCHAR(9)) "
    "WHEN 2 THEN upper(p_name) || ' STORY' WHEN 3 THEN p_name || ' storys' ELSE '' END AS grp, p_partkey AS position FROM {part} WHERE p_partkey % 3 = 0 OR p_name LIKE '% ring'"
)
_GROUPS = _GROUPS.replace(" WHERE p_partkey % 3 = 0 OR p_name LIKE '% ring'", "").replace("p_brand AS plan", "p_brand || CAST(p_partkey % 40 AS VARCHAR(9)) AS plan")


def groups(spark, sf):
    return spark.sql(_GROUPS, part=V.table(spark, sf, "part")).withColumnRenamed("grp", "group")


def _plans(src):
    return f"SELECT plan, arg_min(p_series, position) AS series, count(*) > 4 AS needs_review FROM {src} GROUP BY 1"


_G = _GROUPS.format(part="part")
_GS = S.parsed(f"SELECT *, {S.sub(S.trim_u('grp'), rx.OUTPUT_RANGE_TAIL, '', True)} AS bare FROM ({_G})", "bare")
_GP = S.stage(f"SELECT plan, grp, position, p_series FROM ({_GS})", **X.profile("p_series", "g_"))
_ONE = (
    "SELECT plan, bool_and(g_ok AND (score >= 0.86 OR g_name = f_name)) AS ok FROM (SELECT n.*, CAST("
    + X.pair_score("f_", "g_")
    + " AS DOUBLE) AS score FROM (SELECT gp.*, p_series AS g_name, "
    + ", ".join(f"first_value(g_{c}) OVER w AS f_{c}" for c in ("key", "ok", "spin", "jp", "latin"))
    + ", first_value(p_series) OVER w AS f_name FROM gp WHERE trim(grp) <> '' WINDOW w AS (PARTITION BY plan ORDER BY position)) n) GROUP BY 1"
)


@query("one_work", f"WITH gp AS MATERIALIZED ({_GP}), o AS ({_ONE}) SELECT plan, coalesce(ok, false) AS is_one_work FROM (SELECT DISTINCT plan FROM gp) LEFT JOIN o USING (plan)")
def one_work(spark, sf):
    return I.one_work(groups(spark, sf))


@query(
    "group_routing",
    f"WITH gp AS MATERIALIZED ({_GP}), o AS ({_ONE}), pl AS ({S.stage('SELECT plan, arg_min(p_series, position) AS series, count(*) > 4 AS needs_review FROM gp WHERE trim(grp) <> chr(32) GROUP BY 1', **X.profile('series', 'k_'))}), "
    f"al AS ({S.stage('SELECT plan, arg_max(p_series, position) AS alias FROM gp WHERE trim(grp) <> chr(32) GROUP BY 1', **X.profile('alias', 'a_'))}), "
    f"h AS (SELECT gp.plan, gp.grp, {X.pair_score('k_', 'g_')} >= 0.86 AS hit FROM gp JOIN pl USING (plan) UNION ALL SELECT gp.plan, gp.grp, {X.pair_score('a_', 'g_')} >= 0.86 FROM gp JOIN al USING (plan)), "
    "m AS (SELECT plan, grp, bool_or(hit) AS matched FROM h GROUP BY 1, 2) "
    "SELECT gp.plan, gp.grp AS \"group\", bool_or(trim(gp.grp) = '' OR (NOT needs_review AND k_ok AND coalesce(ok, false)) OR coalesce(matched, false)) AS belongs FROM gp JOIN pl USING (plan) LEFT JOIN o USING (plan) LEFT JOIN m ON m.plan = gp.plan AND m.grp = gp.grp GROUP BY 1, 2",
)
def group_routing(spark, sf):
    g = groups(spark, sf)
    plans = I.with_group_series(g).groupBy("plan").agg(
        F.min_by("group_series", "position").alias("series"), (F.count("*") > 4).alias("needs_review")
    )
    aliases = I.with_group_series(g).groupBy("plan").agg(F.max_by("group_series", "position").alias("alias"))
    return I.routed_groups(plans, aliases, g)


_OT = S.parsed(f"SELECT DISTINCT plan, grp FROM ({_G})", "grp")
_OB = f"(CASE WHEN {S.safe('grp')} = 'Unknown' THEN 'archive' ELSE {S.safe('grp')} END)"
_TARGET = f"CASE WHEN trim(grp) = '' THEN '/out/' || plan || '/' || plan || '.zip' ELSE '/out/' || CASE WHEN p_series = 'Unknown' THEN {_OB} ELSE p_series END || '/' || {_OB} || '.zip' END"


def targets(spark, sf):
    g = groups(spark, sf).select("plan", "group").distinct().withColumn("destination", F.concat(F.lit("/out/"), "plan", F.lit("/"), "plan", F.lit(".zip")))
    return I.with_output_target(g, "/out")


@query("group_outputs", f"SELECT plan, grp AS \"group\", {_TARGET} AS target FROM ({_OT})")
def group_outputs(spark, sf):
    return targets(spark, sf).select("plan", "group", "target")


@query(
    "output_collisions",
    f"WITH t AS (SELECT plan, lower({_TARGET}) AS k FROM ({_OT})), d AS (SELECT k FROM t GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT plan, k AS target FROM t JOIN d USING (k)",
)
def output_collisions(spark, sf):
    return I.output_collisions(targets(spark, sf).select("plan", "target"))


@query(
    "collision_notes",
    f"WITH t AS (SELECT plan, lower({_TARGET}) AS k FROM ({_OT})), d AS (SELECT k FROM t GROUP BY 1 HAVING count(*) > 1) SELECT plan, min(k) AS first, count(DISTINCT k) - 1 AS others FROM t JOIN d USING (k) GROUP BY 1",
)
def collision_notes(spark, sf):
    return I.collision_notes(I.output_collisions(targets(spark, sf).select("plan", "target")))


# --- plans -------------------------------------------------------------------------------------------
_PL = f"SELECT path AS source, name, p_series AS series, p_volume AS volume, p_confidence AS confidence, p_confidence < CAST(0.72 AS DOUBLE) AS needs_review, length(path) % 5 = 0 AS skipped, CASE WHEN length(path) % 7 = 0 THEN 'unreadable' END AS error FROM ({S.parsed(V.LIBRARY_SQL, 'name')}) WHERE {X.archive_filter('name')}"


def plans(spark, sf):
    from checks.q_reconcile import lib
    from shelfmark.sources.listing import is_library_archive

    def build():
        df = N.with_parsed_name(lib(spark, sf).where(is_library_archive(F.col("name"))), "name")
        return stored(
            df.select(
                F.col("path").alias("source"), "name", "parsed.series", "parsed.volume", "parsed.confidence",
                I.needs_review(F.col("parsed.confidence")).alias("needs_review"), (F.length("path") % 5 == 0).alias("skipped"),
                F.when(F.length("path") % 7 == 0, "unreadable").alias("error"),
            )
        )

    return stage(spark, sf, "plans", build)


@query("executable_plans", f"SELECT source FROM ({_PL}) WHERE error IS NULL AND NOT skipped AND NOT needs_review")
def executable_plans(spark, sf):
    return I.executable(plans(spark, sf)).select("source")


@query("resolved_series", f"WITH p AS ({_PL}), r AS (SELECT name, max(series) AS s FROM p WHERE length(name) % 2 = 0 GROUP BY 1) SELECT source, coalesce(s, series) AS series, CASE WHEN s IS NOT NULL THEN 'scan cluster' END AS evidence FROM p LEFT JOIN r USING (name)")
def resolved_series(spark, sf):
    p = plans(spark, sf)
    known = p.where("length(name) % 2 = 0").groupBy("name").agg(F.max("series").alias("series"))
    return I.resolved_series(p, known).select("source", "series", "evidence")


def dryrun_plans(spark, sf):
    return plans(spark, sf).withColumns(
        {
            "name": F.col("source"), "action": F.lit("rename-zip"), "evidence": F.array().cast("array<string>"),
            "destination": F.concat(F.lit("/out/"), "series", F.lit("/x.zip")), "preview_error": F.lit(None).cast("string"),
            "nested": F.lit(False), "warning": F.lit(""), "confidence": F.round("confidence", 6),
        }
    ).withColumn("predicted_outputs", F.array("destination"))


@query(
    "dryrun_report",
    f"SELECT position, source, '[' || lpad(position::VARCHAR, CAST(greatest(4, length(position::VARCHAR)) AS INTEGER), '0') || '] ' || source || chr(10) || '  source: ' || source || chr(10) || '  series: ' || series || chr(10) || '  volume: ' || coalesce(volume::VARCHAR, '-') || chr(10) || "
    "'  action: rename-zip' || chr(10) || '  confidence: ' || printf('%.3f', round(confidence, 6)) || chr(10) || '  review: ' || needs_review || chr(10) || '  skipped: ' || skipped || CASE WHEN error IS NOT NULL THEN chr(10) || '  error: ' || error ELSE "
    "chr(10) || '  predicted_outputs: 1' || chr(10) || '    -> /out/' || series || '/x.zip' || chr(10) || '  nested_archives: no' END AS block "
    f"FROM (SELECT *, row_number() OVER (ORDER BY source) AS position FROM ({_PL}))",
)
def dryrun_report(spark, sf):
    p = dryrun_plans(spark, sf)
    return P.dry_run_blocks(p).select("position", F.col("name").alias("source"), "block")


@query("dryrun_file", "SELECT block FROM (" + SQL["dryrun_report"] + ")")
def dryrun_file(spark, sf):
    """The report as text, blocks with an empty line between, read back."""
    from checks.q_events import scratch

    folder = scratch(spark)
    P.write_dry_run(dryrun_plans(spark, sf), folder)
    return spark.read.option("lineSep", "\n\n").text(folder).withColumnRenamed("value", "block")


@query(
    "plan_action",
    f"SELECT archive, ext, CASE WHEN ext <> '.rar' THEN 'rename-zip' WHEN single_nested_zip THEN 'unwrap-nested-zip' ELSE 'rar-to-zip' END AS action FROM ({_facts(BOXES)}), (VALUES ('.zip'), ('.rar'), ('.cbz')) AS t(ext)",
)
def plan_action(spark, sf):
    """What happens to each box, were it a file of each kind."""
    facts = M.archive_facts(boxes(spark, sf)).select("archive", "single_nested_zip", F.explode(F.array(F.lit(".zip"), F.lit(".rar"), F.lit(".cbz"))).alias("ext"))
    return facts.select("archive", "ext", I.plan_action(F.concat("archive", "ext"), F.col("single_nested_zip")).alias("action"))


# --- nested archives --------------------------------------------------------------------------------
# Five archives; entry k lies in an archive with a smaller number, and some archives hold one archive alone.
_NESTED = """
SELECT archive, k AS node, parent, CASE WHEN parent IS NULL AND a % 2 = 0 THEN 'root/' ELSE '' END || CASE k % 3 WHEN 1 THEN 'd/' WHEN 2 THEN 'd/e.f/' ELSE '' END
    || CASE WHEN k % 41 = 7 THEN '../../../' ELSE '' END || 'n' || CAST(k AS VARCHAR(20)) || ' ' || lang || CASE WHEN k % 37 = 3 THEN '/' WHEN k % 4 < 2 THEN CASE k % 5 WHEN 0 THEN '.cbz' WHEN 1 THEN '.RAR' ELSE '.zip' END
    WHEN k % 31 = 2 THEN '.7z' ELSE '.jpg' END AS name, k % 37 = 3 AS is_dir
FROM (SELECT 'a' || CAST(doc_id % 5 AS VARCHAR(3)) AS archive, doc_id % 5 AS a, coalesce(lang, '') AS lang, CAST(floor(doc_id / 5) AS BIGINT) AS k,
        CASE WHEN floor(doc_id / 5) % 4 = 1 THEN CAST(floor(doc_id / 5) AS BIGINT) - 1 WHEN doc_id < 20 THEN NULL
             WHEN floor(doc_id / 5) % 29 = 28 THEN 3
             ELSE 4 * CAST(floor(floor(doc_id / 5) / 16) AS BIGINT) + CAST(floor(floor(doc_id / 5) / 4) AS BIGINT) % 2 END AS parent
      FROM {documents}) d"""
_CLEANED = S.stage(f"SELECT *, CASE WHEN contains(name, '../../../') THEN true ELSE false END AS unsafe FROM ({_NESTED.format(documents='documents')})", clean="regexp_replace(name, '/$', '')")
_LEAF = "regexp_full_match(lower(logical), '.*\\.(zip|cbz|rar|cbr)')"


@query(
    "nested_outputs",
    f"""WITH RECURSIVE e0 AS MATERIALIZED ({_CLEANED}),
r AS (SELECT archive, CASE WHEN bool_and(contains(clean, '/')) AND min(split_part(clean, '/', 1)) = max(split_part(clean, '/', 1)) THEN min(split_part(clean, '/', 1)) ELSE '' END AS root
  FROM e0 WHERE parent IS NULL AND NOT is_dir GROUP BY 1),
h AS (SELECT archive, parent, count(*) = 1 AND bool_and(regexp_full_match(lower(name), '.*\\.(zip|cbz|rar|cbr|7z)')) AS single FROM e0 WHERE NOT is_dir GROUP BY 1, 2),
e AS MATERIALIZED (SELECT e0.*, CASE WHEN e0.parent IS NULL AND root <> '' THEN substr(clean, length(root) + 2) ELSE clean END AS logical, coalesce(single, false) AS single
  FROM e0 LEFT JOIN r ON r.archive = e0.archive LEFT JOIN h ON h.archive = e0.archive AND h.parent IS NOT DISTINCT FROM e0.parent WHERE NOT is_dir),
s AS MATERIALIZED (SELECT archive, node, parent, unsafe, CASE WHEN contains(logical, '/') THEN regexp_replace(logical, '/[^/]*$', '') END AS dir,
  CASE WHEN NOT single THEN regexp_replace(regexp_extract(logical, '[^/]*$'), '\\.[^.]*$', '') END AS stem FROM e WHERE {_LEAF}),
c(archive, node, prefix, level, unsafe) AS (SELECT archive, node, concat_ws('/', dir, stem), 1, unsafe FROM s WHERE parent IS NULL
  UNION ALL SELECT s.archive, s.node, concat_ws('/', nullif(c.prefix, ''), s.dir, s.stem), c.level + 1, s.unsafe OR c.unsafe FROM s JOIN c ON c.archive = s.archive AND c.node = s.parent),
o AS (SELECT e.archive, e.node, e.parent, logical, prefix, level, CASE WHEN e.parent IS NOT NULL AND level IS NULL THEN 'unknown container' WHEN level > 8 THEN 'too deep'
  WHEN e.unsafe OR c.unsafe THEN 'unsafe path' WHEN ends_with(logical, '.7z') THEN 'unsupported archive' END AS error
  FROM e LEFT JOIN c ON c.archive = e.archive AND c.node = e.parent WHERE NOT {_LEAF})
SELECT archive, node, CASE WHEN parent IS NULL THEN 0 WHEN level <= 16 THEN level END AS level, CASE WHEN error IS NULL THEN concat_ws('/', nullif(prefix, ''), logical) END AS path, error FROM o""",
)
def nested_outputs(spark, sf):
    from shelfmark.operators import nested

    return nested.nested_outputs(spark.sql(_NESTED, documents=V.table(spark, sf, "documents").select("doc_id", "lang")))
