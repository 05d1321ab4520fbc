"""Queries of the column functions over the whole library listing."""

from pyspark.sql import functions as F

from checks import sql_naming as S
from checks import views as V
from checks.memo import own_work
from shelfmark.functions import naming as N
from shelfmark.functions import rx
from shelfmark.functions import text as T

QUERIES, SQL = {}, {}


def parsed(spark, sf, **rules):
    """The listing with its names read; the parts of names are learned ahead of the grouping by path."""
    return N.with_parsed_listing(V.library(spark, sf), "name", names=V.library_names(spark, sf), **rules)


def parse_names(spark, sf):
    df = parsed(spark, sf)
    return df.select("path", *[F.col("parsed")[c].alias(c) for c in ("series", "author", "volume", "has_volume", "confidence")])


QUERIES["parse_names"] = parse_names
SQL["parse_names"] = (
    "SELECT path, p_series AS series, p_author AS author, p_volume AS volume, p_has_volume AS has_volume, "
    f"p_confidence AS confidence FROM ({S.parsed(V.LIBRARY_SQL, 'name')})"
)


def parse_existing(spark, sf):
    df = parsed(spark, sf, existing=True)
    return df.select("path", *[F.col("parsed")[c].alias(c) for c in ("series", "author", "volume", "has_volume", "confidence")])


QUERIES["parse_existing"] = parse_existing
SQL["parse_existing"] = (
    "SELECT path, p_series AS series, p_author AS author, p_volume AS volume, p_has_volume AS has_volume, "
    f"p_confidence AS confidence FROM ({S.parsed(V.LIBRARY_SQL, 'name', existing=True)})"
)


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


LIB = V.LIBRARY_SQL


def lib(spark, sf):
    from checks.q_reconcile import lib as shared

    return shared(spark, sf)


def each(spark, sf, **columns):
    return T.computed_here(lib(spark, sf).select("path", "name", "rel"), **columns).select("path", *columns)


def sql_each(**columns):
    return "SELECT path, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM ({LIB})"


@query("parse_authors", f"SELECT p_author AS author, count(*) AS files, count(DISTINCT p_series) AS series FROM ({S.parsed(LIB, 'name')}) GROUP BY 1")
def parse_authors(spark, sf):
    df = parsed(spark, sf)
    return df.groupBy(F.col("parsed.author").alias("author")).agg(
        F.count("*").alias("files"), F.count_distinct("parsed.series").alias("series")
    )


@query("parse_volume", f"SELECT p_volume AS volume, p_has_volume AS has_volume, count(*) AS files FROM ({S.parsed(LIB, 'name')}) GROUP BY ALL")
def parse_volume(spark, sf):
    df = parsed(spark, sf)
    return df.groupBy(F.col("parsed.volume").alias("volume"), F.col("parsed.has_volume").alias("has_volume")).agg(F.count("*").alias("files"))


@query("confidence", f"SELECT round(p_confidence, 4) AS confidence, count(*) AS files FROM ({S.parsed(LIB, 'name')}) GROUP BY 1")
def confidence(spark, sf):
    df = parsed(spark, sf)
    return df.groupBy(F.round("parsed.confidence", 4).alias("confidence")).agg(F.count("*").alias("files"))


_WHEN = "CASE WHEN {} THEN ['{}'] ELSE [] END"
_REASONS = " || ".join([
    "list_transform(range(len(zp_tags) - len(zp_authors)), lambda x: 'metadata-prefix')", _WHEN.format("len(zp_authors) > 0", "author-prefix"),
    _WHEN.format("zp_text <> zp_body2", "trailing-page-or-chapter-metadata"), _WHEN.format("zp_rule = 1", "explicit-japanese-volume"), _WHEN.format("zp_rule = 2", "explicit-vol-volume"),
    _WHEN.format("zp_rule = 3", "numeric-tail-volume"), _WHEN.format("zp_ranged", "volume-range"), _WHEN.format("zp_title <> ''", "non-empty-series"),
])


@query("parse_reasons", f"SELECT array_to_string({_REASONS}, ',') AS reasons, count(*) AS files FROM ({S.parsed(LIB, 'name', existing=True)}) GROUP BY 1")
def parse_reasons(spark, sf):
    """Which rules applied to the names of a library."""
    df = parsed(spark, sf, existing=True, reasons=True)
    return df.groupBy(F.array_join("parsed.reasons", ",").alias("reasons")).agg(F.count("*").alias("files"))


@query("needs_review", f"SELECT path, p_confidence AS confidence FROM ({S.parsed(LIB, 'name')}) WHERE p_confidence < CAST(0.72 AS DOUBLE)")
def needs_review(spark, sf):
    from shelfmark.plans.inbox import needs_review as low

    df = parsed(spark, sf).select("path", F.col("parsed.confidence").alias("confidence"))
    return df.where(low(F.col("confidence")))


@query("strip_variants", sql_each(bare=S.trim_u(S.sub(S.stem("name"), rx.suffix_run(S.fv.ASCII_SPACE), "", True)), nopage=S.trim_u(S.sub(S.stem("name"), rx.PAGE_RUN, "", True))))
def strip_variants(spark, sf):
    stem = T.without_extension(F.col("name"))
    return each(spark, sf, bare=N.strip_editions_and_variants(stem), nopage=N.strip_pages_and_chapters(stem))


@query("safe_name", sql_each(safe=S.safe("'a/' || rel || '.. ?'")))
def safe_name(spark, sf):
    return each(spark, sf, safe=N.safe_folder_name(F.concat(F.lit("a/"), "rel", F.lit(".. ?"))))


@query("group_key", sql_each(key=S.group_key(S.stem("name"))))
def group_key(spark, sf):
    return each(spark, sf, key=N.group_key(T.without_extension(F.col("name"))))


@query("canonical_key", sql_each(key=S.canonical(S.stem("name"))))
def canonical_key(spark, sf):
    return each(spark, sf, key=N.canonical_key(T.without_extension(F.col("name"))))


@query("series_usable", sql_each(usable=S.usable("name"), counter=S.usable("regexp_extract(name, 'v?[0-9]+')")))
def series_usable(spark, sf):
    return each(spark, sf, usable=N.series_usable(F.col("name")), counter=N.series_usable(F.regexp_extract("name", "v?[0-9]+", 0)))


@query("mojibake_filter", "SELECT doc_id, contains(text, '�') AS bad FROM documents")
def mojibake_filter(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", N.has_mojibake(F.col("text")).alias("bad"))


@query("script_flags", f"SELECT doc_id, {S.spin('text')} AS spin, {S.japanese('text')} AS japanese, {S.latin('text')} AS latin FROM documents")
def script_flags(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", N.has_spin_off(t).alias("spin"), T.has_japanese(t).alias("japanese"), T.has_latin(t).alias("latin")
    )


_TITLE = "regexp_replace(name, '^[^★]*', '')"


@query("rating_split", sql_each(bare=S.rating_bare(_TITLE), marks=S.rating_marks(_TITLE), stars=S.rating_count(_TITLE)))
def rating_split(spark, sf):
    r = N.rating_split(F.regexp_replace("name", "^[^★]*", ""))
    return each(spark, sf, r=r).select("path", "r.bare", "r.marks", F.col("r.count").alias("stars"))


@query(
    "rating_apply",
    f"WITH p AS (SELECT DISTINCT p_series AS series FROM ({S.parsed(LIB, 'name')})), r AS ({S.stage('SELECT series FROM p', k=S.canonical('series'), c=S.rating_count('series'), m=S.rating_marks('series'), b=S.rating_bare('series'))}) "
    "SELECT k AS key, CASE WHEN m = '' THEN b ELSE m || ' ' || b END AS title FROM (SELECT k, min(b) AS b, substr(max(lpad(CAST(c AS VARCHAR), 3, '0') || m), 4) AS m FROM r GROUP BY k)",
)
def rating_apply(spark, sf):
    rows = N.with_profile(N.with_parsed_listing(V.library_names(spark, sf), "name").select("parsed.series").distinct(), "series", "p")
    rows = T.computed_here(rows.select("series", "p.key", "p.rank"), bare=N.rating_split(F.col("series"))["bare"])
    best = rows.groupBy("key").agg(F.min("bare").alias("bare"), F.max("rank").alias("rank"))
    return best.select("key", N.with_rating(F.col("bare"), F.col("rank")).alias("title"))


@query("author_tokens", f"SELECT author, {S.author_tokens('author')} AS tokens FROM (SELECT DISTINCT p_author AS author FROM ({S.parsed(LIB, 'name')}))")
def author_tokens(spark, sf):
    authors = N.with_parsed_listing(V.library_names(spark, sf), "name").select("parsed.author").distinct()
    return authors.select("author", N.author_tokens(F.col("author")).alias("tokens"))


@query("edition_class", sql_each(edition=S.edition("name")))
def edition_class(spark, sf):
    return each(spark, sf, edition=N.edition_class(F.col("name")))


_COV = "name || CASE length(path) % 5 WHEN 0 THEN ' 第3話' WHEN 1 THEN ' ch 4-9' WHEN 2 THEN ' 2-5巻' WHEN 3 THEN ' 第1話-第8話 3-4巻' ELSE '' END"
_COV_COLS = "v_kind AS kind, v_vs AS volume_start, v_ve AS volume_end, v_cs AS chapter_start, v_ce AS chapter_end, v_label AS label"


def covered(spark, sf):
    return N.with_coverage(lib(spark, sf).selectExpr("path", "root", f"{_COV} AS t"), "t")


@query("coverage", f"SELECT path, {_COV_COLS} FROM ({S.coverage(f'SELECT path, {_COV} AS t FROM ({LIB})', 't')})")
def coverage(spark, sf):
    return covered(spark, sf).select("path", "coverage.*")


@query("merge_coverage", f"SELECT folder, {S.merged()} FROM ({S.coverage(f'SELECT split_part(rel, chr(47), 1) AS folder, {_COV} AS t FROM ({LIB})', 't')}) GROUP BY folder")
def merge_coverage(spark, sf):
    df = N.with_coverage(lib(spark, sf).selectExpr("split_part(rel, '/', 1) AS folder", f"{_COV} AS t"), "t")
    return df.groupBy("folder").agg(N.merged_coverage(F.col("coverage")).alias("m")).select("folder", "m.*")


@query(
    "lev_sim",
    "SELECT a.p_name AS a, b.p_name AS b, CAST(1 AS DOUBLE) - CAST(levenshtein(a.p_name, b.p_name) AS DOUBLE) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE) AS sim "
    "FROM (SELECT DISTINCT p_brand, p_name FROM part) a JOIN (SELECT p_brand, min(p_name) AS p_name FROM part GROUP BY 1) b USING (p_brand)",
)
def lev_sim(spark, sf):
    part = V.table(spark, sf, "part")
    a = part.select("p_brand", F.col("p_name").alias("a")).distinct()
    b = part.groupBy("p_brand").agg(F.min("p_name").alias("b"))
    return a.join(b, "p_brand").select("a", "b", N.similarity(F.col("a"), F.col("b")).alias("sim"))


def _pair_score_sql():
    from checks import sql_flow as X

    src = f"SELECT DISTINCT p_series AS a, {X.legacy(S.base(X.dirname('path')))} AS b FROM ({S.parsed(LIB, 'name', True)}) WHERE contains(rel, '/')"
    src = S.stage(src, **X.profile("a", "a_"), **X.profile("b", "b_"))
    return f"SELECT a, b, CAST({X.pair_score('a_', 'b_')} AS DOUBLE) AS score FROM ({src})"


@query("pair_score", _pair_score_sql())
def pair_score(spark, sf):
    df = N.with_parsed_listing(V.library_names(spark, sf).where("contains(rel, '/')"), "name", existing=True)
    found = df.select(F.col("parsed.series").alias("a"), F.substring_index(F.substring_index("rel", "/", -2), "/", 1).alias("folder")).distinct()
    pairs = found.select("a", N.legacy_folder_name(F.col("folder")).alias("b")).distinct()
    pairs = N.with_profile(N.with_profile(pairs, "a", "pa"), "b", "pb")
    return T.computed_here(pairs, s=N.pair_score(F.col("pa"), F.col("pb"))).select("a", "b", "s.score")


@query("destinations", f"SELECT path, '/out/' || p_series || '/' || CASE WHEN {S.extension('name')} = '.rar' THEN CASE WHEN {S.has('name', r'.*\.part0*1\.rar$', True)} THEN {S.ext('name', rx.MULTIPART, 1, True)} ELSE {S.stem('name')} END || '.zip' ELSE name END AS destination FROM ({S.parsed(LIB, 'name')})")
def destinations(spark, sf):
    from shelfmark.plans.inbox import destination

    df = parsed(spark, sf)
    return df.select("path", destination("/out", F.col("parsed.series"), F.col("name")).alias("destination"))
