"""Queries of clustering, de-duplication and the manifest over the ``library`` listing."""

from pyspark.sql import functions as F

from checks import sql_flow as X
from checks import sql_naming as S
from checks import views as V
from checks.memo import own_work, stage
from checks.q_events import scratch
from shelfmark.functions import naming as N
from shelfmark.functions.text import computed_here
from shelfmark.operators import cluster as C
from shelfmark.operators import dedupe as D
from shelfmark.operators import manifest as M
from shelfmark.operators.stable import settled, stored
from shelfmark.plans import reconcile as R
from shelfmark.sources import listing as L
from shelfmark.sources import reports as P

QUERIES, SQL = {}, {}
OUT = X.OUT
same_hash = lambda rows: rows  # noqa: E731  the view carries its hashes


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


# --- shared stages -----------------------------------------------------------------------
def lib(spark, sf):
    return stage(spark, sf, "library", lambda: V.listed(stored(V.library_rows(spark, sf))))


def _packed(rows, path):
    if "destination" in rows.columns:
        rows = rows.withColumn("apart", F.when(~F.col("destination").eqNullSafe(R.home(OUT)), F.col("destination"))).drop("destination")
    return rows.drop(path, "name", "ord")


def _restored(rows, path):
    rows = V.listed(rows, path)
    return rows.withColumn("destination", F.coalesce("apart", R.home(OUT))).drop("apart") if "apart" in rows.columns else rows


#: Tables of files are stored without what their root and rel give, and without destinations that are the home of their series.
SLIM = R.Slim(_packed, _restored)


def named(spark, sf):
    rows = _packed(lib(spark, sf), "path")
    return stage(spark, sf, "named", lambda: SLIM.settled(lambda: R.named_files(rows), "path"))


def series_rows(spark, sf):
    """Series with their authors and numbers of files; the hashes and times of the listing are not asked for."""
    names = V.library_names(spark, sf)
    files = V.listed(names.select("root", "rel").distinct())
    return stage(spark, sf, "series", lambda: settled(lambda: R.series_files(files, names=names)))


def verdicts(spark, sf):
    return stage(spark, sf, "verdicts", lambda: stored(C.cluster_names(series_rows(spark, sf))))


def items(spark, sf, listing=None):
    """The items; the tables of files behind them go, but for a ``listing`` that is read again later."""

    def build():
        files = listing or V.listed(stored(V.library_rows(spark, sf)))
        rows = SLIM.settled(lambda: R.named_files(_packed(files, "path")), "path")
        counted = stored(rows.where("series <> ''").groupBy("series", "author").agg(F.min("ord").alias("ord"), F.count("*").alias("files")))
        v = stored(C.cluster_names(counted)).select(F.col("series").alias("_n"), "canonical")
        joined = rows.join(v, F.col("series") == F.col("_n"), "left").withColumn(
            "series", F.coalesce("canonical", "series")
        ).drop("_n", "canonical")
        return R.with_work_keys(R.base_items(joined, OUT))

    return stage(spark, sf, "items", lambda: SLIM.settled(build, "source"))


def report(spark, sf):
    files = lib(spark, sf)
    return stage(spark, sf, "report", lambda: R.resolved(items(spark, sf, files), files, OUT, same_hash, slim=SLIM))


def variants(spark, sf):
    return stage(spark, sf, "variants", lambda: R.with_variants(items(spark, sf), same_hash))


# --- listing ------------------------------------------------------------------------------
_LISTED = (
    f"SELECT {V._ROOT} AS root, l_suppkey % 3 AS root_ord, {V._ROOT} || '/./' || replace({V._REL}, '/', '//') AS path, "
    "CAST(p_size * 1000 AS BIGINT) AS size, TIMESTAMP '2024-01-01 00:00:00' AS modified FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
)


@query(
    "list_files",
    "SELECT path, min(root) AS root, substr(path, 7) AS rel, min(size) AS size FROM (SELECT replace(replace(path, '/./', '/'), '//', '/') AS path, root, size FROM ("
    + _LISTED.format(lineitem="lineitem", part="part") + ")) GROUP BY path",
)
def list_files(spark, sf):
    rows = spark.sql(_LISTED, lineitem=V.table(spark, sf, "lineitem"), part=V.table(spark, sf, "part"))
    sizes = L.first_listing(rows.withColumn("modified", F.col("modified").cast("timestamp")))
    return sizes.select("path", "root", "rel", "size")


@query("list_with_quarantine", f"SELECT path, split_part(rel, '/', 1) = '{V.QUARANTINE}' AS quarantined FROM ({V.LIBRARY_SQL})")
def list_with_quarantine(spark, sf):
    return lib(spark, sf).select("path", L.in_quarantine(F.col("rel")).alias("quarantined"))


@query("without_quarantine", f"SELECT path FROM ({V.LIBRARY_SQL}) WHERE NOT contains('/' || rel, '/{V.QUARANTINE}/')")
def without_quarantine(spark, sf):
    return L.without_quarantine(lib(spark, sf)).select("path")


@query("quarantine_flag", f"SELECT root, count(*) AS files, count_if(split_part(rel, '/', 1) = '{V.QUARANTINE}') AS quarantined FROM ({V.LIBRARY_SQL}) GROUP BY root")
def quarantine_flag(spark, sf):
    return lib(spark, sf).groupBy("root").agg(
        F.count("*").alias("files"), F.count_if(L.in_quarantine(F.col("rel"))).alias("quarantined")
    )


@query("archive_filter", f"SELECT path FROM ({V.LIBRARY_SQL}) WHERE {X.archive_filter('name')}")
def archive_filter(spark, sf):
    return lib(spark, sf).where(L.is_library_archive(F.col("name"))).select("path")


@query("inbox_scan", f"SELECT path FROM ({V.LIBRARY_SQL}) WHERE NOT contains(rel, '/') AND {X.archive_filter('name')}")
def inbox_scan(spark, sf):
    return L.inbox(lib(spark, sf)).select("path")


_FOLDERS = (
    "SELECT DISTINCT root, array_to_string(list_slice(parts, 1, i), '/') AS folder FROM (SELECT root, string_split(rel, '/') AS parts FROM ({src})) s, "
    "LATERAL (SELECT unnest(range(1, len(parts))) AS i) t"
)


@query("union_roots", f"SELECT 'D' AS tag, root || '/' || folder AS path FROM ({_FOLDERS.format(src=V.LIBRARY_SQL)}) UNION ALL SELECT 'F', path FROM ({V.LIBRARY_SQL})")
def union_roots(spark, sf):
    f = lib(spark, sf)
    dirs = L.folders(f).select(F.lit("D").alias("tag"), F.concat_ws("/", "root", "folder").alias("path"))
    return dirs.unionByName(f.select(F.lit("F").alias("tag"), "path"))


@query(
    "layout_export",
    f"WITH l AS (SELECT root, 'D' AS tag, folder || '/' AS rel FROM ({_FOLDERS.format(src=V.LIBRARY_SQL)}) UNION ALL SELECT root, 'F', rel FROM ({V.LIBRARY_SQL})) "
    "SELECT root, tag || chr(9) || rel AS line, count(*) OVER (PARTITION BY root, tag) AS tag_lines FROM l",
)
def layout_export(spark, sf):
    f = lib(spark, sf)
    lines = P.layout_lines(f)
    return lines.join(P.layout_counts(lines), ["root", "tag"]).select("root", "line", "tag_lines")


@query("layout_file", f"SELECT 'D' || chr(9) || folder || '/' AS line FROM ({_FOLDERS.format(src=V.LIBRARY_SQL)}) UNION ALL SELECT 'F' || chr(9) || rel FROM ({V.LIBRARY_SQL})")
def layout_file(spark, sf):
    """The export as text files, read back."""
    folder = scratch(spark)
    P.write_layout(lib(spark, sf), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


# --- aliases -------------------------------------------------------------------------------
_ALIAS_SRC = "SELECT DISTINCT p_name || ' story' AS alias, upper(p_name) || ' STORY / 2:' AS canonical, min(p_partkey) OVER (PARTITION BY p_name) % 8 AS pick FROM {part}"


def raw_aliases(spark, sf):
    return spark.sql(_ALIAS_SRC, part=V.table(spark, sf, "part"))


_ALIAS_SQL = f"SELECT trim(alias) AS alias, {S.safe(S.trim_u('canonical'))} AS canonical FROM ({_ALIAS_SRC.format(part='part')})"


@query("alias_table", _ALIAS_SQL)
def alias_table(spark, sf):
    from shelfmark.sources import aliases as A

    return A.cleaned(raw_aliases(spark, sf)).select("alias", "canonical")


@query(
    "alias_upsert",
    f"SELECT alias, CASE WHEN pick = 1 THEN 'replaced ' || alias ELSE canonical END AS canonical FROM (SELECT trim(alias) AS alias, {S.safe(S.trim_u('canonical'))} AS canonical, pick FROM ({_ALIAS_SRC.format(part='part')})) WHERE pick <> 2",
)
def alias_upsert(spark, sf):
    from shelfmark.sources import aliases as A

    raw = raw_aliases(spark, sf)
    current = A.cleaned(raw)
    new = A.cleaned(raw.where("pick = 1").select("alias", F.concat(F.lit("replaced "), "alias").alias("canonical")))
    gone = raw.where("pick = 2").select("alias")
    return A.deleted(A.upserted(current, new), gone)


@query(
    "alias_lookup",
    f"WITH al AS (SELECT {S.canonical('alias')} AS k, min(canonical) AS canonical FROM ({_ALIAS_SQL}) GROUP BY 1), "
    f"n AS (SELECT DISTINCT p_series AS series FROM ({S.parsed(f'SELECT * FROM ({V.LIBRARY_SQL}) WHERE ' + X.archive_filter('name'), 'name', True)})), "
    f"k AS ({S.stage('SELECT series FROM n', k=S.canonical('series'), marks=S.rating_marks('series'))}) "
    "SELECT series, CASE WHEN marks = '' THEN canonical ELSE marks || ' ' || canonical END AS canonical FROM k JOIN al USING (k)",
)
def alias_lookup(spark, sf):
    from shelfmark.sources import aliases as A

    names = N.with_parsed_name(
        lib(spark, sf).where(L.is_library_archive(F.col("name"))), "name", existing=True
    ).select("parsed.series").distinct()
    index = C.alias_index(A.cleaned(raw_aliases(spark, sf)))
    return C.with_alias(names, index).where("alias_canonical IS NOT NULL").select(
        "series", F.col("alias_canonical").alias("canonical")
    )


# --- evidence, pairs, clusters ------------------------------------------------------------------
@query("parent_evidence", X.upto("named", "SELECT source, series1 AS series, confidence, work, edition FROM named"))
def parent_evidence(spark, sf):
    return named(spark, sf).select(F.col("path").alias("source"), "series", "confidence", "work", "edition")


@query("series_pairs", X.upto("pr", "SELECT a, b, score, reason FROM pr"))
def series_pairs(spark, sf):
    return C.name_pairs(series_rows(spark, sf))


@query(
    "series_links",
    X.upto("pr", "SELECT series, coalesce(n, 0) AS links FROM nm LEFT JOIN (SELECT s, count(*) AS n FROM (SELECT a AS s FROM pr UNION ALL SELECT b FROM pr) GROUP BY 1) ON s = series"),
)
def series_links(spark, sf):
    return C.name_links(series_rows(spark, sf))[0].select("series", "links")


@query("series_clusters", X.upto("cn", "SELECT series, canonical, reason, score, files FROM cn"))
def series_clusters(spark, sf):
    return verdicts(spark, sf).select("series", "canonical", "reason", "score", "files")


@query("canonical_choice", X.upto("cn", "SELECT canonical, count(*) AS spellings, sum(files)::BIGINT AS files FROM cn WHERE reason IS NOT NULL GROUP BY canonical, cluster"))
def canonical_choice(spark, sf):
    return verdicts(spark, sf).where("reason IS NOT NULL").groupBy("cluster", "canonical").agg(
        F.count("*").alias("spellings"), F.sum("files").alias("files")
    ).drop("cluster")


@query(
    "cluster_aliases",
    X.upto("cn", "SELECT canonical, series AS alias, row_number() OVER (PARTITION BY cluster ORDER BY lower(series), series) AS position FROM cn WHERE reason IS NOT NULL"),
)
def cluster_aliases(spark, sf):
    return C.cluster_aliases(verdicts(spark, sf))


@query("work_identity", X.upto("it", "SELECT DISTINCT series, work, author, work_key FROM it WHERE action <> 'error'"))
def work_identity(spark, sf):
    return items(spark, sf).where("action <> 'error'").select("series", "work", "author", "work_key").distinct()


@query("title_pairs")
def title_pairs(spark, sf):
    """Blocked similarity join over every sentence of every document; too large for a cross join
    in SQL, so it is checked against brute force in the tests."""
    from shelfmark.operators.pairs import near_pairs

    keys = V.titles(spark, sf).select(
        F.lit("").alias("scope"), N.canonical_key(F.col("series")).alias("text")
    ).distinct()
    return near_pairs(stored(keys), 0.90).select("a", "b", "sim")


# --- verdicts ------------------------------------------------------------------------------------
@query(
    "exact_duplicates",
    X.upto("dk", "SELECT it.source AS source, keeper FROM it JOIN dk USING (size, work_key, edition, sha256) WHERE it.action <> 'error' AND it.source <> keeper"),
)
def exact_duplicates(spark, sf):
    return D.exact_duplicates(items(spark, sf), same_hash)


@query("duplicate_keeper", X.upto("dk", "SELECT size, work_key, edition, sha256, keeper FROM dk"))
def duplicate_keeper(spark, sf):
    return D.duplicate_keepers(D.with_hashes(items(spark, sf), same_hash))


@query("newest_variant", X.upto("fin", "SELECT source, volume, work_key, edition FROM fin WHERE auto_selected"))
def newest_variant(spark, sf):
    return variants(spark, sf)[0].where("auto_selected").select("source", "volume", "work_key", "edition")


@query("review_choices", X.upto("vh", "SELECT choice, choice_series, work_key, edition, volume FROM vh WHERE tied"))
def review_choices(spark, sf):
    return variants(spark, sf)[1].select("choice", "choice_series", "work_key", "edition", "volume")


# Names as they are, before clustering, so that many targets lie on occupied paths.
_PLAIN = [
    ("u0", f"SELECT *, series1 AS series, '{OUT}/' || series1 || '/' || {S.base('source')} AS home, split_part(rel, '/', 1) = '{V.QUARANTINE}' AS quarantined FROM named WHERE series1 <> ''"),
    ("uk", f"SELECT size, {S.canonical('work')} AS k, edition, sha256, arg_min(source, (quarantined, -epoch_us(modified), ord)) AS keeper FROM u0 GROUP BY ALL HAVING count(*) > 1"),
    (
        "u1",
        "SELECT u0.source, CASE WHEN keeper IS NULL OR keeper = u0.source THEN CASE WHEN home = u0.source THEN 'keep' ELSE 'move' END WHEN quarantined THEN 'keep' ELSE 'duplicate' END AS action, "
        "CASE WHEN keeper <> u0.source AND quarantined THEN u0.source ELSE home END AS destination "
        f"FROM u0 LEFT JOIN uk ON u0.size = uk.size AND u0.sha256 = uk.sha256 AND u0.edition = uk.edition AND {S.canonical('work')} = uk.k",
    ),
    (
        "u2",
        "SELECT u1.source, destination, v.source IS NOT NULL AS freed FROM u1 JOIN lib ON lib.path = u1.destination LEFT JOIN (SELECT source FROM u1 WHERE action = 'duplicate') v "
        "ON v.source = u1.destination WHERE u1.action IN ('move', 'keep') AND destination <> u1.source",
    ),
]


def plain_items(spark, sf):
    """Every file with the key of its work alone; works are far fewer than files."""
    rows = named(spark, sf)
    keys = stage(spark, sf, "plain_keys", lambda: stored(
        computed_here(rows.where("series <> ''").select(F.col("work").alias("_k")).distinct(), work_key=N.canonical_key(F.col("_k")))
    ))
    return R.base_items(rows.where("series <> ''"), OUT).join(keys, F.col("work") == F.col("_k")).drop("_k")


def plain_conflicts(spark, sf):
    """(source, destination, freed) of the moves onto a path that holds a file."""
    rows, files = plain_items(spark, sf), lib(spark, sf)

    def build():
        # The verdicts need no more of a file than where it is and where it goes, which is below the output root.
        marked = stored(D.mark_exact_copies(rows, same_hash).select("source", "destination", "action"))
        found = stored(D.conflicts(marked, files.where(F.col("path").startswith(OUT + "/"))))
        return marked.select("source", "destination").join(found, "source")

    return stage(spark, sf, "plain_conflicts", lambda: settled(build))


@query("destination_conflicts", X.upto("named", "SELECT source, destination FROM u2 WHERE NOT freed", _PLAIN))
def destination_conflicts(spark, sf):
    return plain_conflicts(spark, sf).where("NOT freed").select("source", "destination")


@query("vacated_conflicts", X.upto("named", "SELECT source, destination FROM u2 WHERE freed", _PLAIN))
def vacated_conflicts(spark, sf):
    return plain_conflicts(spark, sf).where("freed").select("source", "destination")


@query(
    "reconcile_summary",
    X.upto(
        "fin",
        "SELECT count(*) AS files, count_if(action = 'keep') AS keep, count_if(action = 'move') AS move, count_if(action = 'duplicate') AS duplicates, "
        "count_if(action = 'superseded') AS superseded, count_if(action = 'conflict') AS conflicts, count_if(action = 'review') AS review, count_if(action = 'error') AS errors FROM fin",
    ),
)
def reconcile_summary(spark, sf):
    return report(spark, sf).summary


@query("reconcile_items", X.upto("fin", "SELECT source, series, work_key, edition, volume, action, destination, duplicate_of, review_group, auto_selected FROM fin"))
def reconcile_items(spark, sf):
    return report(spark, sf).items.select(
        "source", "series", "work_key", "edition", "volume", "action", "destination", "duplicate_of", "review_group", "auto_selected"
    )


@query("quarantine_names", X.upto("fin", "SELECT source, destination FROM fin WHERE action IN ('duplicate', 'superseded')"))
def quarantine_names(spark, sf):
    return report(spark, sf).items.where("action IN ('duplicate', 'superseded')").select("source", "destination")


_ORDER = "ORDER BY lower(series), series, volume NULLS LAST, source"


@query("report_order", X.upto("fin", f"SELECT source, series, volume, row_number() OVER ({_ORDER}) AS position FROM fin"))
def report_order(spark, sf):
    return P.numbered(report(spark, sf).items.select("source", "series", "volume"), R.report_order(), "position")


@query(
    "report_pages",
    X.upto("fin", f"SELECT page, count(*) AS rows, min(source) AS low, max(source) AS high FROM (SELECT source, (row_number() OVER ({_ORDER}) - 1) // 200 AS page FROM fin) GROUP BY page"),
)
def report_pages(spark, sf):
    return P.paged(report(spark, sf).items.select("source", "series", "volume"), R.report_order()).groupBy("page").agg(
        F.count("*").alias("rows"), F.min("source").alias("low"), F.max("source").alias("high")
    )


@query("report_page_read", X.upto("fin", f"SELECT position, source FROM (SELECT source, row_number() OVER ({_ORDER}) - 1 AS position FROM fin) WHERE position BETWEEN 150 AND 449"))
def report_page_read(spark, sf):
    folder = scratch(spark)
    P.write_pages(report(spark, sf).items.select("source", "series", "volume"), R.report_order(), folder)
    return P.read_page(spark, folder, offset=150, limit=300).select("position", "source")


@query(
    "report_meta",
    X.upto(
        "fin",
        "SELECT count(*) AS items_total, CAST(ceil(count(*) / 200) AS BIGINT) AS items_pages, count(DISTINCT review_group) AS choices_total, CAST(ceil(count(DISTINCT review_group) / 200) AS BIGINT) AS choices_pages, "
        "count_if(action = 'keep') AS keep, count_if(action = 'duplicate') AS duplicates, count_if(action = 'review') AS review, count(*) AS read_back FROM fin",
    ),
)
def report_meta(spark, sf):
    """The report written with its row of totals, which a reader meets before any page."""
    folder, r = scratch(spark), report(spark, sf)
    P.write_report(r.items.select("source", "series", "volume"), r.choices, r.summary, R.report_order(), folder)
    meta = spark.read.json(f"{folder}/meta").select("items_total", "items_pages", "choices_total", "choices_pages", "keep", "duplicates", "review")
    return meta.withColumn("read_back", F.lit(spark.read.parquet(f"{folder}/items").count()))


# --- manifest ----------------------------------------------------------------------------------------
_SELECTED = "SELECT review_group AS choice, min(source) AS selected FROM fin WHERE review_group IS NOT NULL GROUP BY 1"


def selections(spark, sf):
    return report(spark, sf).items.where("review_group IS NOT NULL").groupBy(
        F.col("review_group").alias("choice")
    ).agg(F.min("source").alias("selected"))


_CHOSEN = (
    f"SELECT source, CASE WHEN s.selected IS NULL THEN action WHEN source = s.selected THEN CASE WHEN source = home THEN 'keep' ELSE 'move' END "
    "WHEN quarantined THEN 'keep' ELSE 'superseded' END AS action, "
    "CASE WHEN s.selected IS NULL THEN destination WHEN source = s.selected THEN home WHEN quarantined THEN source ELSE destination END AS destination, "
    "CASE WHEN s.selected IS NOT NULL AND source <> s.selected THEN s.selected ELSE duplicate_of END AS duplicate_of "
    f"FROM (SELECT *, '{OUT}/' || series || '/' || {S.base('source')} AS home FROM fin) f LEFT JOIN ({_SELECTED}) s ON s.choice = review_group"
)


@query("apply_selections", X.upto("fin", _CHOSEN))
def apply_selections(spark, sf):
    return M.apply_selections(report(spark, sf).items, selections(spark, sf), OUT).select(
        "source", "action", "destination", "duplicate_of"
    )


@query(
    "selection_errors",
    X.upto("fin", f"SELECT choice, 'selection required' AS problem FROM (SELECT DISTINCT review_group AS choice FROM fin WHERE review_group LIKE 'volume-choice-%1')"),
)
def selection_errors(spark, sf):
    r = report(spark, sf)
    return M.selection_errors(r.items, r.choices, selections(spark, sf).where("NOT choice LIKE '%1'"))


_TURN = "(lower({0}series), {0}series, {0}volume IS NULL, coalesce({0}volume, 0), {0}source)"


_APPLIED = (
    "SELECT path, coalesce(moved_to, here) AS new_path, CASE WHEN moved_to IS NOT NULL THEN 'moved' WHEN here <> path THEN 'quarantined' WHEN wanted THEN 'skipped' ELSE 'kept' END AS outcome FROM ("
    "SELECT a1.path, a1.here, w.wanted, d.target AS moved_to FROM a1 LEFT JOIN (SELECT source AS path, true AS wanted FROM mv) w ON w.path = a1.path LEFT JOIN won d ON d.path = a1.path)"
)
_APPLY_STEPS = [
        ("a1", "SELECT lib.path, coalesce(q.destination, lib.path) AS here FROM lib LEFT JOIN (SELECT source, destination FROM fin WHERE action IN ('duplicate', 'superseded')) q ON q.source = lib.path"),
        ("mv", f"SELECT source, destination, {_TURN.format('')} AS turn FROM fin WHERE action = 'move' AND source <> destination"),
        ("cm", "SELECT mv.source AS path, mv.destination AS target, mv.turn, a1.path AS holder FROM mv LEFT JOIN a1 ON a1.here = mv.destination"),
        (
            "won(target, path, turn)",
            "SELECT target, arg_min(path, turn), min(turn) FROM cm WHERE holder IS NULL GROUP BY 1 UNION ALL "
            "SELECT target, path, turn FROM (SELECT cm.target, cm.path, cm.turn, row_number() OVER (PARTITION BY cm.target ORDER BY cm.turn) AS k FROM cm JOIN won ON won.path = cm.holder WHERE cm.turn > won.turn) WHERE k = 1",
        ),
    ]


@query("apply_manifest", X.upto("fin", _APPLIED, _APPLY_STEPS))
def apply_manifest(spark, sf):
    return M.apply_manifest(lib(spark, sf), report(spark, sf).items)


@query(
    "manifest_counts",
    X.upto("fin", f"SELECT count_if(outcome = 'moved') AS moved, count_if(outcome = 'quarantined') AS quarantined, count_if(outcome IN ('skipped', 'kept')) AS skipped FROM ({_APPLIED})", _APPLY_STEPS),
)
def manifest_counts(spark, sf):
    return M.manifest_counts(M.apply_manifest(lib(spark, sf), report(spark, sf).items))


@query("quarantine_list", f"SELECT root, path, substr(rel, {len(V.QUARANTINE) + 2}) AS relative, size, modified FROM ({V.LIBRARY_SQL}) WHERE starts_with(rel, '{V.QUARANTINE}/') ORDER BY modified DESC, relative")
def quarantine_list(spark, sf):
    return M.quarantine_files(lib(spark, sf)).orderBy(F.desc("modified"), "relative")


@query("quarantine_totals", f"SELECT count(*) AS files, sum(size)::BIGINT AS total_bytes FROM ({V.LIBRARY_SQL}) WHERE starts_with(rel, '{V.QUARANTINE}/')")
def quarantine_totals(spark, sf):
    return M.quarantine_files(lib(spark, sf)).agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


@query(
    "quarantine_delete_manifest",
    f"SELECT path, CASE WHEN NOT regexp_matches(path, '^/lib[012]/{V.QUARANTINE}/') THEN 'outside quarantine' WHEN size IS NULL THEN 'missing' ELSE 'delete' END AS verdict, "
    f"CASE WHEN regexp_matches(path, '^/lib[012]/{V.QUARANTINE}/') THEN size END AS size FROM (SELECT path, size FROM ({V.LIBRARY_SQL}) UNION ALL SELECT path || '.gone', NULL FROM ({V.LIBRARY_SQL}))",
)
def quarantine_delete_manifest(spark, sf):
    f = lib(spark, sf)
    asked = f.select("path").unionByName(f.select(F.concat("path", F.lit(".gone")).alias("path")))
    return M.delete_manifest(asked, f, ["/lib0", "/lib1", "/lib2"])


_AFTER = f"SELECT root, rel FROM ({V.LIBRARY_SQL}) WHERE NOT contains(rel, 'ring')"


@query(
    "empty_folders",
    f"SELECT root, folder FROM (({_FOLDERS.format(src=V.LIBRARY_SQL)}) EXCEPT ({_FOLDERS.format(src=_AFTER)})) WHERE NOT contains('/' || folder || '/', '/{V.QUARANTINE}')",
)
def empty_folders(spark, sf):
    f = lib(spark, sf)
    return L.empty_folders(f, f.where("NOT contains(rel, 'ring')"))


@query(
    "folder_reuse",
    f"WITH f AS (SELECT DISTINCT split_part(rel, '/', 1) AS folder FROM ({V.LIBRARY_SQL}) WHERE root = '{OUT}' AND contains(rel, '/') AND NOT starts_with(rel, '.')), "
    f"g AS ({S.stage('SELECT folder FROM f', k=S.canonical('folder'), c=S.rating_count('folder'), m=S.rating_marks('folder'), bare=S.rating_bare('folder'))}), "
    "h AS (SELECT k, arg_min(folder, (-c, folder)) AS folder, max(c) AS c FROM g GROUP BY 1), "
    f"s AS (SELECT DISTINCT p_series AS series FROM ({S.parsed(V.LIBRARY_SQL, 'name')})), "
    f"t AS ({S.stage('SELECT series FROM s', k=S.canonical('series'), sc=S.rating_count('series'), sm=S.rating_marks('series'))}) "
    f"SELECT series, CASE WHEN h.folder IS NULL THEN series WHEN h.c >= sc THEN h.folder ELSE sm || ' ' || {S.rating_bare('h.folder')} END AS folder FROM t LEFT JOIN h USING (k)",
)
def folder_reuse(spark, sf):
    from shelfmark.plans.inbox import reused_folders

    series = N.with_parsed_name(lib(spark, sf), "name").select("parsed.series").distinct()
    return reused_folders(series, lib(spark, sf), OUT).select("series", "folder")


_CAND = (
    f"SELECT path AS target, CASE WHEN length(path) % 3 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN length(path) % 2 = 0 THEN modified + INTERVAL 1 DAY ELSE modified END AS modified, "
    "CASE WHEN length(path) % 5 = 0 THEN '0' ELSE sha256 END AS sha256 FROM {src} UNION ALL SELECT path || '.new', size, modified, sha256 FROM {src}"
)


@query(
    "publish_decision",
    f"WITH l AS ({V.LIBRARY_SQL}), c AS ({_CAND.format(src='l')}) SELECT target, CASE WHEN l.path IS NULL THEN 'use-candidate' WHEN c.size = l.size AND c.sha256 = l.sha256 THEN 'exact-duplicate' "
    "WHEN c.modified > l.modified THEN 'use-candidate' ELSE 'keep-existing' END AS decision FROM c LEFT JOIN l ON l.path = c.target",
)
def publish_decision(spark, sf):
    f = lib(spark, sf)
    cand = spark.sql(_CAND.format(src="{src}"), src=f)
    return M.publish_decisions(cand, f).select("target", "decision")


_PART = "SELECT path || '.partial' AS path FROM {src} WHERE path LIKE '%.zip' UNION ALL SELECT path FROM {src} WHERE length(path) % 3 = 0"
_PART_OUT = (
    f"WITH l AS MATERIALIZED (SELECT path FROM ({V.LIBRARY_SQL})), f AS MATERIALIZED ({_PART.format(src='l')}), p AS MATERIALIZED (SELECT path, regexp_replace(path, '\\.partial$', '') AS final FROM f WHERE lower(path) LIKE '%.zip.partial'), "
    "r AS (SELECT p.path, CASE WHEN d.path IS NOT NULL THEN 'stale' WHEN length(p.path) % 2 = 0 THEN 'promote' ELSE 'invalid' END AS outcome FROM p LEFT JOIN f d ON d.path = p.final) "
)


def _recovered(spark, sf):
    f = spark.sql(_PART, src=stored(V.library(spark, sf).select("path")))  # paths alone, without hashes and times
    return M.partial_recovery(f, f.select("path", (F.length("path") % 2 == 0).alias("valid")))


@query("partial_recovery", _PART_OUT + "SELECT path, outcome FROM r")
def partial_recovery(spark, sf):
    return _recovered(spark, sf).select("path", "outcome")


@query("recovery_summary", _PART_OUT + "SELECT count(*) AS found, count_if(outcome = 'promote') AS promoted, count_if(outcome = 'stale') AS removed_stale, count_if(outcome = 'invalid') AS invalid_kept FROM r")
def recovery_summary(spark, sf):
    return M.recovery_summary(_recovered(spark, sf))


# The flagship question without clustering: which copies of each volume are out of date?
_GROUPED = (
    "vg0",
    f"SELECT {S.canonical('work')} AS k, edition, volume, max(modified) AS newest, list(modified) AS ms, arg_min(source, (-epoch_us(modified), ord)) AS winner "
    "FROM u0 WHERE has_volume GROUP BY 1, 2, 3 HAVING count(*) > 1",
)


@query(
    "superseded_volumes",
    X.upto(
        "named",
        "SELECT u0.series, u0.volume, count(*) AS superseded FROM u0 JOIN vg0 ON vg0.edition = u0.edition AND vg0.volume = u0.volume "
        f"AND vg0.k = {S.canonical('u0.work')} WHERE len(list_filter(ms, lambda m: m = newest)) = 1 AND source <> winner AND NOT quarantined GROUP BY 1, 2",
        [_PLAIN[0], _GROUPED],
    ),
)
def superseded_volumes(spark, sf):
    marked, _ = D.mark_variants(plain_items(spark, sf))
    return marked.where("action = 'superseded'").groupBy("series", "volume").agg(F.count("*").alias("superseded"))
