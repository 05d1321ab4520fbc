"""SQL text of the reconcile flow over the ``library`` view, stage by stage (CTEs)."""

from checks import sql_naming as S
from checks import views as V
from shelfmark.functions import fixed_values as fv
from shelfmark.functions import rx

Q = V.QUARANTINE
OUT = "/lib0"
# DuckDB's levenshtein counts bytes: map the wide characters of this view to unused ASCII.
WIDE = "フルカラーモノクロ版巻第コミッ単行本一般"
_WIDE = "".join(dict.fromkeys(WIDE))
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(_WIDE)]


def lev(a, b):
    n = lambda c: f"translate({c}, '{_WIDE}', '{_NARROW}')"
    return f"levenshtein({n(a)}, {n(b)})"


def sim(a, b):
    return f"(CAST(1 AS DOUBLE) - CAST({lev(a, b)} AS DOUBLE) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"


def profile(col, p):
    return {
        p + "key": S.canonical(col), p + "ok": S.usable(col), p + "spin": S.spin(S.trim_u(col)),
        p + "jp": S.japanese(S.trim_u(col)), p + "latin": S.latin(S.trim_u(col)),
        p + "chars": f"length({S.trim_u(col)})", p + "low": f"lower({S.trim_u(col)})",
        p + "count": S.rating_count(col), p + "marks": S.rating_marks(col), p + "bare": S.rating_bare(col),
    }


def _sl(a, b, field):
    """(short, long) field by key length, first one short on a tie."""
    c = f"length({a}key) <= length({b}key)"
    return (f"(CASE WHEN {c} THEN {a}{field} ELSE {b}{field} END)", f"(CASE WHEN {c} THEN {b}{field} ELSE {a}{field} END)")


def is_spin_prefix(a, b):
    (sk, lk), (_, lspin) = _sl(a, b, "key"), _sl(a, b, "spin")
    return f"(length({sk}) >= 6 AND {sk} <> {lk} AND starts_with({lk}, {sk}) AND {lspin})"


def is_bilingual(a, b):
    (sk, lk), (jp, _), (la, _) = _sl(a, b, "key"), _sl(a, b, "jp"), _sl(a, b, "latin")
    rest = (
        f"(CASE WHEN starts_with({lk}, {sk}) THEN substr({lk}, length({sk}) + 1) "
        f"WHEN ends_with({lk}, {sk}) THEN left({lk}, length({lk}) - length({sk})) ELSE '' END)"
    )
    return (
        f"(NOT {a}spin AND NOT {b}spin AND length({sk}) >= 4 AND {sk} <> {lk} AND {rest} <> '' AND "
        f"(({jp} AND NOT {la} AND {S.latin(rest)}) OR ({la} AND NOT {jp} AND {S.japanese(rest)})))"
    )


def is_subtitle(a, b):
    sk, lk = _sl(a, b, "key")
    return f"(length({sk}) >= 6 AND starts_with({lk}, {sk}) AND length({lk}) - length({sk}) >= 2)"


def minor(a, b):
    ka, kb = a + "key", b + "key"
    ten = f"(length({ka}) >= 10 AND length({kb}) >= 10 AND {sim(ka, kb)} >= 0.90)"
    eight = f"(length({ka}) >= 8 AND length({kb}) >= 8 AND {sim(ka, kb)} >= 0.94)"
    close = f"abs(length({ka}) - length({kb})) <= 0.1 * greatest(length({ka}), length({kb}))"
    return f"({close} AND ({ten} OR {eight}))"


def pair_score(a, b):
    ka, kb = a + "key", b + "key"
    return (
        f"CASE WHEN NOT {a}ok OR NOT {b}ok OR {ka} = '' OR {kb} = '' THEN 0 WHEN {ka} = {kb} THEN 1 "
        f"WHEN {is_spin_prefix(a, b)} THEN CAST(0.97 AS DOUBLE) WHEN {is_bilingual(a, b)} THEN CAST(0.98 AS DOUBLE) "
        f"WHEN {a}spin OR {b}spin THEN 0 WHEN {minor(a, b)} THEN {sim(ka, kb)} ELSE 0 END"
    )


def rank(p):
    return f"({p}spin, NOT {p}jp, {p}jp AND {p}latin, {p}chars, {p}low)"


def better(a, b):
    return (
        f"CASE WHEN {a}ok <> {b}ok THEN {a}ok WHEN NOT {a}ok THEN false WHEN {a}spin <> {b}spin THEN NOT {a}spin "
        f"WHEN {a}key <> {b}key AND {a}chars <> {b}chars AND {is_bilingual(a, b)} THEN {a}chars < {b}chars "
        f"ELSE {rank(a)} < {rank(b)} END"
    )


def rated(count, marks, bare):
    return f"CASE WHEN {marks} = '' THEN {bare} ELSE {marks} || ' ' || {bare} END"


def legacy(c):
    for suffix in fv.LEGACY_FOLDER_SUFFIXES:
        c = S.trim_u(S.sub(c if c.startswith("trim") else S.trim_u(c), rx.any_of([suffix]) + r"\z"))
    return c


def archive_filter(c):
    second = f"coalesce(TRY_CAST({S.ext(c, rx.MULTIPART, 2, True)} AS BIGINT) > 1, false)"
    return f"({S.extension(c)} = '.zip' OR ({S.extension(c)} = '.rar' AND NOT {second}))"


def dirname(c):
    return f"regexp_replace({c}, '/[^/]*$', '')"


def stages() -> list[tuple[str, str]]:
    st = [("lib", V.LIBRARY_SQL)]
    st.append(("pa", S.parsed(f"SELECT * FROM lib WHERE {archive_filter('name')}", "name", existing=True)))
    folder = S.base(dirname("path"))
    st.append(
        (
            "pb",
            "SELECT path, root, rel, name, size, modified, sha256, ord, p_series, p_author AS author, p_volume AS volume, "
            f"p_has_volume AS has_volume, p_confidence, CASE WHEN {dirname('path')} <> root AND {folder} NOT IN ('', '.', '{Q}') "
            f"THEN {folder} END AS folder FROM pa",
        )
    )
    ev = "SELECT DISTINCT p_series AS series, folder FROM pb WHERE folder IS NOT NULL"
    ev = S.stage(ev, parent=legacy("folder"), raw_ok=S.usable("folder"))
    ev = S.stage(ev, **profile("parent", "p_"), **profile("series", "n_"))
    ev = S.stage(
        ev, agrees=f"(raw_ok AND p_ok AND n_ok AND ({pair_score('n_', 'p_')} >= 0.90 OR {is_subtitle('n_', 'p_')}))",
        stands_in="(raw_ok AND p_ok AND NOT n_ok)",
    )
    ev = S.stage(ev, shown0=f"CASE WHEN agrees AND {better('p_', 'n_')} THEN parent ELSE series END")
    ev = S.stage(ev, **profile("shown0", "s_"))
    up = "((p_count, p_marks) > (s_count, s_marks))"
    ev = S.stage(
        ev,
        shown=f"CASE WHEN agrees THEN CASE WHEN {up} THEN p_marks || ' ' || s_bare ELSE {rated('s_count', 's_marks', 's_bare')} END "
        "WHEN stands_in THEN parent ELSE series END",
    )
    st.append(("ev", ev))
    named = (
        "SELECT pb.path AS source, root, rel, name, size, modified, sha256, ord, author, volume, has_volume, "
        "coalesce(shown, p_series) AS series0, p_series, "
        "CASE WHEN agrees THEN greatest(p_confidence, CAST(0.9 AS DOUBLE)) WHEN stands_in THEN CAST(0.78 AS DOUBLE) ELSE p_confidence END AS conf0 "
        "FROM pb LEFT JOIN ev ON pb.p_series = ev.series AND pb.folder = ev.folder"
    )
    named = S.stage(named, u=S.usable("series0"), w=S.usable("p_series"), edition=S.edition("name"))
    named = S.stage(
        named, series1="CASE WHEN u THEN series0 ELSE '' END", confidence="CASE WHEN u THEN conf0 ELSE 0 END",
        work="CASE WHEN w THEN p_series WHEN u THEN series0 ELSE '' END",
    )
    st.append(("named", named))
    names = "SELECT series1 AS series, min(ord) AS ord, count(*) AS files FROM named WHERE series1 <> '' GROUP BY 1"
    st.append(("nm", S.stage(names, **profile("series", "x_"))))
    st.append(
        (
            "au",
            "SELECT series1 AS series, list_distinct(flatten(list(toks))) AS authors FROM (SELECT DISTINCT series1, author FROM named "
            f"WHERE series1 <> '') d, LATERAL (SELECT {S.author_tokens('author')} AS toks) t GROUP BY 1",
        )
    )
    cols = "key ok spin jp latin chars low".split()
    pick = lambda t: ", ".join(f"{t}.x_{c} AS {t}_{c}" for c in cols)
    cross = (
        f"SELECT a.series AS a, b.series AS b, a.ord AS oa, b.ord AS ob, {pick('a')}, {pick('b')}, "
        "list_has_any(aa.authors, ab.authors) AS shared "
        "FROM nm a JOIN nm b ON a.ord < b.ord JOIN au aa ON aa.series = a.series JOIN au ab ON ab.series = b.series "
        "WHERE a.x_key <> '' AND b.x_key <> ''"
    )
    a, b = "a_", "b_"
    scored = S.stage(cross, ks=sim("a_key", "b_key"), sub_=is_subtitle(a, b), spinpre=is_spin_prefix(a, b), bil=is_bilingual(a, b))
    ls, ll = f"least(length(a_key), length(b_key))", f"greatest(length(a_key), length(b_key))"
    sk, lk = _sl(a, b, "key")
    inserted = (
        f"({ls} >= 10 AND {ll} - {ls} BETWEEN 1 AND 8 AND len(list_filter(range(0, {ls} + 1), lambda i: "
        f"left({lk}, i) || right({lk}, {ls} - i) = {sk})) > 0)"
    )
    plain = "(NOT a_spin AND NOT b_spin)"
    ten = f"({ls} >= 10 AND ks >= 0.90)"
    near = f"({ls} >= 10 AND ks >= 0.86)"
    free = f"(a_key = b_key OR spinpre OR bil OR ({plain} AND {ten}))"
    verdict = (
        f"CASE WHEN a_key = b_key THEN {{'score': CAST(1 AS DOUBLE), 'reason': '{fv.EXACT_REASON}'}} "
        f"WHEN spinpre THEN {{'score': CAST(0.97 AS DOUBLE), 'reason': '{fv.SPIN_OFF_REASON}'}} "
        f"WHEN bil THEN {{'score': CAST(0.98 AS DOUBLE), 'reason': '{fv.BILINGUAL_REASON}'}} "
        f"WHEN {plain} AND {ten} THEN {{'score': ks, 'reason': '{fv.MINOR_REASON}'}} "
        f"WHEN shared AND sub_ THEN {{'score': CAST(0.96 AS DOUBLE), 'reason': '{fv.SUBTITLE_REASON}'}} "
        f"WHEN shared AND {plain} AND {inserted} THEN {{'score': CAST(0.95 AS DOUBLE), 'reason': '{fv.AUTHOR_VARIATION_REASON}'}} "
        f"ELSE {{'score': ks, 'reason': '{fv.AUTHOR_VARIATION_REASON}'}} END"
    )
    pairs = (
        f"SELECT a, b, oa, ob, v.score AS score, v.reason AS reason FROM (SELECT *, {verdict} AS v FROM ({scored}) "
        f"WHERE {free} OR (shared AND (sub_ OR ({plain} AND ({inserted} OR {near})))))"
    )
    st.append(("pr", pairs))
    st.append(("ed", "SELECT a, b FROM pr UNION SELECT b, a FROM pr"))
    st.append(
        (
            "reach(n, r)",
            "SELECT series, series FROM nm UNION SELECT ed.b, reach.r FROM reach JOIN ed ON ed.a = reach.n",
        )
    )
    st.append(("cl", "SELECT n AS series, min(r) AS cluster FROM reach GROUP BY 1"))
    st.append(
        (
            "mb",
            "SELECT nm.*, cluster, sum(files) OVER (PARTITION BY cluster) AS cluster_files, "
            "sum(files) OVER (PARTITION BY cluster, x_key) AS key_files FROM nm JOIN cl USING (series)",
        )
    )
    st.append(
        (
            "pk",
            f"SELECT cluster, arg_min(x_bare, {rank('x_')[:-1]}, ord)) AS bare FROM (SELECT * FROM mb QUALIFY key_files = max(key_files) "
            "OVER (PARTITION BY cluster)) WHERE cluster_files > 1 GROUP BY 1",
        )
    )
    st.append(
        (
            "cn",
            "SELECT mb.series, mb.cluster, files, CASE WHEN cluster_files > 1 THEN CASE WHEN m.marks = '' THEN pk.bare ELSE m.marks || ' ' || pk.bare END "
            "ELSE mb.series END AS canonical, CASE WHEN cluster_files > 1 THEN coalesce(f.hit.reason, 'series cluster') END AS reason, "
            "CASE WHEN cluster_files > 1 THEN coalesce(f.hit.score, CAST(0.95 AS DOUBLE)) END AS score "
            "FROM mb LEFT JOIN pk ON pk.cluster = mb.cluster LEFT JOIN (SELECT cluster, max((x_count, x_marks))[2] AS marks FROM mb GROUP BY 1) m "
            "ON m.cluster = mb.cluster LEFT JOIN (SELECT s, arg_min(h, po) AS hit FROM (SELECT a AS s, ob AS po, {'reason': reason, 'score': score} AS h FROM pr "
            "UNION ALL SELECT b, oa, {'reason': reason, 'score': score} FROM pr) GROUP BY 1) f ON f.s = mb.series",
        )
    )
    st.append(
        (
            "it0",
            "SELECT source, root, rel, name, size, modified, sha256, named.ord AS ord, author, volume, has_volume, edition, confidence, work, "
            f"coalesce(canonical, series1) AS series, split_part(rel, '/', 1) = '{Q}' AS quarantined "
            "FROM named LEFT JOIN cn ON named.series1 = cn.series",
        )
    )
    st.append(
        (
            "it1",
            f"SELECT *, CASE WHEN series <> '' THEN '{OUT}/' || series || '/' || {S.base('source')} END AS destination FROM it0",
        )
    )
    st.append(
        (
            "it2",
            "SELECT *, CASE WHEN series = '' THEN 'error' WHEN destination = source THEN 'keep' ELSE 'move' END AS action FROM it1",
        )
    )
    cb = "SELECT DISTINCT series, work, coalesce(author, '') AS author FROM it2 WHERE action <> 'error'"
    cb = S.stage(cb, **profile("series", "s_"), **profile("work", "w_"), toks=S.author_tokens("author"),)
    cb = S.stage(cb, digits="array_to_string(regexp_extract_all(w_key, '[0-9]+'), ',')")
    alias = (
        f"(w_key <> '' AND s_key <> '' AND (w_key = s_key OR (w_spin = s_spin AND ((length(s_key) > length(w_key) AND {is_bilingual('w_', 's_')}) "
        f"OR (NOT w_spin AND {minor('w_', 's_')})))))"
    )
    st.append(("cb", S.stage(cb, alias_ok=alias)))
    wcols = "key spin jp latin".split()
    wp = lambda t: ", ".join(f"{t}.w_{c} AS {t}_{c}" for c in wcols)
    st.append(
        (
            "we",
            f"SELECT DISTINCT s, a_key AS x, b_key AS y FROM (SELECT a.s_key AS s, {wp('a')}, {wp('b')} FROM cb a JOIN cb b ON a.s_key = b.s_key AND a.w_key <> b.w_key "
            "AND a.digits = b.digits AND a.toks = b.toks AND len(a.toks) > 0 AND a.alias_ok AND b.alias_ok AND a.w_spin = b.w_spin) "
            f"WHERE {is_bilingual('a_', 'b_')} OR (NOT a_spin AND {minor('a_', 'b_')})",
        )
    )
    st.append(
        (
            "wr(s, n, r)",
            "SELECT DISTINCT s_key, w_key, w_key FROM cb UNION SELECT we.s, we.y, wr.r FROM wr JOIN we ON we.s = wr.s AND we.x = wr.n",
        )
    )
    st.append(
        (
            "wk",
            "SELECT DISTINCT series, work, author, m.work_key FROM cb JOIN (SELECT s, n, min(r) AS work_key FROM wr GROUP BY 1, 2) m ON m.s = s_key AND m.n = w_key",
        )
    )
    st.append(
        (
            "it",
            "SELECT it2.*, work_key FROM it2 LEFT JOIN wk ON it2.series = wk.series AND it2.work = wk.work AND coalesce(it2.author, '') = wk.author",
        )
    )
    st.append(
        (
            "dk",
            "SELECT size, work_key, edition, sha256, arg_min(source, (quarantined, -epoch_us(modified), ord)) AS keeper FROM it "
            "WHERE action <> 'error' GROUP BY ALL HAVING count(*) > 1",
        )
    )
    st.append(
        (
            "d1",
            "SELECT it.* EXCLUDE (action, destination), CASE WHEN keeper IS NULL OR keeper = source THEN action WHEN quarantined THEN 'keep' ELSE 'duplicate' END AS action, "
            "CASE WHEN keeper IS NOT NULL AND keeper <> source AND quarantined THEN source ELSE destination END AS destination, "
            "CASE WHEN keeper <> source THEN keeper END AS duplicate_of "
            "FROM it LEFT JOIN dk ON it.action <> 'error' AND it.size = dk.size AND it.work_key = dk.work_key AND it.edition = dk.edition AND it.sha256 = dk.sha256",
        )
    )
    st.append(
        (
            "vg",
            "SELECT work_key, edition, volume, max(modified) AS newest, arg_min(source, (-epoch_us(modified), ord)) AS winner, "
            "arg_min(work, (-epoch_us(modified), ord)) AS choice_series, list(modified) AS ms "
            "FROM d1 WHERE action NOT IN ('error', 'duplicate') AND has_volume AND series <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1",
        )
    )
    st.append(
        (
            "vh",
            "SELECT work_key, edition, volume, winner, choice_series, tied, CASE WHEN tied THEN 'volume-choice-' || "
            "row_number() OVER (PARTITION BY tied ORDER BY work_key, edition, volume) END AS choice FROM (SELECT *, len(list_filter(ms, lambda m: m = newest)) > 1 AS tied FROM vg)",
        )
    )
    live = "action NOT IN ('error', 'duplicate') AND has_volume AND series <> ''"
    st.append(
        (
            "d2",
            f"SELECT d1.* EXCLUDE (action, destination, duplicate_of), CASE WHEN winner IS NULL OR NOT ({live}) THEN action WHEN tied THEN 'review' WHEN source = winner THEN action "
            "WHEN quarantined THEN 'keep' ELSE 'superseded' END AS action, "
            f"CASE WHEN winner IS NOT NULL AND {live} AND NOT tied AND source <> winner AND quarantined THEN source ELSE destination END AS destination, "
            f"CASE WHEN winner IS NOT NULL AND {live} AND NOT tied AND source <> winner THEN winner ELSE duplicate_of END AS duplicate_of, "
            f"coalesce(winner IS NOT NULL AND {live} AND NOT tied AND source = winner, false) AS auto_selected, "
            f"CASE WHEN {live} THEN choice END AS review_group "
            "FROM d1 LEFT JOIN vh ON d1.work_key = vh.work_key AND d1.edition = vh.edition AND d1.volume = vh.volume",
        )
    )
    st.append(
        (
            "d3",
            "SELECT d2.* EXCLUDE (action), CASE WHEN action IN ('move', 'keep') AND destination <> d2.source AND t.path IS NOT NULL "
            "THEN CASE WHEN v.source IS NOT NULL THEN 'move' ELSE 'conflict' END ELSE action END AS action, "
            "(action IN ('move', 'keep') AND destination <> d2.source AND t.path IS NOT NULL AND v.source IS NOT NULL) AS freed "
            "FROM d2 LEFT JOIN lib t ON t.path = d2.destination LEFT JOIN (SELECT source FROM d2 WHERE action IN ('duplicate', 'superseded')) v ON v.source = d2.destination",
        )
    )
    slot = f"'{OUT}/{Q}/' || series || '/' || {S.base('source')}"
    st.append(
        (
            "qn0",
            f"SELECT source, {slot} AS slot, row_number() OVER (PARTITION BY {slot} ORDER BY ord) AS r FROM d3 WHERE action IN ('duplicate', 'superseded')",
        )
    )
    st.append(
        (
            "qn",
            "SELECT source, CASE WHEN n = 1 THEN slot ELSE regexp_replace(slot, '\\.[^./]*$', '') || ' (' || n || ')' || regexp_extract(slot, '\\.[^./]*$') END AS qpath "
            "FROM (SELECT source, slot, r + CASE WHEN lib.path IS NULL THEN 0 ELSE 1 END AS n FROM qn0 LEFT JOIN lib ON lib.path = slot)",
        )
    )
    st.append(("fin", "SELECT d3.* REPLACE (coalesce(qpath, destination) AS destination) FROM d3 LEFT JOIN qn USING (source)"))
    return st


def upto(last: str, select: str, extra: list[tuple[str, str]] = ()) -> str:
    out = []
    for name, sql in stages():
        keep = "" if "(" in name else " MATERIALIZED"
        out.append(f"{name} AS{keep} ({sql})")
        if name.split("(")[0] == last:
            break
    out += [f"{n} AS ({s})" for n, s in extra]
    return "WITH RECURSIVE " + ", ".join(out) + " " + select
