"""SQL text for the naming rules, as DuckDB runs it (RE2 patterns, plain CASE logic)."""

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import rx
from shelfmark.functions.text import TRIM_CHARS

FW = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])) + "０１２３４５６７８９"
FW_TO = "abcdefghijklmnopqrstuvwxyz" * 2 + "0123456789"


def q(text: str) -> str:
    """A SQL string literal; control characters are spelled with chr()."""
    out, plain = [], ""
    for ch in text:
        if ord(ch) < 32 or ch in "\x85\xa0":
            if plain:
                out.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            out.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not out:
        out.append("'" + plain.replace("'", "''") + "'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def trim_u(c):
    return f"trim({c}, {q(TRIM_CHARS)})"


def sub(c, pattern, by="", ic=False):
    return f"regexp_replace({c}, {q(rx.re2(pattern, ic))}, {q(by)}, 'g')"


def ext(c, pattern, group=0, ic=False):
    return f"regexp_extract({c}, {q(rx.re2(pattern, ic))}, {group})"


def has(c, pattern, ic=False):
    return f"regexp_matches({c}, {q(rx.re2(pattern, ic))})"


def isin(c, words):
    return f"{c} IN ({', '.join(q(w) for w in words)})"


def base(c):
    return f"split_part({c}, '/', -1)"


def extension(c):
    return f"lower({ext(c, rx.EXTENSION)})"


def stem(c):
    return sub(c, rx.EXTENSION)


def stage(src, **cols):
    body = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"SELECT *, {body} FROM ({src})"


def safe(c):
    c = f"translate({c}, {q('/' + chr(92) + ':*?' + chr(34) + '<>|')}, {q(' ' * 9)})"
    c = sub(c, r"\p{Cc}")
    c = f"trim({sub(trim_u(c), '[<s>]+', ' ')}, '. ')"
    c = f"CASE WHEN length({c}) > 180 THEN {trim_u(f'left({c}, 180)')} ELSE {c} END"
    return f"coalesce(nullif({c}, ''), 'Unknown')"


def tidy(c):
    return sub(f"trim({trim_u(c)}, {q(fv.TITLE_EDGE)})", "[<s>]+", " ")


def strip_variants(c, space=fv.ASCII_SPACE):
    return trim_u(sub(trim_u(c), rx.variant_run(space), "", True))


def undouble(c):
    half = f"((length({c}) - 1) // 2)"
    return (
        f"CASE WHEN length({c}) >= 3 AND length({c}) % 2 = 1 AND left({c}, {half}) = right({c}, {half}) "
        f"AND substr({c}, {half} + 1, 1) IN (' ', '　') THEN left({c}, {half}) ELSE {c} END"
    )


def group_key(c):
    return f"translate(lower({undouble(strip_variants(c))}), {q(fv.GROUP_KEY_DROPPED)}, '')"


_EDGE = f"[<u>{fv.STARS}{fv.VARIATION_SELECTORS}]*"


def rating_bare(c):
    t = trim_u(c)
    bare = trim_u(sub(sub(t, f"\\A{_EDGE}"), f"{_EDGE}\\z"))
    return f"CASE WHEN {rating_count(c)} > 0 THEN {bare} ELSE {t} END"


def rating_marks(c):
    t = trim_u(c)
    lead = ext(t, f"\\A{_EDGE}")
    tail = ext(f"substr({t}, length({lead}) + 1)", f"{_EDGE}\\z")
    return f"CASE WHEN {rating_count(c)} > 0 THEN {trim_u(f'({lead} || {tail})')} ELSE '' END"


def rating_count(c):
    t = trim_u(c)
    lead = ext(t, f"\\A{_EDGE}")
    tail = ext(f"substr({t}, length({lead}) + 1)", f"{_EDGE}\\z")
    return f"length({sub(f'({lead} || {tail})', f'[^{fv.STARS}]')})"


def canonical(c):
    return f"translate(lower({trim_u(rating_bare(c))}), {q(FW + fv.CANONICAL_KEY_DROPPED)}, {q(FW_TO)})"


def spin(c):
    return has(f"lower({c})", rx.any_of(fv.SPIN_OFF_MARKERS).replace(r"\ ", " ").replace(r"\-", "-"))


def japanese(c):
    return has(c, rx.JAPANESE_RE2)


def latin(c):
    return has(c, rx.LATIN)


def usable(c):
    t = trim_u(c)
    left = f"lower({t})"
    for token in fv.COUNTER_TOKENS:
        left = f"replace({left}, {q(token)}, '')"
    left = sub(left, f"[<d><u>{fv.COUNTER_PUNCTUATION}]+")
    letters = f"length({sub(t, r'[^\p{L}\p{Han}\p{Hiragana}\p{Katakana}]')})"
    return (
        f"({t} <> '' AND {t} <> 'Unknown' AND NOT contains({t}, '�') AND NOT ({isin(f'lower({t})', fv.GENERIC_NAMES)}) "
        f"AND {letters} >= 2 AND {left} <> '')"
    )


def author_tokens(c):
    parts = f"regexp_split_to_array(coalesce({trim_u(c)}, ''), {q(rx.re2(f'[<u>{fv.AUTHOR_SEPARATORS}]+'))})"
    keys = f"list_transform({parts}, lambda a: {canonical('a')})"
    return f"list_sort(list_distinct(list_filter({keys}, lambda k: length(k) >= 2)))"


def edition(c):
    low = f"lower({stem(base(c))})"
    compact = f"translate({low}, ' _-', '')"
    return (
        f"CASE WHEN {has(low, 'セミカラー')} OR {has(compact, 'semicolor|semicolour')} THEN 'semi-color' "
        f"WHEN {has(low, 'フルカラー')} OR {has(compact, 'fullcolor|fullcolour')} THEN 'full-color' "
        f"WHEN {has(low, 'モノクロ|白黒')} OR {has(compact, 'monochrome|blackandwhite')} THEN 'monochrome' "
        f"WHEN {has(low, 'カラー')} OR {has(compact, 'color|colour')} THEN 'color' ELSE 'standard' END"
    )


def number(c):
    return f"TRY_CAST(translate({c}, '０１２３４５６７８９', '0123456789') AS INTEGER)"


def front(c, pattern, ic):
    return ext(c, r"\A(.*?)(?:" + pattern + ")", 1, ic)


def meta(tag):
    n = f"lower({trim_u(tag)})"
    return f"({isin(n, fv.METADATA_TAGS)} OR ({has(n, rx.any_of(fv.METADATA_TAGS))} AND {has(n, rx.any_of(fv.METADATA_TAG_COMPANIONS))}))"


def parsed(src, col, existing=False, p="p_"):
    """Adds p_series, p_author, p_volume, p_has_volume, p_confidence (and working columns z_*)."""
    space = fv.WIDE_SPACE if existing else fv.ASCII_SPACE
    vol, tail = rx.volume_vol(space), rx.volume_tail(space)
    z = "z" + p
    known = f"CASE WHEN {isin(extension(base(col)), fv.KNOWN_EXTENSIONS)} THEN {stem(base(col))} ELSE {base(col)} END"
    s = stage(src, **{z + "base": trim_u(known)})
    s = stage(s, **{z + "lead": ext(z + "base", rx.LEADING_BRACKETS)})
    units = f"regexp_extract_all({z}lead, {q(rx.re2(rx.BRACKET_UNITS))}, 0)"
    s = stage(
        s,
        **{
            z + "tags": f"list_transform({units}, lambda t: {trim_u('substr(t, 2, length(t) - 2)')})",
            z + "body": trim_u(f"substr({z}base, length({z}lead) + 1)"),
        },
    )
    s = stage(
        s,
        **{
            z + "authors": f"list_filter({z}tags, lambda t: NOT {meta('t')})",
            z + "body2": trim_u(sub(z + "body", rx.suffix_run(space), "", True)),
        },
    )
    s = stage(s, **{z + "text": trim_u(sub(z + "body2", rx.PAGE_RUN, "", True))})
    s = stage(
        s,
        **{
            z + "jp": ext(z + "text", rx.VOLUME_JP, 1, True),
            z + "vol": ext(z + "text", vol, 1, True),
            z + "tail": ext(z + "text", tail, 1),
            z + "isrange": has(z + "text", rx.VOLUME_RANGE_TAIL, True),
        },
    )
    rule = f"CASE WHEN {z}jp <> '' THEN 1 WHEN {z}vol <> '' THEN 2 WHEN {z}tail <> '' THEN 3 ELSE 0 END"
    s = stage(s, **{z + "rule": rule})
    s = stage(s, **{z + "ranged": f"{z}isrange" if existing else f"({z}rule = 0 AND {z}isrange)"})
    front_sql = (
        f"CASE WHEN {z}ranged THEN {front(z + 'text', rx.VOLUME_RANGE_TAIL, True)} "
        f"WHEN {z}rule = 1 THEN {front(z + 'text', rx.VOLUME_JP, True)} "
        f"WHEN {z}rule = 2 THEN {front(z + 'text', vol, True)} "
        f"WHEN {z}rule = 3 THEN {front(z + 'text', tail, False)} ELSE {z}text END"
    )
    s = stage(s, **{z + "title0": strip_variants(tidy(front_sql), space)})
    s = stage(s, **{z + "title": z + "title0" if existing else undouble(z + "title0")})
    digits = f"CASE {z}rule WHEN 1 THEN {z}jp WHEN 2 THEN {z}vol ELSE {z}tail END"
    score = (
        f"CAST(0.45 AS DOUBLE) + CASE WHEN len({z}authors) > 0 THEN CAST(0.12 AS DOUBLE) ELSE 0 END "
        f"+ CASE {z}rule WHEN 1 THEN CAST(0.30 AS DOUBLE) WHEN 2 THEN CAST(0.27 AS DOUBLE) WHEN 3 THEN CAST(0.16 AS DOUBLE) ELSE 0 END "
        f"+ CASE WHEN {z}title <> '' THEN CAST(0.10 AS DOUBLE) ELSE CAST(-0.20 AS DOUBLE) END"
    )
    return stage(
        s,
        **{
            p + "series": safe(f"CASE WHEN {z}title <> '' THEN {z}title ELSE {z}text END"),
            p + "author": f"coalesce({z}authors[-1], '')",
            p + "volume": f"CASE WHEN {z}rule > 0 AND NOT {z}ranged THEN {number(digits)} END",
            p + "has_volume": f"({z}rule > 0 AND NOT {z}ranged)",
            p + "confidence": f"greatest(least({score}, CAST(0.99 AS DOUBLE)), CAST(0 AS DOUBLE))",
        },
    )


def coverage(src, col, p="v_"):
    """Adds p_kind, p_vs, p_ve, p_cs, p_ce, p_label (literal rule order)."""
    t, z = trim_u(col), "z" + p

    def n(pattern, i):
        return number(ext(t, pattern, i, True))

    s = stage(
        src,
        **{
            z + "v1": n(rx.COVERAGE_VOLUMES, 1), z + "v2": n(rx.COVERAGE_VOLUMES, 2),
            z + "a1": n(rx.COVERAGE_JP_CHAPTERS, 1), z + "a2": n(rx.COVERAGE_JP_CHAPTERS, 2),
            z + "b1": n(rx.COVERAGE_CHAPTERS, 1), z + "b2": n(rx.COVERAGE_CHAPTERS, 2),
            z + "one": f"coalesce({n(rx.COVERAGE_JP_CHAPTER, 1)}, {n(rx.COVERAGE_CHAPTER, 1)})",
        },
    )
    s = stage(
        s,
        **{
            p + "vs": f"coalesce(least({z}v1, {z}v2), 0)", p + "ve": f"coalesce(greatest({z}v1, {z}v2), 0)",
            z + "c1": f"CASE WHEN least({z}a1, {z}a2) > 0 THEN least({z}a1, {z}a2) ELSE coalesce(least({z}b1, {z}b2), least({z}a1, {z}a2)) END",
            z + "c2": f"CASE WHEN least({z}a1, {z}a2) > 0 THEN greatest({z}a1, {z}a2) ELSE coalesce(greatest({z}b1, {z}b2), greatest({z}a1, {z}a2)) END",
        },
    )
    s = stage(s, **{z + "need": f"(coalesce({z}c1, 0) = 0 AND {z}one IS NOT NULL)"})
    s = stage(
        s,
        **{
            p + "cs": f"CASE WHEN {z}need THEN {z}one ELSE coalesce({z}c1, 0) END",
            p + "ce": f"CASE WHEN {z}need THEN {z}one ELSE coalesce({z}c2, 0) END",
            p + "kind": f"CASE WHEN {z}v1 IS NOT NULL AND least({z}a1, {z}a2) = 0 AND {z}b1 IS NOT NULL THEN 'chapter' "
            f"WHEN {z}v1 IS NOT NULL AND {z}c1 IS NOT NULL THEN 'mixed' WHEN {z}c1 IS NOT NULL THEN 'chapter' "
            f"WHEN {z}v1 IS NOT NULL AND {z}need THEN 'mixed' WHEN {z}v1 IS NOT NULL THEN 'volume' ELSE '' END",
        },
    )
    v, c = label("巻", p + "vs", p + "ve"), label("話", p + "cs", p + "ce")
    both = f"concat_ws(' / ', CASE WHEN {p}vs > 0 THEN {v} END, CASE WHEN {p}cs > 0 THEN {c} END)"
    return stage(
        s, **{p + "label": f"CASE {p}kind WHEN 'chapter' THEN {c} WHEN 'mixed' THEN {both} WHEN 'volume' THEN {v} ELSE '' END"}
    )


def label(unit, a, b):
    return f"CASE WHEN {a} = 0 THEN '' WHEN {b} = 0 OR {a} = {b} THEN '{unit} ' || {a} ELSE '{unit} ' || {a} || '–' || {b} END"


def merged(p="v_"):
    """Aggregate columns kind, volume_start.. over p_vs.. rows."""
    vs = f"coalesce(min(CASE WHEN {p}vs > 0 THEN {p}vs END), 0)"
    ve = f"coalesce(max(CASE WHEN {p}vs > 0 THEN {p}ve END), 0)"
    cs = f"coalesce(min(CASE WHEN {p}cs > 0 THEN {p}cs END), 0)"
    ce = f"coalesce(max(CASE WHEN {p}cs > 0 THEN {p}ce END), 0)"
    return (
        f"CASE WHEN {vs} > 0 AND {cs} > 0 THEN 'mixed' WHEN {vs} > 0 THEN 'volume' WHEN {cs} > 0 THEN 'chapter' ELSE 'unknown' END AS kind, "
        f"{vs} AS volume_start, {ve} AS volume_end, {cs} AS chapter_start, {ce} AS chapter_end, "
        f"concat_ws(' / ', CASE WHEN {vs} > 0 THEN {label('巻', vs, ve)} END, CASE WHEN {cs} > 0 THEN {label('話', cs, ce)} END) AS label"
    )
