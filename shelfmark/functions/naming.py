"""Names as columns: author, series, volume, confidence, keys, ratings, editions.

Every function takes and returns Columns (or adds Columns to a DataFrame in stages, so
that a value used twice is computed once).  No Python runs per row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import rx
from shelfmark.functions.text import (
    TRIM_CHARS,
    basename,
    computed_here,
    digits_value,
    extension,
    has_japanese,
    has_latin,
    text_before,
    trimmed,
    without_extension,
    without_known_extension,
)
from shelfmark.operators.stable import spread, stored

FULL_WIDTH_UPPER = "".join(map(chr, range(0xFF21, 0xFF3B)))
FULL_WIDTH_LOWER = "".join(map(chr, range(0xFF41, 0xFF5B)))
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


# --- folder names and keys -----------------------------------------------------------
def safe_folder_name(c: Column) -> Column:
    c = F.translate(c, '/\\:*?"<>|\0', " " * 10)
    c = F.regexp_replace(c, r"\p{Cc}", "")
    c = F.regexp_replace(trimmed(c), rx.jvm("[<s>]+"), " ")
    c = F.btrim(c, F.lit(". "))
    c = F.when(F.length(c) > fv.FOLDER_LIMIT, trimmed(F.left(c, F.lit(fv.FOLDER_LIMIT)))).otherwise(c)
    return F.when(c == "", F.lit("Unknown")).otherwise(c)


def tidy_series(c: Column) -> Column:
    return F.regexp_replace(F.btrim(trimmed(c), F.lit(fv.TITLE_EDGE)), rx.jvm("[<s>]+"), " ")


def strip_variants(c: Column, space: str = fv.ASCII_SPACE) -> Column:
    t = trimmed(c)
    return F.when(
        t.rlike(rx.jvm(rx.SUFFIX_LAST)), trimmed(F.regexp_replace(t, rx.jvm(rx.variant_run(space), True), ""))
    ).otherwise(t)


def strip_editions_and_variants(c: Column, space: str = fv.ASCII_SPACE) -> Column:
    return trimmed(F.regexp_replace(c, rx.jvm(rx.suffix_run(space), True), ""))


def strip_pages_and_chapters(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, rx.jvm(rx.PAGE_RUN, True), ""))


def undouble(c: Column) -> Column:
    """``title title`` -> ``title`` when both halves are exactly equal."""
    return F.regexp_replace(trimmed(c), rx.jvm(r"\A(.+?)[<u>]+\1\z"), "$1")


def group_key(c: Column) -> Column:
    return F.translate(F.lower(undouble(strip_variants(c))), fv.GROUP_KEY_DROPPED, "")


def rating_lead(c: Column) -> Column:
    return F.regexp_extract(c, rx.jvm(f"\\A[<u>{fv.STARS}{fv.VARIATION_SELECTORS}]*"), 0)


def rating_split(name: Column) -> Column:
    """struct(bare, marks, count): only star runs at the two ends are a rating."""
    t = trimmed(name)
    lead = rating_lead(t)
    tail = F.regexp_extract(
        F.substr(t, F.length(lead) + 1), rx.jvm(f"[<u>{fv.STARS}{fv.VARIATION_SELECTORS}]*\\z"), 0
    )
    marks = F.concat(lead, tail)
    count = F.length(F.regexp_replace(marks, f"[^{fv.STARS}]", ""))
    bare = F.substr(t, F.length(lead) + 1, F.length(t) - F.length(lead) - F.length(tail))
    has_stars = t.rlike(f"[{fv.STARS}]")
    return F.when(
        has_stars & (count > 0),
        F.struct(trimmed(bare).alias("bare"), trimmed(marks).alias("marks"), count.alias("count")),
    ).otherwise(F.struct(t.alias("bare"), F.lit("").alias("marks"), F.lit(0).alias("count")))


def rating_rank(split: Column) -> Column:
    """Orderable strength of a rating: star count, then the marks themselves."""
    return F.struct(split["count"].alias("count"), split["marks"].alias("marks"))


def with_rating(title: Column, *ranks: Column) -> Column:
    """Put the strongest of the title's own rating and ``ranks`` in front of the bare title."""
    own = rating_split(title)
    best = F.greatest(rating_rank(own), *ranks) if ranks else rating_rank(own)
    return F.when(best["marks"] == "", own["bare"]).otherwise(
        F.concat(best["marks"], F.lit(" "), own["bare"])
    )


def canonical_key(name: Column) -> Column:
    return key_of_bare(rating_split(name)["bare"])


def key_of_bare(bare: Column) -> Column:
    bare = F.lower(trimmed(bare))
    source = FULL_WIDTH_UPPER + FULL_WIDTH_LOWER + "０１２３４５６７８９" + fv.CANONICAL_KEY_DROPPED
    return F.translate(bare, source, ASCII_LOWER + ASCII_LOWER + "0123456789")


def has_spin_off(name: Column) -> Column:
    return F.lower(name).rlike(rx.any_of(fv.SPIN_OFF_MARKERS).replace(r"\ ", " ").replace(r"\-", "-"))


def counter_only(name: Column) -> Column:
    """Nothing is left once counters, digits, blanks and brackets are gone."""
    n = F.lower(trimmed(name))
    for token in fv.COUNTER_TOKENS:
        n = F.replace(n, F.lit(token), F.lit(""))
    return F.regexp_replace(n, rx.jvm(f"[<d><u>{fv.COUNTER_PUNCTUATION}]+"), "") == ""


def series_usable(name: Column) -> Column:
    t = trimmed(name)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", ""))
    return F.coalesce(
        (t != "")
        & (t != "Unknown")
        & ~t.contains("�")
        & F.is_valid_utf8(t)
        & ~F.lower(t).isin(fv.GENERIC_NAMES)
        & (letters >= 2)
        & ~counter_only(t),
        F.lit(False),
    )


def has_mojibake(name: Column) -> Column:
    return ~F.is_valid_utf8(name) | name.contains("�")


def author_tokens(author: Column) -> Column:
    """Distinct canonical creator names of length two and more, sorted."""
    parts = F.split(
        F.coalesce(trimmed(author), F.lit("")), rx.jvm(f"[<u>{fv.AUTHOR_SEPARATORS}]+")
    )
    keys = F.transform(parts, canonical_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2)))


def same_authors(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (a == b)


def edition_class(name: Column) -> Column:
    low = F.lower(without_extension(basename(name)))
    compact = F.translate(low, " _-", "")

    def hit(column, *words):
        found = column.contains(words[0])
        for word in words[1:]:
            found = found | column.contains(word)
        return found

    return (
        F.when(hit(low, "セミカラー") | hit(compact, "semicolor", "semicolour"), "semi-color")
        .when(hit(low, "フルカラー") | hit(compact, "fullcolor", "fullcolour"), "full-color")
        .when(hit(low, "モノクロ", "白黒") | hit(compact, "monochrome", "blackandwhite"), "monochrome")
        .when(hit(low, "カラー") | hit(compact, "color", "colour"), "color")
        .otherwise("standard")
    )


def legacy_folder_name(c: Column) -> Column:
    c = trimmed(c)
    for suffix in fv.LEGACY_FOLDER_SUFFIXES:
        c = trimmed(F.regexp_replace(c, rx.any_of([suffix]) + r"\z", ""))
    return c


# --- the two file name parsers ---------------------------------------------------------
def is_metadata_tag(tag: Column) -> Column:
    n = F.lower(trimmed(tag))
    return n.isin(fv.METADATA_TAGS) | (
        n.rlike(rx.any_of(fv.METADATA_TAGS)) & n.rlike(rx.any_of(fv.METADATA_TAG_COMPANIONS))
    )


def _removal_count(tail: Column, unit: str, first: str) -> Column:
    """How many passes a tail takes when each pass strips one ``first`` unit and then
    every unit of the other kind."""
    units = F.regexp_extract_all(tail, F.lit(rx.jvm(f"(?:{unit})", True)), F.lit(0))
    kinds = F.array_join(
        F.transform(units, lambda u: F.when(u.rlike(rx.jvm(f"\\A(?:{first})\\z", True)), "1").otherwise("2")), ""
    )
    return F.regexp_count(F.reverse(kinds), F.lit("12*|2+"))


def _with_name_parts(df: DataFrame, source: str) -> DataFrame:
    """Adds ``_lead``, the leading brackets, and ``_body``, the rest without a known extension; the rules read them apart."""
    df = computed_here(df, _base=without_known_extension(basename(F.col(source))))
    # A trim from the right looks at the whole text, so it is done only where the last character asks for it.
    blanks = F.lit(TRIM_CHARS)
    df = computed_here(df, _base=F.when(blanks.contains(F.right("_base", F.lit(1))), trimmed(F.col("_base"))).otherwise(F.ltrim("_base", blanks)))
    df = computed_here(df, _lead=F.regexp_extract("_base", rx.jvm(rx.LEADING_BRACKETS), 0))
    return computed_here(df, _body=F.ltrim(F.substr("_base", F.length("_lead") + 1), blanks)).drop("_base")


def _with_lead_facts(df: DataFrame) -> DataFrame:
    """``_lead`` -> struct ``_l`` (author, authors, tags): the last author and the numbers of both."""
    df = df.withColumn(
        "_tags",
        F.when(
            F.col("_lead") != "",
            F.transform(
                F.regexp_extract_all(F.col("_lead"), F.lit(rx.jvm(f"(?:{rx.BRACKET_UNITS})")), F.lit(0)),
                lambda t: trimmed(F.substr(t, F.lit(2), F.length(t) - 2)),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    df = computed_here(df, _authors=F.filter(F.col("_tags"), lambda t: ~is_metadata_tag(t)))
    facts = F.struct(
        F.coalesce(F.try_element_at("_authors", F.lit(-1)), F.lit("")).alias("author"),
        F.size("_authors").alias("authors"), F.size("_tags").alias("tags"),
    )
    return computed_here(df, _l=facts).drop("_tags", "_authors")


def _with_body_facts(df: DataFrame, existing: bool) -> DataFrame:
    """``_body`` -> struct ``_b`` (series, volume, has_volume, rule, ranged, titled, edition_passes, page_passes)."""
    space = fv.WIDE_SPACE if existing else fv.ASCII_SPACE
    vol, tail = rx.volume_vol(space), rx.volume_tail(space)
    c = lambda name: F.col(f"_b_{name}")

    def add(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.withColumns({f"_b_{k}": v for k, v in columns.items()})

    df = add(
        df,
        cut=F.when(
            F.col("_body").rlike(rx.jvm(rx.SUFFIX_LAST)), F.regexp_extract("_body", rx.jvm(rx.suffix_run(space), True), 0)
        ).otherwise(""),
    )
    df = add(df, body2=trimmed(F.left("_body", F.length("_body") - F.length(c("cut")))))
    df = add(
        df,
        page=F.when(
            c("body2").rlike(rx.jvm(rx.PAGE_LAST)), F.regexp_extract(c("body2"), rx.jvm(rx.PAGE_RUN, True), 0)
        ).otherwise(""),
    )
    df = add(df, text=trimmed(F.left(c("body2"), F.length(c("body2")) - F.length(c("page")))))

    jp = F.regexp_extract(c("text"), rx.jvm(rx.VOLUME_JP, True), 1)
    by_vol = F.regexp_extract(c("text"), rx.jvm(vol, True), 1)
    by_tail = F.regexp_extract(c("text"), rx.jvm(tail), 1)
    ranged = c("text").rlike(rx.jvm(rx.VOLUME_RANGE_TAIL, True))
    df = add(df, jp=jp)
    df = add(df, vol=F.when(c("jp") == "", by_vol).otherwise(""))
    df = add(df, tail=F.when((c("jp") == "") & (c("vol") == ""), by_tail).otherwise(""))
    single = (
        F.when(c("jp") != "", "explicit-japanese-volume")
        .when(c("vol") != "", "explicit-vol-volume")
        .when(c("tail") != "", "numeric-tail-volume")
    )
    df = add(df, rule=single, ranged=ranged if existing else (single.isNull() & ranged))
    front = (
        F.when(c("ranged"), text_before(c("text"), rx.VOLUME_RANGE_TAIL, True))
        .when(c("jp") != "", text_before(c("text"), rx.VOLUME_JP, True))
        .when(c("vol") != "", text_before(c("text"), vol, True))
        .when(c("tail") != "", text_before(c("text"), tail, False))
        .otherwise(c("text"))
    )
    title = strip_variants(tidy_series(front), space)
    df = add(df, title=title if existing else undouble(title))
    has_volume = c("rule").isNotNull() & ~c("ranged")
    edition_passes = F.when(
        c("cut") == "", 0
    ).otherwise(_removal_count(c("cut"), f"{rx.EDITION_TAIL}|{rx.variant_tail(space)}", rx.EDITION_TAIL))
    page_passes = F.when(c("page") == "", 0).otherwise(
        _removal_count(c("page"), f"{rx.PAGE_TAIL}|{rx.CHAPTER_TAIL}", rx.PAGE_TAIL)
    )
    facts = {
        "series": safe_folder_name(F.when(c("title") != "", c("title")).otherwise(c("text"))),
        "volume": F.when(has_volume, digits_value(F.concat(c("jp"), c("vol"), c("tail")))),
        "has_volume": has_volume,
        "rule": c("rule"),
        "ranged": c("ranged"),
        "titled": c("title") != "",
        "edition_passes": edition_passes,
        "page_passes": page_passes,
    }
    df = computed_here(df, _b=F.struct(*[v.alias(k) for k, v in facts.items()]))
    return df.drop(*[x for x in df.columns if x.startswith("_b_")])


def _parsed(existing: bool, reasons: bool) -> Column:
    """The struct of a name from the facts of its two parts."""
    b, lead = F.col("_b"), F.col("_l")
    score = F.lit(fv.CONFIDENCE_BASE) + F.when(lead["authors"] > 0, fv.CONFIDENCE_AUTHOR).otherwise(0.0)
    score = score + (
        F.when(b["rule"] == "explicit-japanese-volume", fv.CONFIDENCE_JAPANESE_VOLUME)
        .when(b["rule"] == "explicit-vol-volume", fv.CONFIDENCE_VOL_VOLUME)
        .when(b["rule"] == "numeric-tail-volume", fv.CONFIDENCE_TAIL_VOLUME)
        .otherwise(0.0)
    )
    score = score + F.when(b["titled"], fv.CONFIDENCE_SERIES).otherwise(-fv.CONFIDENCE_NO_SERIES)
    fields = {
        "series": b["series"],
        "author": lead["author"],
        "volume": b["volume"],
        "has_volume": b["has_volume"],
        "confidence": F.greatest(F.least(score, F.lit(fv.CONFIDENCE_MAX)), F.lit(0.0)),
    }
    if reasons:
        none = F.array().cast("array<string>")
        fields["reasons"] = F.concat(
            F.array_repeat(F.lit("metadata-prefix"), lead["tags"] - lead["authors"]),
            F.when(lead["authors"] > 0, F.array(F.lit("author-prefix"))).otherwise(none),
            none if existing else F.array_repeat(F.lit("edition-or-variant-suffix"), b["edition_passes"]),
            F.array_repeat(F.lit("trailing-page-or-chapter-metadata"), b["page_passes"]),
            F.array_compact(
                F.array(
                    b["rule"],
                    F.when(b["ranged"], F.lit("volume-range")),
                    F.when(b["titled"], F.lit("non-empty-series")),
                )
            ),
        )
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def with_parsed_name(
    df: DataFrame, source: str, out: str = "parsed", existing: bool = False, reasons: bool = False
) -> DataFrame:
    """Add struct ``out`` (series, author, volume, has_volume, confidence, reasons).

    ``existing=False`` is the rule set for fresh archives, ``existing=True`` the one for
    libraries that were named before: wide blanks count as blanks, a trailing range
    overrides a single volume, and a doubled title stays.  ``reasons=True`` adds the list of
    rules that applied.
    """
    df = _with_body_facts(_with_lead_facts(_with_name_parts(df, source)), existing)
    return computed_here(df, **{out: _parsed(existing, reasons)}).drop("_lead", "_body", "_l", "_b")


def with_parsed_listing(
    df: DataFrame, source: str, out: str = "parsed", existing: bool = False, reasons: bool = False,
    names: DataFrame | None = None,
) -> DataFrame:
    """``with_parsed_name`` for listings, in which titles and tags come again in many files: each distinct body and lead is read
    once and joined back.  ``names`` has all values of ``source``, if there is a cheaper table of them than ``df``; it may have
    more."""
    parts = _with_name_parts((df if names is None else names).select(source), source)
    parts = stored(
        parts.select(F.inline(F.array(
            F.struct(F.lit(True).alias("leads"), F.col("_lead").alias("part")), F.struct(F.lit(False).alias("leads"), F.col("_body").alias("part"))
        ))).distinct()
    )
    leads = stored(_with_lead_facts(parts.where("leads").select(F.col("part").alias("_lead"))))
    bodies = stored(_with_body_facts(spread(parts.where("NOT leads").select(F.col("part").alias("_body")), "_body"), existing))
    leads = leads.withColumnRenamed("_lead", "_lead_part")
    bodies = bodies.withColumnRenamed("_body", "_body_part")
    joined = (
        _with_name_parts(df, source)
        .join(leads, F.col("_lead").eqNullSafe(F.col("_lead_part")), "left").drop("_lead", "_lead_part")
        .join(bodies, F.col("_body").eqNullSafe(F.col("_body_part")), "left").drop("_body", "_body_part")
    )
    return joined.withColumn(out, _parsed(existing, reasons)).drop("_l", "_b")


# --- coverage -------------------------------------------------------------------------------
def range_label(unit: str, start: Column, end: Column) -> Column:
    one = F.concat(F.lit(unit + " "), start.cast("string"))
    return (
        F.when(start == 0, F.lit(""))
        .when((end == 0) | (start == end), one)
        .otherwise(F.concat(one, F.lit("–"), end.cast("string")))
    )


def with_coverage(df: DataFrame, source: str, out: str = "coverage", literal_kind: bool = True) -> DataFrame:
    """Volume and chapter coverage read from a name.

    ``literal_kind=True`` keeps the rule order in which only an explicit 巻 range sets the
    volume numbers.  ``False`` also reads ``v1-5`` ranges and single volumes.
    """
    prefix = f"_{out}_"
    c = lambda name: F.col(prefix + name)
    ranges = {"v": rx.COVERAGE_VOLUMES, "c1": rx.COVERAGE_JP_CHAPTERS, "c2": rx.COVERAGE_CHAPTERS}
    if not literal_kind:
        ranges["r"] = rx.COVERAGE_VOL_RANGE

    def number(pattern, i):
        return digits_value(F.regexp_extract(c("t"), rx.jvm(pattern, True), i))

    def pair(k):
        a, b = c(f"{k}_1"), c(f"{k}_2")
        return F.when(a.isNotNull(), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    # The numbers are computed ahead of their uses, and the end of a range is looked for only where there is a start.
    df = computed_here(df, **{prefix + "t": trimmed(F.col(source))})
    df = computed_here(
        df, **{f"{prefix}{k}_1": number(p, 1) for k, p in ranges.items()},
        **{prefix + "one": F.coalesce(number(rx.COVERAGE_JP_CHAPTER, 1), number(rx.COVERAGE_CHAPTER, 1))},
    )
    df = computed_here(df, **{f"{prefix}{k}_2": F.when(c(f"{k}_1").isNotNull(), number(p, 2)) for k, p in ranges.items()})
    df = df.withColumns({prefix + k: pair(k) for k in ("v", "c1", "c2")})
    if not literal_kind:
        df = with_parsed_name(df, source, prefix + "p")
        lone = F.when(
            c("p")["has_volume"] & c("c1").isNull() & c("c2").isNull(),
            F.struct(c("p")["volume"].alias("a"), c("p")["volume"].alias("b")),
        )
        df = df.withColumn(prefix + "v", F.coalesce(c("v"), pair("r"), lone)).drop(prefix + "p")
    # A later chapter range only counts while the chapter start is still zero.
    first = F.when(c("c1").isNotNull() & (F.coalesce(c("c1")["a"], F.lit(0)) > 0), c("c1")).otherwise(
        F.coalesce(c("c2"), c("c1"))
    )
    df = df.withColumn(prefix + "c", first)
    ranged = c("c").isNotNull()
    needs_one = (F.coalesce(c("c")["a"], F.lit(0)) == 0) & c("one").isNotNull()
    df = df.withColumns(
        {
            prefix + "vs": F.coalesce(c("v")["a"], F.lit(0)),
            prefix + "ve": F.coalesce(c("v")["b"], F.lit(0)),
            prefix + "cs": F.when(needs_one, c("one")).otherwise(F.coalesce(c("c")["a"], F.lit(0))),
            prefix + "ce": F.when(needs_one, c("one")).otherwise(F.coalesce(c("c")["b"], F.lit(0))),
        }
    )
    has_volumes = c("v").isNotNull()
    # Both chapter ranges present: the second hit turns chapter into chapter, mixed stays mixed.
    second_hit = c("c1").isNotNull() & (c("c1")["a"] == 0) & c("c2").isNotNull()
    if literal_kind:
        kind = (
            F.when(has_volumes & second_hit, "chapter")
            .when(has_volumes & ranged, "mixed")
            .when(ranged, "chapter")
            .when(has_volumes & needs_one, "mixed")
            .when(has_volumes, "volume")
            .otherwise("")
        )
    else:
        kind = (
            F.when(has_volumes & (ranged | needs_one), "mixed")
            .when(ranged | needs_one, "chapter")
            .when(has_volumes, "volume")
            .otherwise("unknown")
        )
    volumes = range_label("巻", c("vs"), c("ve"))
    chapters = range_label("話", c("cs"), c("ce"))
    df = df.withColumn(prefix + "kind", kind)
    label = (
        F.when(c("kind") == "chapter", chapters)
        .when(
            c("kind") == "mixed",
            F.array_join(
                F.array_compact(F.array(F.when(c("vs") > 0, volumes), F.when(c("cs") > 0, chapters))), " / "
            ),
        )
        .when(has_volumes, volumes)
        .otherwise("")
    )
    df = computed_here(
        df,
        **{out: F.struct(
            c("kind").alias("kind"),
            c("vs").alias("volume_start"),
            c("ve").alias("volume_end"),
            c("cs").alias("chapter_start"),
            c("ce").alias("chapter_end"),
            label.alias("label"),
        )},
    )
    return df.drop(*[x for x in df.columns if x.startswith(prefix)])


def merged_coverage(coverage: Column) -> Column:
    """Aggregate expression: one coverage struct for a group of coverage structs."""

    def low(field):
        return F.coalesce(F.min(F.when(coverage[field] > 0, coverage[field])), F.lit(0))

    def high(start, end):
        return F.coalesce(F.max(F.when(coverage[start] > 0, coverage[end])), F.lit(0))

    vs, ve = low("volume_start"), high("volume_start", "volume_end")
    cs, ce = low("chapter_start"), high("chapter_start", "chapter_end")
    kind = (
        F.when((vs > 0) & (cs > 0), "mixed").when(vs > 0, "volume").when(cs > 0, "chapter").otherwise("unknown")
    )
    label = F.array_join(
        F.array_compact(
            F.array(
                F.when(vs > 0, range_label("巻", vs, ve)), F.when(cs > 0, range_label("話", cs, ce))
            )
        ),
        " / ",
    )
    return F.struct(
        kind.alias("kind"), vs.alias("volume_start"), ve.alias("volume_end"),
        cs.alias("chapter_start"), ce.alias("chapter_end"), label.alias("label"),
    )


# --- two-name comparison ----------------------------------------------------------------------
def with_profile(df: DataFrame, source: str, out: str) -> DataFrame:
    """Adds struct ``out``: all that a comparison needs to know about a name, computed once."""
    df = computed_here(
        df, _rated=rating_split(F.col(source)), _trim=trimmed(F.col(source)), _ok=series_usable(F.col(source))
    )
    df = computed_here(
        df, _key=key_of_bare(F.col("_rated.bare")), _spin=has_spin_off(F.col("_trim")),
        _jp=has_japanese(F.col("_trim")), _latin=has_latin(F.col("_trim")),
    )
    fields = F.struct(
        F.col(source).alias("name"), F.col("_key").alias("key"), F.col("_ok").alias("usable"),
        F.col("_spin").alias("spin"), F.col("_jp").alias("jp"), F.col("_latin").alias("latin"),
        F.length("_trim").alias("chars"), F.lower("_trim").alias("low"), rating_rank(F.col("_rated")).alias("rank"),
    )
    return df.withColumn(out, fields).drop("_rated", "_trim", "_ok", "_key", "_spin", "_jp", "_latin")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; zero when either side is empty."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), 0.0).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / F.greatest(la, lb).cast("double")
    )


def close_enough(a: Column, b: Column) -> Column:
    """The minor-variation similarity, or NULL.  The length test runs before the edit distance."""
    la, lb = F.length(a), F.length(b)
    longest, gap = F.greatest(la, lb), F.abs(la - lb)
    floor = F.when((la >= 10) & (lb >= 10), 0.90).otherwise(0.94)
    possible = (la >= 8) & (lb >= 8) & (F.lit(1.0) - gap.cast("double") / longest.cast("double") >= floor)
    sim = F.when(possible, similarity(a, b))
    return F.when(sim >= floor, sim)


def is_bilingual(a: Column, b: Column) -> Column:
    """One title is the other plus the same title in the other script (profiles)."""
    a_short = F.length(a["key"]) <= F.length(b["key"])
    short, long = F.when(a_short, a).otherwise(b), F.when(a_short, b).otherwise(a)
    sk, lk = short["key"], long["key"]
    rest = F.when(F.startswith(lk, sk), F.substr(lk, F.length(sk) + 1)).when(
        F.endswith(lk, sk), F.left(lk, F.length(lk) - F.length(sk))
    )
    crossed = (short["jp"] & ~short["latin"] & has_latin(rest)) | (
        short["latin"] & ~short["jp"] & has_japanese(rest)
    )
    return F.coalesce(
        ~a["spin"] & ~b["spin"] & (F.length(sk) >= 4) & (sk != lk) & (rest != "") & crossed, F.lit(False)
    )


def is_spin_off_prefix(a: Column, b: Column) -> Column:
    a_short = F.length(a["key"]) <= F.length(b["key"])
    sk, lk = F.when(a_short, a["key"]).otherwise(b["key"]), F.when(a_short, b["key"]).otherwise(a["key"])
    long_spin = F.when(a_short, b["spin"]).otherwise(a["spin"])
    return (F.length(sk) >= 6) & (sk != lk) & F.startswith(lk, sk) & long_spin


def is_subtitle_prefix(a: Column, b: Column) -> Column:
    a_short = F.length(a["key"]) <= F.length(b["key"])
    sk, lk = F.when(a_short, a["key"]).otherwise(b["key"]), F.when(a_short, b["key"]).otherwise(a["key"])
    return (F.length(sk) >= 6) & F.startswith(lk, sk) & (F.length(lk) - F.length(sk) >= 2)


def pair_score(a: Column, b: Column) -> Column:
    """struct(score, reason) for two profiles; score 0 means different series."""

    def verdict(score, reason):
        return F.struct(score.cast("double").alias("score"), F.lit(reason).alias("reason"))

    no = verdict(F.lit(0.0), "")
    minor = close_enough(a["key"], b["key"])
    return (
        F.when(~a["usable"] | ~b["usable"], no)
        .when((a["key"] == "") | (b["key"] == ""), no)
        .when(a["key"] == b["key"], verdict(F.lit(1.0), fv.EXACT_REASON))
        .when(is_spin_off_prefix(a, b), verdict(F.lit(0.97), fv.SPIN_OFF_REASON))
        .when(is_bilingual(a, b), verdict(F.lit(0.98), fv.BILINGUAL_REASON))
        .when(a["spin"] | b["spin"], no)
        .when(minor.isNotNull(), verdict(minor, fv.MINOR_REASON))
        .otherwise(no)
    )


def display_rank(p: Column) -> Column:
    """Sort key of a profile (smaller is better) where no bilingual pair is involved: main works
    first, Japanese first, unmixed Japanese first, shorter, then lexical."""
    return F.struct(
        p["spin"].alias("spin"), (~p["jp"]).alias("not_jp"), (p["jp"] & p["latin"]).alias("mixed"),
        p["chars"].alias("chars"), p["low"].alias("low"),
    )


def is_better_display(a: Column, b: Column) -> Column:
    """True when name ``a`` is the better display form than ``b`` (profiles)."""
    return (
        F.when(a["usable"] != b["usable"], a["usable"])
        .when(~a["usable"], F.lit(False))
        .when(a["spin"] != b["spin"], ~a["spin"])
        .when((a["key"] != b["key"]) & (a["chars"] != b["chars"]) & is_bilingual(a, b), a["chars"] < b["chars"])
        .otherwise(display_rank(a) < display_rank(b))
    )


# --- destinations -------------------------------------------------------------------------------
def output_name(name: Column) -> Column:
    """Archive name after processing: RAR sets become one ZIP."""
    base = basename(name)
    stem = F.when(
        base.rlike(rx.jvm(r"\A.*\.part0*1\.rar\z", True)), F.regexp_extract(base, rx.jvm(rx.MULTIPART, True), 1)
    ).otherwise(without_extension(base))
    return F.when(extension(base) == ".rar", F.concat(stem, F.lit(".zip"))).otherwise(base)
