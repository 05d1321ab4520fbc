"""Small text helpers, all built from JVM-side expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import rx

TRIM_CHARS = "\t\n\x0b\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def trimmed(c: Column) -> Column:
    """Trim every Unicode white space (``F.trim`` alone only knows the blank)."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*\z", "")


def _after_last_dot(c: Column) -> tuple[Column, Column]:
    """Whether a name has an extension, and the text behind its dot: ``rx.EXTENSION`` without a search by pattern."""
    after = F.substring_index(c, ".", -1)
    return c.contains(".") & ~after.contains("/"), after


def extension(c: Column) -> Column:
    there, after = _after_last_dot(c)
    return F.when(there, F.lower(F.concat(F.lit("."), after))).when(~there, "")


def without_extension(c: Column) -> Column:
    there, after = _after_last_dot(c)
    return F.when(there, F.left(c, F.length(c) - F.length(after) - 1)).otherwise(c)


def without_known_extension(name: Column) -> Column:
    return F.when(extension(name).isin(fv.KNOWN_EXTENSIONS), without_extension(name)).otherwise(name)


def clean_path(c: Column) -> Column:
    """Lexical path cleaning: empty and ``.`` parts go, and each ``..`` takes back the part before it,
    however deep; at the root of an absolute path it is dropped."""
    rooted = c.startswith("/")
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")

    def step(done, part):
        return (
            F.when(part.isin("", "."), done)
            .when(part != "..", F.array_append(done, part))
            .when(F.when(F.size(done) > 0, up(done)).otherwise(False), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(rooted, done)
            .otherwise(F.array_append(done, part))
        )

    parts = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step)
    folded = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    # Most paths are clean but for a trailing slash.
    simple = F.regexp_replace(c, r"(?<=[^/])/\z", "")
    out = F.when(c.rlike(r"//|(?:\A|/)\.{1,2}(?:/|\z)"), folded).otherwise(simple)
    return F.when(out == "", F.lit(".")).otherwise(out)


def whole_number(c: Column, kind: str = "bigint") -> Column:
    """The number that a match holds, or NULL.  A failed cast raises an exception inside, so the empty text of rows without a
    match, which are most, never gets there."""
    return F.nullif(c, F.lit("")).try_cast(kind)


def digits_value(c: Column) -> Column:
    return whole_number(F.translate(c, "０１２３４５６７８９", "0123456789"), "int")


def has_japanese(c: Column) -> Column:
    return c.rlike(rx.JAPANESE_JVM)


def has_latin(c: Column) -> Column:
    return c.rlike(rx.LATIN)


def text_before(c: Column, pattern: str, ignore_case: bool) -> Column:
    """The text in front of the leftmost match."""
    return F.regexp_extract(c, rx.jvm(r"\A(.*?)(?:" + pattern + ")", ignore_case), 1)


def computed_here(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator.  Filters on them cannot be pushed below it, so
    costly expressions are evaluated once instead of once per use in every later predicate."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))
