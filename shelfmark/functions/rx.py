"""Pattern rendering: one neutral pattern text, two regex dialects.

Neutral patterns use ``<s>`` for ASCII white space inside a class, ``<w>`` for wide
white space, ``<u>`` for trim white space, ``<d>`` for digits and ``<b>`` for an ASCII
word boundary.  RE2 has an ASCII ``\\b``; the JVM's is Unicode-aware, so it is spelled
out with look-arounds there.
"""

from shelfmark.functions import fixed_values as fv

_ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _fill(pattern: str) -> str:
    return (
        pattern.replace("<s>", fv.ASCII_SPACE)
        .replace("<w>", fv.WIDE_SPACE)
        .replace("<u>", fv.UNICODE_SPACE)
        .replace("<d>", fv.DIGIT)
    )


def jvm(pattern: str, ignore_case: bool = False) -> str:
    flags = "(?siu)" if ignore_case else "(?s)"
    return flags + _fill(pattern).replace("<b>", _ASCII_BOUNDARY)


def re2(pattern: str, ignore_case: bool = False) -> str:
    flags = "(?si)" if ignore_case else "(?s)"
    return flags + _fill(pattern).replace("<b>", r"\b")


def any_of(words) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


# --- shared patterns (neutral form) ------------------------------------------------
EXTENSION = r"\.[^./]*\z"
BRACKET_UNITS = (
    r"\[[<u>]*[^\]<u>][^\]]*\]|【[<u>]*[^】<u>][^】]*】|"
    r"（[<u>]*[^）<u>][^）]*）|\([<u>]*[^)<u>][^)]*\)"
)
LEADING_BRACKETS = r"\A(?:[<u>]*(?:" + BRACKET_UNITS + r"))+"

EDITION_TAIL = (
    r"[<s>]*(?:\[[^\]]*(?:" + fv.EDITION_MARKS + r")[^\]]*\]|\([^\)]*(?:" + fv.EDITION_MARKS
    + r")[^\)]*\)|(?:" + fv.EDITION_WORDS + r"))[<s>]*"
)


def variant_tail(space: str) -> str:
    bracket = (
        f"[{space}]*[\\[【（(][{space}]*(?:{fv.VARIANT_WORDS})(?:版)?[{space}]*[\\]】）)][{space}]*"
    )
    plain = f"[{space}_\\-]+(?:{fv.VARIANT_WORDS})(?:[{space}]*版)?[{space}]*"
    return f"(?:{bracket}|{plain})"


def variant_run(space: str) -> str:
    return f"(?:{variant_tail(space)}[<u>]*)+\\z"


def suffix_run(space: str) -> str:
    """A whole run of edition and variant tails, so that one match replaces a loop."""
    return f"(?:(?:{EDITION_TAIL}|{variant_tail(space)})[<u>]*)+\\z"


# A run can only end in one of these; testing the last character first spares the search.
SUFFIX_LAST = r"[\]】）)版本スクーロ黒ンnN炊正xXdD外編伝典けsSaAジき合][<u>]*\z"
PAGE_LAST = r"[<d>\]】）)話][<u>]*\z"

PAGE_TAIL = (
    r"(?:[<s>]*[-_]?[<s>]*)(?:p|pg|page)[<s>]*0*[<d>]{1,6}"
    r"(?:[<s>]*[\[【（(][^\]】）)]{1,80}[\]】）)])?[<s>]*"
)
CHAPTER_TAIL = (
    r"[<s>_\-]+(?:(?:ch(?:apter)?\.?|chap\.?)[<s>]*[<d>]{1,5}|第[<s>]*[<d>]{1,5}[<s>]*話)[<s>]*"
)
PAGE_RUN = f"(?:(?:{PAGE_TAIL}|{CHAPTER_TAIL})[<u>]*)+\\z"

VOLUME_JP = r"[<s>]*第[<s>]*([<d>]{1,4})[<s>]*(?:巻|卷)"
# Fixed pattern: the marks of a range in its class.
VOLUME_RANGE_TAIL = (
    r"(?:[<s>]|\A)(?:第[<s>]*)?(?:vol(?:ume)?\.?[<s>]*|v[<s>]*)?[<d>]{1,4}[<s>]*[-~～〜－][<s>]*[<d>]{1,4}"
    r"[<s>]*(?:巻|卷)?(?:[a-z](?:[0-9]+)?)?[<s>]*\z"
)


def volume_vol(space: str) -> str:
    return (
        f"(?:\\A|[{space}_\\-])(?:vol(?:ume)?\\.?|v)[{space}]*([<d>]{{1,4}})"
        r"(?:[a-z](?:[0-9]+)?)?(?:<b>|\z)"
    )


def volume_tail(space: str) -> str:
    return (
        f"(?:\\A|[{space}_\\-])([<d>]{{1,3}})(?:[{space}]*(?:巻|卷))?"
        f"(?:[{space}]*(?:{fv.VOLUME_ENDINGS}))?[{space}]*\\z"
    )


_DASH = "[-~〜～－ー–—]"
COVERAGE_VOLUMES = (
    r"第?[<s>]*([<d>]{1,4})[<s>]*(?:巻|卷)?[<s>]*" + _DASH + r"[<s>]*第?[<s>]*([<d>]{1,4})[<s>]*(?:巻|卷)"
)
COVERAGE_VOL_RANGE = (
    r"(?:vol(?:ume)?\.?|v)?[<s>]*([<d>]{1,4})[<s>]*" + _DASH
    + r"[<s>]*(?:vol(?:ume)?\.?|v)?[<s>]*([<d>]{1,4})(?:[<s>]*(?:巻|卷)|<b>)"
)
COVERAGE_JP_CHAPTERS = (
    r"第?[<s>]*([<d>]{1,5})[<s>]*(?:話|章)[<s>]*" + _DASH + r"[<s>]*第?[<s>]*([<d>]{1,5})[<s>]*(?:話|章)"
)
COVERAGE_CHAPTERS = (
    r"(?:ch(?:apter)?\.?|c)[<s>]*([<d>]{1,5})[<s>]*" + _DASH + r"[<s>]*(?:ch(?:apter)?\.?|c)?[<s>]*([<d>]{1,5})"
)
COVERAGE_JP_CHAPTER = r"第[<s>]*([<d>]{1,5})[<s>]*(?:話|章)"
COVERAGE_CHAPTER = r"(?:\A|[<s>_\-])(?:ch(?:apter)?\.?|c)[<s>]*([<d>]{1,5})(?:<b>|\z)"

_UNIT = r"(?:第[<s>]*)?(?:(?:vol(?:ume)?\.?|v|ch(?:apter)?\.?|chap\.?|c)[<s>]*)?"
OUTPUT_RANGE_TAIL = (
    r"[<s>_\-]+" + _UNIT + r"[<d>]{1,5}(?:[<s>]*(?:巻|卷|話|章))?[<s>]*" + _DASH + r"[<s>]*"
    + _UNIT + r"[<d>]{1,5}[<s>]*(?:巻|卷|話|章)?[<s>]*\z"
)
MULTIPART = r"\A(.*)\.part([0-9]+)\.rar\z"
JAPANESE_JVM = r"[\p{IsHiragana}\p{IsKatakana}\x{3400}-\x{9FFF}]"
JAPANESE_RE2 = r"[\p{Hiragana}\p{Katakana}\x{3400}-\x{9FFF}]"
LATIN = r"[a-zA-ZＡ-Ｚａ-ｚ]"
