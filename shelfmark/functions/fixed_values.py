"""Word lists, marks, patterns and limits that decide results.

Everything here is data.  Patterns are written once in a dialect-neutral form and
rendered for the JVM (``rx.jvm``) or for an RE2 engine (``rx.re2``).
"""

# --- white space ---------------------------------------------------------------
ASCII_SPACE = r"\t\n\f\r "            # what \s means in these patterns
WIDE_SPACE = r"\t\n\f\r \p{Zs}"       # plus every Unicode space separator
UNICODE_SPACE = (                     # what trimming removes
    r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
DIGIT = "0-9０-９"

# --- file name extensions ------------------------------------------------------
KNOWN_EXTENSIONS = [
    ".zip", ".rar", ".cbz", ".cbr", ".7z",
    ".jpg", ".jpeg", ".png", ".webp", ".avif", ".gif", ".bmp", ".tif", ".tiff",
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".avif", ".gif", ".bmp", ".tif", ".tiff"]
NESTED_EXTENSIONS = [".zip", ".cbz", ".rar", ".cbr"]
ARCHIVE_LIKE_EXTENSIONS = NESTED_EXTENSIONS + [".7z"]
STORED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".webp", ".avif", ".heic", ".gif", ".zip", ".rar", ".7z", ".cbz",
    ".cbr", ".pdf", ".mp3", ".mp4", ".mkv", ".gz", ".xz", ".zst",
]

# --- leading tags --------------------------------------------------------------
METADATA_TAGS = [
    "一般コミック", "コミック", "漫画", "マンガ", "manga",
    "digital", "電子版", "電子書籍", "dl版", "dl", "raw", "scan",
    "complete", "完結", "web",
]
METADATA_TAG_COMPANIONS = ["版", "comic", "コミック"]

# --- edition, variant, page and chapter tails -----------------------------------
EDITION_MARKS = "DL|電子|Digital"
EDITION_WORDS = "特装版|通常版|限定版|単行本|コミックス?"
VARIANT_WORDS = (
    "フルカラー|カラー|セミカラー|モノクロ|白黒|別スキャン|別scan|別炊|再スキャン|再scan|修正|"
    "fix(?:ed)?|番外編?|外伝|特典|おまけ|bonus|extra|単ページ|見開き(?:結合)?"
)
VOLUME_ENDINGS = "特装版|通常版|限定版|完"

# --- naming quality --------------------------------------------------------------
GENERIC_NAMES = [
    "manga", "comic", "comics", "book", "books", "image", "images", "img", "imgs",
    "page", "pages", "scan", "scans", "screenshot", "screenshots", "preview", "previews",
    "sample", "samples", "raw", "source",
    "単ページ", "見開き", "見開きページ", "ページ", "画像", "画像ファイル", "表紙", "カバー", "スクリーンショット",
]
COUNTER_TOKENS = ["volume", "vol", "chapter", "chap", "ch", "第", "巻", "卷", "話", "章"]
COUNTER_PUNCTUATION = r"\-_.()\[\]【】（）#"
GENERIC_DIRECTORIES = [
    "image", "images", "img", "imgs", "page", "pages", "scan", "scans", "jpg", "jpeg", "png", "webp",
    "book", "comic", "manga", "__macosx",
    "単ページ", "見開き", "見開きページ", "ページ", "画像", "画像ファイル", "表紙", "カバー", "スクリーンショット",
    "screenshot", "preview", "previews", "sample", "samples", "raw", "source",
]
CAMERA_PREFIXES = ["img_", "dsc_", "scan_", "page_", "p_"]
SPIN_OFF_MARKERS = [
    "外伝", "異聞", "異伝", "異譚", "前日譚", "後日譚", "列伝", "番外", "スピンオフ",
    "spin-off", "spinoff", "side story", "another story",
]
LEGACY_FOLDER_SUFFIXES = [" 単行本", "【単行本】", "[単行本]", " コミックス", "【コミックス】", "[コミックス]"]

# --- keys ------------------------------------------------------------------------
GROUP_KEY_DROPPED = " \t_-‐‑–—・.．"
CANONICAL_KEY_DROPPED = " \t　_-‐‑–—・.．·!！?？,，、()（）[]【】"
AUTHOR_SEPARATORS = "×xX＆&+/／・,，、"
TITLE_EDGE = "-–—_・. "
STARS = "⭐🌟★☆"
VARIATION_SELECTORS = "︎️"
FOLDER_LIMIT = 180

# --- confidence --------------------------------------------------------------------
CONFIDENCE_BASE = 0.45
CONFIDENCE_AUTHOR = 0.12
CONFIDENCE_JAPANESE_VOLUME = 0.30
CONFIDENCE_VOL_VOLUME = 0.27
CONFIDENCE_TAIL_VOLUME = 0.16
CONFIDENCE_SERIES = 0.10
CONFIDENCE_NO_SERIES = 0.20
CONFIDENCE_MAX = 0.99
REVIEW_BELOW = 0.72
KIND_BONUS = {"nested-archive": 0.20, "top-directory": 0.16, "named-image": 0.07}
JAPANESE_BONUS = 0.34

# --- pair scores ---------------------------------------------------------------------
UNION_AT = 0.86
EXACT_REASON = "normalized exact match"
SPIN_OFF_REASON = "explicit derivative in same series family"
BILINGUAL_REASON = "bilingual title alias"
MINOR_REASON = "minor filename variation"
SUBTITLE_REASON = "same-author title prefix/subtitle"
AUTHOR_VARIATION_REASON = "same-author title variation"

# --- limits --------------------------------------------------------------------------
MAX_DEPTH = 8
MAX_NESTED_ARCHIVES = 1024
MAX_ENTRIES = 250_000
MAX_EXPANDED_BYTES = 128 * 1024**3
MIB = 1024 * 1024
THROTTLE_BYTES = 256 * MIB
RETENTION_DAYS = 14
PAGE_ROWS = 200
MAX_ROOTS = 32
