"""Scalar text functions over columns. Patterns spell out what differs between regex dialects (white space, word borders,
end of input), so results don't depend on the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the web defines it; use inside a character class. Single characters are one bit set, and a range before the others
#: decides for most characters, so that a character costs three tests and not ten.
WS = r"\t\n\x0b\f\r \xa0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
#: The same characters themselves.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word borders

# Words before a full stop that end no sentence.
ABBREVIATIONS = (
    "et al", "fig", "figs", "eq", "eqs", "vol", "no", "e.g", "i.e", "vs", "dr", "prof", "mr", "mrs", "ms", "inc", "ltd", "jr", "sr", "dept", "approx",
    "est", "ref", "refs", "sect", "ch", "pp",
)
# Block types, and those of them that are translated.
BLOCK_TYPES = ("title", "author", "heading", "subheading", "paragraph", "quote", "reference", "image", "caption", "formula", "table", "drop")
TRANSLATABLE = ("title", "heading", "subheading", "paragraph", "quote", "caption", "table")
# Openings of lines that are no content; institution words of an author line.
DROP_STARTS = ("downloaded from", "copyright ©", "all rights reserved", "reuse guidelines", "supplementary material", "view publication stats", "terms and conditions")
INSTITUTIONS = ("university", "institute", "department", "college", "school")
# Connectors, author name and year of a narrative citation.
CONNECTORS = ("Though", "Although", "While", "Whereas")
AUTHOR = r"(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+|(?:van|von|de|del|da)\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+)"
YEAR = r"(?:18|19|20)[0-9]{2}[a-z]?"
CLOSERS = "[\"”’')\\]]*"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def blank_to_null(c: Column) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


# FLT-01, FLT-02
def is_translatable(block_type: Column) -> Column:
    return block_type.isin(*TRANSLATABLE)


def is_pending(block_type: Column, translation: Column, status: Column) -> Column:
    return is_translatable(block_type) & ((F.coalesce(translation, F.lit("")) == "") | F.coalesce(status == "failed", F.lit(False)))


# FLT-03
def is_lookup_candidate(c: Column) -> Column:
    return js_trim(c).rlike(r"^[A-Za-z]+(?:['’][A-Za-z]+)*(?:-[A-Za-z]+)*\z")


# FLT-04
def context_level(selected: Column) -> Column:
    """1 word, 2 sentence, 3 paragraph."""
    t = js_trim(selected)
    words = F.size(F.split(t, rf"[{WS}]+"))
    ends = F.regexp_count(t, F.lit(rf"[.?!][{WS}]")) + F.when(t.rlike(r"[.?!]\z"), 1).otherwise(0)
    return F.when((t == "") | (words <= 3), 1).when(ends >= 2, 3).otherwise(2)


# FLT-09 … FLT-12
def is_markdown_table(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: x != "")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return F.coalesce((F.size(lines) >= 2) & first.contains("|") & second.rlike(rf"^[{WS}]*\|?[{WS}]*:?-{{3,}}") & second.contains("|"), F.lit(False))


def is_formula(c: Column) -> Column:
    t = js_trim(c)
    return t.rlike(r"(?s)^(\$\$.*\$\$|\\\[.*\\\])\z") & (js_length(t) > 4)


def is_author_line(c: Column) -> Column:
    words = F.split(c, rf"[{WS}]+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'’-]+,?\z")))
    named = c.rlike(rf"(?i){LEFT}({'|'.join(INSTITUTIONS)}){RIGHT}")
    plain = (F.size(words) >= 2) & (F.size(words) <= 20) & (capital >= F.ceil(F.size(words) / 2))
    return (js_length(c) <= 240) & ~c.rlike(rf"[.!?][{WS}]*\z") & (named | plain)


def is_dropped_line(c: Column) -> Column:
    return js_trim(c).rlike(rf"(?iu)^({'|'.join(DROP_STARTS)})")


def is_caption_line(c: Column) -> Column:
    return js_trim(c).rlike(rf"(?i)^(fig(?:ure)?\.?|table)[{WS}]+[0-9]+[.:{WS}]")


# FLT-13 … FLT-15: the patterns step over white space at the ends, so that no trimmed copy of a text is made for each
def starts_lowercase(c: Column) -> Column:
    return c.rlike(rf"^[{WS}]*[\"“‘'(\[]*[a-zà-öø-ÿ]")


def ends_sentence(c: Column) -> Column:
    return c.rlike(rf"[.!?]{CLOSERS}[{WS}]*\z")


def is_incomplete(c: Column) -> Column:
    return ~c.rlike(rf"^[{WS}]*\z") & ~ends_sentence(c)


def is_float_label(block_type: Column, c: Column) -> Column:
    return block_type.isin("heading", "subheading") & js_trim(c).rlike(rf"(?i)^(?:table|fig(?:ure)?)[ .:]?[{WS}]*[0-9]+")


# FLT-16 … FLT-19. The markers and placeholders these patterns spell out.
_EMPHASIS = rf"(?:(?:\*\*|__|`)[{WS}]*)?"
_TYPES = "|".join(BLOCK_TYPES)


def _has_sign(c: Column) -> Column:
    """Whether a text holds what stands after TYPE in every marker."""
    return F.contains(c, F.lit(":")) | F.contains(c, F.lit("=")) | F.contains(c, F.lit("：")) | F.contains(c, F.lit("＝"))


def leaks_protocol(c: Column) -> Column:
    marker = rf"{_EMPHASIS}(?:[\[【(（][{WS}]*)?TYPE[{WS}]*[:=：＝][{WS}]*[A-Za-z_-]+[{WS}]*(?:[\]】)）][{WS}]*)?{_EMPHASIS}(?:\r?\n|\z)"
    return (F.contains(c, F.lit("@@")) | _has_sign(c)) & c.rlike(rf"(?i)(?:^|\r?\n)[{WS}]*(?:{marker}|@@[A-Za-z0-9_-]+[{WS}]*(?:\r?\n|\z))")


def has_untranslated_connector(c: Column, language: Column) -> Column:
    s = rf"[{WS}]+"
    author = AUTHOR.replace(r"\s+", s)
    pattern = rf"(?iu)(?:^|[.!?。！？]{CLOSERS}[{WS}]*)(?:{'|'.join(CONNECTORS)}){s}{author}(?:{s}et al\.|{s}(?:and|&){s}{author})?[{WS}]*\({YEAR}\)"
    return ~language.rlike(r"(?i)^en(?:-|\z)") & F.contains(c, F.lit("(")) & c.rlike(pattern)


def has_placeholder(c: Column) -> Column:
    return c.rlike(r"⟦(?:CIT|URL|DOI|MATH|CODE)_[0-9]+⟧")


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(True))


# FN-01
def split_sentences(text: Column) -> Column:
    """Sentences of a text: a white-space token that ends in .?! closes one, unless it is an abbreviation (alone or with the
    word before it), or is or holds a decimal number. The text is cut after every token that ends so, whatever the gap
    to the next, and pieces that don't close are joined to the next ones again."""
    gap, solid = f"[{WS}]", f"[^{WS}]"
    quoted = "|".join(a.replace(".", r"\.").replace(" ", f"{gap}++") for a in ABBREVIATIONS)
    ending = rf"(?<!{solid})(?i:{quoted})\.?[.?!]\z"  # one or two words, taken from the start of a token
    decimal = rf"(?<!{solid})(?:{solid}*?[0-9]\.[0-9]{solid}*+|[0-9]++\.[0-9]*+[?!]?)\z"
    closes = lambda p: p.rlike(r"[.?!]\z") & ~p.rlike(ending) & ~p.rlike(decimal)

    def joined(pieces: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: (i == F.size(pieces)) | closes(F.get(pieces, i - 1)))
        first = lambda e, k: F.when(k == 0, 1).otherwise(F.get(e, k - 1) + 1)
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda at, k: js_trim(F.array_join(F.slice(pieces, first(e, k), at - first(e, k) + 1), ""))))[0]

    cut = F.split(text, rf"(?<=[.?!])(?={gap})")
    return F.filter(F.transform(F.array(cut), joined)[0], lambda p: p != "")


# FN-02, FN-03, FN-04, FN-05
def clean_escapes(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, r"\\([_~`*\[\]#\\])", "$1"))


_IMAGE = rf"(?s)^!\[([^\]]*)\]\(([^)]+)\)[{WS}]*(.*)\z"


def image_parts(c: Column) -> Column:
    part = lambda i: js_trim(F.regexp_extract(c, _IMAGE, i))
    return F.when(c.rlike(_IMAGE), F.struct(part(1).alias("alt"), F.regexp_replace(part(2), r"^<|>\z", "").alias("src"), part(3).alias("trailing")))


def split_references(c: Column) -> Column:
    return F.transform(F.split(c, r"\n(?=[A-Z][A-Za-z0-9_'’.-]+,)"), js_trim)


def join_text(a: Column, b: Column) -> Column:
    gap = F.when(a.rlike(rf"[{WS}]\z") | b.rlike(rf"^[{WS}]"), F.lit("")).otherwise(F.lit(" "))
    return js_trim(F.concat(a, gap, b))


# FN-11
def sanitize(c: Column) -> Column:
    """Up to four rounds of stripping a leading type marker, then trim."""
    bracketed = rf"(?i)^[{WS}]*{_EMPHASIS}[\[【(（][{WS}]*TYPE[{WS}]*[:=：＝][{WS}]*(?:{_TYPES})[{WS}]*[\]】)）][{WS}]*{_EMPHASIS}"
    bare = rf"(?i)^[{WS}]*{_EMPHASIS}TYPE[{WS}]*[:=：＝][{WS}]*(?:{_TYPES})[{WS}]*{_EMPHASIS}(?:(?:\r?\n)+|\z)"
    clean = c
    for _ in range(4):
        clean = F.regexp_replace(F.regexp_replace(clean, bracketed, ""), bare, "")
    return js_trim(F.when(_has_sign(c), clean).otherwise(c))


# FN-14, FN-15
def escape_html(c: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def inline_markdown(c: Column) -> Column:
    """Escaped, then sup, sub, code, strong (two forms), em and line breaks, in this order."""
    steps = (
        (r"\$\^\{([^{}\n]+)\}\$", "<sup>$1</sup>"), (r"\$_\{([^{}\n]+)\}\$", "<sub>$1</sub>"), (r"`([^`\n]+)`", "<code>$1</code>"),
        (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"__([^_\n]+)__", "<strong>$1</strong>"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "<em>$1</em>"), ("\n", "<br>"),
    )
    c = escape_html(c)
    for pattern, shown in steps:
        c = F.regexp_replace(c, pattern, shown)
    return c


# What stands for a removed key or token, the ending and stand-in of output names.
KEY_MASK, TOKEN_MASK = "<redacted-api-key>", "<redacted-token>"
OUTPUT_SUFFIX, OUTPUT_NAME = "（双语）.html", "paper"


# FN-21, SNK-09. The shapes of keys and tokens, and the characters a file name can't hold.
def redact(c: Column) -> Column:
    c = F.regexp_replace(c, rf"{LEFT}sk-[A-Za-z0-9_-]{{8,}}(?:(?<=[A-Za-z0-9_]){RIGHT}|(?<=-)(?=[A-Za-z0-9_]))", KEY_MASK)
    part = r"[A-Za-z0-9_-]{20,}"
    return F.regexp_replace(c, rf"{LEFT}eyJ{part}\.{part}\.{part}(?<=[A-Za-z0-9_]){RIGHT}", TOKEN_MASK)


def safe_filename(title: Column, suffix: str = OUTPUT_SUFFIX, fallback: str = OUTPUT_NAME, most: int = 140) -> Column:
    c = F.regexp_replace(title, r'[\x00-\x1f<>:"/\\|?*]', "_")
    c = F.substring(js_trim(F.regexp_replace(c, rf"[{WS}]+", " ")), 1, most)
    return F.concat(F.when(F.coalesce(c, F.lit("")) == "", F.lit(fallback)).otherwise(c), F.lit(suffix))


def safe_directory(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


# FN-26, FN-27, FN-28, PRJ-07, PRJ-08, PRJ-09, SRC-14, SRC-18
def split_response(c: Column, level: Column) -> Column:
    parts = F.split(c, "---")
    cut = F.struct(js_trim(F.get(parts, F.lit(0))).alias("translation"), blank_to_null(F.get(parts, F.lit(1))).alias("analysis"))
    return F.when(level == 1, F.struct(js_trim(c).alias("translation"), F.lit(None).cast("string").alias("analysis"))).otherwise(cut)


def first_filled(*choices: Column, default: str = "") -> Column:
    return F.coalesce(*[blank_to_null(c) for c in choices], F.lit(default))


def clamp(c: Column, least: int | None = None, most: int | None = None) -> Column:
    c = c if least is None else F.greatest(c, F.lit(least))
    return c if most is None else F.least(c, F.lit(most))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)\z", 1))


# Media types by extension.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp"}


def media_type(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("application/octet-stream")
    for k, v in MEDIA.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def fingerprint(key: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws(":", key, size.cast("string"), mtime.cast("string"))


# Language names shown in prompts.
LANGUAGES = {"zh-CN": "简体中文", "zh-TW": "繁體中文", "en": "English", "ja": "日本語"}


def language_name(c: Column) -> Column:
    out = c
    for k, v in LANGUAGES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def with_title(text: Column, title: Column) -> Column:
    """Markdown of a full text: "# title" goes before it unless the title's first 40 characters already open it."""
    t = js_trim(title)
    window = F.greatest(F.lit(500), F.length(t) * 3)
    shown = F.instr(F.lower(F.substring(text, F.lit(1), window)), F.lower(F.substring(t, 1, 40))) > 0
    return F.when((F.coalesce(t, F.lit("")) == "") | shown, text).otherwise(F.concat(F.lit("# "), t, F.lit("\n\n"), text))


def parser_kind(choice: Column, token: Column) -> Column:
    return F.when(choice != "auto", choice).when(blank_to_null(token).isNotNull(), F.lit("remote")).otherwise(F.lit("fulltext"))


def parser_language(c: Column) -> Column:
    return F.when(c.rlike("(?i)^zh"), F.lit("ch")).otherwise(F.lit("en"))
