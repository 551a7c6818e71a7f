"""Text normalisation and word matching as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split() treats as white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NON_ASCII = r"[^\x00-\x7f]"
# Runs of ASCII white space that are not a single blank already.
ASCII_RUNS = r"[\x09-\x0d\x1c-\x1f][\x09-\x0d\x1c-\x20]*| [\x09-\x0d\x1c-\x20]+"
_HANGUL = range(0xAC00, 0xD7A4)
_CODE_POINTS = range(0x80, 0x30000)


def _folded(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char.casefold())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Case folding and compatibility decomposition, per code point, from the Unicode database.

    Returns the two strings of a ``translate`` (characters folding to nothing come last, with
    no counterpart) and the characters that fold to several characters.
    """
    single, dropped, several = dict.fromkeys("\x85\u1680\u2028\u2029", " "), [], {}
    for upper, lower in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"):
        single[upper] = lower
    for code in _CODE_POINTS:
        if code in _HANGUL or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        target = _folded(char)
        if target == char:
            continue
        if not target:
            dropped.append(char)
        elif len(target) == 1:
            single[char] = target
        else:
            several[char] = target
    return "".join(single) + "".join(dropped), "".join(single.values()), several


def _char_class(chars) -> str:
    """Regex class of the given characters as code point ranges."""
    codes = sorted(map(ord, chars))
    ranges, start = [], None
    for i, code in enumerate(codes):
        if start is None:
            start = code
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code:x}}}")
            start = None
    return "[" + "".join(ranges) + "]"


def text_map(table: dict[str, str]) -> Column:
    """Constant map column; one literal that Catalyst folds, whatever the number of entries."""
    flat = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(flat), F.lit("\x01"), F.lit("\x02"))


def _expand(text: Column, source: str, target: str, several: dict[str, str]) -> Column:
    """Fold character by character; only reached by rows with characters that fold to several."""
    table = text_map(several)
    lead = "".join(chr(0x1100 + i) for i in range(19))
    vowel = "".join(chr(0x1161 + i) for i in range(21))
    tail = "".join(chr(0x11A8 + i) for i in range(27))

    def one(c: Column) -> Column:
        i = F.ascii(c) - F.lit(0xAC00)
        syllable = F.concat(
            F.substring(F.lit(lead), F.floor(i / 588).cast("int") + 1, 1),
            F.substring(F.lit(vowel), F.floor((i % 588) / 28).cast("int") + 1, 1),
            F.when(i % 28 > 0, F.substring(F.lit(tail), (i % 28).cast("int"), 1)).otherwise(""),
        )
        return (
            F.when(c < F.lit("\x80"), F.lower(c))
            .when((c >= F.lit(chr(0xAC00))) & (c <= F.lit(chr(0xD7A3))), syllable)
            .otherwise(F.coalesce(table[c], F.translate(c, source, target)))
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def squeeze(text: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip_space(text: Column) -> Column:
    """Trim what Python's str.strip() trims."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def match_groups(text: Column, pattern: str, groups: int) -> Column:
    """All groups of the pattern's first match, in one pass; those that took no part are empty, null where nothing matches.

    For groups that hold no control characters.
    """
    found = F.regexp_replace(text, f"^(?s:.*?){pattern}(?s:.*)$", "\x01".join(f"${i}" for i in range(1, groups + 1)))
    return F.when(F.rlike(text, F.lit(pattern)), F.split(found, "\x01"))


@lru_cache(maxsize=1)
def _common_tables() -> tuple[dict[str, str], str]:
    """Frequent characters to replace up front, and the class of what is then safe to translate.

    Only characters whose expansion is final may be replaced first. The class covers the Latin
    and punctuation blocks in a handful of ranges, so testing a text against it is cheap.
    """
    source, _, several = _fold_tables()
    affected = set(source) | set(several)
    common = {c: several[c] for c in "ßẞ…½¼¾ﬁﬂ" if c in several and not affected & set(several[c])}
    blocks = [*range(0x80), *range(0xA0, 0x250), *range(0x2000, 0x2070), 0x20AC]
    safe = [chr(c) for c in blocks if chr(c) not in several]
    return common, "[^" + _char_class(safe)[1:]


def normalized(text: Column) -> Column:
    """Case-folded, compatibility-decomposed text without marks and with single blanks.

    ASCII rows, the bulk, take a ``lower`` only; the rest one ``translate``; the few rows
    with ligatures, fractions or Hangul a per-character expansion.
    """
    source, target, several = _fold_tables()
    common, unsafe = _common_tables()
    rare = _char_class(set(several) | {chr(c) for c in _HANGUL})
    plain = text
    for char, expansion in common.items():
        plain = F.replace(plain, F.lit(char), F.lit(expansion))
    needs_expansion = F.rlike(plain, F.lit(unsafe)) & F.rlike(plain, F.lit(rare))
    runs = F.lit(ASCII_RUNS)
    return (
        F.when(~F.rlike(text, F.lit(NON_ASCII)), F.trim(F.regexp_replace(F.lower(text), runs, F.lit(" "))))
        .when(needs_expansion, squeeze(_expand(text, source, target, several)))
        .otherwise(F.trim(F.regexp_replace(F.translate(plain, source, target), runs, F.lit(" "))))
    )


def matches_tokens(searchable: Column, tokens: list[str]) -> Column:
    """Every token equals a word of the normalised text, or (3+ characters) starts one.

    Words are separated by single blanks, so one pattern with a look-ahead per token decides
    it: the text is normalised once and never split into words.
    """
    def ahead(token: str) -> str:
        quoted = re.sub(r"([^0-9a-z ])", r"\\\1", " " + token)
        return f"(?=.*{quoted})" if len(token) >= 3 else f"(?=.*{quoted} )"

    padded = F.concat(F.lit(" "), searchable, F.lit(" "))
    return F.rlike(padded, F.lit("(?s)^" + "".join(map(ahead, tokens))))


def normalized_literal(text: str) -> str:
    """The same normalisation for a driver-side argument."""
    return " ".join("".join(_folded(c) for c in text).split())


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    digits = {
        chr(c): str(unicodedata.decimal(chr(c)))
        for c in _CODE_POINTS
        if not 0xD800 <= c <= 0xDFFF and unicodedata.decimal(chr(c), None) is not None
    }
    return "".join(digits), "".join(digits.values())


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    source, target = _digit_tables()
    return F.when(F.rlike(text, F.lit(NON_ASCII)), F.translate(text, source, target)).otherwise(text)


@lru_cache(maxsize=1)
def _money_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose NFKC form consists of characters a price may hold, and all digits."""
    allowed = set("0123456789.,€ ")
    single, several = dict(zip(*_digit_tables())), {}
    for code in _CODE_POINTS:
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        target = unicodedata.normalize("NFKC", char)
        if target != char and set(target) <= allowed:
            (single if len(target) == 1 else several)[char] = target
    return "".join(single), "".join(single.values()), several


def price_text(text: Column) -> Column:
    """NFKC restricted to what can occur in a price, digits in ASCII, trimmed."""
    source, target, several = _money_tables()
    table = text_map(several)
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], F.translate(c, source, target))), ""
    )
    return (
        F.when(~F.rlike(text, F.lit(NON_ASCII)), F.trim(text))
        .when(F.rlike(text, F.lit(_char_class(several))), strip_space(expanded))
        .otherwise(strip_space(F.translate(text, source, target)))
    )


_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# The longest name that is also read without its semicolon.
_OPEN_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST_OPEN = max(map(len, _OPEN_NAMES))


def _windows_1252() -> dict[str, str]:
    """Numbers 128-159 are read as that code page; those it leaves open are controls."""
    return {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _numbered(code: Column) -> Column:
    """Character of a number; the replacement character for what is none, nothing for non-characters and most controls."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 31) & ~code.isin(9, 10, 12, 13) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 65534)
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(code.between(0x80, 0x9F), text_map(_windows_1252())[code.cast("string")])
            .when(control, "").otherwise(plain))


def _reference(token: Column) -> Column:
    """One character reference decoded; unknown names stay as they are, known beginnings are decoded."""
    name = F.substring(token, F.lit(2), F.length(token))
    closed = text_map({k.removesuffix(";"): v for k, v in html5.items() if k.endswith(";")})
    opened, tail = text_map(_OPEN_NAMES), F.lit(None).cast("string")
    for n in range(2, _LONGEST_OPEN + 1):
        # The longest known beginning is tried last and so wins.
        known = opened[F.when(F.length(name) >= n, F.left(name, F.lit(n))).otherwise("")]
        tail = F.when(known.isNotNull(), F.concat(known, F.substring(name, F.lit(n + 1), F.length(name)))).otherwise(tail)
    digits = F.rtrim(name, F.lit(";"))
    code = F.when(F.lower(F.left(digits, F.lit(2))) == "#x", F.conv(F.right(digits, F.length(digits) - 2), 16, 10)).otherwise(F.right(digits, F.length(digits) - 1))
    number = F.coalesce(code.try_cast("decimal(38,0)"), F.lit(0x110000).cast("decimal(38,0)"))
    number = F.least(number, F.lit(0x110000).cast("decimal(38,0)")).cast("int")
    whole = F.when(F.endswith(name, F.lit(";")), closed[F.rtrim(name, F.lit(";"))])
    return F.when(F.startswith(name, F.lit("#")), _numbered(number)).otherwise(F.coalesce(whole, tail, token))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


# Frequent references whose characters end a reference and start none: as no other can come about, they are replaced wherever they stand.
_FREQUENT = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'", "&nbsp;": "\xa0"}
# Names tried before the list of all names, which is gone through from its start.
_NAMES_FIRST = ("amp", "apos", "euro", "agrave", "egrave", "eacute", "igrave", "ograve", "ugrave", "Agrave", "Egrave", "ndash", "mdash", "rsquo", "lsquo",
                "ldquo", "rdquo", "hellip", "deg", "middot", "bull", "laquo", "raquo", "copy", "reg", "trade", "times")


def unescape(text: Column) -> Column:
    """Decode every named and numbered character reference, in one pass."""
    first = text_map({f"&{name};": html5[f"{name};"] for name in _NAMES_FIRST})

    def one(token: Column) -> Column:
        return F.when(F.startswith(token, F.lit("&")), F.coalesce(first[token], F.when(F.rlike(token, F.lit("^" + _REFERENCE)), _reference(token)), token)).otherwise(token)

    def tokens(rest: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(f"(?s){_REFERENCE}|&|[^&]+"), F.lit(0)), one), "")

    def decoded(whole: Column) -> Column:
        plain = whole
        for reference, char in _FREQUENT.items():
            plain = F.replace(plain, F.lit(reference), F.lit(char))
        return bound(plain, lambda rest: F.when(F.contains(rest, F.lit("&")), tokens(rest)).otherwise(rest))

    return bound(text, lambda whole: F.when(F.contains(whole, F.lit("&")), decoded(whole)).otherwise(whole))


def markup_text(html: Column) -> Column:
    """Text of a markup fragment with white space collapsed."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", " ")
    return squeeze(unescape(F.regexp_replace(plain, "(?s)<[^>]*>", " ")))
