"""Text columns: accent folding, slugs, HTML clean-up, ordered string sets."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters of the web platform; Java's \s alone misses the no-break ones.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The same characters, for F.btrim, and as a class that turns most letters away at its first test.
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_ASCII = "\t\n\x0b\f\r"
_WS_WIDE = r"[\u00A0\u1680-\uFEFF&&[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
_WS_QUICK = r"[\x00-\x20\u00A0\u1680-\uFEFF&&[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
# ASCII word boundaries: Java's \b counts accented letters as word letters.
WB = r"(?<![A-Za-z0-9_])"
WE = r"(?![A-Za-z0-9_])"


def _fold_tables() -> tuple[str, str]:
    """Source and target alphabets of ``translate`` for canonical accent folding.

    Letters whose canonical decomposition is an ASCII letter or digit plus combining
    marks map to that base; the combining marks themselves have no target, so
    ``translate`` deletes them.
    """
    src, dst = [], []
    for cp in range(0xC0, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) < 0x370)
        if base != ch and len(base) == 1 and base.isascii() and base.isalnum():
            src.append(ch)
            dst.append(base)
    marks = "".join(chr(cp) for cp in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst)


FOLD_FROM, FOLD_TO = _fold_tables()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated and planned once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold_accents(c: Column) -> Column:
    # letters are looked up one by one, which is slow: ASCII has none to fold
    return let(c, lambda text: F.when(is_ascii(text), text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO)))


def normalize_text(c: Column) -> Column:
    """Accent-free lower-case words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def slugify(c: Column, joiner: str = "-") -> Column:
    """URL slug; the ``-`` form first deletes apostrophes."""
    base = F.lower(fold_accents(c))
    if joiner == "-":
        base = F.regexp_replace(base, "['\u2019]", "")
    return F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    # few texts hold blanks beyond ASCII; of the others only one with blanks in a row needs a pattern
    def collapsed(text: Column) -> Column:
        any_blank = F.regexp_replace(text, rf"{_WS_QUICK}{{2,}}|(?! ){_WS_QUICK}", " ")
        plain = text
        for blank in _WS_ASCII:
            plain = F.replace(plain, F.lit(blank), F.lit(" "))
        ascii_blank = let(plain, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  +", " ")).otherwise(x))
        return F.trim(F.when(~is_ascii(text) & text.rlike(_WS_WIDE), any_blank).otherwise(ascii_blank))

    return let(c, collapsed)


def not_blank(c: Column) -> Column:
    """The value, or null when empty."""
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture of the first match: null without a match, '' for an empty capture."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _decode_numeric(text: Column, pattern: str, to_hex) -> Column:
    """Replace every numeric reference matching ``pattern`` by its character.

    The text between references and the decoded characters are zipped together again.
    Code points outside Unicode, and surrogates, keep their source text.
    """

    def decode(ref: Column) -> Column:
        def from_digits(digits: Column) -> Column:
            code = F.lpad(digits, 8, "0")
            ok = (F.length(digits) <= 6) & (code <= F.lit("0010FFFF")) & ~code.between("0000D800", "0000DFFF")
            safe = F.when(ok, code).otherwise(F.lit("00000020"))
            return F.when(ok, F.decode(F.unhex(safe), "UTF-32")).otherwise(ref)

        digits = F.upper(F.regexp_replace(to_hex(F.regexp_extract(ref, pattern, 1)), "^0+(?=.)", ""))
        return let(digits, from_digits)

    glued = F.zip_with(
        F.split(text, pattern, -1),
        F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decode), F.array(F.lit(""))),
        lambda part, char: F.concat(part, char),
    )
    return F.when(text.rlike(pattern), F.array_join(glued, "")).otherwise(text)


# Named character references (target text per name), `amp` last so that
# a reference is never decoded twice.
NAMED_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")]


def decode_entities(c: Column, extra: list[tuple[str, str]] | None = None) -> Column:
    """Decode hex, decimal and named character references, in that order."""

    def decimal_to_hex(d: Column) -> Column:
        return F.when(F.length(d) <= 15, F.hex(d.try_cast("bigint"))).otherwise(F.lit("FFFFFFFF"))

    def named(text: Column) -> Column:
        for name, char in (extra or []) + NAMED_ENTITIES:
            text = F.regexp_replace(text, f"(?i)&{name};", char)
        return text

    def decoded(text: Column) -> Column:
        no_hex = _decode_numeric(text, "(?i)&#x([0-9a-f]+);", lambda d: d)
        no_numbers = let(no_hex, lambda x: _decode_numeric(x, "&#([0-9]+);", decimal_to_hex))
        return F.when(~F.contains(text, F.lit("&")), text).otherwise(
            named(F.when(F.contains(text, F.lit("&#")), no_numbers).otherwise(text))
        )

    return let(c, decoded)


def _without(c: Column, pattern: str) -> Column:
    """Tags that match ``pattern`` turned to blanks; most texts have none."""
    return let(c, lambda text: F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, pattern, " ")).otherwise(text))


def strip_tags(c: Column) -> Column:
    """Visible text of an HTML fragment; an unterminated tag swallows the rest."""
    return collapse_ws(decode_entities(_without(c, r"<[^>]*(?:>|\z)")))


def strip_closed_tags(c: Column, extra: list[tuple[str, str]] | None = None) -> Column:
    """As ``strip_tags`` but only tags with a closing ``>`` are removed."""
    return collapse_ws(decode_entities(_without(c, "<[^>]+>"), extra))


def unique_strings(arr: Column) -> Column:
    """Trimmed non-blank strings, first spelling wins, case-insensitive, order kept."""
    trimmed = F.filter(F.transform(arr, trim_ws), lambda x: F.length(x) > 0)

    def first_only(values: Column) -> Column:
        return F.filter(
            values, lambda x, i: F.array_position(F.transform(values, F.lower), F.lower(x)) == i + F.lit(1)
        )

    return let(trimmed, first_only)


def contains_term(haystack: Column, term: Column) -> Column:
    """Whole-term containment over normalised texts."""
    blank = F.lit(" ")
    return F.contains(F.concat(blank, haystack, blank), F.concat(blank, term, blank))


def _spellings(parsed, most: int) -> list[str] | None:
    """Every text a parsed pattern of plain letters, alternatives and options matches, lookarounds left out; null: too many, or another kind."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            here = [chr(value)]
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            here = [chr(c) for _, c in value]
        elif name == "BRANCH":
            parts = [_spellings(x, most) for x in value[1]]
            here = None if None in parts else [w for words in parts for w in words]
        elif name == "SUBPATTERN":
            here = _spellings(value[3], most)
        elif name == "MAX_REPEAT" and value[0] == 0 and value[1] == 1:
            inner = _spellings(value[2], most)
            here = None if inner is None else ["", *inner]
        elif name in ("ASSERT", "ASSERT_NOT"):
            here = [""]
        else:
            here = None
        if here is None or len(out) * len(here) > most:
            return None
        out = [a + b for a, b in product(out, here)]
    return out


def _by_shared_part(words: list[str], least: int = 4) -> list[tuple[str, list[str]]]:
    """``words`` in groups, each behind a part that all its words hold; a word that shares none is its own part."""
    groups, left = [], list(words)
    while left:
        parts = {w[a:b] for w in left for a in range(len(w)) for b in range(a + least, len(w) + 1)} | set(left)
        part = max(sorted(parts), key=lambda x: (sum(x in w for w in left), len(x)))
        held = [w for w in left if part in w]
        groups.append((part, held) if len(held) > 1 else (held[0], held))
        left = [w for w in left if w not in held]
    return groups


def _any_in(text: Column, words: list[str]) -> Column:
    hits = []
    for part, held in _by_shared_part(words):
        looks = reduce(or_, [F.contains(text, F.lit(w)) for w in held])
        hits.append(looks if held == [part] else F.contains(text, F.lit(part)) & looks)
    return reduce(or_, hits)


def says(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)`` for case-sensitive patterns that are mostly lists of words.

    Words are looked for as they stand, which is several times cheaper than trying a pattern at every position, and words
    that share a part only in texts that hold it; a pattern with lookarounds is still tried, but only on texts that hold
    one of its words, and between ``WB`` and ``WE`` not where one stands between blanks.
    """
    words = _spellings(re._parser.parse(pattern), 200)
    if not words or "" in words:
        return text.rlike(pattern)
    fewer = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    found = _any_in(text, fewer)
    core = pattern.removeprefix(WB).removesuffix(WE)
    if len(core) == len(pattern) - len(WB) - len(WE) and "(?" not in core.replace("(?:", "") and core.startswith("(?:"):
        return found & (_any_in(text, [f" {w} " for w in dict.fromkeys(words)]) | text.rlike(pattern))
    return found & text.rlike(pattern) if "(?<" in pattern or "(?!" in pattern or "(?=" in pattern else found


def quickly(pattern: str, least: int = 4) -> str:
    """A ``(?iu)`` pattern of plain words behind a look at the characters any of them can begin with; it matches the same texts."""
    words = _spellings(re._parser.parse(pattern), 200)
    if not words or min(map(len, words)) < least:
        return pattern
    folded = lambda x: chr(x).upper()[:1].lower()[:1]
    heads = ""
    for at in range(least):
        wanted = {folded(ord(w[at])) for w in words}
        heads += "[" + "".join(f"\\u{x:04X}" for x in range(0x10000) if not 0xD800 <= x < 0xE000 and folded(x) in wanted) + "]"
    return f"(?={heads})(?iu:{pattern.removeprefix('(?iu)')})"


def overlap_at_least(a: Column, b: Column, ratio: float) -> Column:
    """Overlap coefficient of two string sets reaches ``ratio`` (false when either is empty)."""
    smaller = F.least(F.size(a), F.size(b))
    return (smaller > 0) & (F.size(F.array_intersect(a, b)) / smaller >= F.lit(ratio))


# Words that carry no meaning in a listing title.
TITLE_STOPWORDS = [
    "venta", "alquiler", "piso", "pisos", "casa", "casas", "chalet", "apartamento", "apartamentos",
    "en", "de", "del", "la", "el", "con",
]


def title_tokens(normalized_title: Column) -> Column:
    """Distinct words of three letters or more, stopwords removed."""
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    words = F.filter(F.split(normalized_title, " "), lambda w: F.length(w) >= 3)
    return F.array_except(words, stop)


def safe_public_text(c: Column, max_length: int) -> Column:
    """Control characters dropped, trimmed, cut to the published length."""
    return F.substring(trim_ws(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), 1, max_length)
