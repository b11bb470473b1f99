"""Scalar text functions as column expressions: normalisation, tokens, keys, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of article and annex numbers, and what names are compared without.
ARTICLE = r"제\s*(\d+)\s*(?:-\s*(\d+))?\s*조(?:\s*의\s*(\d+))?"
ANNEX = r"\[?\s*(별표|별지|서식|첨부)\s*(?:제)?\s*0*(\d+)\s*(?:의\s*(\d+))?\s*(?:호)?\s*\]?"
ANNEX_KINDS = "별표|별지|서식|첨부"
NAME_NOISE = r"(?U)[\s_·ㆍ・.,()\[\]{}<>「」『』/\\-]"


def unicode_strip(text: Column) -> Column:
    """Strips all Unicode white space; ``trim`` takes U+0020 alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_key(name: Column) -> Column:
    """A name without white space and punctuation, for comparing names."""
    return F.regexp_replace(name, NAME_NOISE, "")


def safe_file_name(name: Column) -> Column:
    return F.trim(F.translate(name, '\\/:*?"<>|', "_________"))


def lines(text: Column) -> Column:
    """Lines by every Unicode line break, without the empty rest after a last break."""
    parts = F.split(text, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(runs: Column) -> Column:
    """Character bigrams of each run; runs of one character stay. ``sequence`` would count down below one."""
    return F.flatten(F.transform(runs, lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substring(w, i, F.lit(2))))))


def latin_bigram_tokens(text: Column) -> Column:
    """Numbers whole, runs of letters as bigrams."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)), bigrams(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))))


def groups_of(text: Column, pattern: str, names: str) -> Column:
    """All matches as structs of the pattern's groups, by one-letter names; absent groups are empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def prefixed(prefix: str, value: Column) -> Column:
    """``prefix`` and value, or nothing for an empty value."""
    return F.when(value == "", "").otherwise(F.concat(F.lit(prefix), value))


def padded(number: Column, width: int = 4) -> Column:
    """Zeros in front, up to ``width`` digits; longer numbers stay whole."""
    return F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)


def article_tokens(text: Column) -> Column:
    """A token for each article number; one with a part or a branch comes with the article that it belongs to."""
    whole = lambda p: F.concat(F.lit("조"), p["a"], prefixed("-", p["b"]), prefixed("의", p["c"]))
    plain = lambda p: F.concat(F.lit("조"), p["a"])
    return F.flatten(F.transform(groups_of(text, ARTICLE, "abc"), lambda p: F.when((p["b"] == "") & (p["c"] == ""), F.array(plain(p))).otherwise(F.array(whole(p), plain(p)))))


def annex_tokens(text: Column) -> Column:
    """The kind, the kind with its number, and the number padded to four digits: queries and keys write it either way."""
    branch = lambda p: prefixed("의", p["c"])
    return F.flatten(F.transform(groups_of(text, ANNEX, "kac"), lambda p: F.array(p["k"], F.concat(p["k"], p["a"], branch(p)), F.concat(p["k"], padded(p["a"]), branch(p)))))


def korean_tokens(text: Column) -> Column:
    """Article and annex numbers first and taken out, then annex kinds without a number, ASCII words, Hangul bigrams."""
    rest = F.regexp_replace(F.regexp_replace(text, ARTICLE, " "), ANNEX, " ")
    bare = F.regexp_replace(rest, ANNEX_KINDS, " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))
    kinds = F.regexp_extract_all(rest, F.lit(ANNEX_KINDS), F.lit(0))
    return F.concat(article_tokens(text), annex_tokens(text), kinds, words, bigrams(F.regexp_extract_all(bare, F.lit("[가-힣]+"), F.lit(0))))


def iso_date(digits: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD; null unless eight digits."""
    return F.when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def version_key(*parts: Column) -> Column:
    """Parts joined by ``|``; an absent part is empty, not skipped."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def truncated(text: Column, most: int, note: str = "\n…({n} more)") -> Column:
    """At most ``most`` characters and a note of how many were left out; 0 keeps all."""
    if not most:
        return text
    before, after = note.split("{n}")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(before), (F.length(text) - most).cast("string"), F.lit(after))).otherwise(text)


def snippet(text: Column, query: str, lead: int = 60, width: int = 240) -> tuple[Column, Column]:
    """What stands around the first exact match, and the match's place (0: only another case matched)."""
    at = F.instr(text, query)
    return F.substring(text, F.greatest(F.lit(1), at - lead), F.lit(width)), at


def html_to_text(html: Column) -> Column:
    """Block tags to line breaks, other tags dropped, common entities decoded, blanks collapsed, empty lines dropped."""
    text = F.regexp_replace(html, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def canonical_hash(*columns: Column) -> Column:
    """sha256 of a JSON object of the columns, as given; nulls are kept. Name order is the caller's."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def shares_or_empty(values: Column, wanted: Column) -> Column:
    """The set filter in which a row without values passes."""
    return (F.coalesce(F.size(values), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(values, wanted), F.lit(False))


def names_any(name: Column, parts: list[str]) -> Column:
    """Whether a name has any of the parts, white space aside on both sides; without parts every name does."""
    plain = F.regexp_replace(name, r"\s", "")
    wanted = ["".join(p.split()) for p in parts]
    return F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(plain, p)) if wanted else F.lit(True)


def index_text(title: Column, number: Column, content: Column) -> Column:
    """What is indexed of a section; an absent part is empty and leaves no word behind."""
    return F.concat(*[x for c in (title, number, content) for x in (F.coalesce(c, F.lit("")), F.lit(" "))][:-1])


def present(text: Column, literal: str) -> Column:
    """Whether a text has a literal, white space aside."""
    return F.contains(F.regexp_replace(text, r"\s", ""), F.lit("".join(literal.split())))


def compared(text: Column) -> Column:
    """A text as it is compared: without marks of amendment in brackets, white space and quotes."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|\[[^\]]*\]", ""), "[\\s\"']", "")
