"""Citations of statutes as column expressions: names by alias, names carried on from before, keys of articles and annexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARTICLE, groups_of, padded, prefixed, unicode_strip

# Forms in a basis, and what a later part takes over from the statute before it.
ANNEX_REF = r"(별표|별지|서식)\s*(?:제\s*)?0*(\d+)(?:\s*(?:호\s*의|[-의])\s*(\d+))?"
ISSUER = r"^(?:공정위|금융위|금감원|협회|은행연합회|동)\s*[「'\"]?\s*"
QUOTES = r"[「」『』'\"]"
INHERIT = {"시행령": " 시행령", "시행규칙": " 시행규칙", "감독규정": None, "세부지침": " 세부지침", "시행세칙": " 시행세칙", "동법": ""}
INHERIT_TO = {
    ("금융소비자 보호에 관한 법률", "감독규정"): "금융소비자 보호에 관한 감독규정",
    ("금융소비자 보호에 관한 법률 시행령", "감독규정"): "금융소비자 보호에 관한 감독규정",
}
OWN_SUFFIX = r"\s*(시행령|시행규칙|시행세칙|세부지침)$"


def article_keys(text: Column) -> Column:
    """The key of each article that a text names, blanks out: one candidate each."""
    return F.transform(groups_of(text, ARTICLE, "abc"), lambda p: F.array(F.concat(F.lit("제"), p["a"], prefixed("-", p["b"]), F.lit("조"), prefixed("의", p["c"]))))


def annex_keys(text: Column) -> Column:
    """Candidates of each annex, the likelier first: with four digits, then as it is written; a branch may be missing in the sources."""
    key = lambda p, number, branch: F.concat(F.lit("["), p["k"], F.lit(" "), number, branch, F.lit("]"))
    none = F.lit("")
    both = lambda p, branch: F.array(key(p, padded(p["a"]), branch), key(p, p["a"], branch))
    return F.transform(groups_of(text, ANNEX_REF, "kac"), lambda p: F.when(p["c"] == "", both(p, none)).otherwise(F.concat(both(p, prefixed("의", p["c"])), both(p, none))))


def statute_name(part: Column, before: Column, aliases: dict[str, str]) -> Column:
    """The name a part of a citation speaks of: by the longest alias it begins with, taken over from ``before``, or null."""
    said = F.regexp_replace(F.regexp_replace(unicode_strip(part), ISSUER, ""), QUOTES, "")
    name = F.lit(None).cast("string")
    for token, suffix in reversed(INHERIT.items()):
        taken = before if suffix is None else F.trim(F.concat(F.regexp_replace(before, OWN_SUFFIX, ""), F.lit(suffix)))
        for (old, kind), new in INHERIT_TO.items():
            if kind == token:
                taken = F.when(before == old, new).otherwise(taken)
        name = F.when(F.startswith(said, F.lit(token)) & before.isNotNull(), taken).otherwise(name)
    for alias in sorted(aliases, key=lambda a: (len(a), a)):
        name = F.when(F.startswith(said, F.lit(alias)), aliases[alias]).otherwise(name)
    return name


def parsed_basis(text: Column, aliases: dict[str, str]) -> Column:
    """array<struct<name, keys>>, each once: parts between commas and semicolons, a part without a name has the one before.

    ``keys`` are the candidates of one article or annex, the likelier first; null where the whole statute is meant.
    """
    kind = "array<struct<name:string,keys:array<string>>>"
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), unicode_strip), lambda p: ~p.isin("", "-"))

    def step(a: Column, part: Column) -> Column:
        name = F.coalesce(statute_name(part, a["before"], aliases), a["before"])
        keys = F.concat(article_keys(part), annex_keys(part))
        refs = F.when(F.size(keys) == 0, F.array(F.struct(name.alias("name"), F.lit(None).cast("array<string>").alias("keys")))).otherwise(F.transform(keys, lambda k: F.struct(name.alias("name"), k.alias("keys"))))
        return F.struct(name.alias("before"), F.when(name.isNull(), a["refs"]).otherwise(F.concat(a["refs"], refs.cast(kind))).alias("refs"))

    start = F.struct(F.lit(None).cast("string").alias("before"), F.array().cast(kind).alias("refs"))
    return F.array_distinct(F.aggregate(parts, start, step, lambda a: a["refs"]))
