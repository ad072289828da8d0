"""Column functions on texts, and the same rules as SQL text where another engine has to follow them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L


def normal(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(normal(c), " "), lambda w: w != "")


def distinct_first(tokens: Column, most: int) -> Column:
    return F.slice(F.array_distinct(tokens), 1, most)


def story_key(title: Column, stopwords: list[str] = L.STOPWORDS) -> Column:
    """The first eight distinct tokens of more than two letters that are no stopwords, sorted and joined."""
    kept = F.filter(words(title), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))
    return F.array_join(F.array_sort(distinct_first(kept, 8)), "-")


def family(domain: Column) -> Column:
    """The publisher of a domain: an alias, or the registrable domain."""
    d = F.regexp_replace(F.lower(F.trim(domain)), "^www\\.", "")
    parts = F.split(d, "\\.")
    multi = F.lit(False)
    for suffix in L.MULTIPART_SUFFIXES:
        multi = multi | d.endswith("." + suffix)
    base = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    longer = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")
    out = F.when(multi, longer).otherwise(base)
    for site, name in L.FAMILY_ALIASES.items():
        out = F.when((d == site) | d.endswith("." + site), name).otherwise(out)
    return F.when(F.length(d) > 0, out)


def hits(text: Column, terms: list[str], most: int = 3) -> Column:
    """How many of the terms the text contains, as substrings, up to a limit."""
    lowered = F.lower(text)
    total = F.lit(0)
    for t in terms:
        total = total + F.coalesce(lowered.contains(t), F.lit(False)).cast("int")
    return F.least(total, F.lit(most))


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether the text has one of the terms between characters other than a-z and 0-9."""
    if not terms:
        return F.lit(False)
    body = "|".join(t.replace(".", "\\.").replace(" ", "\\s+") for t in terms)
    return F.coalesce(F.lower(text).rlike(f"(^|[^a-z0-9])({body})($|[^a-z0-9])"), F.lit(False))


# --- the same as SQL text ----------------------------------------------------------------------------------------------------------


def q(terms: list[str]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def sql_words(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


def sql_distinct_first(tokens: str, most: int) -> str:
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i)[1:{most}]"


def sql_hits(text: str, terms: list[str], most: int = 3) -> str:
    return "least(" + " + ".join(f"CAST(contains(lower({text}), {q([t])}) AS INT)" for t in terms) + f", {most})"


def sql_has_term(text: str, terms: list[str]) -> str:
    body = "|".join(t.replace(".", "\\.").replace(" ", "\\s+").replace("'", "''") for t in terms)
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9])({body})($|[^a-z0-9])')"
