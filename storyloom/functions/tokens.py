"""Tokens of titles and texts in three dialects, as columns and as SQL text: for merging, for what is displayed, for coverage.

All lower-case, stem, and drop stopwords; they differ in how they split, in their stems' exceptions, canonical forms, aliases and caps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.functions.text import q, sql_distinct_first, sql_words, words


def _suffix1(x: Column, careful: bool = False) -> Column:
    n = F.length(x)
    es, s = x.endswith("es") & (n > 4), x.endswith("s") & (n > 3)
    if careful:
        es, s = es & ~x.endswith("ves"), s & ~x.endswith("is")
    return F.when(x.endswith("ies") & (n > 4), F.concat(x.substr(F.lit(1), n - 3), F.lit("y"))).when(es, x.substr(F.lit(1), n - 2)).when(s, x.substr(F.lit(1), n - 1)).otherwise(x)


def _suffix2(x: Column) -> Column:
    n = F.length(x)
    return F.when(x.endswith("ing") & (n > 5), x.substr(F.lit(1), n - 3)).when(x.endswith("ed") & (n > 4), x.substr(F.lit(1), n - 2)).otherwise(x)


def _canonical(x: Column, forms: dict[str, str]) -> Column:
    out = None
    for name, listed in forms.items():
        out = F.when(x.isin(listed.split()), name) if out is None else out.when(x.isin(listed.split()), name)
    return out


def canonical_name(word: str, forms: dict[str, str]) -> str:
    """The canonical form of a word of a table: the same rule as for a column's words."""
    names = {form: name for name, listed in reversed(forms.items()) for form in listed.split()}
    w = "".join(c for c in word.lower() if c.isascii() and c.isalnum())
    stem = f"{w[:-3]}y" if w.endswith("ies") and len(w) > 4 else w[:-2] if w.endswith("es") and len(w) > 4 else w[:-1] if w.endswith("s") and len(w) > 3 else w
    stem = stem[:-3] if stem.endswith("ing") and len(stem) > 5 else stem[:-2] if stem.endswith("ed") and len(stem) > 4 else stem
    return names.get(w) or names.get(stem) or stem


def _with_aliases(x: Column, aliases: dict[str, list[str]], forms: dict[str, str]) -> Column:
    out = F.array(x)
    for token, names in aliases.items():
        out = F.when(x == token, F.array(x, *(F.lit(canonical_name(n, forms)) for n in names))).otherwise(out)
    return out


def canonical_token(word: Column, forms: dict[str, str] = L.CANONICAL_FORMS) -> Column:
    """A word's canonical form: that of the word, else that of its stem, else the stem."""
    w = F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
    return F.coalesce(_canonical(w, forms), _canonical(_suffix2(_suffix1(w)), forms), _suffix2(_suffix1(w)))


def sql_canonical_token(w: str, forms: dict[str, str] = L.CANONICAL_FORMS) -> str:
    return f"coalesce({_canon_sql(w, forms)}, {_canon_sql('(' + stem_sql(w) + ')', forms)}, {stem_sql(w)})"


def _tokens(raw: Column, forms: dict[str, str], aliases: dict[str, list[str]]) -> Column:
    steps = F.transform(F.transform(raw, lambda x: F.struct(x.alias("w"), _suffix1(x).alias("s"))), lambda x: F.coalesce(_canonical(x["w"], forms), _canonical(_suffix2(x["s"]), forms), _suffix2(x["s"])))
    return F.flatten(F.transform(steps, lambda x: _with_aliases(x, aliases, forms)))


def merge_tokens(title: Column, most: int = 24, stopwords: list[str] = L.STOPWORDS, aliases: dict = L.TOKEN_ALIASES) -> Column:
    """Canonical, stemmed, alias-expanded, distinct tokens of a title, the first `most`."""
    expanded = _tokens(words(title), L.CANONICAL_FORMS, aliases)
    return F.slice(F.array_distinct(F.filter(expanded, lambda x: (F.length(x) >= 3) & ~x.isin(stopwords))), 1, most)


def topic_tokens(title: Column, most: int = 18, stopwords: list[str] = L.TOPIC_STOPWORDS, aliases: dict = L.TOKEN_ALIASES) -> Column:
    """The same for display: words are what stands between spaces, without signs; numbers of two digits count."""
    raw = F.filter(F.transform(F.split(title, r"\s+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")), lambda x: x != "")
    expanded = _tokens(raw, L.TOPIC_FORMS, aliases)
    return F.slice(F.array_distinct(F.filter(expanded, lambda x: ((F.length(x) >= 3) | x.rlike("^[0-9]{2,}$")) & ~x.isin(stopwords))), 1, most)


def coverage_tokens(text: Column, stopwords: list[str] = L.COVERAGE_STOPWORDS) -> Column:
    """Distinct stemmed tokens of a whole text."""
    raw = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    stems = F.transform(F.transform(raw, lambda x: _suffix1(x, True)), _suffix2)
    return F.array_distinct(F.filter(stems, lambda x: (F.length(x) >= 3) & ~x.isin(stopwords)))


def search_query(title: Column) -> Column:
    """The first eight coverage tokens of a title, as words to search for."""
    return F.array_join(F.slice(coverage_tokens(title), 1, 8), " ")


# --- the same as SQL text ----------------------------------------------------------------------------------------------------------


def stem_sql(x: str, careful: bool = False) -> str:
    """The stem of an SQL expression."""
    es = f" AND {x} NOT LIKE '%ves'" if careful else ""
    s = f" AND {x} NOT LIKE '%is'" if careful else ""
    one = f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN concat(substr({x}, 1, length({x}) - 3), 'y') WHEN {x} LIKE '%es' AND length({x}) > 4{es} THEN substr({x}, 1, length({x}) - 2) WHEN {x} LIKE '%s' AND length({x}) > 3{s} THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"
    y = f"({one})"
    return f"CASE WHEN {y} LIKE '%ing' AND length({y}) > 5 THEN substr({y}, 1, length({y}) - 3) WHEN {y} LIKE '%ed' AND length({y}) > 4 THEN substr({y}, 1, length({y}) - 2) ELSE {y} END"


def _canon_sql(x: str, forms: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({q(listed.split())}) THEN '{name}'" for name, listed in forms.items()) + " END"


def _tokens_sql(raw: str, forms: dict[str, str]) -> str:
    inner = f"list_transform({raw}, lambda w: coalesce({_canon_sql('w', forms)}, {_canon_sql('(' + stem_sql('w') + ')', forms)}, {stem_sql('w')}))"
    alias = "list_concat([w], CASE " + " ".join(f"WHEN w = '{k}' THEN [{q([canonical_name(n, forms) for n in v])}]" for k, v in L.TOKEN_ALIASES.items()) + " ELSE [] END)"
    return f"flatten(list_transform({inner}, lambda w: {alias}))"


def sql_merge_tokens(title: str, most: int = 24) -> tuple[str, int]:
    """All tokens with repeats, and how many distinct ones count; see sql_distinct_first."""
    return f"list_filter({_tokens_sql(sql_words(title), L.CANONICAL_FORMS)}, lambda w: length(w) >= 3 AND w NOT IN ({q(L.STOPWORDS)}))", most


def sql_topic_tokens(title: str, most: int = 18) -> tuple[str, int]:
    raw = f"list_filter(list_transform(regexp_split_to_array({title}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: w <> '')"
    return f"list_filter({_tokens_sql(raw, L.TOPIC_FORMS)}, lambda w: (length(w) >= 3 OR regexp_matches(w, '^[0-9]{{2,}}$')) AND w NOT IN ({q(L.TOPIC_STOPWORDS)}))", most


def sql_coverage_tokens(text: str) -> str:
    raw = f"regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+')"
    return f"list_distinct(list_filter(list_transform({raw}, lambda w: {stem_sql('w', True)}), lambda w: length(w) >= 3 AND w NOT IN ({q(L.COVERAGE_STOPWORDS)})))"


def sql_first(tokens: tuple[str, int], name: str = "raw") -> str:
    return sql_distinct_first(name, tokens[1])
