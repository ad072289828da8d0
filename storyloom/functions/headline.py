"""Headline casing as one column expression: words are cased one by one, acronyms and small words by table, then the context rule for IT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small words that stay in lower case, acronyms in capitals, names with a casing of their own.
SMALL = "a an the and but or for nor on at to from by of in vs vs. with without into over under as per".split()
CAPITALS = (
    "ak al ai ap ar az ca co ct cte dc dei de dpi dpscd ela ell esl fl fy ga gop hi ia id il in iep isd ks ky la lausd lgbtq lgbtqia lms ma md me mi mn mo ms mt mtss naep"
    " nc nd ne nh nj nm nv nyc ny oh ok or pa pta ri rti sc sd sat sel sf stem steam tn tx us u.s u.s. ut va vt wa wi wv wy"
).split()
NAMES = {"edtech": "EdTech", "k12": "K-12", "k-12": "K-12", "mcmahon": "McMahon"}
IT_CONTEXT = r"\bIt\s+(Teams?|Departments?|Leaders?|Staff|Infrastructure|Security|Systems?|Services?|Budgets?|Directors?|Admins?|Administrators?|Operations?)\b"
_NOT = "[^A-Za-z0-9_]+"


def _known(lower: Column) -> Column:
    out = F.when(lower.isin(CAPITALS), F.upper(lower))
    for name, cased in NAMES.items():
        out = out.when(lower == name, cased)
    return out


def _capital(lower: Column) -> Column:
    return F.concat(F.upper(F.substring(lower, 1, 1)), lower.substr(F.lit(2), F.length(lower)))


def _core(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, f"^{_NOT}", ""), f"{_NOT}$", "")


def _shell(word: Column, core: Column) -> Column:
    return F.when(_core(word) == "", word).otherwise(F.concat(F.regexp_extract(word, f"^({_NOT})?", 0), core, F.regexp_extract(word, f"({_NOT})$", 0)))


def _titled(word: Column, at: Column) -> Column:
    def part(p: Column, k: Column) -> Column:
        low = F.lower(p)
        small = F.when((k == 0) & (at == 0), _capital(low)).otherwise(low)
        return F.when(low.isin(SMALL), small).otherwise(F.coalesce(_known(low), F.when(low.rlike(r"^\d+(st|nd|rd|th)$"), low).when(low.rlike(r"^\d"), F.upper(low)).otherwise(_capital(low))))

    return _shell(word, F.array_join(F.transform(F.split(_core(word), "-"), part), "-"))


def _fixed(word: Column, at: Column, before: Column) -> Column:
    def part(p: Column) -> Column:
        low, letters = F.lower(p), F.regexp_replace(p, "[^A-Za-z]", "")
        small = low.isin(SMALL) & ~F.coalesce(before.endswith(","), F.lit(False))
        known = F.when(_known(low).isNotNull(), F.when(small, F.when(at == 0, _capital(low)).otherwise(low)).otherwise(_known(low)))
        short = (F.length(letters) > 0) & (F.length(letters) <= 2) & (letters == F.upper(letters))
        return F.coalesce(known, F.when(low.rlike(r"^\d+(st|nd|rd|th)$"), low).when(low.rlike(r"^\$?\d+(\.\d+)?[kmb]$"), F.upper(low)).when(short, _capital(low)).otherwise(p))

    return _shell(word, F.array_join(F.transform(F.split(_core(word), "-"), part), "-"))


def headline(title: Column) -> Column:
    """The title in headline casing: wholly recased if its casing looks wrong, else only where acronyms and numbers are."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    w = F.split(t, " ")
    count = lambda test: F.size(F.filter(w, test)).cast("double")
    n = F.size(w).cast("double")
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z]", "")
    capitals = count(lambda x: (F.length(letters(x)) >= 3) & (letters(x) == F.upper(letters(x))))
    known = count(lambda x: _known(_core(x)).isNotNull() & (_core(x) == F.lower(_core(x))))
    wrong = (
        ~t.rlike("[A-Z]") | (count(lambda x: x.rlike("^[A-Z]")) < F.greatest(F.lit(2.0), n * 0.4)) | ((n >= 4) & (count(lambda x: _core(x).rlike("^[a-z]")) / n >= 0.4))
        | ((n >= 4) & (capitals / n >= 0.7)) | (known > 0)
    )
    cased = F.when(wrong, F.array_join(F.transform(w, _titled), " ")).otherwise(F.array_join(F.transform(w, lambda x, i: _fixed(x, i, F.get(w, i - 1))), " "))
    return F.when(t == "", t).otherwise(F.regexp_replace(cased, IT_CONTEXT, "IT $1"))


# --- the same as DuckDB text -------------------------------------------------------------------------------------------------------


def _q(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _sql_known(low: str) -> str:
    return f"CASE WHEN {low} IN ({_q(CAPITALS)}) THEN upper({low}) " + " ".join(f"WHEN {low} = '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"


def _sql_capital(low: str) -> str:
    return f"concat(upper(substr({low}, 1, 1)), substr({low}, 2))"


def _sql_core(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '^{_NOT}', ''), '{_NOT}$', '')"


def _sql_shell(w: str, core: str) -> str:
    return f"CASE WHEN {_sql_core(w)} = '' THEN {w} ELSE concat(regexp_extract({w}, '^({_NOT})?', 0), {core}, regexp_extract({w}, '({_NOT})$', 0)) END"


def sql_headline(rows: str) -> str:
    """A statement with (id, title, headline) of rows (id, title)."""
    low = "lower(p)"
    titled = f"CASE WHEN {low} IN ({_q(SMALL)}) THEN CASE WHEN k = 1 AND i = 1 THEN {_sql_capital(low)} ELSE {low} END ELSE coalesce({_sql_known(low)}, CASE WHEN regexp_matches({low}, '^\\d+(st|nd|rd|th)$') THEN {low} WHEN regexp_matches({low}, '^\\d') THEN upper({low}) ELSE {_sql_capital(low)} END) END"
    fixed = f"""coalesce(CASE WHEN ({_sql_known(low)}) IS NOT NULL THEN CASE WHEN {low} IN ({_q(SMALL)}) AND NOT coalesce(before LIKE '%,', false) THEN CASE WHEN i = 1 THEN {_sql_capital(low)} ELSE {low} END ELSE {_sql_known(low)} END END,
      CASE WHEN regexp_matches({low}, '^\\d+(st|nd|rd|th)$') THEN {low} WHEN regexp_matches({low}, '^\\$?\\d+(\\.\\d+)?[kmb]$') THEN upper({low}) WHEN length(regexp_replace(p, '[^A-Za-z]', '', 'g')) BETWEEN 1 AND 2 AND regexp_replace(p, '[^A-Za-z]', '', 'g') = upper(regexp_replace(p, '[^A-Za-z]', '', 'g')) THEN {_sql_capital(low)} ELSE p END)"""
    return f"""WITH t AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM {rows}), w AS (SELECT id, t, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM t),
    c AS (SELECT *, {_sql_core('w')} AS core, lag(w) OVER (PARTITION BY id ORDER BY i) AS before, regexp_replace(w, '[^A-Za-z]', '', 'g') AS letters FROM w),
    s AS (SELECT id, NOT regexp_matches(any_value(t), '[A-Z]') OR count(*) FILTER (WHERE regexp_matches(w, '^[A-Z]')) < greatest(2.0, count(*) * 0.4) OR (count(*) >= 4 AND count(*) FILTER (WHERE regexp_matches(core, '^[a-z]')) / count(*) >= 0.4)
      OR (count(*) >= 4 AND count(*) FILTER (WHERE length(letters) >= 3 AND letters = upper(letters)) / count(*) >= 0.7) OR count(*) FILTER (WHERE ({_sql_known('core')}) IS NOT NULL AND core = lower(core)) > 0 AS wrong FROM c GROUP BY id),
    p AS (SELECT id, i, w, before, unnest(string_split(core, '-')) AS p, generate_subscripts(string_split(core, '-'), 1) AS k FROM c),
    j AS (SELECT id, i, any_value(w) AS w, string_agg({titled}, '-' ORDER BY k) AS a, string_agg({fixed}, '-' ORDER BY k) AS b FROM p GROUP BY id, i),
    h AS (SELECT id, string_agg(CASE WHEN wrong THEN {_sql_shell('w', 'a')} ELSE {_sql_shell('w', 'b')} END, ' ' ORDER BY i) AS h FROM j JOIN s USING (id) GROUP BY id)
    SELECT t.id, regexp_replace(h, '{IT_CONTEXT}', 'IT \\1', 'g') AS headline FROM t JOIN h USING (id) WHERE t.t <> ''"""
