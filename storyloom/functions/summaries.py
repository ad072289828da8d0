"""Cleaning of summaries and summaries made from titles, as column expressions with SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. A summary is cut at the first of these, in this order, that it contains.
JUNK = ["sign up", "subscribe", "newsletter", "republish", "become a", "sponsor", "donate", "support( our)? journalism", "advertis", "getty images", "base64", "streamlinehq", "share on", "follow us", "facebook|twitter|instagram|linkedin"]
TAILS = [r"\bthe post\b.{0,240}?\bappeared first on\b.*$", r"\bthis article (was )?originally (appeared|published) on\b.*$", r"\boriginally published (on|at)\b.*$"]
REPEATS = [r"(\bcontact\b.*){2,}", r"(\bdownloads?\b.*){2,}", r"(\bshare\b.*){3,}"]
#: Words in lower case of which a text must have one for a pattern of JUNK, TAILS, REPEATS or MARKUP to match: looking for them is many
#: times cheaper than trying the pattern on a whole text, and what has none of them is left alone.
_JUNK_WORDS = [["sign up"], ["subscribe"], ["newsletter"], ["republish"], ["become a"], ["sponsor"], ["donate"], ["journalism"], ["advertis"], ["getty images"], ["base64"], ["streamlinehq"], ["share on"], ["follow us"], ["facebook", "twitter", "instagram", "linkedin"]]
_TAIL_WORDS = [["appeared first on"], ["this article"], ["originally published"]]
_REPEAT_WORDS = [["contact"], ["download"], ["share"]]
#: What each of the junk and tail words holds. A search compares at every place with the first letter, so these begin with a rare one.
_JUNK_PARTS = ["gn up", "bscribe", "wsletter", "publish", "become a", "ponsor", "donate", "journalism", "vertis", "getty images", "base64", "linehq", "hare on", "follow us", "facebook", "witter", "agram", "kedin"]
_TAIL_PARTS = ["peared first on", "his article", "publish"]
#: All but a-z, 0-9 and the space, and the same without any white space, by ranges: the negated class takes many times as long in Java.
_NO_WORD, _NO_NEAR = r"[\x00-\x1F!-/:-`{-\x{10FFFF}]", r"[\x00-\x08\x0E-\x1F!-/:-`{-\x{10FFFF}]"
_MARKUP_SIGNS = [["!["], ["]("], ["<"], ["://"], ["@"]]
#: Image and link markup, addresses: (pattern, what stays: nothing or the link's text).
MARKUP = [(r"!\[[^\]]*\]\(<?[^)\s>]+>?\)", False), (r"\[([^\]]+)\]\(<?[^)\s>]+>?\)", True), (r"<[^>]*>", False), (r"https?://\S+", False), (r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", False)]
LONGEST, SHORTEST = 320, 40
#: What makes a stored summary one that any new one replaces.
STORED_JUNK = ["(sign up|subscribe|newsletter|republish|sponsor|advertis|getty images|base64|streamlinehq|share on|follow us|facebook|twitter|instagram|linkedin)", r"!\[[^\]]*\]\(", "(contact.*contact|downloads?.*downloads?|share.*share.*share)"]

#: Openings and reasons by topic; the first topic that the title hits, then a variant by the title's hash.
OPENINGS = [
    ("budget|funding|tax|bond|spending|deficit", ["Budget coverage now centers on {}.", "New finance reporting highlights {}.", "District budget attention is shifting toward {}."]),
    ("lawsuit|court|bill|policy|ban|federal|state", ["Policy coverage is focused on {}.", "Legal and policy reporting now centers on {}.", "New governance reporting highlights {}."]),
    ("teacher|students|curriculum|classroom|literacy|math|attendance", ["Education reporting is focused on {}.", "Classroom-focused coverage now highlights {}.", "New school reporting points to {}."]),
    ("", ["New coverage highlights {}.", "Recent reporting points to {}.", "Districts are now tracking {}."]),
]
REASONS = [
    ("budget|funding|million|bond|tax|finance|deficit|spending", ["Budget decisions can directly affect staffing levels, programs, and student services.", "Funding shifts often change staffing plans, program availability, and district priorities.", "School finance changes can quickly impact classrooms and student support capacity."]),
    ("court|lawsuit|judge|bill|legislation|policy|ban|federal|state|compliance|board", ["Policy and legal changes can quickly reshape district rules and day-to-day school operations.", "New legal or policy decisions can force rapid district-level implementation changes.", "Governance shifts here may alter how schools operate in the near term."]),
    ("cellphone|phone|technology|ai|edtech|software|device|cybersecurity|data", ["Districts may need to update classroom expectations, training, and implementation plans.", "Technology decisions here can affect instruction, policy enforcement, and staff training.", "Schools may need clearer implementation plans and communication with educators and families."]),
    ("literacy|math|reading|curriculum|instruction|attendance|discipline|special education", ["Classroom practice and student outcomes can shift as districts adopt new approaches.", "Instructional changes here can affect day-to-day teaching and student progress.", "District response may influence curriculum choices, classroom routines, and supports."]),
    ("", ["District leaders and educators may need to adjust policy, staffing, or classroom practice.", "School systems may need to revisit planning, staffing, or implementation decisions.", "This could influence district priorities and how schools execute day-to-day operations."]),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the trees of nested rules would else repeat it at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _squeezed(c: Column) -> Column:
    # Single spaces are no match, so nothing is copied for them. One class comes first, as a choice of two is tried at every character.
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f](?:(?<! )|(?=[ \t\r\n\f]))[ \t\r\n\f]*", " "))


def _has(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def _matches(t: Column, low: Column, words: list[str], pattern: str) -> Column:
    """Whether the pattern matches t, tried only where low (t in lower case) has one of the words."""
    return _has(low, words) & t.rlike(pattern)


def _without_markup(t: Column, markup: list, signs: list) -> Column:
    without = lambda pattern, stays, words: lambda t: F.when(_has(t, words), F.regexp_replace(t, f"(?i){pattern}", "$1" if stays else " ")).otherwise(t)
    for (pattern, stays), words in zip(markup, signs, strict=True):
        t = let(t, without(pattern, stays, words))
    return t


def _without_tails(t: Column) -> Column:
    """t, squeezed, without trailing boilerplate."""
    out = t
    for pattern in TAILS:
        out = F.regexp_replace(out, f"(?is){pattern}", " ")
    return F.when(_has(F.lower(t), [w for words in _TAIL_WORDS for w in words]), _squeezed(out)).otherwise(t)


def _words(low: Column) -> Column:
    """The words of a text in lower case between spaces, of letters and digits only."""
    return F.array_remove(F.split(F.regexp_replace(low, _NO_WORD, ""), " "), "")


def _dull(w: Column) -> Column:
    return (F.size(w) >= 16) & (F.size(F.array_distinct(w)) / F.size(w) < 0.55)


def sanitized(c: Column) -> Column:
    """The summary without markup, addresses and trailing boilerplate, cut at junk; empty if it repeats itself or is short; 320 at most."""
    t = _without_markup(F.coalesce(c, F.lit("")), MARKUP, _MARKUP_SIGNS)
    cleaned = lambda t: let(_without_tails(t), lambda t: let(let(F.lower(t), lambda low: _cut(t, low)), lambda t: let(F.lower(t), lambda low: _checked(t, low))))
    return let(_squeezed(t), lambda t: let(F.lower(t), lambda low: F.when(_has(low, _JUNK_PARTS + _TAIL_PARTS), cleaned(t)).otherwise(_checked(t, low))))


def _cut(t: Column, low: Column) -> Column:
    """The text up to the first junk, in the list's order. low is t in lower case."""
    out = None
    for p, words in zip(JUNK, _JUNK_WORDS, strict=True):
        hit, rest = _matches(t, low, words, f"(?i){p}"), F.trim(F.split(t, f"(?i){p}")[0])
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return out.otherwise(t)


def _repeats(t: Column, low: Column, flags: str) -> Column:
    return reduce(lambda a, b: a | b, (_matches(t, low, words, f"(?{flags}){p}") for p, words in zip(REPEATS, _REPEAT_WORDS, strict=True)))


def _checked(t: Column, low: Column) -> Column:
    bad = (F.length(t) < SHORTEST) | _repeats(t, low, "is") | let(_words(low), _dull)
    return F.when(bad, "").when(F.length(t) > LONGEST, F.concat(F.trim(F.substring(t, 1, LONGEST)), F.lit("…"))).otherwise(t)


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _sql_squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"


def sql_sanitized(rows: str, keep: str) -> str:
    """Common table expressions that end in s: rows (id, summary, keep) with the summary sanitized and t, what it was before the tests."""
    t = "coalesce(summary, '')"
    for pattern, stays in MARKUP:
        t = f"regexp_replace({t}, {_lit('(?i)' + pattern)}, '{chr(92) + '1' if stays else ' '}', 'g')"
    tails = _sql_squeezed(t)
    for pattern in TAILS:
        tails = f"regexp_replace({tails}, {_lit('(?is)' + pattern)}, ' ', 'g')"
    cut = "CASE " + " ".join(f"WHEN regexp_matches(t0, {_lit('(?i)' + p)}) THEN trim(regexp_split_to_array(t0, {_lit('(?i)' + p)})[1], ' ')" for p in JUNK) + " ELSE t0 END"
    bad = " OR ".join(f"regexp_matches(t, {_lit('(?is)' + p)})" for p in REPEATS)
    return f"""WITH s0 AS (SELECT {keep}, {_sql_squeezed(tails)} AS t0 FROM {rows}), s1 AS (SELECT {keep}, {cut} AS t FROM s0),
    s2 AS (SELECT *, list_filter(list_transform(string_split(lower(t), ' '), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS w FROM s1),
    s AS (SELECT *, CASE WHEN {bad} OR (len(w) >= 16 AND len(list_distinct(w)) / len(w) < 0.55) OR length(t) < {SHORTEST} THEN '' WHEN length(t) > {LONGEST} THEN concat(trim(substr(t, 1, {LONGEST}), ' '), '…') ELSE t END AS summary FROM s2)"""


#: What is not displayed. Terms anywhere, templates at the start, generic reasons at the end.
DISCARDED = ["sign up", "subscribe", "newsletter", "republish", "sponsor", "advertis", "getty images", "base64-image-removed"]
TEMPLATES = [
    r"^(coverage|reporting)\s+(is\s+)?(converging on|focused on|centered on|now centers on)\b", r"^(new coverage highlights|recent reporting points to|new reporting points to|districts are now tracking)\b",
    r"^(budget coverage now centers on|new (finance|budget) reporting highlights|district budget attention is shifting toward)\b", r"^(policy coverage is focused on|legal and policy reporting now centers on|new governance reporting highlights)\b",
    r"^(education reporting is focused on|classroom-focused coverage now highlights|new school reporting points to)\b",
]
GENERIC_REASON = r"\bwhy it matters:\s*(district leaders and educators may need to adjust policy,\s*staffing,\s*or classroom practice\.?|school systems may need to revisit planning,\s*staffing,\s*or implementation decisions\.?|this could influence district priorities and how schools execute day-to-day operations\.?)$"
_DISPLAYED_MARKUP = [MARKUP[0], MARKUP[1], ("<base64-image-removed>", False), *MARKUP[3:]]
#: What one of the templates begins with, in lower case.
_OPENS = ["coverage", "reporting", "new ", "recent ", "districts ", "budget ", "district ", "policy ", "legal ", "education ", "classroom-"]
#: What each of the terms, and a generic reason, holds.
_HIDDEN_PARTS = ["gn up", "bscribe", "wsletter", "publish", "ponsor", "vertis", "getty images", "base64", "why it matters:"]
_HIDDEN = "|".join([*(t.replace("-", "\\-") for t in DISCARDED), *TEMPLATES, GENERIC_REASON])


def _opens(low: Column) -> Column:
    # A template's words may stand between other white space than spaces.
    return reduce(lambda a, b: a | b, (low.startswith(w.strip()) for w in _OPENS))


def display_summary(c: Column) -> Column:
    """A summary fit for display: without markup, addresses and trailing boilerplate; null if it is short, junk, a template or repeats
    itself; 320 characters at most."""
    t = _without_markup(F.coalesce(c, F.lit("")), _DISPLAYED_MARKUP, _MARKUP_SIGNS)
    cleaned = lambda t: let(_without_tails(t), lambda t: let(F.lower(t), lambda low: _displayed(t, low)))
    return let(_squeezed(t), lambda t: let(F.lower(t), lambda low: F.when(_has(low, _TAIL_PARTS), cleaned(t)).otherwise(_displayed(t, low))))


def _displayed(t: Column, low: Column) -> Column:
    hidden = (_has(low, _HIDDEN_PARTS) | _opens(low)) & t.rlike(f"(?i){_HIDDEN}")
    bad = (F.size(F.split(t, " ")) < 8) | hidden | _repeats(t, low, "i") | let(_words(low), _dull)
    return F.when(~bad, F.when(F.length(t) > LONGEST, F.concat(F.trim(F.substring(t, 1, LONGEST)), F.lit("…"))).otherwise(t))


def sql_display(rows: str) -> str:
    """Common table expressions that end in dz (id, kind, clean) for rows (id, kind, raw)."""
    t = "coalesce(raw, '')"
    for pattern, stays in _DISPLAYED_MARKUP:
        t = f"regexp_replace({t}, {_lit('(?i)' + pattern)}, '{chr(92) + '1' if stays else ' '}', 'g')"
    tails = _sql_squeezed(t)
    for pattern in TAILS:
        tails = f"regexp_replace({tails}, {_lit('(?is)' + pattern)}, ' ', 'g')"
    bad = " OR ".join([f"regexp_matches(t, {_lit('(?i)' + _HIDDEN)})", *(f"regexp_matches(t, {_lit('(?i)' + p)})" for p in REPEATS)])
    return f"""dx AS (SELECT id, kind, {_sql_squeezed(tails)} AS t FROM {rows}), dy AS (SELECT *, list_filter(list_transform(string_split(lower(t), ' '), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS w FROM dx),
    dz AS (SELECT id, kind, CASE WHEN NOT ({bad} OR len(string_split(t, ' ')) < 8 OR (len(w) >= 16 AND len(list_distinct(w)) / len(w) < 0.55)) THEN CASE WHEN length(t) > {LONGEST} THEN concat(trim(substr(t, 1, {LONGEST}), ' '), '…') ELSE t END END AS clean FROM dy)"""


MONTH_DAY = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b\s+\d{1,2}\b"
_SYNTHETIC = "|".join([*TEMPLATES, GENERIC_REASON])


def synthetic(c: Column) -> Column:
    """Whether a text is one of the templates that summaries without a source are made from."""
    return let(F.lower(F.trim(c)), lambda low: (_has(low, ["why it matters:"]) | _opens(low)) & F.trim(c).rlike(f"(?i){_SYNTHETIC}"))


def sql_synthetic(c: str) -> str:
    return f"regexp_matches(trim({c}), {_lit('(?i)' + _SYNTHETIC)})"


def near_text(c: Column) -> Column:
    """What two texts are compared by: letters and digits in lower case, without a month and its day."""
    undated = lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, MONTH_DAY, " ")).otherwise(t)
    return F.trim(F.regexp_replace(F.regexp_replace(let(F.lower(F.coalesce(c, F.lit(""))), undated), _NO_NEAR, " "), r"\s+", " "))


def sql_near_text(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), {_lit(MONTH_DAY)}, ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def headline_echo(title: Column, summary: Column) -> Column:
    """Whether a summary only repeats the title: the same words, nearly all of the longer words and few more, or the title and a little."""
    return let(near_text(title), lambda a: let(near_text(summary), lambda b: _echoes(a, b)))


def _echoes(a: Column, b: Column) -> Column:
    words = lambda x: F.size(F.array_remove(F.split(x, " "), ""))
    longer = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: F.length(w) >= 4))
    few = words(b) <= words(a) + 7
    on = b.startswith(a) & (F.length(b) <= F.length(a) + 55)

    def alike(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
        return (F.size(x) > 0) & (F.size(y) > 0) & (on | few & (shared >= 0.92))

    # Most summaries are longer than that, so that no words are compared for them.
    return (a != "") & (b != "") & ((a == b) | ((few | on) & let(longer(a), lambda x: let(longer(b), lambda y: alike(x, y)))))


def sql_headline_echo(title: str, summary: str) -> str:
    a, b = sql_near_text(title), sql_near_text(summary)
    words = lambda x: f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    longer = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) >= 4))"
    la, lb = longer(a), longer(b)
    return f"""({a} <> '' AND {b} <> '' AND ({a} = {b} OR (len({la}) > 0 AND len({lb}) > 0 AND ((len(list_intersect({la}, {lb})) / greatest(1, least(len({la}), len({lb}))) >= 0.92 AND {words(b)} <= {words(a)} + 7)
      OR (starts_with({b}, {a}) AND length({b}) <= length({a}) + 55)))))"""


def sql_low_quality(c: str) -> str:
    w = f"list_filter(list_transform(regexp_split_to_array(lower({c}), '\\s+'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '')"
    repeats = " OR ".join(f"regexp_matches({c}, {_lit('(?i)' + p)})" for p in REPEATS)
    return f"""(length({c}) < {SHORTEST} OR regexp_matches({c}, {_lit('(?i)' + '|'.join(JUNK))}) OR {repeats} OR (len({w}) >= 16 AND len(list_distinct({w})) / len({w}) < 0.55) OR len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')) < 8)"""


def low_quality(c: Column) -> Column:
    """Whether a text is no summary: short, junk, or repeating itself."""
    return let(F.coalesce(c, F.lit("")), lambda t: let(F.lower(t), lambda low: _low_quality(t, low)))


def _low_quality(t: Column, low: Column) -> Column:
    junk = _matches(t, low, [w for words in _JUNK_WORDS for w in words], "(?i)" + "|".join(JUNK)) | _repeats(t, low, "i")
    spaced = lambda x: F.regexp_replace(x, r"[\t\n\x0B\f\r]", " ")
    return (F.length(t) < SHORTEST) | (F.size(F.array_remove(F.split(spaced(t), " "), "")) < 8) | junk | let(_words(spaced(low)), _dull)


def hash31(c: Column) -> Column:
    """The 32-bit hash 31 h + code over the characters, without its sign."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit((1 << 32) - 1)))
    return let(h, lambda h: F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)))


def _variant(seed: Column, text: Column, groups: list) -> Column:
    """One of the variants of the first topic that the text hits, by the seed's hash."""
    choice = F.array(*map(F.lit, groups[-1][1]))
    for pattern, variants in reversed(groups[:-1]):
        choice = F.when(text.rlike(f"(?i)({pattern})"), F.array(*map(F.lit, variants))).otherwise(choice)
    return F.element_at(choice, (hash31(seed) % 3 + 1).cast("int"))


def fallback_summary(title: Column) -> Column:
    """A summary made from the title alone: what is reported, and why it matters. Empty for short titles and section titles."""
    topic = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"^[^|]{1,40}\|\s*", ""), r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\b\s+\d{1,2}\b.*$", "")
    return let(F.trim(F.regexp_replace(_squeezed(topic), "[?!.…]+$", "")), _from_topic)


def _from_topic(topic: Column) -> Column:
    low = F.concat(F.lower(F.substring(topic, 1, 1)), topic.substr(F.lit(2), F.length(topic)))
    lead = let(low, lambda low: F.replace(_variant(low, topic, OPENINGS), F.lit("{}"), low))
    why = F.concat(F.lit("Why it matters: "), _variant(F.lower(topic), topic, REASONS))
    section = topic.rlike(r"(?i)^from\s+[a-z]|^(latest|breaking)\s+news\b")
    return F.when((F.length(topic) < 12) | section, "").otherwise(sanitized(F.concat_ws(" ", lead, why)))


def sql_fallback(rows: str) -> str:
    """A statement with (id, fallback) of rows (id, title)."""
    h = lambda c: f"list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split({c}, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295)"
    at = lambda c: f"CAST(abs(CASE WHEN {h(c)} >= 2147483648 THEN {h(c)} - 4294967296 ELSE {h(c)} END) % 3 + 1 AS INT)"
    pick = lambda groups, c: "CASE " + " ".join(f"WHEN regexp_matches(topic, '(?i)({p})') THEN ([{', '.join(map(_lit, v))}])[{c}]" for p, v in groups if p) + f" ELSE ([{', '.join(map(_lit, groups[-1][1]))}])[{c}] END"
    body = f"""(WITH a AS (SELECT id, regexp_replace(regexp_replace(title, '^[^|]{{1,40}}\\|\\s*', ''), '(?i)\\b(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\\b\\s+\\d{{1,2}}\\b.*$', '') AS x FROM {rows}), b AS (SELECT id, trim(regexp_replace({_sql_squeezed('x')}, '[?!.…]+$', ''), ' ') AS topic FROM a),
    c AS (SELECT id, topic, concat(lower(substr(topic, 1, 1)), substr(topic, 2)) AS low FROM b), d AS (SELECT *, {at('low')} AS i, {at('lower(topic)')} AS j FROM c)
    SELECT id, CASE WHEN length(topic) < 12 OR regexp_matches(topic, '(?i)^from\\s+[a-z]|^(latest|breaking)\\s+news\\b') THEN '' ELSE concat_ws(' ', replace({pick(OPENINGS, 'i')}, '{{}}', low), 'Why it matters: ' || {pick(REASONS, 'j')}) END AS summary FROM d)"""
    return sql_sanitized(body, "id") + " SELECT id, summary AS fallback FROM s"
