"""Token overlap between stories as an inverted-index join, merge decisions, clustering.

Pairs that can merge share a token that is neither generic nor an action, or two action tokens. So candidates are found by equi-joins on
strong tokens and on pairs of action tokens, with a time bucket in every key; or where a least ratio is known every two rows of a window meet
in a unit of bounded size, where what they share is counted (setjoin).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import lexicons as L
from storyloom.functions.text import q, sql_distinct_first, sql_words, words
from storyloom.functions.summaries import sanitized, sql_sanitized
from storyloom.functions.tokens import canonical_token, coverage_tokens, merge_tokens, sql_canonical_token, sql_coverage_tokens, sql_merge_tokens, sql_topic_tokens, topic_tokens
from storyloom.operators.graphs import path_compress, stored
from storyloom.operators.setjoin import covering, like_pairs
from storyloom.registry import register
from storyloom.sources.views import AS_OF


def with_tokens(stories: DataFrame, actions: list[str] = L.ACTION_TOKENS, generic: list[str] = L.GENERIC_TOKENS, dialect: Callable[[Column], Column] = merge_tokens) -> DataFrame:
    """stories (id, title, last_seen) with their tokens and those of each class. For merging, the words of a story_key, where there is such a
    column, follow those of the title."""
    text = F.coalesce("title", F.lit(""))
    if dialect is merge_tokens and "story_key" in stories.columns:
        text = F.concat_ws(" ", text, F.translate(F.coalesce("story_key", F.lit("")), "-", " "))
    out = stories.withColumn("tokens", dialect(text))
    return out.withColumns({"strong": F.filter("tokens", lambda t: ~t.isin(actions) & ~t.isin(generic)), "action": F.filter("tokens", lambda t: t.isin(actions))})


def topical(stories: DataFrame, actions: list[str] = L.TOPIC_ACTIONS, generic: list[str] = L.TOPIC_GENERIC) -> DataFrame:
    """The same with the tokens of what is displayed."""
    return with_tokens(stories, actions, generic, topic_tokens)


def numbered_sets(sets: DataFrame, *classes: str) -> DataFrame:
    """(id, t, and each class): the sets (id, tokens, and subsets of them by class) as numbers in order, rarest token first. The numbers run
    from 0 along the tokens by frequency, then by the token, so all sets of a call have one order."""
    every = sets.select("id", F.explode("tokens").alias("key"), *classes).select("id", "key", *(F.array_contains(c, F.col("key")).alias(c) for c in classes))
    order = stored(every.groupBy("key").agg(F.count("*").alias("df")).orderBy("df", "key").withColumn("no", F.monotonically_increasing_id()))
    # The upper bits are the partition: its first number takes their place.
    part, starts, n = F.shiftright("no", 33).cast("int"), [], 0
    for p, rows in sorted(order.groupBy(part.alias("p")).count().collect()):
        starts += [n] * (p + 1 - len(starts))
        n += rows
    kind = "int" if n < 1 << 31 else "long"
    no = (F.get(F.array(*(F.lit(x) for x in starts or [0])), part) + F.col("no").bitwiseAND((1 << 33) - 1)).cast(kind)
    listed = (F.array_sort(F.collect_list(F.when(F.col(c), F.col("no")))).alias(c) for c in classes)
    return every.join(order.select("key", no.alias("no")), "key").groupBy("id").agg(F.array_sort(F.collect_list("no")).alias("t"), *listed)


def prefix_join(rows: DataFrame, days: float, least: float, carried: list[str], touched: DataFrame | None = None, classes: list[str] | None = None, keep: Callable | None = None) -> DataFrame:
    """(l, r, n_l, shared, n_<class> of each, and c_l, c_r of each carried column c): every two rows (id, last_seen, t) seen within some days
    that share `least` of the smaller set, l; t and the classes as in numbered_sets(). With `touched` (id) only pairs that have one of these ids
    on a side. Each pair is made once, by like_pairs() with `keep`, and nothing is shuffled but the rows."""
    flagged = rows.withColumn("hit", F.lit(True)) if touched is None else rows.join(touched.select("id", F.lit(True).alias("hit")).distinct(), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    timed = flagged.where("last_seen is not null").select("id", F.unix_seconds(F.col("last_seen").cast("timestamp")).alias("at"), "t", "hit", *dict.fromkeys([*carried, *(classes or [])]))
    met = like_pairs(stored(timed.withColumn("no", F.monotonically_increasing_id())), round(days * 86_400), least, classes or [], carried, touched is not None, keep)
    c = F.col
    first = (c("n_a") < c("n_b")) | ((c("n_a") == c("n_b")) & (c("id_a") < c("id_b")))
    by = lambda a, b: F.when(first, c(a)).otherwise(c(b))
    ends = [by(f"{x}_{p}", f"{x}_{o}").alias(f"{x}_{q}") for x in carried for p, o, q in (("a", "b", "l"), ("b", "a", "r"))]
    return met.where("id_a <> id_b").select(by("id_a", "id_b").alias("l"), by("id_b", "id_a").alias("r"), F.least("n_a", "n_b").alias("n_l"), "shared", *(f"n_{x}" for x in classes or []), *ends)


def overlap_pairs(tokens: DataFrame, days: int = 5, least: float = 0.0, touched: DataFrame | None = None, traits: list[str] | None = None, theta: float | None = None) -> DataFrame:
    """(i, j, ratio, shared, n_action, n_strong) of stories i < j that share a strong token or two action tokens, seen within some days,
    with a ratio of `least`.

    tokens: with_tokens(). Without `least` the keys are strong tokens and pairs of action tokens; pairs that share several keys are kept
    once, by an aggregate on the ids alone. With it the pairs are those of prefix_join(). With `touched` (id) only pairs that have one of
    these ids on a side. With `traits` (columns of tokens) these come along as c_i and c_j. With `theta` and `least` only pairs that
    merge_decision() takes for alike at theta.
    """
    if least > 0:
        return _prefix_pairs(tokens, days, least, touched, traits or [], theta)
    traits = traits or []
    some = (lambda rows: rows) if touched is None else (lambda rows: rows.join(touched.select("id"), "id", "left_semi"))
    bucket = F.floor(F.unix_seconds(F.col("last_seen").cast("timestamp")) / F.lit(days * 86_400))
    pairs = F.transform(F.sequence(F.lit(0), F.size("action") - 2), lambda a: F.transform(F.slice("action", a + 2, F.size("action")), lambda b: F.concat_ws("+", F.array_sort(F.array(F.get("action", a), b)))))
    keys = F.concat("strong", F.when(F.size("action") >= 2, F.flatten(pairs)).otherwise(F.array().cast("array<string>")))
    rows = tokens.select("id", "last_seen", bucket.alias("bucket"), F.explode(F.array_distinct(keys)).alias("key"))
    near = F.abs(F.unix_seconds(F.col("ta").cast("timestamp")) - F.unix_seconds(F.col("tb").cast("timestamp"))) <= days * 86_400
    left = some(rows).select(F.col("id").alias("a"), F.col("last_seen").alias("ta"), "key", F.explode(F.array(*(F.col("bucket") + k for k in ((0, -1) if touched is None else (-1, 0, 1))))).alias("bucket"))
    right = rows.select(F.col("id").alias("b"), F.col("last_seen").alias("tb"), "key", "bucket")
    found = left.join(right, ["key", "bucket"]).where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    cols = lambda p: tokens.select(F.col("id").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("tokens", "strong", "action", *traits)))
    both = found.join(cols("i"), "i").join(cols("j"), "j")
    inter = lambda c: F.size(F.array_intersect(f"{c}_i", f"{c}_j"))
    shared = inter("tokens")
    ratio = shared / F.greatest(F.lit(1), F.least(F.size("tokens_i"), F.size("tokens_j")))
    out = both.select("i", "j", F.round(ratio, 6).alias("ratio"), shared.alias("shared"), inter("action").alias("n_action"), inter("strong").alias("n_strong"), *(f"{c}_{p}" for c in traits for p in "ij"))
    return out.where((F.col("n_strong") >= 1) | (F.col("n_action") >= 2))


def _prefix_pairs(tokens: DataFrame, days: int, least: float, touched: DataFrame | None, traits: list[str], theta: float | None = None) -> DataFrame:
    rows = tokens.where("last_seen is not null").select("id", "last_seen", *traits).join(numbered_sets(tokens, "strong", "action"), "id")
    # The fewer of the tokens are counted anew: those that are not strong.
    rows = rows.withColumn("weak", F.filter("t", lambda x: ~F.array_contains("strong", x)))
    met = prefix_join(rows, days, least, traits, touched, ["action", "weak"], None if theta is None else _alike(_bounded(theta)))
    first = F.col("l") < F.col("r")
    by = [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{p}") for c in traits for p, x, y in (("i", "l", "r"), ("j", "r", "l"))]
    out = met.select(F.least("l", "r").alias("i"), F.greatest("l", "r").alias("j"), F.round(F.col("shared") / F.col("n_l"), 6).alias("ratio"), "shared", "n_action", (F.col("shared") - F.col("n_weak")).alias("n_strong"), *by)
    return out.where((F.col("ratio") >= least) & ((F.col("n_strong") >= 1) | (F.col("n_action") >= 2)))


def _bounded(theta: float) -> float:
    return min(0.95, max(0.3, theta))


def _alike(theta: float) -> Callable[..., np.ndarray]:
    """What merge_decision() asks of two sets, on numbers: their smaller size, what they share, and how much of that are actions and weak tokens."""

    def keep(n: np.ndarray, shared: np.ndarray, action: np.ndarray, weak: np.ndarray) -> np.ndarray:
        ratio, strong = (2_000_000 * shared + n) // (2 * n) / 1e6, shared - weak  # six digits, halves up
        return np.where(ratio >= theta, (strong >= 1) | (action >= 2), (ratio >= 0.3) & (shared >= 3) & (action >= 1) & (strong >= 1))

    return keep


def _token_sql(rows: str, dialect: Callable = sql_merge_tokens) -> str:
    kept, most = dialect("title")
    act, gen = q(L.DATA["actions"]), q(L.DATA["generic"])
    return f"""WITH k0 AS (SELECT id, title, last_seen, article_count, status, {kept} AS raw FROM {rows}), k AS (SELECT * EXCLUDE raw, {sql_distinct_first('raw', most)} AS tokens FROM k0),
    t AS (SELECT *, list_filter(tokens, lambda x: x NOT IN ({act}) AND x NOT IN ({gen})) AS strong, list_filter(tokens, lambda x: x IN ({act})) AS action FROM k)"""


def _pair_sql(dialect: Callable) -> str:
    return _token_sql("v_stories", dialect) + """, p AS (SELECT a.id AS i, b.id AS j, len(list_intersect(a.tokens, b.tokens)) AS shared, len(list_intersect(a.action, b.action)) AS n_action, len(list_intersect(a.strong, b.strong)) AS n_strong,
    len(a.tokens) AS na, len(b.tokens) AS nb FROM t a JOIN t b ON a.id < b.id AND abs(date_diff('second', a.last_seen, b.last_seen)) <= 432000), o AS (SELECT i, j, round(shared / greatest(1, least(na, nb)), 6) AS ratio, shared, n_action, n_strong FROM p WHERE n_strong >= 1 OR n_action >= 2)"""


PAIR_SQL, TOPIC_PAIR_SQL = _pair_sql(sql_merge_tokens), _pair_sql(sql_topic_tokens)


def data_tokens(stories: DataFrame) -> DataFrame:
    return with_tokens(stories, L.DATA["actions"], L.DATA["generic"])


def data_topical(stories: DataFrame) -> DataFrame:
    return topical(stories, L.DATA["actions"], L.DATA["generic"])


_PAIRS = "SELECT i, j, ratio, CAST(shared AS INT) AS shared, CAST(n_action AS INT) AS n_action, CAST(n_strong AS INT) AS n_strong FROM o"
#: No pair below a ratio of 0.3 merges, whatever else it shares.
register("title_overlap_pairs", "v_stories", lambda s: overlap_pairs(data_tokens(s), least=0.3), f"{PAIR_SQL} {_PAIRS} WHERE ratio >= 0.3")
register("topic_overlap_pairs", "v_stories", lambda s: overlap_pairs(data_topical(s), 5, 0.4), f"{TOPIC_PAIR_SQL} {_PAIRS} WHERE ratio >= 0.4")


def token_index(tokens: DataFrame) -> DataFrame:
    """(token, class, df): document frequencies by class of token."""
    kind = F.when(F.array_contains("action", F.col("token")), "action").when(F.array_contains("strong", F.col("token")), "strong").otherwise("generic")
    return tokens.select("id", "strong", "action", F.explode("tokens").alias("token")).groupBy("token", kind.alias("class")).agg(F.count("*").alias("df"))


def token_indices(stories: DataFrame, actions: list[str], generic: list[str]) -> DataFrame:
    """(dialect, token, class, df): the index of each dialect; coverage tokens have no classes."""
    by = {"merge": merge_tokens, "topic": topic_tokens, "coverage": coverage_tokens}
    out = None
    for name, dialect in by.items():
        none = name == "coverage"
        one = token_index(with_tokens(stories.select("id", "title"), [] if none else actions, [] if none else generic, dialect)).withColumn("dialect", F.lit(name))
        one = one.withColumn("class", F.lit(None).cast("string")) if none else one
        out = one if out is None else out.unionByName(one)
    return out.select("dialect", "token", "class", "df")


def _index_sql() -> str:
    kind = f"CASE WHEN token IN ({q(L.DATA['actions'])}) THEN 'action' WHEN token IN ({q(L.DATA['generic'])}) THEN 'generic' ELSE 'strong' END"
    tokens = {"merge": sql_distinct_first("merged", 24), "topic": sql_distinct_first("shown", 18), "coverage": "covered"}
    each = " UNION ALL ".join(f"SELECT '{name}' AS dialect, unnest({x}) AS token FROM w" for name, x in tokens.items())
    return f"""WITH w AS (SELECT {sql_merge_tokens('title')[0]} AS merged, {sql_topic_tokens('title')[0]} AS shown, {sql_coverage_tokens('title')} AS covered FROM v_stories), d AS ({each})
    SELECT dialect, token, CASE WHEN dialect <> 'coverage' THEN {kind} END AS class, count(*) AS df FROM d GROUP BY ALL"""


register("token_index", "v_stories", lambda s: token_indices(s, L.DATA["actions"], L.DATA["generic"]), _index_sql())


def _veto(n_strong: Column, n_action: Column) -> Column:
    """Why two stories (states s_i, s_j, entities e_i, e_j) must not be merged, or null."""
    conflict = (F.size("e_i") >= 2) & (F.size("e_j") >= 2) & (F.size(F.array_intersect("e_i", "e_j")) == 0) & (n_strong == 0) & (n_action >= 1)
    return F.when(F.col("s_i").isNotNull() & F.col("s_j").isNotNull() & (F.col("s_i") != F.col("s_j")), "state_mismatch").when(conflict, "entity_conflict")


def _by_opening(rows: DataFrame) -> DataFrame:
    """Rows grouped by the first letters of their titles, as stories of mixed articles."""
    return rows.withColumn("story_id", F.expr("substr(lower(title), 1, 3)"))


def merge_decision(pairs: DataFrame, states: DataFrame | None, theta: float = 0.56) -> DataFrame:
    """pairs with the veto and whether to merge. states: (id, state, entities array); None if the pairs have them as traits s and e."""
    theta = _bounded(theta)
    s = lambda p: states.select(F.col("id").alias(p), F.col("state").alias(f"s_{p}"), F.col("entities").alias(f"e_{p}"))
    c = F.col
    joined = pairs if states is None else pairs.join(s("i"), "i").join(s("j"), "j")
    veto = _veto(c("n_strong"), c("n_action"))
    alike = F.when(c("ratio") >= theta, (c("n_strong") >= 1) | (c("n_action") >= 2)).otherwise((c("ratio") >= 0.3) & (c("shared") >= 3) & (c("n_action") >= 1) & (c("n_strong") >= 1))
    out = joined.withColumn("veto", veto)
    return out.select("i", "j", "ratio", "shared", "n_action", "n_strong", "veto", (F.col("veto").isNull() & alike).alias("should_merge"))


def state_of(t: Column, aliases: list[list[str]]) -> Column:
    """The first state, in the table's order, one of whose aliases stands in the text between spaces."""
    from storyloom.functions.text import normal

    padded = F.concat(F.lit(" "), normal(t), F.lit(" "))
    out = F.lit(None).cast("string")
    for state, *names in reversed(aliases):
        hit = F.lit(False)
        for n in names:
            hit = hit | padded.contains(f" {n} ")
        out = F.when(hit, state).otherwise(out)
    return out


def entity_tokens(title: Column, generic: list[str], actions: list[str]) -> Column:
    """Capitalised words but the first, and words in capitals, in canonical form: at least three letters, no stopword, no generic or action
    token, and none of the words that are written like names."""
    w = F.filter(F.transform(F.split(title, r"\s+"), lambda x: F.regexp_replace(x, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")), lambda x: x != "")
    named = F.filter(w, lambda x, i: x.rlike("^[A-Z0-9]{2,}$") | ((i > 0) & x.rlike("^[A-Z][a-z]+$")))
    stop = sorted({*L.STOPWORDS, *generic, *actions, *L.ENTITY_STOPWORDS})
    return F.array_distinct(F.filter(F.transform(named, lambda x: canonical_token(x)), lambda x: (F.length(x) >= 3) & ~x.isin(stop)))


def _with_states(s: DataFrame) -> DataFrame:
    """Stories with their state s and entities e."""
    text = F.concat_ws(" ", "title", F.translate("story_key", "-", " ")) if "story_key" in s.columns else F.col("title")
    return s.withColumns({"s": state_of(text, L.DATA["states"]), "e": entity_tokens(F.col("title"), L.DATA["generic"], L.DATA["actions"])})


_STATE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(concat(' ', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), ' {n} ')''' for n in names)} THEN '{s}'" for s, *names in L.DATA["states"]) + " END"
_ENT_SQL = f"""list_distinct(list_filter(list_transform(list_transform(list_filter(list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda x: x <> ''),
    lambda x, i: regexp_matches(x, '^[A-Z0-9]{{2,}}$') OR (i > 1 AND regexp_matches(x, '^[A-Z][a-z]+$'))), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda w: {sql_canonical_token('w')}),
    lambda x: length(x) >= 3 AND x NOT IN ({q(sorted({*L.STOPWORDS, *L.DATA['generic'], *L.DATA['actions'], *L.ENTITY_STOPWORDS}))})))"""
DECIDE_SQL = PAIR_SQL + f""", e AS (SELECT id, {_STATE_SQL} AS state, {_ENT_SQL} AS ent FROM v_stories), v AS (SELECT o.*, CASE WHEN a.state <> b.state THEN 'state_mismatch' WHEN len(a.ent) >= 2 AND len(b.ent) >= 2 AND len(list_intersect(a.ent, b.ent)) = 0 AND n_strong = 0 AND n_action >= 1 THEN 'entity_conflict' END AS veto
    FROM o JOIN e a ON a.id = i JOIN e b ON b.id = j), m AS (SELECT *, veto IS NULL AND CASE WHEN ratio >= 0.56 THEN n_strong >= 1 OR n_action >= 2 ELSE ratio >= 0.3 AND shared >= 3 AND n_action >= 1 AND n_strong >= 1 END AS should_merge FROM v)"""


def decided(s: DataFrame, theta: float = 0.56, days: int = 5, least: float = 0.3, touched: DataFrame | None = None, alike: bool = False) -> DataFrame:
    """Decisions on the pairs that can merge or nearly do; no pair below a ratio of 0.3 merges. With `touched` (id) only pairs of these; with `alike`
    only those that would merge but for a veto."""
    return merge_decision(overlap_pairs(_with_states(data_tokens(s)), days, least, touched, ["s", "e"], theta if alike else None), None, theta)


register("merge_decision", "v_stories", lambda s: decided(s).select("i", "j", "veto", "should_merge"), DECIDE_SQL + " SELECT i, j, veto, should_merge FROM m WHERE ratio >= 0.3")
register("duplicate_pair_audit", "v_stories", lambda s: decided(s, 0.54).where("should_merge").select("i", "j", "ratio"), DECIDE_SQL.replace("0.56", "0.54") + " SELECT i, j, ratio FROM m WHERE should_merge")


def near_miss_audit(decisions: DataFrame, singles: DataFrame, k: int = 3) -> DataFrame:
    """For each single-source story its best k merges and near misses. decisions: merge_decision(); singles: (id)."""
    kind = F.when(F.col("should_merge"), "merge").when(F.col("ratio") >= 0.3, "near_miss")
    side = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("match"))
    rows = decisions.select(F.explode(F.array(side("i", "j"), side("j", "i"))).alias("x"), "ratio", "shared", kind.alias("kind")).where("kind is not null").select("x.*", "ratio", "shared", "kind")
    # The best k come before the semi-join, so that each task has cut its pairs before they are shuffled.
    r = F.row_number().over(Window.partitionBy("id", "kind").orderBy(F.desc("ratio"), F.desc("shared"), "match"))
    best = rows.withColumn("r", r).where(F.col("r") <= k)
    return best.join(singles.select("id"), "id", "left_semi").select("id", "kind", "r", "match")


register(
    "near_miss_audit", "v_stories", lambda s: near_miss_audit(decided(s), s.where("article_count = 1")),
    DECIDE_SQL + """, b AS (SELECT i, j, ratio, shared, should_merge FROM m UNION ALL SELECT j, i, ratio, shared, should_merge FROM m), n AS (SELECT *, CASE WHEN should_merge THEN 'merge' WHEN ratio >= 0.3 THEN 'near_miss' END AS kind FROM b WHERE i IN (SELECT id FROM v_stories WHERE article_count = 1))
    SELECT i AS id, kind, CAST(row_number() OVER (PARTITION BY i, kind ORDER BY ratio DESC, shared DESC, j) AS INT) AS r, j AS match FROM n WHERE kind IS NOT NULL QUALIFY r <= 3""",
)


def story_key_jaccard(stories: DataFrame, theta: float = 0.6, days: int = 4, k: int | None = None) -> DataFrame:
    """(source, target, overlap): stories whose title tokens have a Jaccard index of theta; the one with more articles, then newer, is the target.

    Sets of Jaccard theta share theta of the larger one, so of the smaller one too: the pairs are among those of prefix_join().
    """
    t = stories.select("id", "last_seen", "article_count", F.array_distinct(words(F.coalesce("title", F.lit("")))).alias("tokens"))
    seen = F.col("last_seen").alias("seen")
    rows = t.where("last_seen is not null").select("id", "last_seen", seen, "article_count").join(numbered_sets(t), "id").withColumn("size", F.size("t"))
    met = prefix_join(rows, days, theta, ["seen", "article_count", "size"])
    out = met.withColumn("overlap", F.round(F.col("shared") / (F.col("size_l") + F.col("size_r") - F.col("shared")), 6)).where(F.col("overlap") >= theta)
    by = lambda c: [F.when(F.col("l") < F.col("r"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")) for x, y in ("lr", "rl")]
    (seen_i, seen_j), (count_i, count_j) = by("seen"), by("article_count")
    out = out.select(F.least("l", "r").alias("i"), F.greatest("l", "r").alias("j"), "overlap", seen_i.alias("last_seen_i"), seen_j.alias("last_seen_j"), count_i.alias("article_count_i"), count_j.alias("article_count_j"))
    first = F.struct("article_count_i", "last_seen_i") >= F.struct(F.col("article_count_j").alias("article_count_i"), F.col("last_seen_j").alias("last_seen_i"))
    out = out.select(F.when(first, F.col("j")).otherwise(F.col("i")).alias("source"), F.when(first, F.col("i")).otherwise(F.col("j")).alias("target"), "overlap")
    return out if k is None else out.orderBy(F.desc("overlap"), "source", "target").limit(k)


register(
    "story_key_jaccard", "v_stories", story_key_jaccard,
    f"""WITH t AS (SELECT id, last_seen, article_count, list_distinct({sql_words('title')}) AS w FROM v_stories), p AS (SELECT a.id AS i, b.id AS j, len(list_intersect(a.w, b.w)) AS x, len(a.w) + len(b.w) AS n, a.article_count AS ca, b.article_count AS cb, a.last_seen AS ta, b.last_seen AS tb
    FROM t a JOIN t b ON a.id < b.id AND abs(date_diff('second', a.last_seen, b.last_seen)) <= 345600 WHERE len(a.w) > 0 AND len(b.w) > 0), o AS (SELECT *, round(x / (n - x), 6) AS overlap, ca > cb OR (ca = cb AND ta >= tb) AS f FROM p)
    SELECT CASE WHEN f THEN j ELSE i END AS source, CASE WHEN f THEN i ELSE j END AS target, overlap FROM o WHERE overlap >= 0.6""",
)


def coverage_join(seeds: DataFrame, candidates: DataFrame, hours: int = 72, least: float = 0.28, best: int | None = None) -> DataFrame:
    """(seed, cand, similarity): candidates within some hours of a seed whose tokens overlap by `least` of the smaller set, in the titles
    or in titles and summaries together, whichever is more.

    seeds and candidates (id, title, summary, ts); null times match nothing. Both sets of a row are counted at once by covering(), so each
    pair is made once and pairs are not shuffled. With `best`, where seeds and candidates are not the same, candidates that are not among the
    so many best of a seed, ties to the smallest one, may be left out.
    """
    one, c = candidates is seeds, F.col
    title, both = F.coalesce("title", F.lit("")), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    ends = lambda df, hit: [] if one else [(c("id") if hit else F.lit(None).cast(seeds.schema["id"].dataType)).alias("id_a"), (F.lit(None).cast(candidates.schema["id"].dataType) if hit else c("id")).alias("id_b")]
    sets = lambda df, hit: df.where("ts is not null").select(F.struct(F.lit(hit).alias("hit"), F.col("id") if one else F.col("id").cast("string").alias("id")).alias("id"), F.lit(hit).alias("hit"), *ends(df, hit), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), coverage_tokens(title).alias("w"), coverage_tokens(both).alias("b"))
    rows = stored(sets(seeds, True) if one else sets(seeds, True).unionByName(sets(candidates, False)))
    numbers = lambda part: numbered_sets(rows.select("id", F.col(part).alias("tokens"))).withColumnRenamed("t", part)
    rows = rows.drop("w", "b").join(numbers("w"), "id", "left").join(numbers("b"), "id", "left").withColumns({p: F.coalesce(p, F.array().cast("array<int>")) for p in "wb"})
    rows = rows.where(F.size("w") + F.size("b") > 0).withColumn("no", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("id", F.col("id.id")) if one else rows.drop("id"))
    out = covering(rows, hours * 3600, least, not one, best)
    if not one:
        return out.select(c("a").alias("seed"), c("b").alias("cand"), "similarity")
    pairs = F.explode(F.array(*(F.struct(c(a).alias("seed"), c(b).alias("cand")) for a, b in ("ab", "ba"))))
    return out.select(pairs.alias("x"), "similarity").select("x.*", "similarity")


def _among(articles: DataFrame, *options) -> DataFrame:  # noqa: ANN002
    return coverage_join(articles, articles, *options)


def with_ledes(articles: DataFrame) -> DataFrame:
    """articles with their summaries cleaned to ledes."""
    return articles.withColumn("summary", sanitized(F.col("summary")))


_COV = f"""{sql_sanitized("v_articles", "id, title, ts")}, k AS (SELECT id, ts, {sql_coverage_tokens('title')} AS w, {sql_coverage_tokens("concat(title, ' ', summary)")} AS b FROM s),
    p AS (SELECT a.id AS seed, c.id AS cand, coalesce(round(len(list_intersect(a.w, c.w)) / nullif(least(len(a.w), len(c.w)), 0), 3), 0) AS x, coalesce(round(len(list_intersect(a.b, c.b)) / nullif(least(len(a.b), len(c.b)), 0), 3), 0) AS y FROM k a JOIN k c ON a.id <> c.id AND abs(date_diff('second', a.ts, c.ts)) <= 259200),
    o AS (SELECT seed, cand, greatest(x, y) AS similarity FROM p WHERE greatest(x, y) >= 0.28)"""
register("coverage_similarity", "v_articles", lambda a: _among(with_ledes(a)), _COV + " SELECT * FROM o")
register("coverage_window_join", "v_articles", lambda a: _among(with_ledes(a), 24, 0.5), _COV.replace("259200", "86400").replace("0.28", "0.5") + " SELECT * FROM o")


# --- clustering --------------------------------------------------------------------------------------------------------------------


def group_by_story_key(articles: DataFrame, stories: DataFrame, at: str = AS_OF, days: int = 7) -> DataFrame:
    """(id, story_id, is_new, is_primary) for ungrouped articles (id, story_key, ts): to the newest recent story of the key, else to one
    new story for the key if its newest article is recent, else each to a story of its own."""
    horizon = F.expr(f"TIMESTAMP_NTZ '{at}' - INTERVAL {24 * days} HOURS")
    recent = stories.where(F.col("last_seen") >= horizon).groupBy("story_key").agg(F.max_by("id", F.struct("last_seen", "id")).alias("found"))
    new = articles.groupBy("story_key").agg(F.max("ts").alias("newest"), F.max_by("id", F.struct("ts", "id")).alias("first_id"))
    joined = articles.join(recent, "story_key", "left").join(new, "story_key")
    alone = F.col("found").isNull() & (F.coalesce("newest", F.lit("1970-01-01").cast("timestamp_ntz")) < horizon)
    story = F.when(F.col("found").isNotNull(), F.col("found")).when(alone, F.md5(F.concat(F.lit("a:"), F.col("id").cast("string")))).otherwise(F.md5(F.concat(F.lit("k:"), F.col("story_key"))))
    return joined.select("id", story.alias("story_id"), F.col("found").isNull().alias("is_new"), (F.col("found").isNull() & (alone | (F.col("id") == F.col("first_id")))).alias("is_primary"))


_GK = "concat_ws('-', split_part(lower(title), ' ', 1), split_part(lower(title), ' ', 2))"
register(
    "group_by_story_key", "v_articles v_stories", lambda a, s: group_by_story_key(a.withColumn("story_key", F.expr(_GK)), s.where("status = 'active'").withColumn("story_key", F.expr(_GK))),
    f"""WITH a AS (SELECT id, ts, {_GK} AS k FROM v_articles), s AS (SELECT {_GK} AS k, arg_max(id, struct_pack(t := last_seen, i := id)) AS found FROM v_stories WHERE status = 'active' AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS GROUP BY 1),
    n AS (SELECT k, max(ts) AS newest, arg_max(id, struct_pack(t := ts, i := id)) AS first_id FROM a GROUP BY k), j AS (SELECT a.*, found, first_id, found IS NULL AND newest < TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS AS alone FROM a JOIN n USING (k) LEFT JOIN s USING (k))
    SELECT id, CASE WHEN found IS NOT NULL THEN found WHEN alone THEN md5(concat('a:', id)) ELSE md5(concat('k:', k)) END AS story_id, found IS NULL AS is_new, found IS NULL AND (alone OR id = first_id) AS is_primary FROM j""",
)


def merge_apply(stories: DataFrame, links: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots after the merges: sources disappear, their links move, blanks of a target are filled from its sources, pinned wins."""
    from storyloom.operators.rollups import link_union_merge

    final = path_compress(plan)
    named = stories.join(final.withColumnRenamed("source", "id"), "id", "left").withColumn("into", F.coalesce("target", "id"))
    first = lambda c: F.min_by(c, F.struct(F.col(c).isNull(), F.col("target").isNotNull(), "id"))
    merged = named.groupBy("into").agg(first("title").alias("title"), first("summary").alias("summary"), F.when(F.bool_or(F.col("status") == "pinned"), "pinned").otherwise(first("status")).alias("status"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("article_count").alias("article_count"))
    return merged.withColumnRenamed("into", "id"), link_union_merge(links.select("story_id", "article_id"), final)


def _star_stories(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("id"), F.expr("if(o_custkey % 3 = 0, null, o_orderpriority)").alias("title"), F.col("o_orderpriority").alias("summary"), F.expr("if(o_custkey % 11 = 0, 'pinned', 'active')").alias("status"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), F.lit(1).alias("article_count"))


def _star_plan(o: DataFrame) -> DataFrame:
    return o.where("o_orderkey % 16 > 0").select(F.col("o_orderkey").alias("source"), F.expr("o_orderkey - 1").alias("target")).join(o.select((F.col("o_orderkey")).alias("target")), "target", "left_semi")


register(
    "merge_apply", "orders star_links", lambda o, x: merge_apply(_star_stories(o), x, _star_plan(o))[0].select("id", "title", "status", F.col("article_count")),
    """WITH RECURSIVE p AS (SELECT o_orderkey AS source, o_orderkey - 1 AS target FROM orders WHERE o_orderkey % 16 > 0 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)),
    c AS (SELECT source, target, 1 AS d FROM p UNION ALL SELECT c.source, p.target, d + 1 FROM c JOIN p ON p.source = c.target), f AS (SELECT source, arg_max(target, d) AS target FROM c GROUP BY source),
    s AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title, CASE WHEN o_custkey % 11 = 0 THEN 'pinned' ELSE 'active' END AS status, target FROM orders LEFT JOIN f ON source = o_orderkey),
    n AS (SELECT *, coalesce(target, id) AS grp FROM s) SELECT grp AS id, first(title ORDER BY title IS NULL, target IS NOT NULL, id) AS title, CASE WHEN bool_or(status = 'pinned') THEN 'pinned' ELSE 'active' END AS status, count(*) AS article_count FROM n GROUP BY grp""",
)


def split_mixed(stories: DataFrame, links: DataFrame, dominant: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stories, links, counts) after each story's newest article of another state than the story's dominant one has moved.

    stories (id, story_key, title, last_seen); links (story_id, article_id, is_primary, ts, state, story_key, title), the last two of the
    article; dominant (story_id, state). An article goes to the newest other story of its key, else to a new one of its own. Stories
    without articles go; the others' last times and primary articles are set anew. One article a story and run, as repeated runs drain the
    rest; counts has the candidates, all outliers and the moves. With `most`, only the newest so many stories are split.
    """
    outliers = links.join(dominant.where("state is not null").select("story_id", F.col("state").alias("main")), "story_id").where("state is not null and state <> main")
    newest = outliers.groupBy("story_id").agg(F.max_by(F.struct("article_id", "story_key", "title", "ts"), F.struct("ts", "article_id")).alias("a")).select("story_id", "a.*")
    if most is not None:
        newest = newest.join(stories.select(F.col("id").alias("story_id"), "last_seen"), "story_id").orderBy(F.desc("last_seen"), F.desc("story_id")).limit(most).drop("last_seen")
    # The newest story of each key and the next one after it: one of the two is another story than the article's own.
    by_key = stories.select("story_key", F.struct("last_seen", "id").alias("s"))
    first = by_key.groupBy("story_key").agg(F.max("s").alias("first"))
    second = by_key.join(first, "story_key").where("s <> first").groupBy("story_key").agg(F.max("s").alias("second"))
    at = newest.join(first, "story_key", "left").join(second, "story_key", "left")
    other = F.when(F.col("first.id") != F.col("story_id"), F.col("first.id")).otherwise(F.col("second.id"))
    moves = stored(at.select("story_id", "article_id", "title", "story_key", "ts", F.coalesce(other, F.concat_ws("-", F.lit("split"), "article_id")).alias("target"), other.isNull().alias("created")))
    moved = links.join(moves.select("story_id", "article_id", "target", "created"), ["story_id", "article_id"], "left")
    after = moved.select(F.coalesce("target", "story_id").alias("story_id"), "article_id", F.when(F.col("target").isNotNull(), F.col("created")).otherwise(F.col("is_primary")).alias("is_primary"), "ts")
    after = after.groupBy("story_id", "article_id").agg(F.max("is_primary").alias("is_primary"), F.max("ts").alias("ts"))
    per = Window.partitionBy("story_id")
    lead = F.row_number().over(per.orderBy(F.desc("ts"), F.desc("article_id"))) == 1
    after = after.withColumn("is_primary", F.when(F.max(F.col("is_primary").cast("int")).over(per) == 1, F.col("is_primary")).otherwise(lead))
    every = stories.select("id", "title").unionByName(moves.where("created").select(F.col("target").alias("id"), "title"))
    seen = after.groupBy(F.col("story_id").alias("id")).agg(F.max("ts").alias("last_seen"))
    named = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counts = named("candidates", links.select("story_id").distinct()).union(named("flagged", outliers)).union(named("split", moves))
    return every.join(seen, "id"), after.select("story_id", "article_id", "is_primary"), counts.agg(*(F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in ("candidates", "flagged", "split")))


_SPLIT_STATE = "CASE source_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'west' END"


def _split(x: DataFrame) -> DataFrame:
    from storyloom.operators.rollups import dominant_value

    key = "substr(title, 1, 8)"
    rows = x.select(F.col("story_id").cast("string").alias("story_id"), "article_id", "is_primary", "ts", F.expr(_SPLIT_STATE).alias("state"), F.expr(key).alias("story_key"), "title")
    stories = rows.groupBy(F.col("story_id").alias("id")).agg(F.min("story_key").alias("story_key"), F.min("title").alias("title"), F.max("ts").alias("last_seen"))
    none = rows.select("story_id").distinct().withColumn("own_state", F.lit(None).cast("string"))
    s, links, counts = split_mixed(stories, rows, dominant_value(rows.select("story_id", "state"), none, 2, 0.67))
    out = links.join(s, links["story_id"] == s["id"]).select("story_id", "article_id", "is_primary", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return out.unionByName(counts.select(F.lit("counts").alias("story_id"), F.concat_ws(",", "candidates", "flagged", "split").alias("article_id"), F.lit(None).cast("boolean").alias("is_primary"), F.lit(None).cast("string").alias("last_seen")))


register(
    "split_mixed_stories", "star_links", _split,
    f"""WITH a AS (SELECT CAST(story_id AS VARCHAR) AS story_id, article_id, is_primary, ts, title, substr(title, 1, 8) AS k, {_SPLIT_STATE} AS state FROM star_links), c AS (SELECT story_id, state, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT story_id, sum(n) AS total FROM c GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, state) AS r, lead(n) OVER (PARTITION BY story_id ORDER BY n DESC, state) AS second FROM c WHERE state IS NOT NULL), b AS (SELECT r.story_id, state AS main FROM r JOIN t USING (story_id) WHERE r = 1 AND n >= 2 AND n > coalesce(second, 0) AND n >= 0.67 * total),
    o AS (SELECT a.* FROM a JOIN b USING (story_id) WHERE state <> main), w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, article_id DESC) = 1),
    s AS (SELECT story_id AS id, min(k) AS k, max(ts) AS last_seen FROM a GROUP BY 1), m AS (SELECT w.story_id, w.article_id, (SELECT s.id FROM s WHERE s.k = w.k AND s.id <> w.story_id ORDER BY s.last_seen DESC, s.id DESC LIMIT 1) AS found FROM w),
    f AS (SELECT CASE WHEN m.article_id IS NULL THEN a.story_id ELSE coalesce(m.found, concat('split-', a.article_id)) END AS story_id, a.article_id, max(CASE WHEN m.article_id IS NULL THEN is_primary ELSE m.found IS NULL END) AS p, max(a.ts) AS ts FROM a LEFT JOIN m ON m.story_id = a.story_id AND m.article_id = a.article_id GROUP BY 1, 2),
    g AS (SELECT *, bool_or(p) OVER (PARTITION BY story_id) AS has, row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, article_id DESC) = 1 AS newest, max(ts) OVER (PARTITION BY story_id) AS seen FROM f)
    SELECT story_id, article_id, CASE WHEN has THEN p ELSE newest END AS is_primary, strftime(seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM g
    UNION ALL SELECT 'counts', concat_ws(',', (SELECT count(*) FROM s), (SELECT count(*) FROM o), (SELECT count(*) FROM m)), NULL, NULL""",
)


def cluster_outlier_counts(links: DataFrame, stories: DataFrame, states: list[list[str]], generic: list[str], actions: list[str], theta: float = 0.56) -> DataFrame:
    """(story_id, n, state_n, entity_n): how many titles a story's articles have, and how many of them the merge decision would veto
    beside the story's own title, for its state or for its entities. links (story_id, title); stories (id, title)."""
    side = lambda df, key, p: with_tokens(df, actions, generic).select(*key, *(F.col(c).alias(f"{c}_{p}") for c in ("tokens", "strong", "action")), state_of(F.col("title"), states).alias(f"s_{p}"), entity_tokens(F.col("title"), generic, actions).alias(f"e_{p}"))
    titled = links.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    both = side(titled, ["story_id"], "j").join(side(stories, [F.col("id").alias("story_id")], "i"), "story_id")
    inter = lambda c: F.size(F.array_intersect(f"{c}_i", f"{c}_j"))
    veto = _veto(inter("strong"), inter("action"))
    return both.withColumn("veto", veto).groupBy("story_id").agg(F.count("*").alias("n"), F.count_if(F.col("veto") == "state_mismatch").alias("state_n"), F.count_if(F.col("veto") == "entity_conflict").alias("entity_n"))


register(
    "cluster_outlier_counts", "v_stories v_articles",
    lambda s, a: cluster_outlier_counts(_by_opening(a.select("id", "title")).select("story_id", "title"), _by_opening(s.select("id", "title")).groupBy(F.col("story_id").alias("id")).agg(F.min("title").alias("title")), L.DATA["states"], L.DATA["generic"], L.DATA["actions"]),
    f"""WITH x AS (SELECT substr(lower(title), 1, 3) AS story_id, title FROM v_articles WHERE trim(title) <> ''), y AS (SELECT substr(lower(title), 1, 3) AS story_id, min(title) AS title FROM v_stories GROUP BY 1),
    k0 AS (SELECT story_id, title, 'i' AS side, {sql_merge_tokens('title')[0]} AS raw FROM y UNION ALL SELECT story_id, title, 'j', {sql_merge_tokens('title')[0]} FROM x), k AS (SELECT *, {sql_distinct_first('raw', 24)} AS tokens, {_STATE_SQL} AS state, {_ENT_SQL} AS ent FROM k0),
    t AS (SELECT *, list_filter(tokens, lambda x: x NOT IN ({q(L.DATA['actions'])}) AND x NOT IN ({q(L.DATA['generic'])})) AS strong, list_filter(tokens, lambda x: x IN ({q(L.DATA['actions'])})) AS action FROM k),
    v AS (SELECT j.story_id, CASE WHEN i.state <> j.state THEN 'state_mismatch' WHEN len(i.ent) >= 2 AND len(j.ent) >= 2 AND len(list_intersect(i.ent, j.ent)) = 0 AND len(list_intersect(i.strong, j.strong)) = 0 AND len(list_intersect(i.action, j.action)) >= 1 THEN 'entity_conflict' END AS veto
      FROM t j JOIN t i ON i.story_id = j.story_id AND i.side = 'i' AND j.side = 'j')
    SELECT story_id, count(*) AS n, count(*) FILTER (WHERE veto = 'state_mismatch') AS state_n, count(*) FILTER (WHERE veto = 'entity_conflict') AS entity_n FROM v GROUP BY 1""",
)


def cluster_title_pick(clusters: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Each cluster's headline from its weightiest source, then newest; with source count and last time."""
    rows = clusters.join(articles, "id").join(sources.select(F.col("id").alias("source_id"), "weight"), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.max_by("title", F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), "ts", "id")).alias("title"), F.count_distinct("source_id").alias("source_count"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


register(
    "cluster_title_pick", "v_articles v_sources", lambda a, s: cluster_title_pick(a.select("id", (F.col("id") % 40).alias("cluster_id")), a, s),
    """SELECT a.id % 40 AS cluster_id, arg_max(title, struct_pack(w := coalesce(weight, 0), t := ts, i := a.id)) AS title, count(DISTINCT source_id) AS source_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM v_articles a LEFT JOIN v_sources s ON s.id = source_id GROUP BY 1""",
)


def local_trends(rows: DataFrame, weeks: int = 8, factor: float = 2.0, least: int = 3) -> DataFrame:
    """(state, topic, week, n, baseline, emerging): weekly counts against the mean of the weeks before, gaps counting as zero.

    rows: (state, topic, ts). Each pair's calendar runs from its first week to its last.
    """
    week = F.to_date(F.date_trunc("week", "ts"))
    n = rows.groupBy("state", "topic", week.alias("week")).agg(F.count("*").alias("n"))
    span = n.groupBy("state", "topic").agg(F.min("week").alias("a"), F.max("week").alias("b")).select("state", "topic", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    dense = span.join(n, ["state", "topic", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("state", "topic").orderBy("week").rowsBetween(-weeks, -1)
    out = dense.withColumn("baseline", F.round(F.coalesce(F.avg("n").over(before), F.lit(0.0)), 4))
    return out.withColumns({"emerging": (F.col("n") >= least) & (F.col("n") >= factor * F.col("baseline")), "week": F.date_format("week", "yyyy-MM-dd")})


_TREND = "SELECT concat('s', user_id % 5) AS state, event_type AS topic, ts FROM events"
register(
    "local_trends", "events", lambda e: local_trends(e.select(F.expr("concat('s', user_id % 5)").alias("state"), F.col("event_type").alias("topic"), "ts"), 3, 1.2),
    f"""WITH r AS ({_TREND}), n AS (SELECT state, topic, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT state, topic, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM n GROUP BY 1, 2),
    d AS (SELECT s.*, coalesce(n.n, 0) AS n FROM s LEFT JOIN n USING (state, topic, week)), b AS (SELECT *, round(coalesce(avg(n) OVER (PARTITION BY state, topic ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 4) AS baseline FROM d)
    SELECT state, topic, strftime(week, '%Y-%m-%d') AS week, n, baseline, n >= 3 AND n >= 1.2 * baseline AS emerging FROM b""",
)


#: Topics of the driver's invented prose; the first pattern that hits names one.
TOPICS = [("budget", "edble"), ("safety", "nicht|pour"), ("teaching", "that")]


def topic_of(t: Column, topics: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(F.lower(t).rlike(p), name) for name, p in topics), F.lit("general"))
