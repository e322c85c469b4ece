"""Quality rules under weak supervision.

Eleven rules look at counts of a text and vote good, bad or abstain. No vote decides: expectation-maximisation over the
counts of vote patterns estimates how accurate each rule is, that is how often it votes which way on good documents and
on each kind of bad ones, and a document is kept when its posterior probability of being good is at least a half.

Rules that look for one flaw see nothing of another, so bad documents are of several kinds. What tells a kind of bad documents
from the noise of a rule is that bad votes of different rules fall on the same documents more often than chance: a kind is
begun from the two rules whose shared bad votes the kinds so far explain least, the fit is run again with it, and so
on until no pair is left unexplained. The chance of each vote under each kind is estimated freely, from a prior of
PRIOR documents. A rule that fires at random, or that no other bears out, therefore loses its say, and a document with its bad vote
alone is kept; two rules that bear each other out are believed.

A document that fails the base rules (fewer than 20 words, or over 30 % of its words in repeated 8-word windows) goes
whatever the votes, and takes no part in the fit.

Counting and voting are SQL expressions over one row; the only shuffle is the count of vote patterns, of which
there are ``3 ** len(RULES)`` at most, so the fit on the driver has a bounded size for any input.

Words and windows are compared by 64-bit hashes within one text, so a false repeat in a text of n words has a
probability of about n^2 / 2^65.

Defined cases: null and blank texts have no words and fail the base rules; an empty table gives an empty result
(the fit then keeps its prior); repeated rows are judged alike, and count as often as they occur in the fit; texts of any length are counted whole;
null ids pass through; other columns are ignored by ``assess`` and kept by ``keep_good``, whatever their names. Bad votes of fewer documents than SURPRISE allows for
(about three that share two bad votes in a few hundred) make no kind. A table in which all documents are bad in the same way has no good ones to tell them from: all are kept that pass the base rules.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.llm.common import SPACE, settle

WINDOW = 8
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_stutters", "n_distinct", "n_symbol_runs", "n_odd_ends",
)
#: (name, numerator, denominator, good up to, bad from): votes good below, bad above, abstains between. Distinct words are set against the words' power 3/4.
RULES = (
    ("symbols", "n_symbols", "n_words", 0.02, 0.15),
    ("symbol_runs", "n_symbol_runs", "n_words", 0.02, 0.1),
    ("odd_ends", "n_odd_ends", "n_words", 0.02, 0.1),
    ("shouts", "n_shouts", "n_words", 0.05, 0.2),
    ("capitals", "n_capitals", "word_chars", 0.15, 0.35),
    ("stutters", "n_stutters", "n_words", 0.05, 0.15),
    ("sameness", "pow(n_words, 0.75)", "n_distinct", 0.55, 0.8),
    ("repeats", "n_repeat_words", "n_words", 0.1, 0.25),
    ("lines", "n_dup_lines", "n_lines", 0.2, 0.5),
    ("long_words", "word_chars", "n_words", 8.0, 14.0),
    ("short_text", "20", "n_words", 0.5, 0.8),
)
#: A run of signs that seldom ends a word, at the end of one.
ODD_END = r"[^\p{L}\p{N}\s.,;:!?()'\"’”»\]]+(?=\s|$)"
#: Votes.
BAD, NONE, GOOD = 0, 1, 2
#: Documents that the expectation of a rule's votes weighs as much as, and that expectation (bad, no, good vote) for good documents and for a kind of bad ones.
PRIOR, PRIOR_GOOD, PRIOR_BAD = 3.0, (0.05, 0.15, 0.8), (1 / 3, 1 / 3, 1 / 3)
#: Pseudo-documents: good ones, and of each kind of bad ones.
PRIOR_KIND = (9.0, 1.0)
#: Natural logarithm of how much likelier the number of documents on which two rules vote bad must be than expected, for a new kind (a Poisson likelihood ratio).
SURPRISE = 9.0
#: Each kind explains a pair of rules, so there are no more kinds of bad documents than pairs; rounds of EM for each, at most, and the change of a posterior that ends them.
KINDS, ROUNDS, STILL = len(RULES) * (len(RULES) - 1) // 2, 500, 1e-9


def sql_let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(hashes: str) -> str:
    """SQL for the number of words that lie in a window found twice or more, from the array of their hashes."""
    window = ", ".join(f"{hashes}[i + {k}]" for k in range(WINDOW))
    windows = f"transform(sequence(0, size({hashes}) - {WINDOW}), i -> xxhash64({window}))"
    flagged = "transform(filter(s, (e, k) -> e.x = get(s, k - 1).x or e.x = get(s, k + 1).x), e -> e.i)"
    covered = f"aggregate(sequence(1, size(p) - 1), bigint({WINDOW}), (a, k) -> a + least({WINDOW}, p[k] - p[k - 1]))"
    places = sql_let(f"array_sort({flagged})", "p", covered)
    found = sql_let("array_sort(transform(g, (x, i) -> struct(x as x, i as i)))", "s", places)
    return f"case when size({hashes}) <= {WINDOW} then 0L else {sql_let(windows, 'g', f'case when size(array_distinct(g)) = size(g) then 0L else {found} end')} end"


def counts_of(text: str = "text") -> list[Column]:
    """The columns of COUNTS."""
    space = SPACE.replace("\\", "\\\\")
    t = f"coalesce({text}, '')"
    lines = f"filter(split({t}, '\\n'), l -> l rlike '{SPACE.replace('[', '[^').replace('+', '')}')".replace("\\x", "\\\\x")
    fields = {
        "n_words": "bigint(size(h))",
        "n_distinct": "bigint(size(array_distinct(h)))",
        "n_repeat_words": repeat_words("h"),
        "n_stutters": "bigint(size(filter(h, (v, i) -> v = get(h, i - 1))))",
    }
    words = f"filter(split({t}, '{space}'), v -> v <> '')"
    packed = F.expr(sql_let(f"transform({words}, v -> xxhash64(v))", "h", "struct(" + ", ".join(f"{sql} as {name}" for name, sql in fields.items()) + ")"))
    split_lines = F.expr(sql_let(lines, "l", "struct(bigint(size(l)) as n_lines, bigint(size(l) - size(array_distinct(l))) as n_dup_lines)"))
    left = lambda pattern: F.expr(f"bigint(char_length(regexp_replace({t}, '{pattern}', '')))")
    found = lambda pattern: F.expr(f"bigint(regexp_count({t}, '{pattern}'))")
    return [
        packed.alias("_w"), split_lines.alias("_l"), left(space).alias("word_chars"), left("[^#*$%&|<>]+").alias("n_symbols"), left("[^A-Z]+").alias("n_capitals"), left("[^!]+").alias("n_shouts"),
        found("[#*$%&|<>]+").alias("n_symbol_runs"), found(ODD_END.replace("\\", "\\\\").replace("'", "\\'")).alias("n_odd_ends"),
    ]


def features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the columns of COUNTS, one row for each document."""
    wide = docs.select(*keep, *counts_of())
    kept = [c for c in wide.columns if c not in ("_w", "_l", *COUNTS)]
    at = {c: f"_w.{c}" for c in ("n_words", "n_distinct", "n_repeat_words", "n_stutters")} | {c: f"_l.{c}" for c in ("n_lines", "n_dup_lines")}
    return wide.select(*kept, *[F.col(at.get(c, c)).alias(c) for c in COUNTS])


def votes() -> list[Column]:
    """Of each rule: BAD, NONE or GOOD."""
    out = []
    for _, num, den, good, bad in RULES:
        n = F.expr(num)
        out.append(F.when(n > F.col(den) * bad, BAD).when(n <= F.col(den) * good, GOOD).otherwise(NONE))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def estimate(one: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM from given shares of the kinds in each pattern: log share of each kind, log chance of each vote of each rule by kind, and the new shares."""
    kinds = len(share)
    prior = PRIOR * np.array([PRIOR_GOOD] + [PRIOR_BAD] * (kinds - 1))[:, None, :]
    more = np.array([PRIOR_KIND[0]] + [PRIOR_KIND[1]] * (kinds - 1))
    flat = one.reshape(len(n), len(RULES) * 3)
    for _ in range(ROUNDS):
        weight = share * n
        kind = np.log((weight.sum(1) + more) / (n.sum() + more.sum()))
        vote = (weight @ flat).reshape(kinds, len(RULES), 3) + prior
        vote = np.log(vote / vote.sum(2, keepdims=True))
        total = kind[:, None] + vote.reshape(kinds, len(RULES) * 3) @ flat.T
        new = np.exp(total - total.max(0))
        new /= new.sum(0)
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < STILL:
            break
    return kind, vote, share


def expect(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    """From (votes, number of documents): log share of each kind, the good one first, and log chance of each vote of each rule by kind."""
    one = np.array([[[float(x == v) for v in (BAD, NONE, GOOD)] for x in votes] for votes, _ in patterns]).reshape(len(patterns), len(RULES), 3)
    n = np.array([k for _, k in patterns], float)
    share, bad = np.ones((1, len(n))), one[:, :, BAD]
    for _ in range(KINDS + 1):
        kind, vote, share = estimate(one, n, share)
        shared = np.triu((bad * n[:, None]).T @ bad, 1)
        weight = share * n
        fires = weight @ bad  # of each kind, by rule: without the prior, which would expect votes that nobody cast
        expected = (fires / np.maximum(weight.sum(1), 1e-300)[:, None]).T @ fires
        surprise = np.where(shared > expected, shared * np.log(np.maximum(shared, 1) / np.maximum(expected, 1e-300)) - (shared - expected), 0)
        i, j = np.unravel_index(surprise.argmax(), surprise.shape)
        if surprise[i, j] < SURPRISE:
            break
        both = bad[:, i] * bad[:, j] > 0
        share = np.concatenate([share * np.where(both, 1e-3, 1), np.where(both, 1 - 1e-3, 0)[None]])
    return kind, vote


def fit(voted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """EM over the documents that pass the base rules, from rows with COUNTS."""
    names = [f"v{j}" for j in range(len(RULES))]
    chosen = voted.where(~base_failed()).select(*[v.alias(n) for v, n in zip(votes(), names, strict=True)])
    rows = chosen.groupBy(*names).count().orderBy(*names).collect()  # 3 ** len(RULES) at most
    return expect([(tuple(r[:-1]), r[-1]) for r in rows])


def posterior(model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Probability of being good, from the votes."""
    kind, vote = model
    against = []
    for k in range(1, len(kind)):
        odds = F.lit(float(kind[k] - kind[0]))
        for cast, by in zip(votes(), (vote[k] - vote[0]).tolist(), strict=True):
            odds = odds + F.when(cast == BAD, by[BAD]).when(cast == GOOD, by[GOOD]).otherwise(by[NONE])
        against.append(F.exp(odds))
    return 1 / (1 + sum(against, F.lit(0.0)))


def verdict(counted: DataFrame) -> DataFrame:
    """Add base_failed, posterior and kept to rows with COUNTS, which are read twice."""
    model = fit(counted)
    return counted.select("*", base_failed().alias("base_failed"), posterior(model).alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def assess(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, COUNTS, base_failed, posterior, kept), one for each document."""
    return verdict(settle(features(docs, [F.col("doc_id")]), "rule-counts"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns; names of other columns cannot clash.

    Rows and counts are written once to the shared folder, so texts are counted once.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return verdict(settle(features(packed, [F.col("_row")]), "rule-counts")).where("kept").select("_row.*")
