"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at one trait of a text and votes good (1), bad (-1) or abstains (0). No rule decides: how
accurate each is, on good texts and on bad ones, is estimated by expectation-maximisation from how they
agree, and a text is kept if the posterior probability that it is good is at least `keep_from`.

The documents are read once. Traits and votes are written; what the estimation needs of them is the number
of texts with each combination of votes, at most 3 ** len(RULES) rows whatever the corpus, which one
combined aggregate gives. The rounds are arithmetic on these rows; the posterior is a compiled expression of
the votes.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are each judged
(and counted); null ids are kept as such; extra columns are not looked at; of an empty table there are no
rows, and the rates stay as they start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_of

BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Letters, with marks of punctuation about and between them.
PLAIN = "^[\"'(\\[«“„¿¡-]*\\p{L}[\\p{L}\\p{M}'’-]*[.,;:!?\"')\\]»”।。،؟-]*$"
#: The end of a sentence, with the blank after it.
STOP = f"[.!?。؟।][\"')\\]”»]*(?:[{BLANK}]|\\z)"


@dataclass(frozen=True)
class Rule:
    """Votes good where `good` holds of the traits, bad where `bad` does, else not at all. Both are SQL."""

    name: str
    good: str
    bad: str


#: Shares are compared as products of whole numbers, so that no rounding decides.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("variety", "n_words < 400 and 10 * n_different >= 4 * n_words or n_words >= 400 and 10 * n_different >= n_words", "20 * n_different < n_words"),
    Rule("signs", "100 * n_symbols <= word_chars", "25 * n_symbols > word_chars"),
    Rule("plain", "10 * n_plain >= 9 * n_words", "10 * n_plain < 7 * n_words"),
    Rule("sentences", "n_stops > 0 and 60 * n_stops >= n_words", "n_stops = 0 or 200 * n_stops < n_words"),
)


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    #: Where the estimation starts: the share of good texts, and the chances of (bad, no, good) votes on good and on bad ones.
    start_good: float = 0.8
    start_on_good: tuple[float, float, float] = (0.05, 0.25, 0.7)
    start_on_bad: tuple[float, float, float] = (0.35, 0.25, 0.4)
    #: No chance gets closer to 0 or 1, so that no rule decides alone.
    least: float = 0.01
    keep_from: float = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+", -1), lambda w: w != "")


def repeated(hashes: Column, grams: Column) -> Column:
    """Words inside three-word windows that occur twice or more. grams: array of (hash, place), sorted.

    Equal windows are neighbours after sorting. The places of windows with an equal neighbour, in order,
    cover three words each, less what the next one covers too.
    """
    same = lambda i, j: F.get(grams, i)["g"] == F.get(grams, j)["g"]
    twice = F.transform(grams, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"]))
    places = F.sort_array(F.filter(twice, lambda p: p.isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    walk = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, walk, lambda s: s["n"])


def traits(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at. Windows of three words are compared by 64-bit hashes within their text."""
    rows = documents.select("doc_id", text_of().alias("text"))
    left = lambda c, chars: F.length(F.translate(c, chars, ""))
    rows = rows.select(
        "doc_id", words_of(F.col("text")).alias("w"), left(F.col("text"), BLANK).cast("long").alias("word_chars"),
        (F.length("text") - left(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")).alias("lines"),
        F.regexp_count("text", F.lit(STOP)).cast("long").alias("n_stops"),
    )
    rows = rows.withColumns({"h": F.transform("w", lambda x: F.xxhash64(x))})
    window = lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2))
    rows = rows.withColumns({"g": F.transform(F.expr("slice(h, 1, greatest(size(h) - 2, 0))"), window)})
    doubled = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.when(doubled, F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "doc_id", long(F.size("w")).alias("n_words"), "word_chars", "n_symbols", long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), long(F.size(F.array_distinct("h"))).alias("n_different"),
        long(F.size(F.filter("w", lambda x: x.rlike(PLAIN)))).alias("n_plain"), "n_stops", "h", placed.alias("placed"),
    )
    return rows.withColumn("n_repeat_words", F.coalesce(repeated(F.col("h"), F.col("placed")), F.lit(0).cast("long"))).drop("h", "placed")


def votes(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with `vote_<rule>`; a text without words gets no vote but from a rule whose `bad` says so."""
    return rows.withColumns({f"vote_{r.name}": F.expr(f"case when {r.bad} then -1 when n_words > 0 and ({r.good}) then 1 else 0 end") for r in rules})


@dataclass(frozen=True)
class Model:
    """The share of good texts; for each rule the chances of its votes (bad, none, good) on good texts and on bad ones."""

    good: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def weights(self) -> list[tuple[float, float, float]]:
        """What each vote of each rule adds to the log odds; a good vote never speaks against a text, nor a bad one for it."""
        of = [tuple(math.log(g / b) for g, b in zip(*both)) for both in zip(self.on_good, self.on_bad)]
        return [(min(w[0], 0.0), w[1], max(w[2], 0.0)) for w in of]


def fit(counts: list[tuple[tuple[int, ...], int]], settings: Settings | None = None, rules: int = len(RULES)) -> Model:
    """Expectation-maximisation over the number of texts with each combination of votes; sums run in the order of combinations."""
    s, counts = settings or Settings(), sorted(counts)
    model = Model(s.start_good, (s.start_on_good,) * rules, (s.start_on_bad,) * rules)
    total = sum(n for _, n in counts)
    bounded = lambda x: min(max(x, s.least), 1 - s.least)
    for _ in range(s.rounds if total else 0):
        weights = model.weights()
        rated = [(v, n, _posterior(v, model.good, weights)) for v, n in counts]
        good = sum(n * p for _, n, p in rated)
        share = lambda j, vote, of, whole: bounded((sum(n * of(p) for v, n, p in rated if v[j] == vote) + s.least) / (whole + 3 * s.least))  # noqa: B023, E731
        on_good = tuple(tuple(share(j, vote, lambda p: p, good) for vote in (-1, 0, 1)) for j in range(rules))
        on_bad = tuple(tuple(share(j, vote, lambda p: 1 - p, total - good) for vote in (-1, 0, 1)) for j in range(rules))
        model = Model(bounded(good / total), on_good, on_bad)
    return model


def _posterior(votes: tuple[int, ...], good: float, weights: list[tuple[float, float, float]]) -> float:
    return 1 / (1 + math.exp(-math.log(good / (1 - good)) - sum(w[v + 1] for v, w in zip(votes, weights))))


def probability(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    """The posterior as an expression of the votes."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for r, (bad, none, good) in zip(rules, model.weights()):
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judged(documents: DataFrame, settings: Settings | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Traits, votes, probability, base_failed and kept of every document."""
    s = settings or Settings()
    rows = keep(votes(traits(documents), rules), "votes")
    names = [f"vote_{r.name}" for r in rules]
    met = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()  # 3 ** len(rules) rows at most
    model = fit([(tuple(r[n] for n in names), r["n"]) for r in met], s, len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumns({"probability": probability(model, rules), "base_failed": failed})
    return rows.withColumn("kept", ~failed & (F.col("probability") >= s.keep_from))


def quality(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    found = judged(documents, settings)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
