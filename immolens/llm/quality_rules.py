"""Quality by weak supervision: rules vote or abstain, expectation-maximisation with
priors on their error rates weighs them, and the posterior probability of quality decides.

DataFrame functions only.  A text's measures come from arrays of its own row (no
shuffle): repeated windows are found by sorting one long per window, a hash above
the window's position, and comparing neighbours word by word.  The measures are
written once, a row of numbers per document; votes are counted by pattern (at
most 3 to the power of the rules), and the estimates are made from those counts.

Cases: null, empty or blank text has no word and fails the base rule; repeated
rows and null ids are judged row by row; an empty table keeps the prior and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import WHITESPACE, table, written

MIN_WORDS = 50                  # fixed by the contract
MAX_REPEAT_PERCENT = 50         # fixed by the contract
ROUNDS = 500                    # of expectation-maximisation, at most
SMOOTHING = 2.0                 # votes added to each side of an estimate
PRIOR = 0.8                     # share of good texts that is expected at least
EXPECT = 2.0                    # how much that weighs, as a share of the texts
TRUST = 0.03                    # how much beliefs in rules weigh, as a share of the texts
BELIEF = 0.002                  # chance of a false vote against, where nothing else is said
EMPTY: frozenset = frozenset()
KEEP_FROM = 0.5                 # posterior probability

#: name -> (measure, votes against, votes for); neither: the rule abstains
RULES = {
    "length": ("n_words", "x < 20", "x >= 80"),
    "symbols": ("n_symbols / n_words", "x > 0.3", "x < 0.05"),
    "capitals": ("n_capitals / word_chars", "x > 0.4", "x < 0.2"),
    "emphasis": ("n_marks / n_words", "x > 0.4", "x < 0.15"),
    "line_copies": ("n_dup_lines / n_lines", "x > 0.5", "x < 0.2"),
    "repeats": ("n_repeat_words / n_words", "x > 0.4", "x < 0.2"),
    "vocabulary": ("n_distinct / sqrt(n_words)", "x < 2", "x > 4"),
    "word_length": ("word_chars / n_words", "x < 2.5 or x > 14", "x between 3 and 11"),
}

#: rules that see the same thing -> how often they are believed to be wrong about a good
#: text; being short is a weak reason, so short texts are judged by the other rules
GROUPS = {
    ("length",): 0.05,
    ("symbols", "capitals", "emphasis"): BELIEF,
    ("line_copies", "repeats", "vocabulary"): BELIEF,
    ("word_length",): BELIEF,
}


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of numbers per input row."""
    words = F.array_remove(F.split("t", WHITESPACE, -1), "")
    one = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    two = one.select("doc_id", "t", words.alias("w"),
                     F.expr("filter(split(t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
                     .alias("lines"))
    # the low bits of a long hold a window's position, the others its hash
    three = two.select(
        "doc_id", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long")
        .alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}", ""))).cast("long")
        .alias("n_capitals"),
        (F.length("t") - F.length(F.regexp_replace("t", "[!?]", ""))).cast("long")
        .alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.expr("shiftleft(-1L, length(bin(size(w))))").alias("high"))
    numbers = [c for c in three.columns if c not in ("w", "high")]
    four = three.select(*numbers, "w", "high", F.expr(
        "sort_array(transform(if(size(w) < 3, array(), sequence(0, size(w) - 3)), i -> "
        "(xxhash64(w[i], w[i + 1], w[i + 2]) & high) | cast(i as bigint)))").alias("p"))

    def same(other: str) -> str:
        words = " and ".join(
            f"w[cast(x & ~high as int) + {k}] = w[cast({other} & ~high as int) + {k}]"
            for k in range(3))
        return f"coalesce((x & high) = ({other} & high), false) and {words}"

    five = four.select(*numbers, F.expr(
        "sort_array(transform(filter(p, (x, i) -> "
        f"({same('get(p, i - 1)')}) or ({same('get(p, i + 1)')})), x -> x & ~high))").alias("at"))
    covered = F.expr(
        "aggregate(at, named_struct('e', 0L, 'n', 0L), (a, s) -> named_struct("
        "'e', s + 3, 'n', a.n + s + 3 - greatest(s, a.e)), a -> a.n)")
    return five.select(*numbers, covered.alias("n_repeat_words"))


def vote(name: str) -> Column:
    """-1 against quality, 1 for it, 0 no opinion (also where the measure is undefined)."""
    measure, against, for_it = RULES[name]
    top, _, below = measure.partition(" / ")
    x = f"try_divide({top}, {below})" if below else top
    return F.expr("case " + " ".join(
        f"when {rule.replace('x', f'({x})')} then {v}"
        for rule, v in ((against, -1), (for_it, 1))) + " else 0 end")


@dataclass(frozen=True)
class Model:
    """``weights``: of each group, the log likelihood ratio of quality by the set of
    its rules that vote against; the empty set stands for votes for quality only."""
    prior: float
    weights: tuple[dict[frozenset, float], ...]
    groups: tuple[tuple[int, ...], ...]
    good: tuple[dict[frozenset, float], ...] = ()       # chance of each set in good texts
    bad: tuple[dict[frozenset, float], ...] = ()

    def posterior(self, votes) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(
            w[s] for w, s in zip(self.weights, seen(votes, self.groups), strict=True)
            if s is not None)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def accuracies(self) -> dict[int, tuple[float, float]]:
        """Of each rule, the share of bad texts it votes against and of good ones it
        doesn't, among those that its group has an opinion on."""
        return {j: (sum(p for s, p in b.items() if j in s), 1 - sum(p for s, p in g.items() if j in s))
                for group, g, b in zip(self.groups, self.good, self.bad, strict=True) for j in group}


def seen(votes, groups) -> list[frozenset | None]:
    """What each group says: the rules that vote against, None if all abstain."""
    return [frozenset(j for j in group if votes[j] < 0) if any(votes[j] for j in group) else None
            for group in groups]


def _false_rate(against: float, total: float, k: float, believed: float) -> float:
    """The x that maximises against log x + (total - against) log(1 - x) - k log(1 + x / believed)."""
    k = min(k, total / 2)
    middle = against * (1 - believed) - (total - against) * believed - k
    return ((middle + math.sqrt(middle * middle + 4 * (total - k) * against * believed))
            / (2 * (total - k)))


def _climb(told: list, start: list[float], groups, beliefs, total: int) -> tuple[float, Model]:
    """Expectation-maximisation from given posteriors: (log posterior, model)."""
    sets = [sorted({t[g] for t, _ in told if t[g]} | {frozenset((j,)) for j in group}, key=sorted)
            for g, group in enumerate(groups)]
    p, last = start, -math.inf
    for _ in range(ROUNDS):
        mass = sum(n * q for (_, n), q in zip(told, p, strict=True))
        prior = min(0.99, (mass + PRIOR) / (total + 1))
        less = prior < PRIOR                    # a flat prior above, a slope below
        prior = (prior + EXPECT * PRIOR) / (1 + EXPECT) if less else prior
        good, bad, penalty = [], [], 0.0
        for g, (own, believed) in enumerate(zip(sets, beliefs, strict=True)):
            # votes for quality only are counted as the empty set
            counts = {s: [believed * SMOOTHING, SMOOTHING / len(own)] for s in own}
            counts[EMPTY] = [SMOOTHING, SMOOTHING]
            for (t, n), q in zip(told, p, strict=True):
                if t[g] is not None:
                    counts[t[g]][0] += n * q
                    counts[t[g]][1] += n * (1 - q)
            of_good, of_bad = (sum(c[k] for c in counts.values()) for k in (0, 1))
            false = {s: _false_rate(counts[s][0], of_good, TRUST * total, believed) for s in own}
            # together at most one half, so that the empty set keeps its sign
            scale = min(1.0, 0.5 / sum(false.values()))
            false = {s: x * scale for s, x in false.items()}
            true = {s: max(counts[s][1] / of_bad, false[s]) for s in own}
            scale = min(1.0, (1 - 1e-6) / sum(true.values()))
            good.append(false | {EMPTY: 1 - sum(false.values())})
            bad.append({s: x * scale for s, x in true.items()}
                       | {EMPTY: 1 - scale * sum(true.values())})
            penalty += TRUST * total * sum(math.log1p(x / believed) for x in false.values())
        if less:
            penalty += EXPECT * total * (PRIOR * math.log(PRIOR / prior)
                                         + (1 - PRIOR) * math.log((1 - PRIOR) / (1 - prior)))
        value, p = -penalty, []
        for t, n in told:
            x, y = prior, 1 - prior
            for g, s in enumerate(t):
                if s is not None:
                    x, y = x * good[g][s], y * bad[g][s]
            value += n * math.log(x + y)
            p.append(x / (x + y))
        if value - last < 1e-9 * total:
            break
        last = value
    weights = tuple({s: min(0.0, math.log(x[s] / y[s])) if s else max(0.0, math.log(x[s] / y[s]))
                     for s in x} for x, y in zip(good, bad, strict=True))
    return value, Model(prior, weights, tuple(groups), tuple(good), tuple(bad))


def estimate(counted: list[tuple[tuple[int, ...], int]], groups=None, beliefs=None) -> Model:
    """The model of vote patterns (votes, number of texts) that is likeliest after the data.

    Rules that see the same thing form a group, whose votes are not independent: each
    set of its rules that vote together has a chance of its own in good and in bad texts.
    A text that one set alone votes against can be a bad one that the others miss or a
    good one, which votes can't tell.  There the belief in the rules counts: a set's chance
    x among good texts has the prior (1 + x / belief) ^ (-``TRUST`` * texts), which
    is heavy-tailed, so rare lone votes are trusted at every size of the table and
    frequent ones are outweighed by what the other rules say, nearly unbiased.
    A share of ``PRIOR`` of good texts or more is expected; a smaller one costs as much
    as if ``EXPECT`` times the texts had that share.

    The estimate climbs from the start that doubts each text with a vote against,
    then from starts that pardon one more rule or set; it keeps the best.
    """
    rules = len(counted[0][0]) if counted else 0
    groups = [(j,) for j in range(rules)] if groups is None else groups
    beliefs = [BELIEF] * len(groups) if beliefs is None else beliefs
    if not counted:
        return Model(PRIOR, tuple({} for _ in groups), tuple(groups))
    merged: dict[tuple, int] = {}
    for votes, n in counted:
        key = tuple(seen(votes, groups))
        merged[key] = merged.get(key, 0) + n
    told = list(merged.items())
    total = sum(merged.values())

    def climb(pardoned: frozenset) -> tuple[float, Model]:
        doubts = [any(s and s not in pardoned for s in t) for t, _ in told]
        return _climb(told, [0.1 if d else 0.95 for d in doubts], groups, beliefs, total)

    # what can be pardoned at once: a set, or all sets that hold a rule
    sets = {s for t, _ in told for s in t if s}
    choices = {frozenset((s,)) for s in sets} | {
        frozenset(s for s in sets if j in s) for j in range(rules)} - {frozenset()}
    choices = sorted(choices, key=lambda c: sorted(sorted(s) for s in c))
    pardoned, best = frozenset(), climb(frozenset())
    while True:
        tried = [(climb(pardoned | c), pardoned | c) for c in choices if not c <= pardoned]
        better = max(tried, key=lambda x: x[0][0], default=None)
        if better is None or better[0][0] <= best[0] + 1e-6 * total:
            return best[1]
        best, pardoned = better


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` (stored) with votes, probability and verdict."""
    names = list(RULES)
    voted = measured.select("*", *(vote(n).alias(f"vote_{n}") for n in names))
    columns = [f"vote_{n}" for n in names]
    counted = [(tuple(r[c] for c in columns), r["n"])
               for r in voted.groupBy(*columns).agg(F.count("*").alias("n")).collect()]
    model = estimate(sorted(counted), [tuple(map(names.index, g)) for g in GROUPS],
                     list(GROUPS.values()))
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for group, weights in zip(model.groups, model.weights, strict=True):
        own = [F.col(columns[j]) for j in group]
        against = F.array_compact(F.array(*(F.when(c < 0, F.lit(j))
                                            for c, j in zip(own, group, strict=True))))
        evidence = F.when(F.lit(False), F.lit(0.0))
        for s in sorted(weights, key=sorted):
            opinion = F.lit(True) if s else reduce(lambda a, b: a | b, (c > 0 for c in own))
            evidence = evidence.when((against == F.array(*map(F.lit, sorted(s))).cast("array<int>"))
                                     & opinion, F.lit(weights[s]))
        odds = odds + evidence.otherwise(F.lit(0.0))
    return voted.withColumn("probability", 1 / (1 + F.exp(-odds)))


def query(spark, sf_dir) -> DataFrame:
    judged = judge(written(measures(table(spark, sf_dir, "documents")), "quality-measures"))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("probability") >= KEEP_FROM)).alias("kept"), "probability")
