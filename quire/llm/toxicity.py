"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult and threat (with weights), target, negation, report, other.
Small transducers rewrite the symbols of a clause, each reading what the one before has written:
the first marks insults and threats in the scope of a negation, and turns a negated reporting word
into a denial; the second marks what a report or a denial says; the third what is aimed at a
target. They are composed into a single deterministic machine, run over each clause that holds an
insult or threat. A clause counts once for each kind of match in it, with its greatest weight, and
a logistic layer over the kinds, trained on a bounded sample of labels, gives the score. Insults
and threats beyond the seed words are learned from the same sample, as words and stems that occur
in many different contexts of toxic texts and in hardly any others; those that mostly follow a word
of intent are threats.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't didn't ne pas jamais nicht kein keine nie nunca jamás".split()
TARGETS = "you your you're yours he she they them him her those these tu vous toi ton votre du ihr dich euch usted ustedes tú".split()
REPORTS = "said says saying wrote writes quoted called claims claimed reported according dit selon sagte laut dijo según".split()
INTENTS = "will shall gonna i'll we'll going to vais va werde werden wird voy vamos".split()
THREATS = {"kill": 2.0, "murder": 2.0, "hurt": 1.5, "shoot": 1.5, "stab": 2.0, "beat": 1.0, "burn": 1.0, "destroy": 1.0, "tuer": 2.0, "töten": 2.0, "matar": 2.0}
INSULTS = {"idiot": 2.0, "moron": 2.0, "imbecile": 2.0, "stupid": 1.5, "scum": 2.0, "loser": 1.5, "pathetic": 1.5, "worthless": 1.5, "disgusting": 1.0, "trash": 1.0}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:,\n\r\t|]+")
#: Lengths of the stems that are tried.
STEMS = range(4, 9)
#: Symbols; insults and threats take eight each, as marks are added to their number.
OTHER, TARGET, NEGATION, REPORT, DENIAL, INSULT, THREAT, SYMBOLS = 0, 1, 2, 3, 4, 5, 13, 21
NEGATED, REPORTED, AIMED = 1, 2, 4


def marked(symbol: int, marks: int) -> int:
    """An insult or threat with more marks; other symbols as they are."""
    return symbol if symbol < INSULT else INSULT + ((symbol - INSULT) | marks)


class Transducer:
    """A deterministic machine: ``table[state][symbol]`` is (state, symbol written); it begins in state 0."""

    def __init__(self, table: list[list[tuple[int, int]]]):
        self.table = table

    def compose(self, after: Transducer) -> Transducer:
        """One machine that writes what ``after`` writes on reading what this one writes."""
        n = len(after.table)
        out = []
        for mine in self.table:
            for q in range(n):
                steps = ((p, *after.table[q][written]) for p, written in mine)
                out.append([(p * n + r, last) for p, r, last in steps])
        return Transducer(out)

    def run(self, symbols: list[int]) -> list[int]:
        state, out, table = 0, [], self.table
        for s in symbols:
            state, written = table[state][s]
            out.append(written)
        return out


def negation(reach: int = 3) -> Transducer:
    """Marks insults and threats, and makes reports denials, up to ``reach`` words after a negation."""
    rows = []
    for left in range(reach + 1):
        after = max(0, left - 1)
        rows.append([(reach if s == NEGATION else after, DENIAL if left and s == REPORT else marked(s, NEGATED if left else 0)) for s in range(SYMBOLS)])
    return Transducer(rows)


def reporting() -> Transducer:
    """Marks all that follows a report in the clause; after a denial it is negated, too."""
    marks = (0, REPORTED, REPORTED | NEGATED)
    return Transducer([[(1 if s == REPORT else 2 if s == DENIAL else state, marked(s, marks[state])) for s in range(SYMBOLS)] for state in range(3)])


def aiming(reach: int = 4) -> Transducer:
    """Marks insults and threats up to ``reach`` words after a target."""
    return Transducer([[(reach if s == TARGET else max(0, left - 1), marked(s, AIMED if left else 0)) for s in range(SYMBOLS)] for left in range(reach + 1)])


GRAMMAR = negation().compose(reporting()).compose(aiming())
#: insult or threat, times the marks; the last feature is the number of matched clauses.
KINDS = 2 * 8


@dataclass
class Model:
    insults: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    threats: dict[str, float] = field(default_factory=lambda: dict(THREATS))
    weights: np.ndarray = field(default_factory=lambda: np.array([1.5, 1.5, 0.2, 0.2, 0.4, 0.4, 0.1, 0.1] + [1.5, 2.0, 0.2, 0.2, 0.4, 0.4, 0.1, 0.1] + [0.5]))
    bias: float = -2.5

    def __post_init__(self) -> None:
        self.symbols = dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(REPORTS, REPORT)
        self.symbols |= dict.fromkeys(self.threats, THREAT) | dict.fromkeys(self.insults, INSULT)
        self.memo: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word; recent ones are kept."""
        if word not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            symbol = self.symbols.get(word, OTHER)
            weight = self.insults.get(word, 0.0) if symbol == INSULT else self.threats.get(word, 0.0)
            if symbol == OTHER:
                weight, symbol = max(*((self.insults.get(p, 0.0), INSULT) for p in patterns(word)), *((self.threats.get(p, 0.0), THREAT) for p in patterns(word)))
                symbol = symbol if weight else OTHER
            self.memo[word] = symbol, weight
        return self.memo[word]

    def features(self, text: str | None, grammar: Transducer | None = None) -> np.ndarray:
        """Saturated weight of each kind of match over the clauses of the whole text."""
        grammar = grammar or GRAMMAR
        out = np.zeros(KINDS + 1)
        text = (text or "").lower()
        hits = {w for w in set(WORD.findall(text)) if self.read(w)[0] >= INSULT}
        if not hits:
            return out
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if hits.isdisjoint(words):
                continue
            read = [self.read(w) for w in words]
            most: dict[int, float] = {}
            for (_, weight), s in zip(read, grammar.run([s for s, _ in read]), strict=True):
                if s >= INSULT:
                    # reordered so that the marks of aim come first in a kind
                    marks = (s - INSULT) % 8
                    kind = (s - INSULT) // 8 * 8 + (marks & AIMED) // 4 + 2 * (marks & (NEGATED | REPORTED))
                    most[kind] = max(most.get(kind, 0.0), weight)
            for kind, weight in most.items():
                out[kind] += weight
            out[KINDS] += 1
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int) -> DataFrame:
    """Up to ``per_class`` documents of either label, by least hash of the key: doc_id, text, toxic.

    Several labels of a document count as toxic if one is; null labels teach nothing.
    """
    rows = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    few = rows.where("toxic = 1").orderBy("h").limit(per_class).unionByName(rows.where("toxic = 0").orderBy("h").limit(per_class))
    found = docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id", "toxic")), "doc_id")  # at most 2 * per_class rows
    return found.where("text IS NOT NULL").dropDuplicates(["toxic", "text"])


def patterns(word: str) -> list[str]:
    """The word, and its beginnings with a star: forms that differ in their endings share one."""
    return [word, *(f"{word[:n]}*" for n in STEMS if n < len(word))]


def learn_patterns(rows: DataFrame, limit: int = 2000, least: int = 8, ratio: float = 12.0, intent: float = 0.5) -> tuple[dict[str, float], dict[str, float]]:
    """Insults and threats: patterns of toxic texts that hardly occur elsewhere, in ``least`` or more
    different contexts; threats are those with a word of intent before them in a share ``intent`` of these.

    The odds of a pattern must be ``ratio`` or more, even two standard errors of their logarithm
    lower. Contexts (the words beside) keep out the words of one text that was copied often. Of
    patterns that cover one another the one in most toxic texts stays, or the whole word if it
    alone makes up four fifths of a stem. ``limit`` bounds the patterns, of ``rows`` that are a
    bounded sample themselves: those in most contexts stay.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toxic: Counter[str] = Counter()
            clean: Counter[str] = Counter()
            for text, t in zip(pdf["text"], pdf["toxic"], strict=True):
                (toxic if t else clean).update({p for w in set(WORD.findall(text.lower())) for p in patterns(w)})
            keys = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"word": keys, "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]})

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}, {}
    counts = rows.select("text", "toxic").mapInPandas(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = counts.where((F.col("a") >= least) & (F.log(odds) - 2 * error >= math.log(ratio))).orderBy(F.desc("a"), F.length("word"), "word").limit(4 * limit).toPandas()
    times = dict(zip(top["word"], top["a"], strict=True))
    for w in [w for w in times if not w.endswith("*")]:
        for p in patterns(w)[1:]:
            if times[w] >= 0.8 * times.get(p, math.inf):
                del times[p]
    known: set[str] = set()
    for w in times:  # most frequent first
        if known.isdisjoint(patterns(w.rstrip("*"))):
            known.add(w)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for text in pdf["text"]:
                w = WORD.findall(text.lower())
                out.update((p, " ".join(w[max(0, i - 1) : i + 2]), bool(i and w[i - 1] in INTENTS)) for i, x in enumerate(w) for p in patterns(x) if p in known)
            yield pd.DataFrame(sorted(out), columns=["word", "context", "meant"])

    varied = rows.where("toxic = 1").select("text").mapInPandas(contexts, "word string, context string, meant boolean").distinct()
    varied = varied.groupBy("word").agg(F.count("*").alias("c"), F.count_if("meant").alias("meant")).toPandas()
    top = top.merge(varied, on="word")
    top = top[(top["c"] >= least) & (top["c"] >= 0.25 * top["a"])].sort_values(["c", "word"], ascending=[False, True]).head(limit)
    weight = {w: min(3.0, math.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))) / 2) for w, a, b in zip(top["word"], top["a"], top["b"], strict=True)}
    threats = {w for w, c, m in zip(top["word"], top["c"], top["meant"], strict=True) if m >= intent * c}
    return {w: v for w, v in weight.items() if w not in threats}, {w: v for w, v in weight.items() if w in threats}


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int = 3000) -> Model:
    """Learn from at most ``per_class`` documents of either label; seed weights stay without any."""
    rows = materialize(labelled(docs, labels, learn, per_class), "labelled")
    base = Model()
    insults, threats = learn_patterns(rows)
    insults, threats = {w: v / 2 for w, v in base.insults.items() if w not in threats} | insults, {w: v for w, v in base.threats.items() if w not in insults} | threats
    shared = docs.sparkSession.sparkContext.broadcast(Model(insults, threats))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "f": [shared.value.features(t) for t in pdf["text"]]})

    found = rows.mapInPandas(extract, "doc_id long, toxic int, f array<double>").toPandas().sort_values(["doc_id", "toxic"])
    if found["toxic"].nunique() < 2:
        return Model(insults, threats)
    x, y = np.stack(found["f"].to_numpy()), found["toxic"].to_numpy(np.float64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    prior = base.weights
    w, b = prior.copy(), base.bias
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = weight * (p - y) / len(y)
        w -= 2.0 * (x.T @ g + 0.0005 * (w - prior))
        b -= 2.0 * g.sum()
    return Model(insults, threats, w, float(b))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted; null and empty texts get the score of no match."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([float(model.score(model.features(t))) for t in texts], dtype="float64")

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn("__score", rate(F.col(text_col))).select(*keep, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
