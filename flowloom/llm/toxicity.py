"""Toxicity by a learned lexicon, misspellings of its terms, and their surroundings.

The lexicon has words and stems (beginnings) that mark toxic training texts.
Its trie is intersected with the Levenshtein automaton of each word: a state is
the set of (trie node, edits so far) that are still possible, states are made
deterministic as they are met, and most words leave the automaton after a few
letters.  Terms of ``FUZZY`` letters or more match with one edit.  A token with
digits or symbols inside (``id1ot``, ``wor-thless``) goes through the automaton whole
if none of the runs of letters in it matches.

Each match is looked at in a window of ``WINDOW`` words: whether it stands in
quotation marks, is reported or named as a word, or is aimed at the reader.  A
logistic regression over these counts gives the score, so that quotation and
abuse weigh what the training labels say.

Lexicon and regression are fitted on the driver to at most about ``PER_CLASS``
labelled texts of each class, chosen by a hash of the id, and to fewer where those
would have more than ``CLASS_BYTES`` bytes.  Scoring runs in tasks over whole texts.

* NULL, empty and harmless texts get the score of a text without any match.
* Of several labels of one document the highest counts; NULL labels count not.
* Without labels of both classes there is nothing to learn and every score is 0.
* Repeated rows get equal scores.  Columns of the same names are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import held_out, query, table

PER_CLASS = 4000
# Bytes of text of each class that may be expected on the driver.
CLASS_BYTES = 32 << 20
SHORTEST = 4
FUZZY = 5
STEMS = (4, 5, 6, 7)
WINDOW = 5
AT_LEAST = 0.3
REMEMBER = 300_000

_WORD = re.compile(r"[^\W\d_]+")
# From the first to the last letter or digit between blanks or quotation marks.
_TOKEN = re.compile(r"[^\W_](?:[^\s\"“”„«»]*[^\W_])?")
# Words around a term that report it, and words that address someone.
REPORTING = set(
    "said says wrote writes quoted quotes called calls word term dit écrit mot appelé"
    " sagte schrieb wort nannte dijo escribió palabra llamó".split()
)
ADDRESSING = set("you your you're u tu te toi vous du dich dir ihr usted ustedes eres".split())


class Lexicon:
    """Trie of terms and its product with the one-edit automaton, made as it is used."""

    def __init__(self, terms: dict[str, tuple[bool, float]]) -> None:
        self.terms = sorted(terms)
        self.weights = [terms[t][1] for t in self.terms]
        self.stems = [terms[t][0] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.end: dict[int, int] = {}
        for k, term in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.end[node] = k
        self.letters = {c for kids in self.children for c in kids}
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.found: list[tuple[int, int] | None] = []
        self.next: dict[tuple[int, str], int] = {}
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _allowed(self, term: int) -> int:
        return 1 if len(self.terms[term]) >= FUZZY else 0

    def _state(self, reached: dict) -> int:
        """The number of a set of nodes with their least edits; missing letters are skipped here."""
        for node, edits in list(reached.items()):
            if edits == 0 and node >= 0:
                for child in self.children[node].values():
                    reached.setdefault(child, 1)
        for node, edits in list(reached.items()):
            term = self.end.get(node)
            if term is not None and self.stems[term] and edits <= self._allowed(term):
                # A finished stem takes any ending; -1 - term stands for it.
                mark = -1 - term
                reached[mark] = min(edits, reached.get(mark, edits))
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            ends = [(e, -1 - n) for n, e in key if n < 0]
            ends += [
                (e, self.end[n]) for n, e in key if n in self.end and e <= self._allowed(self.end[n])
            ]
            self.found.append(min(ends) if ends else None)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= 1 and edits < reached.get(node, 2):
                reached[node] = edits

        for node, edits in self.states[state]:
            if node < 0:
                reach(node, edits)
                continue
            reach(node, edits + 1)
            for c, child in self.children[node].items():
                reach(child, edits + (c != letter))
        return self._state(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its edits, or None."""
        state = self.start
        for c in word:
            if c not in self.letters:
                c = ""
            key = (state, c)
            after = self.next.get(key)
            if after is None:
                after = self.next[key] = self._step(state, c)
            if after == self.dead:
                return None
            state = after
        return self.found[state]


def learn_lexicon(texts: list[str], toxic: list[int], weights: list[float]) -> dict[str, tuple[bool, float]]:
    """Terms found in toxic texts nearly alone: ``{term: (is a stem, log odds)}``."""
    words = [Counter(), Counter()]
    stems = [Counter(), Counter()]
    endings: dict[str, set] = defaultdict(set)
    totals = [0.0, 0.0]
    # Toxic texts with a word or stem, and (text, word) pairs with a stem.
    seen, stemmed, forms = Counter(), Counter(), Counter()
    for text, label, weight in zip(texts, toxic, weights):
        totals[label] += weight
        own = set(_WORD.findall(text.lower()))
        begin = {w[:n] for w in own for n in STEMS if len(w) > n}
        for term in own:
            words[label][term] += weight
        for stem in begin:
            stems[label][stem] += weight
        if label:
            seen.update(own)
            stemmed.update(begin)
            for w in own:
                for n in STEMS:
                    if len(w) > n:
                        endings[w[:n]].add(w[n:])
                        forms[w[:n]] += 1
    least = max(4, 0.004 * sum(toxic))

    def odds(term: str, counts: list[Counter]) -> float:
        a = (counts[1][term] + 0.5) / (totals[1] + 1)
        b = (counts[0][term] + 0.5) / (totals[0] + 1)
        return math.log(a / b)

    def marks(term: str, counts: list[Counter]) -> bool:
        return counts[1][term] >= 0.9 * (counts[0][term] + counts[1][term])

    terms: dict[str, tuple[bool, float]] = {}
    for stem in sorted(stems[1], key=lambda s: (len(s), s)):
        if any(stem[:n] in terms for n in STEMS if n < len(stem)):
            continue
        # A stem of many forms in few texts is as sure a sign as a word in many.
        many = stemmed[stem] >= max(2, least / 2) and forms[stem] >= least + 2
        if many and len(endings[stem]) >= 4 and marks(stem, stems):
            terms[stem] = (True, odds(stem, stems))
    for word in words[1]:
        if len(word) >= SHORTEST and seen[word] >= least and marks(word, words):
            if not any(word[:n] in terms and terms[word[:n]][0] for n in STEMS):
                terms[word] = (False, odds(word, words))
    return terms


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a place stands between quotation marks on its line."""
    line = text.rfind("\n", 0, start) + 1
    before = text[line:start]
    if before.count('"') % 2:
        return True
    if max(before.rfind("“"), before.rfind("«"), before.rfind("„")) > max(before.rfind("”"), before.rfind("»")):
        return True
    return text[max(0, start - 1) : start] in ("'", "‘") and text[end : end + 1] in ("'", "’")


@dataclass
class Model:
    lexicon: Lexicon
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = -math.inf
    cache: dict = field(default_factory=dict)
    whole: dict = field(default_factory=dict)

    def match(self, word: str) -> tuple[int, int] | None:
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= REMEMBER:
                self.cache.clear()
            found = self.cache[word] = self.lexicon.match(word)
            return found

    def disguised(self, token: str) -> tuple[int, int] | None:
        """The term that a token with other signs than letters stands for as a whole, or None."""
        if token.isalpha():
            return None
        runs = _WORD.findall(token)
        return self.match(token) if runs and not any(map(self.match, runs)) else None

    def tokens(self, blanked: str) -> tuple[str, ...]:
        """The disguised tokens in what stands between two blanks."""
        try:
            return self.whole[blanked]
        except KeyError:
            if len(self.whole) >= REMEMBER:
                self.whole.clear()
            found = tuple(t for t in _TOKEN.findall(blanked) if self.disguised(t))
            self.whole[blanked] = found
            return found

    def figures(self, text: str) -> list[float] | None:
        """What the regression looks at; None without any match."""
        lower = text.lower()
        if len(lower) != len(text):
            text = lower
        # The distinct words and tokens of most texts match nothing.
        plain = any(map(self.match, set(_WORD.findall(lower))))
        tokens = {t for b in set(lower.split()) if not b.isalpha() for t in self.tokens(b)}
        if not plain and not tokens:
            return None
        spans = list(_WORD.finditer(lower))
        words = [m.group() for m in spans]
        # Place among the words, begin, end and term of each match.
        hits = [(i, *spans[i].span(), hit) for i, w in enumerate(words) if (hit := self.match(w))]
        if tokens:
            starts = [m.start() for m in spans]
            hits += [
                (bisect_left(starts, m.start()), *m.span(), self.disguised(m.group()))
                for m in _TOKEN.finditer(lower)
                if m.group() in tokens
            ]
        counts = Counter()
        heaviest = 0.0
        for i, begin, end, (edits, term) in hits:
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = _quoted(text, begin, end)
            counts["fuzzy" if edits else "exact", quoted] += 1
            counts["reported"] += not REPORTING.isdisjoint(near)
            counts["aimed"] += not ADDRESSING.isdisjoint(near)
            if not quoted:
                heaviest = max(heaviest, self.lexicon.weights[term] * (0.5 if edits else 1.0))
        open_ = counts["exact", False] + counts["fuzzy", False]
        n = open_ + counts["exact", True] + counts["fuzzy", True]
        return [
            math.log1p(counts["exact", False]),
            math.log1p(counts["exact", True]),
            math.log1p(counts["fuzzy", False]),
            math.log1p(counts["fuzzy", True]),
            float(counts["exact", False] > 0),
            counts["reported"] / n,
            counts["aimed"] / n,
            heaviest / 5,
            min(5.0, 100 * open_ / max(1, len(words))),
        ]

    def score(self, text: str | None) -> float:
        if math.isinf(self.base):
            return 0.0
        x = self.figures(text) if text else None
        z = self.base + (0.0 if x is None else float(np.dot(self.center, x)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[str], toxic: list[int], weights: list[float]) -> Model:
    """Lexicon, then ridge logistic regression by Newton steps; weights undo the sampling."""
    if not 0 < sum(toxic) < len(toxic):
        return Model(Lexicon({}))
    model = Model(Lexicon(learn_lexicon(texts, toxic, weights)))
    rows = [model.figures(t) or [0.0] * 9 for t in texts]
    x = np.column_stack([np.ones(len(rows)), np.array(rows)])
    y, w = np.array(toxic, float), np.array(weights)
    w = w / w.mean()
    theta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * theta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        theta = theta + np.linalg.solve(hessian, gradient)
    model.base, model.center, model.cache, model.whole = float(theta[0]), theta[1:], {}, {}
    return model


def sample(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES
) -> tuple[list, list, list]:
    """Texts, labels and weights to learn from.

    About ``per_class`` texts of each class at most; where those have more than
    ``class_bytes`` bytes, so many fewer whole texts that this is about the number of bytes.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = F.xxhash64("doc_id", F.lit(7)) / F.lit(2.0**64) + 0.5
    texts = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")

    def draw(share: dict[int, float]) -> DataFrame:
        chance = F.lit(0.0)
        for label, one_in in share.items():
            chance = F.when(F.col("toxic") == label, F.lit(1 / one_in)).otherwise(chance)
        # Some thousand ids at most, whatever the number of labels.
        return texts.join(F.broadcast(known.filter(drawn < chance)), "doc_id")

    share = {label: max(1.0, n / per_class) for label, n in sizes.items()}
    held = draw(share).groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    for r in held:
        share[r["toxic"]] *= max(1.0, r["n"] / class_bytes)
    rows = (
        draw(share)
        .select("doc_id", "text", "toxic")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("text", "ascending")])
    )
    toxic = rows["toxic"].to_pylist()
    return rows["text"].to_pylist(), toxic, [share[t] for t in toxic]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            held_out(F.col("doc_id")).alias("held_out"),
            "text",
        )
        .mapInArrow(run, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= AT_LEAST).cast("int"))
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, fit(*sample(docs, labels)))
