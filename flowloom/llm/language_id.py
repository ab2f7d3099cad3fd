"""Language of every word, and of the text, by a linear-chain conditional random field.

Words are runs of letters in lower case.  A word's features are its byte n-grams
with both ends marked, longer affixes, and the lists of frequent words it is on.
Weights and transitions between the languages of neighbouring words are learned
from code-switched sequences, made by putting stretches of training texts of
different languages after each other; the labels are the texts' own.
Forward-backward gives each word a distribution over languages, so that a text
may switch; the text's language is the one with the largest mean, its score.

Every language of a training text is learned, from about ``PER_LANG`` of its distinct
texts, chosen by a hash of the text, or from all if it has fewer.  With many languages
or long texts the number falls, to keep about ``TEXTS`` texts and ``LANG_BYTES`` bytes of
each language, but not below ``LEAST``.  Training runs on the driver within that
bound; prediction in tasks, over whole texts, a batch of texts at a time.  A model of
many languages has fewer slots and shorter lists, so that its size is bounded.

* NULL texts and texts without a letter are ``und`` with score 0, and so is
  everything if there is nothing to learn from.
* Rows with a NULL language, or NULL id, are predicted like all others.
* Repeated rows get equal results.  Ties go to the language first by name.
* Columns of the same names in the input are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import held_out, query, table
from flowloom.operators.lineage import cut

PER_LANG = 1000
# Texts of all languages, bytes of one and the least number of texts of one.
TEXTS = 200_000
LANG_BYTES = 16 << 20
LEAST = 20
# Feature slots and frequent words of a language, and bounds on those of all.
SLOTS, WEIGHTS = 1 << 16, 1 << 24
LISTED, ALL_LISTED = 2000, 400_000
SEED = 5
# Words whose emissions a worker remembers, and word positions worked on at once.
REMEMBER = 300_000
CELLS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Labels, feature weights, transition scores and the lists of frequent words."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    listed: dict[str, list[int]]
    slots: int = SLOTS

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature slots and the word each belongs to; every word has some."""
        marked = [b"^" + w.encode() + b"$" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(marked)), sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - starts[owner]
        left = sizes[owner] - place
        slots, owners = [], []
        for n in (2, 3, 4, 5):
            if len(data) < n:
                break
            code = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                code = (code + data[k : len(data) - n + 1 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            inside = left[: len(code)] >= n
            if n > 3:  # the long ones only as prefix or suffix
                inside &= (place[: len(code)] == 0) | (left[: len(code)] == n)
            slots.append((code[inside] >> np.uint64(40)).astype(np.int64) % self.slots)
            owners.append(owner[: len(code)][inside])
        lists = [(self.slots + s, i) for i, w in enumerate(words) for s in self.listed.get(w, ())]
        if lists:
            s, i = zip(*lists)
            slots.append(np.array(s, np.int64))
            owners.append(np.array(i, np.int64))
        return np.concatenate(slots), np.concatenate(owners)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word, as factors with a greatest of 1."""
        slots, owners = self.features(words)
        n = len(words)
        raw = np.stack(
            [np.bincount(owners, self.weights[slots, k], n) for k in range(len(self.labels))], axis=1
        )
        return np.exp(np.maximum(raw - raw.max(axis=1, keepdims=True), -30.0))


def forward_backward(
    emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (time, sequence, label) and expected moves, for sequences from long to short.

    ``emit`` is (time, sequence, label) in factors; positions past the end of a
    sequence are not looked at.
    """
    steps, many, labels = emit.shape
    factor = np.exp(moves)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lengths > t
    ahead = np.zeros_like(emit)
    ahead[0] = emit[0] / emit[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = active[t]
        a = (ahead[t - 1, :k] @ factor) * emit[t, :k]
        ahead[t, :k] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros((labels, labels))
    back = np.ones((many, labels))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        g = ahead[t, :k] * back[:k]
        ahead[t, :k] = g / g.sum(axis=1, keepdims=True)
        if t:
            out = emit[t, :k] * back[:k]
            before = ahead[t - 1, :k]
            pair = before.T[:, None, :] * factor[:, :, None] * out.T[None, :, :]
            moved += (pair / pair.sum(axis=(0, 1))).sum(axis=2)
            b = out @ factor.T
            back[:k] = b / b.sum(axis=1, keepdims=True)
    return ahead, moved


def _means(emit: np.ndarray, lengths: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Mean posterior of each sequence, from long to short, without expected moves."""
    steps, many, labels = emit.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    ahead = np.empty_like(emit)
    ahead[0] = emit[0] / emit[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = active[t]
        a = (ahead[t - 1, :k] @ factor) * emit[t, :k]
        ahead[t, :k] = a / a.sum(axis=1, keepdims=True)
    total, back = np.zeros((many, labels)), np.ones((many, labels))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        g = ahead[t, :k] * back[:k]
        total[:k] += g / g.sum(axis=1, keepdims=True)
        b = (emit[t, :k] * back[:k]) @ factor.T
        back[:k] = b / b.sum(axis=1, keepdims=True)
    return total / lengths[:, None]


def fit(texts: list[str], langs: list[str], seed: int = SEED, rounds: int = 60, size: int = 100, steps: int = 60) -> Model:
    """Weights by AdaGrad on batches of ``size`` sequences of ``steps`` words."""
    labels = sorted(set(langs))
    by_label: list[list[list[str]]] = [[] for _ in labels]
    counts = [Counter() for _ in labels]
    for text, lang in zip(texts, langs):
        found = word_list(text)
        if found:
            k = labels.index(lang)
            by_label[k].append(found)
            counts[k].update(found)
    n = len(labels)
    most_listed = min(LISTED, ALL_LISTED // max(1, n))
    listed: dict[str, list[int]] = {}
    for k, count in enumerate(counts):
        for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: most_listed]:
            listed.setdefault(word, []).append(k)
    slots_of_all = min(SLOTS, max(1 << 11, WEIGHTS // max(1, n)))
    model = Model(labels, np.zeros((slots_of_all + n, n)), np.zeros((n, n)), listed, slots_of_all)
    usable = [k for k in range(n) if by_label[k]]
    if not usable:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((0, 0)), {})
    rng = np.random.default_rng(seed)
    grown, grown_moves = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    for _ in range(rounds):
        words: list[str] = []
        truth: list[int] = []
        for _ in range(size):
            line: list[str] = []
            tags: list[int] = []
            while len(line) < steps:
                k = usable[rng.integers(len(usable))]
                text = by_label[k][rng.integers(len(by_label[k]))]
                length = int(rng.integers(3, 41))
                at = int(rng.integers(max(1, len(text) - length + 1)))
                line += text[at : at + length]
                tags += [k] * (len(line) - len(tags))
            words += line[:steps]
            truth += tags[:steps]
        slots, owners = model.features(words)
        emit = model.emissions(words).reshape(size, steps, n).transpose(1, 0, 2)
        gold = np.array(truth).reshape(size, steps).T
        post, moved = forward_backward(np.ascontiguousarray(emit), np.full(size, steps), model.moves)
        wrong = -post
        np.put_along_axis(wrong, gold[:, :, None], np.take_along_axis(wrong, gold[:, :, None], 2) + 1, 2)
        flat = wrong.transpose(1, 0, 2).reshape(size * steps, n)
        gradient = np.stack(
            [np.bincount(slots, flat[owners, k], len(model.weights)) for k in range(n)], axis=1
        )
        pairs = np.zeros((n, n))
        np.add.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        for value, slope, past in (
            (model.weights, gradient - 1e-3 * model.weights, grown),
            (model.moves, pairs - moved, grown_moves),
        ):
            past += slope * slope
            value += 0.5 * slope / np.sqrt(past)
    return model


def sample(docs: DataFrame, per_lang: int = PER_LANG, lang_bytes: int = LANG_BYTES) -> tuple[list[str], list[str]]:
    """Distinct texts and languages to learn from; see the module for how many."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    digest = F.xxhash64("text", F.lit(SEED))
    # Repeated texts must not use up a language's share, so distinct ones are counted.
    langs = known.groupBy("lang").agg(
        F.approx_count_distinct(digest, 0.02).alias("_texts"), F.avg(F.octet_length("text")).alias("_bytes")
    )
    langs = cut(langs)
    share = max(LEAST, min(per_lang, TEXTS // max(1, langs.count())))
    wanted = F.greatest(F.lit(LEAST), F.least(F.lit(share), F.lit(lang_bytes) / F.greatest("_bytes", F.lit(1.0))))
    # One small row for each language; Spark broadcasts them where it finds them small.
    chance = langs.select(F.col("lang").alias("_lang"), (wanted / F.col("_texts")).alias("_chance"))
    rows = (
        known.select("text", "lang")
        .join(chance, F.col("lang") == F.col("_lang"))
        .filter(digest / F.lit(2.0**64) + 0.5 < F.col("_chance"))
        .select("text", "lang")
        .distinct()
        .toArrow()
        .sort_by([("lang", "ascending"), ("text", "ascending")])
    )
    return rows["text"].to_pylist(), rows["lang"].to_pylist()


class _Tagger:
    """One worker's model with the emissions of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.factor = model, np.exp(model.moves)
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(model.labels)))

    def _known(self, texts: list[list[str]]) -> None:
        if len(self.rows) > REMEMBER:
            self.rows, self.table = {}, self.table[:0]
        new = dict.fromkeys(w for words in texts for w in words if w not in self.rows)
        if new:
            base = len(self.rows)
            self.table = np.concatenate([self.table, self.model.emissions(list(new))])
            self.rows.update(zip(new, range(base, base + len(new))))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Mean posteriors; texts must not be empty."""
        out = np.empty((len(texts), len(self.model.labels)))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            some = order[at : at + max(1, CELLS // longest)]
            at += len(some)
            group = [texts[i] for i in some]
            self._known(group)
            lengths = np.array([len(g) for g in group])
            ids = np.zeros((len(group), longest), np.int64)
            for k, g in enumerate(group):
                ids[k, : len(g)] = np.fromiter(map(self.rows.__getitem__, g), np.int64, len(g))
            out[some] = _means(self.table[ids.T], lengths, self.factor)
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _Tagger(shared.value)
        labels = np.array(shared.value.labels, object)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [word_list(t or "") for t in part.column("text").to_pylist()]
                some = [i for i, t in enumerate(texts) if t and len(labels)]
                best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if some:
                    means = tagger([texts[i] for i in some])
                    best[some] = labels[means.argmax(axis=1)]
                    score[some] = np.clip(means.max(axis=1), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(best.tolist(), pa.string()),
                        pa.array(score),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(tag, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, fit(*sample(docs)))
