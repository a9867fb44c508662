"""Abusive, hateful or sexually explicit sentences, by two Kneser-Ney models (problem 8).

Two language models over tokens are fitted from hand-labelled documents, one of unwanted and one of ordinary sentences.
Each is an interpolated Kneser-Ney model: discounted counts of the class at the highest order, continuation counts (in
how many contexts of the class an expression stands) below it, and normalised backoff weights. The lowest order is SHARED
by the two: what a class has not seen falls back on one distribution for both, so that rare words decide nothing by
themselves. A sentence's score is the difference of the two log-likelihoods divided by its number of tokens, a
document's score that of its worst sentence.

Labels are of documents and partly wrong. So the sentences of a document labelled unwanted are divided again after each
round of fitting, by models that don't know the document: ordinary ones go to the ordinary class, and where none is
unwanted nothing is learnt of those that the models can't place. Scores that set the threshold come from models that
were fitted without the document, and few labels move it from ``PRIOR_THRESHOLD`` by little.

Fitting takes at most ``MOST_LABELLED`` labelled documents with ``MOST_CHARACTERS`` characters (documented bounds, by a
hash of the id); everything else, scoring and rates, goes over all documents and whole texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.fold import CYRILLIC, GREEK, LATIN_OF_CYRILLIC, LATIN_OF_GREEK
from linkspark.llm.spread import spread

#: Labelled documents that are used for fitting at most.
MOST_LABELLED = 20_000
#: Characters of these at most; the texts that are taken are taken whole.
MOST_CHARACTERS = 50_000_000
ORDER = 3
DISCOUNT = 0.75
ROUNDS = 2
FOLDS = 5
#: Score from which, either way, a sentence contradicts the label of its document.
SURE = 2.0
#: F1 values on held-out labels that differ by no more than this are equal, as labels are wrong by more.
TOLERANCE = 0.01
#: The threshold before any label is seen, and how many unwanted labels it weighs.
PRIOR_THRESHOLD, PRIOR_WEIGHT = 0.4, 200
#: Tokens of a stretch without an end of sentence that are scored at a time, and by how many the next one starts later.
STRETCH, STEP = 48, 24

_INVISIBLE = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_LOOKALIKE = str.maketrans(CYRILLIC + GREEK, LATIN_OF_CYRILLIC + LATIN_OF_GREEK)
_MIXED = re.compile("[A-Za-zÀ-ɏͰ-ϿЀ-ӿ@$0-9*]+")
_LEET = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<![^\W\d_])([^\W\d_])(?:([ .\-_*|])([^\W\d_]))(?:\2([^\W\d_])){1,}(?![^\W\d_])")
_REPEATED = re.compile(r"(\D)\1{2,}")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？!?])|\n+")
_TOKEN = re.compile(r"[a-zß-ɏ'’]*[a-zß-ɏ][a-zß-ɏ'’]*(?:[*#]+[a-zß-ɏ'’]*)*|[*#]{2,}[a-zß-ɏ]*|\d+(?:[.,:]\d+)*|[々〇぀-ヿ㐀-䶿一-鿿豈-﫿*]|[^\W\d_々〇぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def plain_text(text: str) -> str:
    """The text without the disguises under which unwanted words are typed."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _MIXED.sub(_unmask, text)
    text = _SPACED.sub(lambda m: m.group().replace(m.group(2), ""), text)
    return _REPEATED.sub(r"\1", text)


def _unmask(m: re.Match) -> str:
    w = m.group()
    if not w.isascii() and re.search("[A-Za-z]", w) and re.search("[Ͱ-ӿ]", w):
        w = w.translate(_LOOKALIKE)
    if re.search("[0-9@$]", w) and len(re.findall("[A-Za-zÀ-ɏ]", w)) >= 1 and not re.fullmatch(r"[A-Za-z]?[0-9@$*]+[A-Za-z]?", w):
        w = w.translate(_LEET)
    return w


def tokens(sentence: str) -> list[str]:
    """Words, single ideographs and kana; numbers are one token, and so are words with crossed-out letters."""
    out = []
    for t in _TOKEN.findall(sentence.lower()):
        if t[0].isdigit():
            t = "9"
        elif "*" in t or "#" in t:
            t = "*"
        out.append(t)
    return out


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """Token sequences of the sentences of a text; stretches without an end are cut into overlapping parts."""
    out = []
    for s in _END.split(plain_text(text or "")):
        ts = tuple(tokens(s)) if s else ()
        if len(ts) <= STRETCH:
            if ts:
                out.append(ts)
        else:
            out += [ts[i : i + STRETCH] for i in range(0, max(1, len(ts) - STRETCH + STEP), STEP)]
    return out


class ClassModels:
    """Interpolated Kneser-Ney models of several classes over one shared lowest order."""

    def __init__(self, weighted: Iterable[tuple[tuple[str, ...], int, float]], names: frozenset = frozenset(), classes: int = 2, order: int = ORDER, discount: float = DISCOUNT):
        """weighted: sentences with their class and how often they occur in it. names: tokens that stand for any name."""
        self.names, self.order, self.discount, self.classes = names, order, discount, classes
        sizes = [0.0] * classes
        seen = [defaultdict(lambda: [0.0] * classes) for _ in range(order + 1)]  # by length
        for s, c, w in weighted:
            sizes[c] += w
            padded = self._padded(s)
            for i in range(order - 1, len(padded)):
                for n in range(2, order + 1):
                    seen[n][padded[i - n + 1 : i + 1]][c] += w
        self.odds = math.log(max(sizes[0], 1) / max(sizes[1], 1))
        # below the highest order: before how many words an expression stands; what begins a sentence is counted as it is
        self.grams: list[dict] = [{} for _ in range(order + 1)]
        self.grams[order] = dict(seen[order])
        for n in range(2, order):
            contexts = defaultdict(lambda: [0.0] * classes)
            for g, counts in seen[n + 1].items():
                for c, x in enumerate(counts):
                    contexts[g[1:]][c] += x > 0
            self.grams[n] = dict(contexts) | {g: counts for g, counts in seen[n].items() if g[0] == "<s>"}
        # counts of histories, and how many words follow them
        self.total: list[dict] = [{} for _ in range(order + 1)]
        self.kinds: list[dict] = [{} for _ in range(order + 1)]
        for n in range(2, order + 1):
            total, kinds = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0] * classes)
            for g, counts in self.grams[n].items():
                t, k = total[g[:-1]], kinds[g[:-1]]
                for c, x in enumerate(counts):
                    t[c] += x
                    k[c] += x > 0
            self.total[n], self.kinds[n] = dict(total), dict(kinds)
        # shared: before how many words a word stands, whichever class they are of
        self.contexts = Counter(g[-1] for g in seen[2])
        self.all_contexts = sum(self.contexts.values())

    def _padded(self, sentence: tuple[str, ...]) -> tuple[str, ...]:
        if self.names:
            sentence = tuple("<name>" if t in self.names else t for t in sentence)
        return ("<s>",) * (self.order - 1) + tuple(sentence) + ("</s>",)

    def shared(self, word: str) -> float:
        """The probability that all classes fall back on; the discounted mass is spread over known words and one unknown."""
        d, n, known = self.discount, self.all_contexts, len(self.contexts)
        if not n:
            return 1.0
        return max(self.contexts.get(word, 0) - d, 0) / n + d * known / n / (known + 1)

    def probabilities(self, history: tuple[str, ...], word: str) -> list[float]:
        """The probability of a word behind a history, by class; over all known words and one unknown they sum to 1."""
        d, none = self.discount, (0.0,) * self.classes
        p = [self.shared(word)] * self.classes
        for n in range(2, self.order + 1):
            h = history[len(history) - n + 1 :]
            total = self.total[n].get(h)
            if total is None:
                break
            counts, kinds = self.grams[n].get((*h, word), none), self.kinds[n][h]
            p = [p[c] if not total[c] else (max(counts[c] - d, 0) + d * kinds[c] * p[c]) / total[c] for c in range(self.classes)]
        return p

    def gain(self, sentence: tuple[str, ...]) -> float:
        """Log-likelihood of the sentence in class 1 minus that in class 0 and minus the log odds of the classes, per token."""
        padded, gained = self._padded(sentence), -self.odds
        for i in range(self.order - 1, len(padded)):
            p = self.probabilities(padded[i - self.order + 1 : i], padded[i])
            gained += math.log(p[1]) - math.log(p[0])
        return gained / (len(sentence) + 1)


Labelled = list[tuple[list[tuple[str, ...]], int]]


def find_names(texts: Iterable[tuple[str | None, str | None]]) -> frozenset:
    """Words of (text, language) that are capitalised wherever they stand and belong to no language in particular."""
    small: Counter = Counter()
    large: dict[str, Counter] = defaultdict(Counter)
    for text, language in texts:
        words = set(re.findall(r"[^\W\d_぀-ヿ㐀-䶿一-鿿々]+", plain_text(text or "")))
        for w in words:
            if w[0].isupper() and w[1:].islower():
                large[w.lower()][(language or "")[:2].lower()] += 1
            elif w.islower():
                small[w] += 1
    return frozenset(
        w for w, by in large.items() if (n := sum(by.values())) >= 4 and small[w] <= 0.05 * n and max(by.values()) <= 0.75 * n and len(w) > 2
    )


def divide(labelled: Labelled, names: frozenset = frozenset(), rounds: int = ROUNDS, folds: int = FOLDS) -> tuple[list[list[int | None]], list[ClassModels]]:
    """For each sentence of each labelled document its class, None for neither; and the models fitted without each fold.

    A sentence of a document labelled unwanted is unwanted if models that don't know the document find it so, and so is
    the worst one of such a document, unless it is ordinary by far; the others are ordinary if there is an unwanted one,
    and left out otherwise. A sentence of a document labelled ordinary that is unwanted by far is left out.
    """
    classes: list[list[int | None]] = [[label] * len(doc) for doc, label in labelled]
    models: list[ClassModels] = []
    for _ in range(rounds):
        models = [fit_models([(doc, c) for i, ((doc, _), c) in enumerate(zip(labelled, classes)) if i % folds != f], names) for f in range(folds)]
        known: list[dict] = [{} for _ in range(folds)]
        for i, (doc, label) in enumerate(labelled):
            gains = []
            for s in doc:
                g = known[i % folds].get(s)
                if g is None:
                    g = known[i % folds][s] = models[i % folds].gain(s)
                gains.append(g)
            worst = max(gains, default=0.0)
            for j, g in enumerate(gains):
                if label:
                    classes[i][j] = 1 if g > 0 or (g == worst and g > -SURE) else 0 if worst > 0 else None
                else:
                    classes[i][j] = None if g > SURE else 0
    return classes, models


def fit_models(divided: list[tuple[list[tuple[str, ...]], list[int | None]]], names: frozenset = frozenset()) -> ClassModels:
    """Models from the sentences of documents and their classes; a sentence counts once for each document."""
    counts: Counter = Counter()
    for doc, classes in divided:
        counts.update({(s, c) for s, c in zip(doc, classes) if c is not None})
    return ClassModels(((s, c, float(n)) for (s, c), n in counts.items()), names)


def score_document(models: ClassModels, doc: list[tuple[str, ...]], memory: dict | None = None) -> float | None:
    """The score of the worst sentence; None for a document without a token."""
    best = None
    for s in doc:
        g = memory.get(s) if memory is not None else None
        if g is None:
            g = models.gain(s)
            if memory is not None:
                if len(memory) > 100_000:
                    memory.clear()
                memory[s] = g
        best = g if best is None or g > best else best
    return best


def fit(labelled: Labelled, names: frozenset = frozenset()) -> tuple[ClassModels, float]:
    """Models and the threshold of the score: the strictest of those whose F1 over labelled documents that the models
    didn't know is the best within TOLERANCE, as labelled documents are richer in unwanted ones than all are; moved
    towards PRIOR_THRESHOLD as that weighs PRIOR_WEIGHT unwanted labels."""
    classes, held_out = divide(labelled, names)
    scored = [(score_document(held_out[i % len(held_out)], doc), label) for i, (doc, label) in enumerate(labelled)]
    scored = sorted(((x, label) for x, label in scored if x is not None), reverse=True)
    positives = sum(label for _, label in scored)
    cuts, hits = [], 0
    for i, (x, label) in enumerate(scored):
        hits += label
        below = scored[i + 1][0] if i + 1 < len(scored) else x - 1
        if below < x:
            cuts.append((2 * hits / (i + 1 + positives), (x + below) / 2))
    best = max(f1 for f1, _ in cuts)
    strictest = max(t for f1, t in cuts if f1 >= best - TOLERANCE)
    threshold = (positives * strictest + PRIOR_WEIGHT * PRIOR_THRESHOLD) / (positives + PRIOR_WEIGHT)
    return fit_models([(doc, c) for (doc, _), c in zip(labelled, classes)], names), threshold


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, characters: int = MOST_CHARACTERS) -> DataFrame:
    """``(doc_id, text, lang, label)`` of at most ``most`` labelled documents of ``characters`` together, by a hash of the id.

    Of several labels of a document the mean decides, a half counting as unwanted; null labels count for nothing.
    """
    said = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id"), "text", lang.alias("lang"))
    sample = texts.join(F.broadcast(said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)), "doc_id").dropDuplicates(["doc_id"])
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample alone
    return sample.withColumn("upto", upto).where(F.col("upto") <= characters).drop("upto")


def fit_from_tables(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[ClassModels, float]:
    """Models and threshold from a bounded sample of labelled documents, fitted on the driver."""
    rows = labelled_sample(documents, labels, most).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    names = find_names((r["text"], r["lang"]) for r in rows)
    labelled = [(sentences(r["text"]), r["label"]) for r in rows]
    labelled = [(doc, label) for doc, label in labelled if doc]
    if len({label for _, label in labelled}) < 2:
        return ClassModels([]), math.inf  # nothing is known of one of the classes
    return fit(labelled, names)


def score(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", most: int = MOST_LABELLED) -> DataFrame:
    """``(<id_column>, source, score DOUBLE, unwanted BOOLEAN)`` of every document by its whole text.

    Defined cases: null, empty and wordless texts have a null score and aren't unwanted; without labels of both classes
    nothing is unwanted; repeated rows are scored each; other columns are ignored, whatever their names.
    """
    models, threshold = fit_from_tables(documents, labels, most)
    shipped = documents.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        m = shipped.value
        for b in batches:
            scores = [score_document(m, sentences(t), memory) if isinstance(t, str) else None for t in b["text"]]
            yield pd.DataFrame({id_column: b[id_column], "source": b["source"], "score": pd.Series(scores, dtype="Float64")})

    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    chosen = spread(documents.select(id_column, source.alias("source"), "text"))
    scored = chosen.mapInPandas(run, f"`{id_column}` {kind}, source string, score double")
    return scored.withColumn("unwanted", F.coalesce(F.col("score") > F.lit(threshold), F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """``(source, n_documents, n_unwanted, rate)``; a null source is a source of its own."""
    n = F.sum(F.col("unwanted").cast("int"))
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), n.alias("n_unwanted"), (n / F.count("*")).alias("rate"))
