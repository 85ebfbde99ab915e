"""Counterfactually regularised toxicity classifier.

A sentence's logit is the sum of the weights of its distinct words, a word's weight that of the word and of its prefixes of
``PREFIXES`` letters (inflected forms share a stem); a document's is that of its worst sentence. Fitting
minimises the cross entropy of labelled documents (the gradient goes to each document's worst sentence), plus ``penalty``
times the mean squared change of the logit when an identity term in a labelled sentence is swapped: for each other term of
its kind, a neutral word among them, and for a word that says nothing. A group's mention then moves the score no more than
any such word does, so neutral mentions stay below the threshold, while words that are toxic beside any group keep their
weight.

Terms are listed for each language of the documents; their inflected forms count as the term itself.

Fitting takes a bounded sample in one task: at most ``per_class`` labelled documents of each class, of each its first
``fit_sentences`` distinct sentences by hash order over the whole text, of ``fit_words`` words together, cut where the text
is read. Scoring reads every sentence of every text, map-only.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, held_out, table
from agentlens.llm.labelled import labelled

# Terms for groups of people, by language and kind; the first of each kind is the neutral word.
IDENTITY = {
    "en gender": "person woman man girl boy female male transgender",
    "en orientation": "someone gay lesbian bisexual straight queer",
    "en religion": "believer muslim christian jew jewish hindu buddhist atheist",
    "en origin": "resident black white asian african european american mexican immigrant refugee foreigner",
    "en age and ability": "adult old young elderly disabled deaf blind",
    "de gender": "mensch frau mann mädchen junge weiblich männlich",
    "de orientation": "jemand schwul lesbisch schwule lesbe bisexuell",
    "de religion": "gläubige muslim muslima christ jude jüdisch hindu buddhist atheist",
    "de origin": "einwohner schwarz weiß asiatisch afrikanisch europäisch amerikanisch türke türkisch ausländer einwanderer flüchtling",
    "de age and ability": "erwachsene alt jung behindert taub blind",
    "fr gender": "personne femme homme fille garçon féminin masculin",
    "fr orientation": "quelqu gai homosexuel lesbienne bisexuel",
    "fr religion": "croyant musulman chrétien juif juive hindou bouddhiste athée",
    "fr origin": "habitant noir blanc asiatique africain européen américain arabe immigré réfugié étranger",
    "fr age and ability": "adulte vieux jeune handicapé sourd aveugle",
    "es gender": "persona mujer hombre chica chico femenino masculino",
    "es orientation": "alguien gay homosexual lesbiana bisexual",
    "es religion": "creyente musulmán musulman cristiano judío judía hindú budista ateo",
    "es origin": "habitante negro blanco asiático africano europeo americano mexicano árabe inmigrante refugiado extranjero",
    "es age and ability": "adulto viejo joven discapacitado sordo ciego",
}
IDENTITY = {kind: terms.split() for kind, terms in IDENTITY.items()}
# Endings of inflected forms by language, and forms that no ending makes.
ENDINGS = {"en": "s es", "de": "e en er es em n s in innen nen", "fr": "s e es x ne nes le les", "es": "s es a as o os"}
FORMS = {"woman": "women", "man": "men", "mann": "männer", "frau": "frauen", "jude": "juden", "türke": "türken", "blanc": "blanche", "vieux": "vieille", "étranger": "étrangère", "croyant": "croyante", "viejo": "vieja", "chica": "chicas", "musulmán": "musulmana"}
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
GROUP: dict[str, str] = {}
for _kind, _terms in IDENTITY.items():
    for _term in _terms:
        GROUP.setdefault(_term, _kind)


def inflections(term: str, language: str) -> list[str]:
    """Forms of a term: itself with an ending; Spanish and French ones with the last vowel changed, too."""
    stems = [term, term[:-1]] if language in ("es", "fr") and term[-1] in "oae" else [term]
    made = [stem + end for stem in stems for end in ENDINGS[language].split()]
    irregular = FORMS.get(term)
    return [*made, *([irregular, irregular + "s"] if irregular else [])]


#: The term of each form of an identity term; a form of several is that of the first.
TERM_OF = {t: t for t in GROUP}
for _kind, _terms in IDENTITY.items():
    for _term in _terms:
        for _form in inflections(_term, _kind[:2]):
            TERM_OF.setdefault(_form, _term)


def sentences(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [s for s in (set(WORD.findall(x)) for x in SENTENCE.split((text or "").lower())) if s]


def features(word: str) -> list[str]:
    """The word, and its prefixes marked with a hyphen; a form of an identity term stands for the term, alone."""
    term = TERM_OF.get(word)
    return [term] if term else [word, *[word[:k] + "-" for k in PREFIXES if len(word) > k]]


def sample_of(text: str | None, fit_sentences: int = 400, fit_words: int = 4000) -> list[list[str]]:
    """Sentences of a text to fit on, each as its sorted words: by hash order over the whole text, at most ``fit_sentences``
    different ones of ``fit_words`` words together (the first is cut to that)."""
    found = sorted(map(sorted, {frozenset(s) for s in sentences(text)}), key=lambda s: (zlib.crc32(" ".join(s).encode()), s))
    out, left = [], fit_words
    for s in found[:fit_sentences]:
        if out and len(s) > left:
            break
        out.append(s[:left])
        left -= len(out[-1])
    return out


def fit(texts: list[str], y: np.ndarray, **how) -> dict:
    return fit_samples([sample_of(t) for t in texts], y, **how)


def fit_samples(docs: list[list[list[str]]], y: np.ndarray, penalty: float = 1.0, min_docs: int = 3, least: float = 20.0, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3, neutral_weight: float = 0.7) -> dict:
    """{"bias": b, "words": {word: weight}} from each document's sentences; bias 0 and no words without both classes."""
    if len(set(y.tolist())) < 2:
        return {"bias": 0.0, "words": {}}
    seen = [Counter(), Counter()]
    for d, label in zip(docs, y, strict=True):
        seen[int(label)].update({f for s in d for x in s for f in features(x)})
    n = [int((y == k).sum()) for k in (0, 1)]

    def evidence(a: int, b: int) -> float:
        """Log-likelihood ratio of a feature in a toxic and b other documents against equal shares; 0 if it is rarer in
        the toxic ones."""
        share = (a + b) / len(y)
        if a <= n[1] * share:
            return 0.0
        parts = ((a, n[1] * share), (b, n[0] * share), (n[1] - a, n[1] * (1 - share)), (n[0] - b, n[0] * (1 - share)))
        return 2 * sum(k * np.log(k / e) for k, e in parts if k)

    vocabulary = sorted({w for w, a in seen[1].items() if a >= min_docs and evidence(a, seen[0][w]) >= least} | set(GROUP))
    at = {w: i for i, w in enumerate(vocabulary)}
    # Start: smoothed log odds of a word between the classes, shrunk to those beyond doubt.
    odds = np.array([np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1)) for w in vocabulary])
    w = np.where(odds > 1, odds, 0.0)
    kept = [[[at[f] for x in s for f in features(x) if f in at] for s in d] for d in docs]
    kept = [[s for s in d if s] or [[]] for d in kept]
    flat = [s for d in kept for s in d]
    size = np.array([len(s) for s in flat])
    words = np.array([x for s in flat for x in s], np.int64)
    sentence = np.repeat(np.arange(len(flat)), size)
    first = np.concatenate([[0], np.cumsum([len(d) for d in kept])])[:-1]
    owner = np.repeat(np.arange(len(kept)), [len(d) for d in kept])
    # Swaps in labelled sentences: each identity term for each other one of its kind, the neutral word first.
    swaps = Counter((t, o) for d in docs for s in d for x in s if (t := TERM_OF.get(x)) for o in IDENTITY[GROUP[t]] if o != t)
    for kind in IDENTITY.values():  # every term counts once at least, seen or not
        swaps.update([(x, kind[0]) for x in kind[1:]] + [(kind[0], x) for x in kind[1:]])
    one, two = (np.array([at[p[i]] for p in swaps]) for i in (0, 1))
    share = np.array(list(swaps.values()), float) / sum(swaps.values())
    weight = np.where(y == 1, (1 - neutral_weight) / y.mean(), neutral_weight / (1 - y.mean())) / len(y)
    bias, m, v, bm, bv = -2.0, np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, w[words], minlength=len(flat)) + bias
        top = np.maximum.reduceat(z, first)
        worst = np.full(len(kept), -1)
        hit = np.flatnonzero(z == top[owner])[::-1]
        worst[owner[hit]] = hit
        dz = (1 / (1 + np.exp(-np.clip(top, -30, 30))) - y) * weight
        at_sentence = np.zeros(len(flat))
        at_sentence[worst] = dz
        g = np.bincount(words, at_sentence[sentence], minlength=len(w)) + ridge * w / len(y)
        gap = 2 * penalty * share * (w[one] - w[two])
        # And for a word that says nothing, which has no weight.
        g += np.bincount(one, gap + 2 * penalty * share * w[one], minlength=len(w)) - np.bincount(two, gap, minlength=len(w))
        b = dz.sum()
        m, v, bm, bv = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * bm + 0.1 * b, 0.999 * bv + 0.001 * b * b
        fix = rate / (1 - 0.9**step)
        w -= fix * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        bias -= fix * bm / (np.sqrt(bv / (1 - 0.999**step)) + 1e-6)
    return {"bias": float(bias), "words": {x: float(w[i]) for x, i in at.items() if abs(w[i]) > 1e-3}}


class Weights(dict):
    """The weight of any word; forgets all when it holds ``limit``."""

    def __init__(self, of: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = w = sum(self.of.get(f, 0.0) for f in features(word))
        return w


def logit(text: str | None, bias: float, words: Weights) -> float:
    """That of the worst sentence; the bias without any."""
    return bias + max((sum(map(words.__getitem__, s)) for s in sentences(text)), default=0.0)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2500, fit_sentences: int = 400, fit_words: int = 4000) -> dict:
    """The model of at most 2 * per_class documents, of which sentences of fit_words words at most go to the fitting task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(sample=[json.dumps(sample_of(t, fit_sentences, fit_words)) for t in b["text"]])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "sample"])
        return pd.DataFrame({"model": [json.dumps(fit_samples([json.loads(x) for x in pdf["sample"]], pdf["y"].to_numpy(float)))]})

    rows = labelled(docs, labels, label, per_class).select("doc_id", "y", "text").mapInPandas(cut, "doc_id long, y int, sample string")
    made = rows.groupBy().applyInPandas(train, "model string").collect()
    return json.loads(made[0]["model"]) if made else {"bias": 0.0, "words": {}}


def scored(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bias, words = shipped.value["bias"], Weights(shipped.value["words"])
        for b in batches:
            z = np.array([logit(t, bias, words) for t in b["text"]], float)
            yield b.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= 0.7).

    The score is the probability of toxic 1. Labels of held-out ids (crc32 of the id modulo 3 is 1) are never used, nor
    any other column than text. Null and empty texts have the bias alone; without labels of both classes every score is
    0.5. Repeated rows are scored each by itself; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    return scored(docs, fitted(docs, labels, per_class=per_class))


def op5(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
