"""Language of a text, word first: known words by their frequency per language, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS_PER_LANGUAGE = 20_000
LANGUAGES = 200
LONGEST_GRAM = 5
SMOOTHING = 0.5
KNOWN = 300_000
#: Runs of letters and of the few numerals (as in m² or Ⅷ) that the standard library counts as word characters.
NEARLY_LETTERS = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, words: int = WORDS_PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """``lang, word, n, total``: the most frequent words of each language, from all rows that may be learned from.

    Counts cover every text; only the kept list is bounded, as the model's size.
    """
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    kept = learned.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages)
    counts = (
        learned.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .join(kept.select("lang"), "lang", "left_semi")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= words).drop("place")


class LanguageModel:
    """Log shares of the languages per word and per character n-gram."""

    def __init__(self, counts: list[tuple[str, str, int]], longest: int = LONGEST_GRAM):
        self.languages = sorted({lang for lang, _, _ in counts})
        self.longest = longest
        number = {lang: k for k, lang in enumerate(self.languages)}
        grams: list[Counter] = [Counter() for _ in self.languages]
        words: list[dict[str, int]] = [{} for _ in self.languages]
        for lang, word, n in counts:
            words[number[lang]][word] = n
            of = grams[number[lang]]
            for gram in self._grams(word):
                of[gram] += n
        self.words, self.word_shares = self._shares(words)
        self.grams, self.gram_shares = self._shares(grams)

    def _grams(self, word: str) -> Iterator[str]:
        framed = f"^{word}$"
        for size in range(1, self.longest + 1):
            for at in range(len(framed) - size + 1):
                yield framed[at : at + size]

    def _shares(self, tables: list[dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        """Log frequency in each language, relative to that over all languages, per row."""
        rows = {key: k for k, key in enumerate(dict.fromkeys(key for t in tables for key in t))}
        counts = np.full((len(rows), len(tables)), SMOOTHING)
        for k, of in enumerate(tables):
            counts[[rows[key] for key in of], k] += np.fromiter(of.values(), dtype=float, count=len(of))
        logs = np.log(counts / counts.sum(axis=0)) if len(rows) else counts
        return rows, logs - np.logaddexp.reduce(logs, axis=1, keepdims=True) if len(rows) else logs

    def score(self, word: str) -> np.ndarray:
        """A known word's own scores; else the mean of its longest n-grams that are known, else nothing."""
        if word in self.words:
            return self.word_shares[self.words[word]]
        framed = f"^{word}$"
        for size in range(min(self.longest, len(framed)), 0, -1):
            found = [k for at in range(len(framed) - size + 1) if (k := self.grams.get(framed[at : at + size])) is not None]
            if found:
                return self.gram_shares[found].mean(axis=0)
        return np.full(len(self.languages), -math.log(len(self.languages)))


class Predictor:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _add(self, word: str) -> int:
        at = len(self.place)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.score(word)
        self.place[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        runs = NEARLY_LETTERS.findall(text.lower()) if isinstance(text, str) else []
        words = runs if "".join(runs).isalpha() else [w for run in runs for w in LETTERS.findall(run)]
        if not words or not self.model.languages:
            return "und", 0.0
        if len(self.place) > KNOWN:
            self.place = {}
        place = self.place
        at = [place[w] if w in place else self._add(w) for w in words]
        total = self.table[at].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict_language(docs: DataFrame, counts: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``; only the text is looked at.

    ``counts`` is a table as ``word_counts`` makes it: at most ``LANGUAGES`` times
    ``WORDS_PER_LANGUAGE`` rows, which the tasks get whole. A text that is null or
    has no letter is ``und`` with score 0; so is every text if nothing was learned.
    The score is the share of the likelihood that the language has; equal scores go
    to the first name. Repeated rows each get their row. Other columns are ignored.
    """
    rows = [(r["lang"], r["word"], r["n"]) for r in counts.orderBy("lang", F.desc("n"), "word").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(LanguageModel(rows, longest))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(sent.value)
        for batch in batches:
            found = [predictor.predict(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "lang_pred": [f[0] for f in found],
                    "score": np.array([f[1] for f in found], dtype=float),
                }
            )

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double")
