"""Language identification (operator 6): known words first, then ever shorter character n-grams.

A word of the model adds its log frequency in each language. A word that the model lacks is read as
``^word$``: at each place the longest known n-gram (``max_gram`` characters down to one) gives the log
frequencies, and their mean stands for the word. A language's sum plus its log share of the training rows
is its score; the posterior of the best one is returned.

Fitting reads a sample bounded by ``max_rows`` (expected size; rows are chosen by a hash of their text), and
the model is bounded by ``max_words``, ``max_grams`` and ``max_langs``. Words and n-grams are chosen by their
highest share in any language. Prediction reads every whole text and nothing else.

Defined results: ``und`` and 0.0 where the text is null or has no letter, or nothing was learned; ties go to the
language that sorts first; a text without any known piece gets the most frequent language with its prior.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import written

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 150_000


class LanguageModel:
    """Log frequencies of words and n-grams, one column a language."""

    def __init__(self, langs: list[str], prior: list[float], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], max_gram: int):
        self.langs, self.max_gram = langs, max_gram
        self.prior = np.array(prior, dtype=np.float64)
        self.words, self.word_rows = words
        self.grams, self.gram_rows = grams

    def predict(self, docs: DataFrame, text_col: str = "text", out: str = "language") -> DataFrame:
        """``docs`` with ``out: struct<lang, score>`` (it replaces a column of that name)."""
        sent, key = docs.sparkSession.sparkContext.broadcast(self), uuid.uuid4().hex

        @F.arrow_udf("struct<lang:string,score:double>")
        def guess(text: pa.Array) -> pa.Array:
            scorer = _SCORERS.get(key)
            if scorer is None:
                _SCORERS.clear()
                scorer = _SCORERS[key] = _Scorer(sent.value)
            return pa.array([scorer.guess(t.as_py()) for t in text], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

        return docs.withColumn(out, guess(F.col(text_col)))


class _Scorer(dict):
    """Row of a word in ``rows``; rows of unseen words are made when first met."""

    def __init__(self, model: LanguageModel):
        super().__init__(zip(model.words, range(len(model.words))))
        self.model, self.known = model, len(model.words)
        self.gram_row = dict(zip(model.grams, range(len(model.grams))))
        self.rows = np.zeros((self.known + _CACHE_WORDS, len(model.langs)), dtype=np.float32)
        self.rows[:self.known] = model.word_rows
        self.made: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self.known + len(self.made)
        self.made.append(word)
        self[word] = row
        return row

    def fill(self, since: int) -> None:
        """Rows of the words made since then: of each the mean over its n-grams."""
        known, most = self.gram_row, self.model.max_gram
        flat: list[int] = []
        starts, filled = [], []
        for i in range(since, len(self.made)):
            marked, first = f"^{self.made[i]}$", len(flat)
            for at in range(len(marked)):
                for size in range(most, 0, -1):
                    # Behind the end a slice is a shorter n-gram, which the next turn would find anyway.
                    row = known.get(marked[at:at + size])
                    if row is not None:
                        flat.append(row)
                        break
            if len(flat) > first:
                starts.append(first)
                filled.append(self.known + i)
        self.rows[self.known + since:self.known + len(self.made)] = 0
        if filled:
            sums = np.add.reduceat(self.model.gram_rows[flat], starts, axis=0, dtype=np.float64)
            self.rows[filled] = sums / np.diff(np.append(starts, len(flat)))[:, None]

    def guess(self, text: str | None) -> dict:
        words = _LETTERS.findall(text.lower()) if text else []
        # The class also takes number-like characters such as fractions; a letter has to be there.
        if not self.model.langs or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
            return {"lang": UNDETERMINED, "score": 0.0}
        total = self.model.prior.copy()
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            if len(self.made) + len(part) > _CACHE_WORDS:
                for word in self.made:
                    del self[word]
                self.made = []
            since = len(self.made)
            rows = [self[w] for w in part]
            if len(self.made) > since:
                self.fill(since)
            total += self.rows[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return {"lang": self.model.langs[best], "score": float(1 / np.exp(total - total[best]).sum())}


_SCORERS: dict[str, _Scorer] = {}


def _logs(counts: DataFrame, key: str, langs: list[str], most: int, alpha: float) -> tuple[list[str], np.ndarray]:
    """The ``most`` keys of the highest share in any language, and their log frequencies in each."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    of = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    rated = counts.join(F.broadcast(totals), "lang").groupBy(key).agg(F.max(F.col("n") / F.col("all")).alias("share"), *of)
    rows = rated.orderBy(F.desc("share"), key).limit(most).drop("share").toArrow()  # columns: no object a row on the driver
    found = np.column_stack([np.asarray(rows.column(f"n{i}"), dtype=np.float64) for i in range(len(langs))])
    return rows.column(key).to_pylist(), np.log((found + alpha) / (found.sum(axis=0) + alpha * max(1, rows.num_rows))).astype(np.float32)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 30_000, max_words: int = 50_000,
        max_grams: int = 30_000, max_gram: int = 4, max_langs: int = 200, alpha: float = 0.5) -> LanguageModel:
    """Learn from rows whose language is given; rows without one or without text are left out."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs, n = sorted(r["lang"] for r in shares), sum(r["count"] for r in shares)
    if not langs:
        nothing = ([], np.zeros((0, 0), dtype=np.float32))
        return LanguageModel([], [], nothing, nothing, max_gram)
    prior = {r["lang"]: float(np.log(r["count"] / n)) for r in shares}
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, max_rows / n) * (1 << 30))
    words = rows.where(chosen & F.col("lang").isin(langs)).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    places = [F.transform(F.sequence(F.lit(1), F.length(marked) - (size - 1)), lambda at, size=size: F.substring(marked, at, size)) for size in range(1, max_gram + 1)]
    # A run of letters without a blank may be very long; it is no word to learn n-grams from.
    grams = counts.where(F.length("word").between(max_gram, 64)).select("lang", "n", F.explode(F.concat(*places)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return LanguageModel(langs, [prior[lang] for lang in langs], _logs(counts, "word", langs, max_words, alpha),
                         _logs(grams, "gram", langs, max_grams, alpha), max_gram)
