"""Whether a text is mainly English.

Frequent words tell some languages apart.  Any other language is known by its trigrams of
letters: a profile, made of all clearly English texts of the corpus, says how likely a word is
in English, and a text with too many unlikely words is not English.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import pick, stored

#: Counters of a profile; trigrams are hashed to them.
TRIGRAMS = 1 << 13
#: Part of the words that must be frequent English ones, and how many times as many as of any other language, in a clearly English text.
CLEAR, AHEAD = 0.15, 3
#: A word is unlikely if it is less likely than all but this part of the words in the clearly English texts; a text may have so large a part of unlikely words.
RARE, STRANGE = 0.01, 0.25
#: Words whose likelihoods a task keeps at hand.
CACHE = 100_000

# Frequent words that tell languages apart (words two of them share are left out).
FREQUENT = {
    "en": frozenset("the of and to is that it with for as are this be by from which you we if then when not each what but have at how one can".split()),
    "de": frozenset("der die das und ist nicht ein eine einen den dem mit für auf wir sie werden wird kann man jede nach aus bei zuerst danach bitte wollen noch weil nun es".split()),
    "es": frozenset("el los las una de que en y es por con para hay si al del se más como vamos ahora cada primero otra faltan tiene la".split()),
    "fr": frozenset("le les des et est une dans pour qui que sur avec nous vous pas ce cette il elle sont aux du chaque".split()),
}


def trigrams(word: str) -> list[int]:
    """Counters of a word's trigrams, its ends included."""
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode("utf-8", "replace")) % TRIGRAMS for i in range(len(w) - 2)]


def hits(words: Mapping[str, int]) -> tuple[int, int]:
    """(frequent English words, those of the other language that has most)."""
    n = {k: sum(words.get(w, 0) for w in v) for k, v in FREQUENT.items()}
    return n.pop("en"), max(n.values())


def clear(words: Mapping[str, int]) -> bool:
    """Whether a text of these words is clearly English."""
    en, other = hits(words)
    return en >= max(1, CLEAR * sum(words.values()), AHEAD * other)


class Profile:
    """Log-probability of each trigram in English, and the least mean one of a word that is not unlikely."""

    def __init__(self, counts: np.ndarray, least: float = -np.inf):
        c = counts + 0.5
        self.log, self.least = np.log(c / c.sum()), least
        self.cache: dict[str, bool] = {}

    def likelihood(self, word: str) -> float:
        return float(self.log[trigrams(word)].mean())

    def likely(self, word: str) -> bool:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[word] = self.likelihood(word) >= self.least
        return got

    def english(self, words: Mapping[str, int]) -> bool:
        """Whether a text of these words (in lower case) is mainly English."""
        en, other = hits(words)
        return bool(words) and en >= other and sum(c for w, c in words.items() if not self.likely(w)) <= STRANGE * sum(words.values())


def marked(documents: DataFrame) -> DataFrame:
    """The documents with ``hash``, which equal texts share, and ``row``, a number of their own once they are stored."""
    return documents.withColumn("hash", F.unhex(F.md5("text"))).withColumn("row", F.monotonically_increasing_id())


def fit(documents: DataFrame, words_of: Callable[[str | None], Counter]) -> Profile:
    """The profile of English from all different texts of documents(text)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [words_of(t) for t in pdf.pop("text")]
            yield pdf.assign(vocabulary=[list(w) for w in got], counts=[list(w.values()) for w in got])[[clear(w) for w in got]]

    texts = marked(pick(documents, "text").where("text IS NOT NULL"))
    return profile(stored(texts.mapInPandas(run, "hash binary, row bigint, vocabulary array<string>, counts array<int>"), "texts"))


def profile(texts: DataFrame) -> Profile:
    """The profile of English from clearly English texts(hash, row, vocabulary, counts), which are stored; equal texts count once.

    A corpus without clearly English texts has no unlikely words: frequent words alone decide then.
    """
    # Hashes alone are shuffled; as few of them recur, their texts' words mostly stay where they are.
    again = stored(texts.groupBy("hash").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first"), "again")
    once = texts.join(again, "hash", "left").where("first IS NULL OR row = first")
    words = once.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("x")).groupBy(F.col("x.vocabulary").alias("word")).agg(F.sum("x.counts").alias("n"))
    words = stored(words, "english")

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            counts = np.zeros(TRIGRAMS)
            for w, n in zip(pdf["word"], pdf["n"]):
                np.add.at(counts, trigrams(w), n)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"t": at, "n": counts[at]})

    found = words.mapInPandas(split, "t int, n double").groupBy("t").agg(F.sum("n").alias("n")).toPandas()  # at most TRIGRAMS rows
    counts = np.zeros(TRIGRAMS)
    counts[found["t"].to_numpy(int)] = found["n"].to_numpy(float)
    plain = Profile(counts)

    def rate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"x": [plain.likelihood(w) for w in pdf["word"]], "n": pdf["n"]})

    if not counts.any():
        return plain
    # Each word counts as often as it occurs, so the level is read off a histogram of fixed size.
    bins = F.floor(F.col("x") * 100).cast("int").alias("bin")
    rated = words.mapInPandas(rate, "x double, n bigint").groupBy(bins).agg(F.sum("n").alias("n")).toPandas().sort_values("bin")  # hundredths of a logarithm: some hundreds of rows
    upto = rated["n"].cumsum().to_numpy() / rated["n"].sum()
    return Profile(counts, float(rated["bin"].to_numpy()[np.searchsorted(upto, RARE)]) / 100)
