"""Reading level of the prose of each document.

Features of length, lexical diversity, word rarity, connectives and clause depth go into
a regularised ordinal (cumulative logit) regression that is calibrated to graded
documents.  Word rarity rests on the word counts of the whole corpus, kept in a table of
fixed size (counts by hash of the word), so what is sent to the tasks does not grow.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import language
from loamgraph.llm.prose import prose
from loamgraph.session import pick, stored

#: Counters of the corpus-wide word counts.
BUCKETS = 1 << 17
#: Bands of the graded documents, easiest first.
BANDS = (1, 2, 3, 4)

# Function words whose rates are features (connectives, subordinators, pronouns, common helpers) ...
CONNECTIVES = (
    "a about after all although an and another any as at be because been before between but by can do each first for from had has have hence how however if in insofar is it its let "
    "more most next no nor not notwithstanding of on once one only or otherwise our out over should since so some such than that the their them then there thereby therefore these they "
    "this those though thus to too try under unless until upon us was we were what when where whereas whether which while who whose why with within without would yes you your"
).split()
#: ... and those that open a subordinate clause.
SUBORDINATORS = frozenset("after although as because before if insofar once otherwise since so than that though unless until what when where whereas whether which whichever while who whom whose why".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_VOWELS = re.compile(r"[aeiouy]+")
_RARITY_BINS = (8.0, 10.0, 11.0, 12.0, 13.0, 14.0, 16.0)


def bucket(word: str) -> int:
    """The counter of a word."""
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def prose_words(text: str | None) -> Counter:
    """The words of a text's prose, in lower case, with their counts."""
    return Counter(w.lower() for p in prose(text) for w in _WORD.findall(p))


def measure(text: str | None) -> tuple[int, bool, list[float], list[str], list[int]]:
    """(words of prose, clearly English, features without rarity, different words, their counts)."""
    sentences = [s for p in prose(text) for s in _END.split(p)]
    split = [_WORD.findall(s) for s in sentences]
    split = [w for w in split if w]
    words = [x for w in split for x in w]
    n = len(words)
    if not n:
        return 0, False, [], [], []
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    lengths = np.fromiter(map(len, lower), float, n)
    per = np.array([len(w) for w in split], float)
    subs = np.array([sum(x.lower() in SUBORDINATORS for x in w) for w in split], float)
    commas = np.array([s.count(",") + s.count(";") + s.count(":") for s in sentences], float)
    vowels = sum(len(_VOWELS.findall(w)) * c for w, c in counts.items()) / n
    marks = "".join(sentences)
    s = len(split)
    ands = counts["and"] / s
    features = [
        # length
        np.log(per.mean()), np.log(per.max()), per.std() / per.mean(), lengths.mean(), lengths.std(), vowels, *((lengths >= k).mean() for k in (4, 6, 8, 10, 12, 15)),
        # lexical diversity
        len(counts) / np.sqrt(n), len(counts) / n, np.log(len(counts)) / np.log(n + 1), sum(c == 1 for c in counts.values()) / n,
        # clause depth
        subs.mean(), subs.max(), subs.sum() / n, commas.sum() / s, commas.max() if len(commas) else 0.0, commas.sum() / n, ands, counts["and"] / n,
        np.log1p(per.mean() * subs.sum() / n), (per > 25).mean(), (per < 8).mean(), marks.count("?") / s, marks.count("!") / s,
        # connectives
        *(np.sqrt(counts[w] / n) for w in CONNECTIVES),
    ]
    return n, language.clear(counts), [float(x) for x in features], list(counts), list(counts.values())


def rarity(buckets: np.ndarray, counts: np.ndarray, corpus: np.ndarray, total: float) -> list[float]:
    """Mean and spread of the words' rarity (bits) and the share of words above some rarities."""
    bits = np.log2((total + 1) / (corpus[buckets] + 0.5))
    w = counts / counts.sum()
    mean = float(w @ bits)
    return [mean, float(np.sqrt(w @ (bits - mean) ** 2)), *(float(w[bits > k].sum()) for k in _RARITY_BINS)]


#: The features whose products are features too: places among those of ``measure``, then among those of ``rarity``.
_CROSSED = (0, 2, 3, 7, 9, 10, 12, 16, 18, 22, 25, 26)
_CROSSED_RARITY = (0, 1, 4, 5)


@dataclass(frozen=True)
class OrdinalModel:
    """Cumulative logit model: P(band <= k) = logistic(cut_k - x w), x with the products of ``crossed``."""

    crossed: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        eta = _crossed(np.clip((x - self.mean) / self.scale, -6, 6), self.crossed) @ self.weights
        upto = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - eta[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(x), 1)), upto, np.ones((len(x), 1))]), axis=1)


def _crossed(z: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    products = [np.clip(z[:, a] * z[:, b], -16, 16) for i, a in enumerate(at) for b in at[i:]]
    return np.column_stack([z, *products]) if products else z


class Graded:
    """Graded documents(x, given) of a table: their features, and how many ratings put them into each band.

    Only sums over them come to the driver, so they may be as many as the table holds.  Its length is the number of ratings.
    """

    #: Sums that come to the driver at once; those of more partitions are added up by as many tasks first.
    SUMS = 16

    def __init__(self, rows: DataFrame, ratings: int):
        self.rows, self.ratings, self.parts = rows, ratings, rows.rdd.getNumPartitions()

    def __len__(self) -> int:
        return self.ratings

    def total(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of f(x, given) over blocks of all rows."""

        def block(it: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            return (f(*(np.stack(pdf[c].to_list()).astype(float) for c in ("x", "given"))) for pdf in it if len(pdf))

        def add(sums: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
            found = sum(sums, start=np.zeros(1))  # of the length of the first one
            yield pd.DataFrame({"sums": [found.tobytes()] if len(found) > 1 else []})

        def again(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return add(np.frombuffer(b) for pdf in it for b in pdf["sums"])

        sums = self.rows.mapInPandas(lambda it: add(block(it)), "sums binary")
        if self.parts > self.SUMS:
            sums = sums.repartition(self.SUMS).mapInPandas(again, "sums binary")
        return np.sum([np.frombuffer(r.sums) for r in sums.collect()], axis=0)


def _terms(x: np.ndarray, given: np.ndarray, crossed: tuple[int, ...], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """What these rows add to the negative log-likelihood, to its gradient by weights and cuts, and to the expected information."""
    z = _crossed(np.clip((x - mean) / scale, -6, 6), crossed)
    padded = np.concatenate([[-np.inf], cuts, [np.inf]])
    upto = 1 / (1 + np.exp(-np.clip(padded - (z @ weights)[:, None], -40, 40)))
    upto[:, 0], upto[:, -1] = 0.0, 1.0
    prob = np.maximum(np.diff(upto), 1e-12)
    slope = upto * (1 - upto)
    up, lo = slope[:, 1:] / prob, slope[:, :-1] / prob  # by the band's upper and lower cut
    by_eta = up - lo
    expected = given.sum(axis=1, keepdims=True) * prob
    gc = (given[:, 1:] * lo[:, 1:] - given[:, :-1] * up[:, :-1]).sum(axis=0)
    ww = z.T @ (z * (expected * by_eta**2).sum(axis=1, keepdims=True))
    wc = z.T @ ((expected * by_eta * lo)[:, 1:] - (expected * by_eta * up)[:, :-1])
    cc = np.diag((expected * up**2)[:, :-1].sum(axis=0) + (expected * lo**2)[:, 1:].sum(axis=0))
    beside = -(expected * up * lo)[:, 1:-1].sum(axis=0)
    cc = cc + np.diag(beside, 1) + np.diag(beside, -1)
    return np.concatenate([[-(given * np.log(prob)).sum()], z.T @ (given * by_eta).sum(axis=1), gc, np.block([[ww, wc], [wc.T, cc]]).ravel()])


def fit_ordinal(x: np.ndarray | None, y: np.ndarray | Graded, *, l2: float = 5.0, bands: int = len(BANDS), steps: int = 400, crossed: tuple[int, ...] = ()) -> OrdinalModel:
    """Maximum penalised likelihood by Fisher scoring; y holds 0 .. bands-1, or both features and bands (x is None then).  Cuts keep their order.

    Rows enter by sums only.  A step takes one pass over them, and a fit about ten.
    """
    total = y.total if isinstance(y, Graded) else lambda f: f(x, np.eye(bands)[y])
    n = len(y)
    first = total(lambda x, given: np.concatenate([given.sum(axis=0), given.sum(axis=1) @ x]))
    of_band, mean = first[:bands], first[bands:] / n
    scale = np.sqrt(total(lambda x, given: given.sum(axis=1) @ (x - mean) ** 2) / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p = len(mean) + len(crossed) * (len(crossed) + 1) // 2

    def cuts_of(v: np.ndarray) -> np.ndarray:  # first cut, then the logarithms of the gaps
        return np.cumsum(np.concatenate([v[p : p + 1], np.exp(np.clip(v[p + 1 :], -20, 5))]))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        weights, cuts = v[:p], cuts_of(v)
        got = total(lambda x, given: _terms(x, given, crossed, mean, scale, weights, cuts))
        by = np.eye(len(v))  # weights and cuts by v
        by[p:, p:] = np.tril(np.ones((bands - 1, bands - 1))) * np.concatenate([[1.0], np.exp(np.clip(v[p + 1 :], -20, 5))])
        g, info = by.T @ got[1 : len(v) + 1], by.T @ got[len(v) + 1 :].reshape(len(v), len(v)) @ by
        g[:p] += l2 * weights
        info[np.diag_indices(p)] += l2
        return float(got[0] + 0.5 * l2 * weights @ weights), g, info

    share = np.clip(np.cumsum(of_band)[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    v = np.concatenate([np.zeros(p), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    f, g, info = loss(v)
    for _ in range(steps):
        q = np.linalg.solve(info + 1e-6 * np.eye(len(v)), g)  # a band without ratings tells nothing of its cuts
        slope = g @ q
        if slope < 1e-9 * max(1.0, abs(f)):
            break
        step = 1.0
        while step > 1e-10:
            f2, g2, info2 = loss(v - step * q)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        v, f, g, info = v - step * q, f2, g2, info2
    return OrdinalModel(crossed, mean, scale, v[:p].copy(), cuts_of(v))


class ReadingLevels:
    """Reading levels of documents(doc_id, text), calibrated to labels(doc_id, rater, band).

    Each rating within the bands counts as one observation of its document; null bands,
    raters' repeated rows and unknown documents do not count.  The model is fitted on all ratings, and
    word counts and the profile of English cover all documents.  Without two different bands among the
    ratings there is no model and no level.  Null or empty texts have no prose and no level.  Rows with
    one doc_id are separate documents; a rating of it is one observation, of the row with the least
    features.  Columns ``keep`` of the documents are carried to the levels.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, *, least_words: int = 40, l2: float = 5.0, keep: Sequence[str] = ()):
        self.least_words, self.keep = least_words, tuple(keep)
        docs = pick(documents, "doc_id", "text", *self.keep)
        context = docs.sparkSession.sparkContext

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                got = [measure(t) for t in pdf["text"]]
                yield pdf.drop(columns="text").assign(**{c: [g[i] for g in got] for i, c in enumerate(("words", "clear", "features", "vocabulary", "counts"))})

        self._kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in self.keep)
        schema = f"doc_id bigint{self._kept}, hash binary, row bigint, words int, clear boolean, features array<float>, vocabulary array<string>, counts array<int>"
        self.measured = stored(language.marked(docs).mapInPandas(run, schema), "measured")
        self.english = context.broadcast(language.profile(self.measured.where("clear").select("hash", "row", "vocabulary", "counts")))
        pairs = self.measured.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("x"))
        at = (F.crc32(F.encode("x.vocabulary", "utf-8")) % BUCKETS).cast("int").alias("b")  # as in `bucket`
        found = pairs.groupBy(at).agg(F.sum("x.counts").alias("n")).toPandas()  # at most BUCKETS rows
        corpus = np.zeros(BUCKETS)
        corpus[found["b"].to_numpy(int)] = found["n"].to_numpy(float)
        self.corpus = context.broadcast(corpus)
        ratings = pick(labels, "doc_id", "rater", "band").where(F.col("band").isin(*BANDS) & F.col("doc_id").isNotNull()).distinct()
        # A row for each rated document, however many raters it has.
        given = stored(ratings.groupBy("doc_id").agg(F.array(*(F.count_if(F.col("band") == b) for b in BANDS)).alias("given")), "given")
        rated = self.measured.join(given.select("doc_id"), "doc_id", "left_semi")
        each = self._scored(rated).groupBy("doc_id").agg(F.min("x").alias("x"))
        graded = stored(each.join(given, "doc_id").select("x", "given"), "graded")
        of_band = [n or 0 for n in graded.agg(*(F.sum(F.col("given")[i]) for i in range(len(BANDS)))).first()]
        self.model = None
        if sum(n > 0 for n in of_band) > 1:
            plain = len(graded.first()["x"]) - len(_RARITY_BINS) - 2
            self.model = fit_ordinal(None, Graded(graded, sum(of_band)), l2=l2, crossed=(*_CROSSED, *(plain + k for k in _CROSSED_RARITY)))

    def _scored(self, rows: DataFrame) -> DataFrame:
        """(doc_id, x) of the rows that are mainly English; x are the features with rarity."""
        corpus, english, vectors, mainly = self.corpus, self.english, self._vectors, self._mainly

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                pdf = pdf[mainly(pdf, english.value)]
                if len(pdf):
                    yield pdf[["doc_id"]].assign(x=list(vectors(pdf, corpus.value).astype(np.float32)))

        return rows.select("doc_id", "features", "vocabulary", "counts").mapInPandas(run, "doc_id bigint, x array<float>")

    @staticmethod
    def _mainly(pdf: pd.DataFrame, english: language.Profile) -> np.ndarray:
        return np.array([english.english(dict(zip(v, c))) for v, c in zip(pdf["vocabulary"], pdf["counts"])], bool)

    @staticmethod
    def _vectors(pdf: pd.DataFrame, corpus: np.ndarray) -> np.ndarray:
        total = corpus.sum()
        return np.array([[*f, *rarity(np.array([bucket(w) for w in v]), np.asarray(c, float), corpus, total)] for f, v, c in zip(pdf["features"], pdf["vocabulary"], pdf["counts"])])

    def levels(self) -> DataFrame:
        """(doc_id, words, band, p_top, score, reason) and the columns kept, one row for every document.

        ``band`` is the likeliest, ``p_top`` the chance of the highest, ``score`` the mean band.  They are null
        where ``reason`` is not: 'no prose', 'not English', 'short' (fewer words of prose than asked for) or 'no model'.
        """
        model, corpus, english, vectors, mainly, keep, least = self.model, self.corpus, self.english, self._vectors, self._mainly, self.keep, self.least_words
        schema = f"doc_id bigint, words int, band int, p_top double, score double{self._kept}, reason string"

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                words = pdf["words"].to_numpy()
                reason = np.select([words == 0, ~mainly(pdf, english.value), words < least], ["no prose", "not English", "short"], "" if model else "no model").astype(object)
                has = reason == ""
                reason[has] = None
                band, p_top, score = pd.array([None] * len(pdf), "Int32"), pd.array([None] * len(pdf), "Float64"), pd.array([None] * len(pdf), "Float64")
                if has.any():
                    p = model.probabilities(vectors(pdf[has], corpus.value))
                    band[has], p_top[has], score[has] = p.argmax(axis=1) + BANDS[0], p[:, -1], p @ np.array(BANDS, float)
                columns = {"doc_id": pdf["doc_id"].array, "words": words, "band": band, "p_top": p_top, "score": score, **{c: pdf[c].array for c in keep}, "reason": reason}
                yield pd.DataFrame(columns)

        return self.measured.select("doc_id", "words", *(F.col(f"`{c}`") for c in keep), "features", "vocabulary", "counts").mapInPandas(run, schema)
