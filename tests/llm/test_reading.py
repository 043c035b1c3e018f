"""Reading levels: prose, the ordinal model, and held-out accuracy."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loamgraph.llm import language
from loamgraph.llm import reading as R
from loamgraph.llm.prose import prose
from loamgraph.llm.queries import QUERIES

SENTENCE = "The group looks simple because some tables are regular."


def test_prose_of_each_style():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Title\n", "\n", SENTENCE]}, {"cell_type": "code", "source": "print('no.')", "outputs": []}]}
    script = f"# %% [markdown]\n# {SENTENCE}\n# %% In[1]\n# TODO this is not prose.\nx = 1\n# %% [output]\n#> a sentence here. Not prose.\n"
    plain = f"# Title\n\n{SENTENCE}\n\nIn [1]:\nfor i in range(3):\n\nOut[1]:\n  a  b\n\n$$x = 1$$\n\n- {SENTENCE}\n\nWords: metamorph, quasicausal, hyperlineal, multiform.\n"
    assert prose(json.dumps(nb)) == [SENTENCE] and prose(script) == [SENTENCE] and prose(plain) == [SENTENCE, SENTENCE]
    tight = f"In [1]:\nx = f(1)\n# TODO is not done.\n{SENTENCE}\nOut[1]:\n3.5\n- {SENTENCE}\nIn [2]:\nend\n"  # no empty lines
    assert prose(tight) == [SENTENCE, SENTENCE]
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in SENTENCE).replace("l", "l\u200b")
    assert prose(wide) == [SENTENCE]
    assert prose(None) == prose("") == prose('{"cells": [') == []


def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    eta = x @ np.array([2.0, -1.0, 0.5, 0.0])
    y = np.digitize(eta + rng.logistic(size=3000) * 0.5, [-1.5, 0.0, 1.5])
    m = R.fit_ordinal(x[:2000], y[:2000])
    p = m.probabilities(x[2000:])
    assert np.all(np.diff(m.cuts) > 0) and np.allclose(p.sum(axis=1), 1)
    best = np.digitize(eta[2000:], [-1.5, 0.0, 1.5]) == y[2000:]  # what the true weights reach
    assert (p.argmax(axis=1) == y[2000:]).mean() > best.mean() - 0.02
    w = m.weights / m.scale
    assert np.allclose(w / w[0], [1, -0.5, 0.25, 0], atol=0.05)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    levels = R.ReadingLevels(docs, labels.where(~held)).levels()
    truth = labels.where(held & F.col("band").isNotNull()).groupBy("doc_id").agg(F.median("band").alias("m"))
    rows = levels.join(truth, "doc_id").select("band", "m").collect()
    assert len(rows) > 20 and np.mean([abs(r.band - r.m) <= 0.5 for r in rows]) > 0.85


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, SENTENCE * 3000), (4, "x" * 200_000), (4, SENTENCE)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(3, "a", 2), (4, "a", 4), (3, "b", None), (99, "a", 1), (None, "a", 1), (3, None, 9)], "doc_id bigint, rater string, band int")
    got = R.ReadingLevels(docs, labels).levels().collect()
    assert sorted((r.doc_id, r.band is None, r.reason) for r in got) == [(1, True, "no prose"), (2, True, "no prose"), (3, False, None), (4, True, "no prose"), (4, True, "short")]
    assert {r.reason for r in R.ReadingLevels(docs, labels.limit(0)).levels().collect()} == {"no prose", "short", "no model"}
    assert R.ReadingLevels(docs.limit(0), labels).levels().count() == 0


OTHERS = {
    "nl": "de hond loopt door het park en hij ziet een kat die op de muur zit omdat het mooi weer is vandaag en wij gaan naar huis want er is nog veel werk te doen voordat de zon onder gaat en de kinderen moeten naar bed",
    "id": "saya pergi ke pasar untuk membeli ikan dan sayuran karena ibu akan memasak makan malam untuk keluarga besar kami di rumah dan kami semua akan makan bersama setelah matahari terbenam",
    "it": "il cane corre nel parco e vede un gatto che siede sul muro perché oggi fa bel tempo e noi andiamo a casa insieme con gli amici per mangiare qualcosa di buono prima che il sole tramonti",
    "sv": "hunden springer i parken och ser en katt som sitter på muren eftersom det är vackert väder idag och vi ska gå hem tillsammans för att äta något gott innan solen går ner",
    "fr": "le chien court dans le parc et il voit un chat qui est assis sur le mur car il fait beau et nous allons tous ensemble à la maison pour manger quelque chose avant le coucher du soleil",
}
ENGLISH = "the dog runs through the park and sees a cat that sits on the wall because the weather is fine today and we go home together to eat something good before the sun sets"


def test_languages_without_a_list_are_not_english(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profile = language.fit(docs, R.prose_words)
    assert profile.english(Counter(ENGLISH.split()))
    assert not any(profile.english(Counter(t.split())) for t in OTHERS.values())
    rows = docs.where("lang IN ('en', 'EN', 'de', 'es') AND text IS NOT NULL").select("lang", "text").collect()
    got = [(r.lang.lower() == "en", profile.english(w)) for r in rows if (w := R.prose_words(r.text)).total() >= 40]
    assert len(got) > 700 and np.mean([a == b for a, b in got]) > 0.99
    assert language.fit(docs.limit(0), R.prose_words).english(Counter(ENGLISH.split())) and not profile.english(Counter())


def test_profile_of_repeated_and_null_ids(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spark.read.parquet(f"{small}/reading_labels.parquet").write.parquet(f"{tmp_path}/reading_labels.parquet")
    labelled = spark.read.parquet(f"{small}/reading_labels.parquet").where("band IS NOT NULL").select("doc_id").distinct()
    again = docs.unionByName(docs.join(labelled, "doc_id", "left_semi").select(docs.columns)).unionByName(docs.withColumn("doc_id", F.lit(None).cast("bigint")))
    again.write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    levels = QUERIES["p8_levels"](spark, d).select("doc_id", "words").collect()
    profile = QUERIES["p8_profile"](spark, d).collect()
    assert sum(r.documents for r in profile) == len(levels) and any(r.doc_id is None for r in levels) and len({r.doc_id for r in levels}) < len(levels)
    assert sum(r.words for r in profile) == sum(r.words for r in levels)


def test_repeated_documents_do_not_weigh_more(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_labels"))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").limit(60)
    seen = []
    fit, R.fit_ordinal = R.fit_ordinal, lambda x, y, **kw: seen.append(len(y)) or fit(x, y, **kw)
    try:
        for d in (docs, docs.unionByName(docs)):
            R.ReadingLevels(d, labels)
    finally:
        R.fit_ordinal = fit
    assert len(seen) == 2 and seen[0] == seen[1]


def test_every_rating_counts(spark):
    """More ratings than any sample would hold, in blocks whose sums come to the driver in two steps, give the model of all ratings."""
    texts = ["The cat sat on the mat and it was glad to be there. " * 3, "Although the committee deliberated, the proposals that remained were, notwithstanding every objection, adopted. " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.range(30_000).selectExpr("id % 2 AS doc_id", "CAST(id AS STRING) AS rater", "CAST(1 + id % 2 + IF(id % 3 = 0, 1, 0) AS INT) AS band")
    seen = []
    fit, R.fit_ordinal = R.fit_ordinal, lambda x, y, **kw: seen.append(len(y)) or fit(x, y, **kw)
    try:
        R.ReadingLevels(docs, labels)
    finally:
        R.fit_ordinal = fit
    assert seen == [30_000]
    rng = np.random.default_rng(7)
    x, given = rng.normal(size=(900, 5)).astype(np.float32), rng.integers(0, 3, size=(900, 4))
    x[:, 0] += given @ [0, 1, 2, 3]
    rows = spark.createDataFrame([(a.tolist(), g.tolist()) for a, g in zip(x, given)], "x array<float>, given array<bigint>").repartition(40)
    spread = R.Graded(rows, int(given.sum()))
    assert spread.parts > spread.SUMS
    whole = R.fit_ordinal(np.repeat(x.astype(float), given.sum(axis=1), axis=0), np.concatenate([np.repeat(np.arange(4), g) for g in given]), crossed=(0, 1))
    got = R.fit_ordinal(None, spread, crossed=(0, 1))
    assert np.allclose(got.weights, whole.weights, atol=1e-5) and np.allclose(got.cuts, whole.cuts, atol=1e-5) and np.allclose(got.mean, whole.mean)


def test_profile_of_english_from_every_text(spark):
    """All different texts, of more than any sample would hold, and none twice."""
    letters = "abcdefghijklmnopqrst"
    texts = [f"The {letters[i // 400]}{letters[i // 20 % 20]}{letters[i % 20]}x is one of the things that we see here." for i in range(3000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:700], None, "Der Hund und die Katze."]], "text string").repartition(3)
    counts = np.zeros(language.TRIGRAMS)
    for w, n in sum(map(R.prose_words, texts), Counter()).items():
        np.add.at(counts, language.trigrams(w), n)
    profile = language.fit(docs, R.prose_words)
    assert np.allclose(profile.log, language.Profile(counts).log, atol=1e-12) and np.isfinite(profile.least)
