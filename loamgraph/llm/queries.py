"""Queries on text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import leakage, packing
from loamgraph.llm.reading import ReadingLevels
from loamgraph.session import load, stored


def p6_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(s, d, "documents"))


def p6_filling(s: SparkSession, d: str) -> DataFrame:
    return packing.filling(packing.pack(load(s, d, "documents")))


def p6_violations(s: SparkSession, d: str) -> DataFrame:
    """What is placed, and the number of breaches of each rule of packing."""
    docs = load(s, d, "documents")
    sizes = stored(packing.token_counts(docs), "sizes")
    return packing.violations(stored(packing.pack(docs), "placed"), sizes).drop("pieces")


def _leaks(s: SparkSession, d: str, **kw) -> DataFrame:
    return leakage.find_leaks(load(s, d, "documents"), load(s, d, "eval_items"), **kw)


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d, least=1.0).where("verbatim").select("item_id", "doc_id")


def p7_near(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d)


def _levels(s: SparkSession, d: str, **kw) -> DataFrame:
    return ReadingLevels(load(s, d, "documents"), load(s, d, "reading_labels"), **kw).levels()


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return _levels(s, d).where("p_top >= 0.5").select("doc_id")


def p8_levels(s: SparkSession, d: str) -> DataFrame:
    return _levels(s, d)


def p8_profile(s: SparkSession, d: str) -> DataFrame:
    """Documents and words of prose by source and band, or the reason why there is none."""
    return _levels(s, d, keep=["source"]).groupBy("source", "band", "reason").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("score").alias("mean_score"))


QUERIES = {
    "p6_containers": p6_containers,
    "p6_filling": p6_filling,
    "p6_violations": p6_violations,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
}

#: What the words' compatibility form needs in DuckDB, which has the canonical form only: full-width characters, and the ligature of f and i.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(33, 127)), "".join(map(chr, range(33, 127))).replace("'", "''")


def _words_sql(text: str) -> str:
    plain = f"nfc_normalize(replace(translate({text}, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'))"
    return rf"regexp_extract_all(lower(regexp_replace({plain}, '\p{{Cf}}', '', 'g')), '[\p{{L}}\p{{Nd}}]+')"


def _windows_sql(id_: str, text: str, table: str) -> str:
    return f"""SELECT DISTINCT {id_}, array_to_string(list_slice(ws, i, i + 12), ' ') AS passage
        FROM (SELECT {id_}, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT {id_}, {_words_sql(text)} AS ws FROM {table} WHERE {text} IS NOT NULL AND {id_} IS NOT NULL))"""


#: SQL where it can express a query; tests/llm hold the others against brute force, round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "p6_violations": """SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS placed, 0::BIGINT AS lost, 0::BIGINT AS added, 0::BIGINT AS cut,
        0::BIGINT AS overfull, 0::BIGINT AS overlap, 0::BIGINT AS gap FROM documents WHERE length(text) > 0""",
    "p7_found": f"""WITH i AS ({_windows_sql("item_id", "prompt", "eval_items")}), d AS ({_windows_sql("doc_id", "text", "documents")})
        SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (passage)""",
}
