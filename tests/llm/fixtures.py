"""Rows that every operator must take: missing values, empty and long texts, ties,
repeated rows, and extra columns whose names the operators use themselves."""

from __future__ import annotations

EXTRA = "key string, n int, score string, copies string, spans string, rank int"


def documents(spark, rows):
    """``rows``: (doc_id, text); with lang, source, n_chars and clashing columns."""
    return spark.createDataFrame([(i, t, None if i is None else ("en", "de")[i % 2], "s", None, "k", 1, "x", "y", "z", 2) for i, t in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


PROSE = ("the river runs below the old stone bridge and the children watch the slow boats pass under it every morning "
         "while their teacher counts the birds that rest on the long wooden rail beside the quiet water").split()


def prose(start: int, words: int) -> str:
    return " ".join(f"{PROSE[(start * 7 + k * 5 + k * k) % len(PROSE)]}{(start * 13 + k * 3) % 17}" for k in range(words))
