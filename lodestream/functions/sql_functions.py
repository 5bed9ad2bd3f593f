"""The library's functions for SQL text: scalar ones as SQL expressions, one that gives a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import EDGE_CHARS, STOPWORDS


class _Sentences:
    """``lode_sentences(text)``: one row per sentence, in order."""

    def eval(self, text: str):
        import re

        for s in re.split(r"[.!?]+(?:\s|$)", text or ""):
            s = s.strip(" \t\n\r\x0b\x0c")
            if s:
                yield (s,)


def register(spark: SparkSession) -> None:
    """Make ``lode_n_terms(text)``, ``lode_clip(x)``, ``lode_sigmoid(x)`` and the table function ``lode_sentences(text)`` callable in this session."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    words = ", ".join(quote(w) for w in STOPWORDS)
    space = r"[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x1c-\\x1f]+"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION lode_n_terms(t STRING) RETURNS INT RETURN size(array_distinct(filter(transform(split(regexp_replace(t, '<[^>]+>', ' '), '{space}'), w -> btrim(lower(w), {quote(EDGE_CHARS)})), "
        rf"w -> length(w) >= 3 AND w NOT IN ({words}) AND NOT contains(w, '://') AND NOT w RLIKE '^[0-9][0-9.]*$' AND NOT w RLIKE '^[-#]{{2,}}$' AND w RLIKE '[\\p{{L}}\\p{{N}}]')))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lode_clip(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lode_sigmoid(x DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-x))")
    spark.udtf.register("lode_sentences", F.udtf(_Sentences, returnType="sentence: string"))
