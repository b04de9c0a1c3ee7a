"""Structured Streaming: stateless encoding, and running pre-token counts (an extension)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.tokenizer import Tokenizer


def encode_stream(rows: DataFrame, tokenizer: Tokenizer, key: str, text: str = "text") -> DataFrame:
    """(key, ids) for each row as it arrives; rows are encoded one by one, so no state is kept."""
    return tokenizer.encode(rows, key, text)


def count_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """Running (pretoken, n), for output mode complete or update."""
    return rows.select(F.explode(T.pretokenize(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))
