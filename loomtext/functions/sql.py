"""The tokenizer as SQL functions.

pretokenize and pretoken_rows need no tokenizer; encode and decode are Arrow functions over one.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomtext.functions import text as T
from loomtext.operators.tokenizer import Tokenizer, joined, text_encoder, token_stream


class _Pretokens:
    def eval(self, text: str):
        import regex

        for i, p in enumerate(regex.findall(T.PATTERN, text) if text else ()):
            yield i, p


def _table_encoder(shared):
    """Table function classes over a broadcast tokenizer: a row a token, a row a text."""

    def checked(last: StructType):
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            """The key, of the column's own type, then the others: the schema follows the table that is passed."""
            if not rows.isTable or not key.isConstantExpression or not text.isConstantExpression:
                raise ValueError("a table and the names of its key and text columns are wanted")
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            if missing := [c for c in (key.value, text.value) if c not in kinds]:
                raise ValueError(f"the table has no column {missing[0]}")
            if kinds[text.value] != StringType():
                raise ValueError(f"{text.value} isn't text")
            return AnalyzeResult(StructType([StructField(key.value, kinds[key.value]), *last.fields]))

        return staticmethod(analyze)

    class EncodeTable:
        analyze = checked(StructType().add("pos", LongType()).add("token_id", IntegerType()))

        def __init__(self):
            ids, ranks, specials, _ = shared.value
            self.stream = token_stream(ids, ranks, specials)

        def eval(self, row, key: str, text: str):
            if row[text] is not None:
                for i, t in enumerate(self.stream(row[text])):
                    yield row[key], i, t

    class EncodeTexts:
        analyze = checked(StructType().add("ids", ArrayType(IntegerType())))

        def __init__(self):
            ids, ranks, specials, _ = shared.value
            self.encode = text_encoder(ids, ranks, specials)

        def eval(self, row, key: str, text: str):
            yield row[key], None if row[text] is None else self.encode(row[text])

    return EncodeTable, EncodeTexts


def register(spark: SparkSession, tokenizer: Tokenizer | None = None, prefix: str = "lt_") -> None:
    """Adds to spark: the table function {prefix}pretoken_rows(text) -> (pos, pretoken); the scalar function
    {prefix}pretokenize(text) -> array, which the optimizer sees through; and, with a tokenizer, {prefix}encode(text) -> array of ids,
    {prefix}decode(ids) -> text, and the table function {prefix}encode_table(TABLE(...) [PARTITION BY ...], key, text) -> (key, pos, token_id), which is given
    a table and the names of two columns, and makes a row a token without holding a text's ids; {prefix}encode_texts, which is given the same and makes a row (key, ids) a
    text, null for null: a row costs a table function more than a token, so it is the faster one. Null gives null, and no rows."""
    spark.udtf.register(f"{prefix}pretoken_rows", F.udtf(_Pretokens, returnType="pos int, pretoken string"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}pretokenize(text STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(text, {_literal('(?U)' + T.PATTERN)}, 0)")
    if tokenizer is None:
        return
    shared = spark.sparkContext.broadcast((tokenizer.ids, tokenizer.ranks, tokenizer.specials, tokenizer.vocab))  # bounded by the vocabulary

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, ranks, specials, _ = shared.value
        one = text_encoder(ids, ranks, specials)
        for p in parts:
            yield p.map(lambda t: None if t is None else one(t))

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = shared.value[3]
        for p in parts:
            yield p.map(lambda x: None if x is None else joined(vocab, x))

    for name, made in zip(("encode_table", "encode_texts"), _table_encoder(shared), strict=True):
        spark.udtf.register(f"{prefix}{name}", F.udtf(made))
    spark.udf.register(f"{prefix}encode", F.pandas_udf(encode, "array<int>"))
    spark.udf.register(f"{prefix}decode", F.pandas_udf(decode, "string"))


def _literal(text: str) -> str:
    """A raw SQL string literal."""
    return f'r"{text}"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
