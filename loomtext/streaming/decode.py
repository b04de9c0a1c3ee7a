"""Decoding of token streams, with the unfinished bytes of a character held as state between rows and micro-batches."""
from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

#: transformWithState keeps its state there.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decode_stream(rows: DataFrame, vocab: dict[int, bytes], key: str, order: str, ids: str = "ids") -> DataFrame:
    """(key, order, text) for rows (key, order, ids) of a stream: the texts of a key, joined in order, are what batch decoding makes of all its ids.

    A character whose bytes are split over rows or micro-batches comes with the row that ends it; up to three bytes a key are the state. A row with null
    ids ends its key: bytes left over become U+FFFD. Within a micro-batch a key's rows are taken by `order`; they must come in that order from one
    micro-batch to the next. An id that the vocabulary lacks raises.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    vocab = dict(vocab)  # goes with the function: its first run, on the driver, knows no broadcasts
    kinds = [rows.schema[key], rows.schema[order]]

    class Decoder(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rest = handle.getValueState("rest", "data binary")

        def handleInputRows(self, of, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            if self.rest.exists():
                decoder.setstate((bytes(self.rest.get()[0]), 0))
            got = pd.concat(list(parts)).sort_values(order, kind="stable")  # a key's rows of one micro-batch
            texts = []
            for x in got[ids]:
                if x is None:
                    texts.append(decoder.decode(b"", final=True))
                    decoder.reset()
                else:
                    try:
                        texts.append(decoder.decode(b"".join(vocab[int(i)] for i in x)))
                    except KeyError as e:
                        raise ValueError(f"token id not in the vocabulary: {e.args[0]}") from None
            held = decoder.getstate()[0]
            if held:
                self.rest.update((held,))
            else:
                self.rest.clear()
            yield pd.DataFrame({key: [of[0]] * len(texts), order: got[order].tolist(), "text": texts})

        def close(self) -> None:
            """Nothing is held open."""

    out = StructType([*kinds, StructField("text", StringType())])
    return rows.select(key, order, ids).groupBy(key).transformWithStateInPandas(Decoder(), out, "Append", "None")
