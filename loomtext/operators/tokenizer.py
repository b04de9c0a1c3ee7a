"""A BPE tokenizer over DataFrames."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import merges as M
from loomtext.operators import training
from loomtext.sources import files, token_files
from loomtext.sources.arrow import by_bytes

#: Up to so many merges run as one SQL expression over distinct pre-tokens; more run in Arrow batches.
EXPRESSION_MERGES = 512
#: Bytes of distinct pre-tokens with their tokens that may be broadcast, and tasks over which a frequent one is dealt beyond that.
WORDS, SALTS = 96 << 20, 64
#: Bytes of texts, in UTF-8, that a task of encode_joined encodes.
CHUNK = 8 << 20


class Tokenizer:
    """vocab: id -> bytes; merges in rank order. Special tokens that the vocabulary lacks get the next ids; the caller's dict
    isn't changed."""

    def __init__(self, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], special_tokens: list[str] | None = None):
        self.vocab, self.merges, self.specials = dict(vocab), list(merges), list(special_tokens or [])
        known = set(self.vocab.values())
        for s in self.specials:
            if s.encode() not in known:
                self.vocab[max(self.vocab, default=-1) + 1] = s.encode()
        self.ids = {t: i for i, t in self.vocab.items()}
        self.ranks = {m: i for i, m in enumerate(self.merges)}

    @classmethod
    def from_files(cls, vocab_path: str, merges_path: str, special_tokens: list[str] | None = None) -> Tokenizer:
        """Of a vocabulary file of either form (files.read_vocab); the merge list is read in the same form."""
        return cls(files.read_vocab(vocab_path), files.read_merges(merges_path, files.is_byte_level(vocab_path)), special_tokens)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(token_id, token)."""
        return spark.createDataFrame(sorted(self.vocab.items()), "token_id int, token binary")

    def words(self, pretokens: DataFrame, column: str = "pretoken") -> DataFrame:
        """Distinct pre-tokens with their merged symbol strings: (pretoken, word)."""
        return self.merged(pretokens.select(F.col(column).alias("pretoken")).where("pretoken is not null").distinct())

    def merged(self, rows: DataFrame) -> DataFrame:
        """rows, whose first column is `pretoken`, with its merged symbol string in a column `word`."""
        if len(self.merges) <= EXPRESSION_MERGES and M.in_order(self.merges):
            hexes = [(a.hex().upper(), b.hex().upper()) for a, b in self.merges]
            return rows.withColumn("word", T.apply_merges(T.symbols(F.col("pretoken")), hexes))
        ranks = rows.sparkSession.sparkContext.broadcast(self.ranks)  # bounded by the vocabulary

        def run(batches):
            for b in by_bytes(batches, 0):
                got = ["".join(f"<{s.hex().upper()}>" for s in M.encode_word(w.encode(), ranks.value)) for w in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "word"])

        return rows.mapInArrow(run, rows.withColumn("word", F.lit("")).schema)

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise") -> DataFrame:
        """(key, ids): Arrow batches, bounded in bytes, each worker keeping the ids of pre-tokens it has met. No shuffle.

        A text with a symbol that the vocabulary lacks raises, or with unknown="null" gives null. Null text gives null, empty text no ids.
        """
        return self._encoded(docs, key, text, unknown, "array<int>", lambda got: pa.array(got, pa.list_(pa.int32())))

    def encode_packed(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise", width: int = 2) -> DataFrame:
        """encode with ids as token_files packs them, integers of 2 or 4 bytes; a text without ids gives empty bytes."""

        if max(self.vocab, default=0) >= 1 << 8 * width:
            raise ValueError(f"token ids don't fit into {width} bytes")
        return self._encoded(docs, key, text, unknown, "binary", lambda got: pa.array(got, pa.binary()), width)

    def _encoded(self, docs: DataFrame, key: str, text: str, unknown: str, kind: str, column, width: int | None = None) -> DataFrame:
        me = docs.sparkSession.sparkContext.broadcast((self.ids, self.ranks, self.specials))  # bounded by the vocabulary
        skip = _skips(unknown)

        def run(batches):
            ids, ranks, specials = me.value
            encode = text_encoder(ids, ranks, specials) if width is None else packed_encoder(ids, ranks, specials, width)

            def one(t):
                try:
                    return None if t is None else encode(t)
                except UnknownSymbol:
                    if skip:
                        return None
                    raise

            for b in by_bytes(batches, 1):
                got = column([one(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), got], names=[key, "ids"])

        return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids {kind}")

    def encode_relational(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise", frequent: int = 2_000, most: int = WORDS) -> DataFrame:
        """(key, seg, tok, part, token_id, token) for every token, by joins only: met_relational, a row a token."""
        met = self.met_relational(docs, key, text, unknown, frequent, most)
        return met.select(key, "seg", "tok", F.explode("parts").alias("t")).select(key, "seg", "tok", "t.*")

    def met_relational(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise", frequent: int = 2_000, most: int = WORDS) -> DataFrame:
        """(key, seg, tok, parts) for every pre-token, parts being its tokens (part, token_id, token) in order, by joins only: pre-tokens, each distinct one merged once, then looked up.

        The texts are read once to count their pre-tokens and once more for the join. Distinct pre-tokens with their tokens are broadcast if they
        have `most` bytes at most, which is measured. Beyond that they are shuffled, and as a few of them make up much of any text, each of the
        `frequent` most counted ones is dealt over SALTS tasks. A symbol that the vocabulary lacks raises, or with unknown="null" has a null id.
        """
        seg = docs.select(key, F.posexplode(T.split_special(F.col(text), self.specials)).alias("seg", "s"))
        special = F.col("s").isin(*self.specials) if self.specials else F.lit(False)
        tok = seg.select(key, "seg", special.alias("special"), F.posexplode(F.when(special, F.array("s")).otherwise(T.pretokenize(F.col("s")))).alias("tok", "pretoken"))
        ids, token_id = self._looked_up(docs.sparkSession, unknown)
        counted = self.merged(training.pretoken_counts(docs, self.specials, text))
        found = counted.select("pretoken", "n", F.posexplode(T.symbol_list(F.col("word"))).alias("part", "token")).join(F.broadcast(ids), "token", "left")
        found = found.groupBy("pretoken", "n").agg(F.array_sort(F.collect_list(F.struct("part", token_id.alias("token_id"), "token"))).alias("parts"))
        found = files.stored(found, "words")
        own = F.array(F.struct(F.lit(0).alias("part"), F.element_at(self._special_ids(), F.col("pretoken")).alias("token_id"), F.hex(F.encode("pretoken", "UTF-8")).alias("token")))
        near = found.select("pretoken", "parts")
        if self._bytes(found) <= most:
            met = tok.join(F.broadcast(near), "pretoken", "left")
        else:
            top = found.orderBy(F.desc("n"), "pretoken").limit(frequent).select("pretoken", F.lit(True).alias("top"))
            deal = F.when(F.col("top"), F.pmod(F.xxhash64(key, "seg", "tok"), F.lit(SALTS)).cast("int")).otherwise(0)
            tok = tok.join(F.broadcast(top), "pretoken", "left").withColumn("salt", deal).drop("top")
            copies = F.when(F.col("top"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            near = near.join(F.broadcast(top), "pretoken", "left").select("pretoken", "parts", F.explode(copies).alias("salt"))
            met = tok.join(near, ["pretoken", "salt"], "left")
        return met.select(key, "seg", "tok", F.when(F.col("special"), own).otherwise(F.col("parts")).alias("parts"))

    def encode_columns(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise") -> DataFrame:
        """(key, ids) as encode gives them, without Python: as one expression over each text and no shuffle, or, where merges or special tokens don't run as
        one, by encode_joined."""
        if len(self.merges) > EXPRESSION_MERGES or len(self.specials) > T.MANY or not M.in_order(self.merges):
            return self.encode_joined(docs, key, text, unknown)
        return docs.select(key, T.encoded(F.col(text), self.ids, self.merges, self.specials, _skips(unknown)).alias("ids"))

    def encode_joined(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: str = "raise", size: int = CHUNK) -> DataFrame:
        """(key, ids) as encode gives them, by joins; key must be unique.

        Texts are dealt by their keys into chunks of about `size` bytes. Behind that exchange a task finds the distinct pre-tokens of its chunk, merges and
        looks up each once, and joins them with the chunk's pre-tokens, so none of these leaves its task; merges that don't run as an expression deal the
        distinct ones again. What is shuffled follows the texts, what a task holds follows a chunk, or its longest text.
        """
        spark = docs.sparkSession
        n = max(spark.sparkContext.defaultParallelism, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // size))
        chunk = F.coalesce(F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.lit(0))  # never null, or the join would filter one of two equal exchanges
        dealt = docs.select(key, text).repartitionById(n, chunk).select(chunk.alias("chunk"), F.struct(key).alias("row"), F.col(text).alias("text"))
        # A last pre-token "" for every text but null leaves a row of those without any.
        own = F.concat(T.pieces(F.col("text"), self.specials), F.array(F.lit("")))
        tok = dealt.select("chunk", "row", F.posexplode_outer(own).alias("pos", "pretoken"))
        words = self.merged(tok.where(~F.col("pretoken").isin("", *self.specials)).select("pretoken", "chunk").distinct())
        ids, token_id = self._looked_up(spark, unknown)
        found = words.select("chunk", "pretoken", F.posexplode(T.symbol_list(F.col("word"))).alias("part", "token")).join(F.broadcast(ids), "token", "left")
        found = found.groupBy("chunk", "pretoken").agg(F.sort_array(F.collect_list(F.struct("part", token_id.alias("token_id")))).alias("parts"))
        found = found.select("chunk", "pretoken", F.when(F.forall("parts", lambda p: p["token_id"].isNotNull()), F.col("parts")["token_id"]).alias("found"))
        got = tok.join(found.hint("shuffle_hash"), ["chunk", "pretoken"], "left")
        fixed = F.when(F.col("pretoken") == "", F.array().cast("array<int>"))
        if self.specials:
            fixed = fixed.when(F.col("pretoken").isin(*self.specials), F.array(F.element_at(self._special_ids(), F.col("pretoken"))))
        got = got.groupBy("chunk", "row").agg(F.sort_array(F.collect_list(F.struct("pos", fixed.otherwise(F.col("found")).alias("ids")))).alias("all"))
        return got.select(F.col("row")[key].alias(key), F.flatten(F.col("all")["ids"]).alias("ids"))

    def _looked_up(self, spark: SparkSession, unknown: str) -> tuple[DataFrame, Column]:
        """(token_id, token) with tokens in hex, and the id of a symbol left-joined with it: one that the vocabulary lacks raises, or has none."""
        ids = self.vocabulary(spark).select("token_id", F.hex("token").alias("token"))
        return ids, F.col("token_id") if _skips(unknown) else F.coalesce("token_id", F.raise_error(F.concat(F.lit("symbol not in the vocabulary: "), F.col("token"))).cast("int"))

    @staticmethod
    def _bytes(found: DataFrame) -> int:
        """Bytes in memory of pre-tokens with their parts, or a little over them."""
        return found.agg(F.sum(64 + F.octet_length("pretoken") + F.aggregate("parts", F.lit(0), lambda a, p: a + 48 + F.octet_length(p["token"])))).first()[0] or 0

    def _special_ids(self) -> Column:
        return F.create_map(*(x for s in self.specials for x in (F.lit(s), F.lit(self.ids[s.encode()])))).cast("map<string,int>")

    def decode(self, df: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
        """(key, text): bytes of all ids joined, then read as UTF-8 with replacement. Null ids give null; an id that the vocabulary lacks, or a
        null one among others, raises ValueError."""
        vocab = df.sparkSession.sparkContext.broadcast(self.vocab)  # bounded by the vocabulary

        def run(batches: Iterator[pa.RecordBatch]):
            for b in by_bytes(batches, 1):
                got = [None if x is None else joined(vocab.value, x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[key, "text"])

        return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")

    def encode_text(self, text: str) -> list[int]:
        return text_encoder(self.ids, self.ranks, self.specials)(text)

    def encode_iterable(self, texts) -> Iterator[int]:
        """Each element by itself; no pre-token spans two elements."""
        stream = token_stream(self.ids, self.ranks, self.specials)
        for t in texts:
            yield from stream(t)

    def decode_ids(self, ids: list[int]) -> str:
        """An id that the vocabulary lacks raises ValueError."""
        return joined(self.vocab, ids)


class UnknownSymbol(KeyError):
    """A symbol that the vocabulary lacks."""


def _skips(unknown: str) -> bool:
    if unknown not in ("raise", "null"):
        raise ValueError("unknown must be raise or null")
    return unknown == "null"


def joined(vocab: dict[int, bytes], ids: list[int]) -> str:
    """The text of ids; one that the vocabulary lacks, or a null one, raises ValueError."""
    try:
        return b"".join(map(vocab.__getitem__, ids)).decode("utf-8", "replace")
    except KeyError as e:
        raise ValueError(f"token id not in the vocabulary: {e.args[0]}") from None


#: The longest pre-token, in characters, whose ids a worker remembers, and the number of these: up to some 250 bytes each, so 30 MB.
LONGEST, KNOWN = 64, 1 << 17


def text_encoder(ids: dict[bytes, int], ranks: dict, specials: list[str], most: int = KNOWN):
    """A function from text to its list of ids that remembers up to `most` pre-tokens."""
    parts = _encoded_parts(ids, ranks, specials, most)

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for p in parts(text):
            out += p
        return out

    return encode


def packed_encoder(ids: dict[bytes, int], ranks: dict, specials: list[str], width: int, most: int = KNOWN):
    """text_encoder with the ids as token_files packs them, which are never a list of numbers."""
    parts = _encoded_parts(ids, ranks, specials, most, lambda got: token_files.pack(got, width))
    return lambda text: b"".join(parts(text))


def token_stream(ids: dict[bytes, int], ranks: dict, specials: list[str], most: int = KNOWN):
    """A function from text to an iterator of its ids, of which those of one pre-token are held."""
    parts = _encoded_parts(ids, ranks, specials, most)
    return lambda text: (i for p in parts(text) for i in p)


def _encoded_parts(ids: dict[bytes, int], ranks: dict, specials: list[str], most: int, form=tuple):
    """A function from text to an iterator of ids in a form, one for each pre-token or special token."""
    import regex

    pattern = regex.compile(T.PATTERN)
    split = T.special_splitter(specials)
    special, known = set(specials), {}

    def encode(text: str) -> Iterator:
        for part in split(text):
            if part in special:
                yield form([ids[part.encode()]])
                continue
            for p in (p for piece in T.cut(part) for p in pattern.findall(piece)):
                got = known.get(p)
                if got is None:
                    try:
                        got = form([ids[x] for x in M.encode_word(p.encode(), ranks)])
                    except KeyError as e:
                        raise UnknownSymbol(*e.args) from None
                    if len(known) >= most:
                        known.clear()
                    if len(p) <= LONGEST:
                        known[p] = got
                yield got

    return encode


def tokenizable(words: DataFrame, vocab: Column | DataFrame) -> DataFrame:
    """words (key..., word) with `ok`: whether all symbols are in the vocabulary (token_id, token)."""
    keys = [c for c in words.columns if c != "word"]
    parts = words.select(*keys, F.explode(T.symbol_list(F.col("word"))).alias("token"))
    known = vocab.select(F.hex("token").alias("token"), F.lit(1).alias("known"))
    return parts.join(F.broadcast(known), "token", "left").groupBy(*keys).agg(F.bool_and(F.col("known").isNotNull()).alias("ok"))
