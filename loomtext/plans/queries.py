"""The registered queries of the corpus, tokenizer and vector operators, each with its DuckDB counterpart where SQL can say it."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import nn, sql, tiles, train
from loomtext.functions import text as T
from loomtext.operators import corpus, frequent, grouped, merges, tokenizer, training
from loomtext.sources import files, token_files

#: A small vocabulary for the queries: merges in rank order.
PAIRS = [(" ", "t"), ("h", "e"), ("i", "n"), ("r", "e"), (" t", "he"), ("o", "n"), ("e", "r"), (" ", "a"), ("a", "t"), ("e", "n"), ("n", "d"), ("o", "r"), ("e", "s"), ("t", "i"), (" a", "nd"), ("ti", "on"), ("in", "g"), ("o", "u"), ("l", "y"), ("s", "t"), ("d", "e"), ("c", "h"), ("i", "e"), ("l", "e")]
MERGES = [(a.encode(), b.encode()) for a, b in PAIRS]
SPECIALS = [T.END, T.END * 2]
VOCAB = dict(enumerate([bytes([i]) for i in range(256)] + [s.encode() for s in SPECIALS] + [a + b for a, b in MERGES]))
HEXES = [(a.hex().upper(), b.hex().upper()) for a, b in MERGES]
ROUNDS, TOP, VOCAB_SIZE = 4, 10, 500
assert merges.in_order(MERGES)

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return files.read_table(spark, f"{d}/{name}.parquet")


def book() -> tokenizer.Tokenizer:
    return tokenizer.Tokenizer(VOCAB, MERGES, SPECIALS)


# ---- SQL fragments -------------------------------------------------------------------------------------------------
_WS = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PIECE = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+"


def sql_pretokens(text: str) -> str:
    """Pre-tokens without look-ahead: a mark before the last blank of a run that precedes a non-blank."""
    marked = rf"regexp_replace({text}, '([{_WS}])([^{_WS}])', chr(57344) || '\1\2', 'g')"
    return f"flatten(list_transform(string_split({marked}, chr(57344)), lambda x: regexp_extract_all(x, '{_PIECE}')))"


def sql_symbols(word: str) -> str:
    return f"regexp_replace(hex(encode({word})), '(..)', '<\\1>', 'g')"


def sql_merged(word: str, hexes=None) -> str:
    for a, b in HEXES if hexes is None else hexes:
        word = f"replace({word}, '<{a}><{b}>', '<{a}{b}>')"
    return word


SQL_COUNTS = f"SELECT pretoken, count(*) AS n FROM (SELECT unnest({sql_pretokens('text')}) AS pretoken FROM documents) GROUP BY pretoken"
SQL_PAIRS = """SELECT s[i] AS l, s[i + 1] AS r, sum(n)::BIGINT AS c FROM (SELECT string_split(substr(word, 2, length(word) - 2), '><') AS s, n FROM {0}) x,
  unnest(range(1, len(s))) AS u(i) GROUP BY 1, 2"""
SQL_VOCAB = "(VALUES " + ", ".join(f"({i}, '{t.hex().upper()}')" for i, t in VOCAB.items()) + ") AS vocab(token_id, token)"
_FLAT = "string_split(substr(w, 2, length(w) - 2), '><')"


# ---- text ----------------------------------------------------------------------------------------------------------
@query(SQL_COUNTS)
def pretoken_counts(spark, d):
    return training.pretoken_counts(read(spark, d, "documents"))


@query(f"SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {sql_pretokens('text')} AS p FROM documents)")
def pretokenize(spark, d):
    p = read(spark, d, "documents").select("doc_id", T.pretokenize(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(f"SELECT page_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT page_id, {sql_pretokens('html')} AS p FROM pages)")
def pretokenize_pages(spark, d):
    p = read(spark, d, "pages").select("page_id", T.pretokenize(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


_MARKED = f"concat(text, '{T.END}{T.END}', source, '{T.END}', lang)"


@query(rf"""SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, md5(unnest(s)) AS digest FROM (SELECT doc_id,
  list_filter(string_split(regexp_replace({_MARKED}, '(<\|endoftext\|><\|endoftext\|>|<\|endoftext\|>)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '') AS s FROM documents)""")
def special_split(spark, d):
    s = T.split_special(F.expr(_MARKED), SPECIALS)
    return read(spark, d, "documents").select("doc_id", F.posexplode(s).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("digest"))


_FOUND = [" of the ", " of ", "ing ", "tion", " the th", "é"]
_FOUND_SQL = "(" + "|".join(sorted(_FOUND, key=len, reverse=True)) + ")"


@query(f"""SELECT doc_id, len(s)::BIGINT AS n_special, md5(array_to_string(list_filter(p, lambda x: x <> ''), '|') || '#' || array_to_string(s, '|')) AS digest
  FROM (SELECT doc_id, string_split_regex(text, '{_FOUND_SQL}') AS p, regexp_extract_all(text, '{_FOUND_SQL}') AS s FROM documents)""")
def special_split_many(spark, d):
    """10,000 special tokens, of which the last six occur."""
    specials = [f"<|special {i}|>" for i in range(10_000 - len(_FOUND))] + _FOUND
    docs = read(spark, d, "documents")
    parts = corpus.split_at_specials(docs, specials).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment", "special"))).alias("t"))
    parts = docs.select("doc_id").join(parts, "doc_id", "left").withColumn("t", F.coalesce("t", F.array().cast(parts.schema["t"].dataType)))
    of = lambda special: F.transform(F.filter("t", lambda x: x["special"] == special), lambda x: x["segment"])
    return parts.select("doc_id", F.size(of(True)).cast("long").alias("n_special"), F.md5(F.concat(F.array_join(of(False), "|"), F.lit("#"), F.array_join(of(True), "|"))).alias("digest"))


@query(f"SELECT pretoken, {sql_symbols('pretoken')} AS word, octet_length(encode(pretoken))::BIGINT AS n_bytes FROM ({SQL_COUNTS})")
def byte_symbols(spark, d):
    c = training.pretoken_counts(read(spark, d, "documents"))
    return c.select("pretoken", T.symbols(F.col("pretoken")).alias("word"), F.octet_length("pretoken").cast("long").alias("n_bytes"))


@query(f"""SELECT conv_id, pos, document FROM (SELECT conv_id, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, regexp_replace(unnest(s), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS document
  FROM (SELECT conv_id, string_split(string_agg(text, ' {T.END}' || chr(10) ORDER BY turn, role, text), '{T.END}') AS s FROM conversations GROUP BY conv_id)) WHERE document <> ''""")
def split_documents(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    joined = rows.select("conv_id", F.array_join(F.transform("t", lambda r: r["text"]), f" {T.END}\n").alias("text"))
    return corpus.split_documents(joined, key="conv_id").withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT pretoken, n FROM ({SQL_COUNTS}) ORDER BY n DESC, encode(pretoken) DESC LIMIT {TOP}")
def top_pretokens(spark, d):
    return training.pretoken_counts(read(spark, d, "documents")).orderBy(F.desc("n"), F.desc("pretoken")).limit(TOP)


@query(f"SELECT pretoken, n FROM ({SQL_COUNTS}) ORDER BY n DESC, encode(pretoken) DESC LIMIT {TOP}")
def top_pretokens_bounded(spark, d):
    """By summaries of 4,096 entries a task and an exact recount, so the shuffle doesn't grow with the vocabulary."""
    return frequent.top_pretokens(read(spark, d, "documents"), TOP, size=4_096)


@query("""SELECT b AS byte, chr(c) AS symbol, c AS code_point FROM (SELECT b, (CASE WHEN own THEN b ELSE 255 + row_number() OVER (PARTITION BY own ORDER BY b) END)::INTEGER AS c
  FROM (SELECT range::INTEGER AS b, (range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range >= 174) AS own FROM range(256)))""")
def byte_unicode_map(spark, d):
    return files.byte_unicode_map(spark)


@query(f"""WITH t AS (SELECT string_agg(text, '{T.END}' ORDER BY item_id) AS t FROM benchmark), g AS (SELECT t, length(t) AS size, (i * (length(t) // 16))::BIGINT AS g FROM t, range(1, 16) AS r(i)),
  c AS (SELECT CASE WHEN instr(substr(t, g + 1), '{T.END}') = 0 THEN size ELSE g + instr(substr(t, g + 1), '{T.END}') - 1 END AS c FROM g UNION SELECT 0 UNION SELECT size FROM g)
  SELECT (row_number() OVER (ORDER BY c) - 1)::INTEGER AS chunk, c::INTEGER AS start FROM c""")
def chunk_boundaries(spark, d):
    cuts = corpus.table_chunks(read(spark, d, "benchmark"), 16, key="item_id")
    return spark.createDataFrame(list(enumerate(cuts)), "chunk int, start int")


# ---- training ------------------------------------------------------------------------------------------------------
_SQL_WORDS = f"(SELECT {sql_symbols('pretoken')} AS word, n FROM ({SQL_COUNTS}))"


@query(SQL_PAIRS.format(_SQL_WORDS))
def pair_counts(spark, d):
    return training.pair_counts(training.words(training.pretoken_counts(read(spark, d, "documents"))))


@query(f"SELECT * FROM ({SQL_PAIRS.format(_SQL_WORDS)}) ORDER BY c DESC, l DESC, r DESC LIMIT {TOP}")
def top_pairs(spark, d):
    return training.top_pairs(pair_counts(spark, d), TOP)


def _unrolled() -> str:
    steps, words = [f"w0 AS MATERIALIZED {_SQL_WORDS}"], "w0"
    for i in range(ROUNDS):
        steps.append(f"p{i} AS MATERIALIZED (SELECT * FROM ({SQL_PAIRS.format(words)}) ORDER BY c DESC, l DESC, r DESC LIMIT 1)")
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(word, (SELECT '<' || l || '><' || r || '>' FROM p{i}), (SELECT '<' || l || r || '>' FROM p{i})) AS word, n FROM w{i})")
        words = f"w{i + 1}"
    return "WITH " + ", ".join(steps)


@query(_unrolled() + " " + " UNION ALL ".join(f"SELECT {i} AS rank, l, r FROM p{i}" for i in range(ROUNDS)))
def bpe_merges_k(spark, d):
    got = training.train_merges(training.pretoken_counts(read(spark, d, "documents")), ROUNDS, "iterative")
    return spark.createDataFrame([(i, a.hex().upper(), b.hex().upper()) for i, (a, b) in enumerate(got)], "rank int, l string, r string")


@query(_unrolled() + f"""SELECT range::INTEGER AS token_id, lpad(hex(range), 2, '0') AS token FROM range(256) UNION ALL SELECT 256, '{T.END.encode().hex().upper()}'
  UNION ALL """ + " UNION ALL ".join(f"SELECT {257 + i}, l || r FROM p{i}" for i in range(ROUNDS)))
def bpe_vocab_k(spark, d):
    vocab, _ = training.train_bpe(read(spark, d, "documents"), 257 + ROUNDS, [T.END])
    return spark.createDataFrame([(i, t.hex().upper()) for i, t in vocab.items()], "token_id int, token string")


def _trained(spark, d, size: int, strategy: str = "local"):
    vocab, _ = training.train_bpe(read(spark, d, "documents"), size, [T.END], strategy)
    return spark.createDataFrame([(i, t.hex().upper()) for i, t in vocab.items()], "token_id int, token string")


def sql_trained(size: int, words: str) -> str:
    """(grp, token_id, token): a vocabulary for each group of counted words (grp, word, n), by recursion over a keyed table: each round replaces the words that
    hold their group's most frequent pair."""
    base = f"SELECT range::INTEGER AS token_id, lpad(hex(range), 2, '0') AS token FROM range(256) UNION ALL SELECT 256, '{T.END.encode().hex().upper()}'"
    return f"""WITH RECURSIVE w0 AS MATERIALIZED (SELECT grp, row_number() OVER () AS id, word, n::BIGINT AS n FROM ({words})),
  t(kind, grp, id, word, n) USING KEY (kind, grp, id) AS (
    SELECT 0, grp, id, word, n FROM w0 UNION ALL SELECT DISTINCT 1, grp, 0, '', 0 FROM w0
    UNION
    (WITH s AS (SELECT grp, id, word, n, string_split(substr(word, 2, length(word) - 2), '><') AS s FROM recurring.t WHERE kind = 0),
     p AS (SELECT grp, s[i] AS l, s[i + 1] AS r, sum(n) AS c FROM s, unnest(range(1, len(s))) AS u(i) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY c DESC, l DESC, r DESC) = 1),
     m AS (SELECT p.grp, l, r, max(id) AS k FROM recurring.t x JOIN p ON x.grp = p.grp AND kind = 1 GROUP BY 1, 2, 3 HAVING max(id) < {size - 257})
     SELECT 0, s.grp, s.id, replace(s.word, '<' || l || '><' || r || '>', '<' || l || r || '>'), s.n FROM s JOIN m ON s.grp = m.grp WHERE contains(s.word, '<' || l || '><' || r || '>')
     UNION ALL SELECT 1, grp, k + 1, l || r, 0 FROM m))
  SELECT grp, token_id, token FROM (SELECT DISTINCT grp FROM w0), ({base}) UNION ALL SELECT grp, 256 + id::INTEGER, word FROM t WHERE kind = 1 AND id > 0"""


_SQL_500 = f"SELECT token_id, token FROM ({sql_trained(VOCAB_SIZE, f'SELECT 0 AS grp, word, n FROM {_SQL_WORDS}')})"
_SQL_LANG_COUNTS = f"SELECT lang AS grp, pretoken, count(*) AS n FROM (SELECT lang, unnest({sql_pretokens('text')}) AS pretoken FROM documents) GROUP BY 1, 2"
_SQL_LANG_WORDS = f"SELECT grp, {sql_symbols('pretoken')} AS word, n FROM ({_SQL_LANG_COUNTS})"


@query(_SQL_500)
def bpe_vocab_500(spark, d):
    """243 merges by the driver's trainer."""
    return _trained(spark, d, VOCAB_SIZE)


@query(_SQL_500)
def bpe_vocab_500_indexed(spark, d):
    """The same 243 merges by the distributed trainer, whose jobs look up words in an index and add up deltas of counts."""
    return _trained(spark, d, VOCAB_SIZE, "indexed")


@query(f"SELECT grp AS lang, token_id, token FROM ({sql_trained(300, _SQL_LANG_WORDS)})")
def bpe_vocab_by_lang(spark, d):
    """A vocabulary of 300 entries for each language."""
    return grouped.train(read(spark, d, "documents"), "lang", 300, [T.END]).select(F.col("grp").alias("lang"), "token_id", F.hex("token").alias("token"))


@query()
def bpe_vocab_10000(spark, d):
    """A vocabulary of production size."""
    return _trained(spark, d, 10_000)


@query(f"SELECT replace(word, '<20><74>', '<2074>') AS word, n FROM {_SQL_WORDS}")
def merge_step(spark, d):
    return training.merge(training.words(training.pretoken_counts(read(spark, d, "documents"))), "20", "74")


@query("SELECT range::INTEGER AS token_id, lpad(hex(range), 2, '0') AS token FROM range(256) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({256 + i}, '{s.encode().hex().upper()}')" for i, s in enumerate(SPECIALS)) + ")")
def base_vocab(spark, d):
    return training.base_vocabulary(spark, SPECIALS).select("token_id", F.hex("token").alias("token"))


# ---- tokenizer -----------------------------------------------------------------------------------------------------
@query(f"SELECT pretoken, {sql_merged(sql_symbols('pretoken'))} AS word FROM ({SQL_COUNTS})")
def encode_pretokens(spark, d):
    return book().words(training.pretoken_counts(read(spark, d, "documents")))


def sql_encoded(table: str, key: str, text: str = "text") -> str:
    """(key, pos, token): tokens of a text without special tokens, in order."""
    return f"""SELECT {key}, pos, token_id, token FROM (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1)::BIGINT AS pos, token FROM (
  SELECT {key}, i, generate_subscripts(s, 1) AS j, unnest(s) AS token FROM (SELECT {key}, i, {_FLAT.replace("w", "w", 1)} AS s FROM (
  SELECT {key}, i, {sql_merged(sql_symbols("p"))} AS w FROM (SELECT {key}, generate_subscripts(p, 1) AS i, unnest(p) AS p FROM (SELECT {key}, {sql_pretokens(text)} AS p FROM {table})))))) JOIN {SQL_VOCAB} USING (token)"""


_IDS = "array_to_string(list(token_id ORDER BY pos), ',')"


def sql_digests(table: str, key: str) -> str:
    """Every row of table, those without tokens with the digest of the empty list."""
    return f"""SELECT {key}, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(digest, md5('')) AS digest FROM {table}
  LEFT JOIN (SELECT {key}, count(*) AS n_tokens, md5({_IDS}) AS digest FROM ({sql_encoded(table, key)}) GROUP BY {key}) USING ({key})"""


def digests(got: DataFrame, key: str) -> DataFrame:
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return got.select(key, F.size(ids).cast("long").alias("n_tokens"), F.md5(F.array_join(ids, ",")).alias("digest"))


@query(sql_digests("documents", "doc_id"))
def encode_docs(spark, d):
    return digests(book().encode(read(spark, d, "documents")), "doc_id")


@query(sql_digests("documents", "doc_id"))
def encode_docs_table_function(spark, d):
    """By the table function that makes a row a text, in SQL."""
    sql.register(spark, book(), "lt_")
    docs = read(spark, d, "documents").select("doc_id", "text")
    return digests(spark.sql("SELECT doc_id, ids FROM lt_encode_texts(TABLE({docs}), 'doc_id', 'text')", docs=docs), "doc_id")


@query(sql_digests("documents", "doc_id"))
def encode_docs_relational(spark, d):
    """Without Python; as in SQL, a row without a key meets no tokens."""
    got = book().encode_columns(read(spark, d, "documents"))
    return digests(got.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("ids")).alias("ids")), "doc_id")


_LINES = "(SELECT conv_id * 1000000 + turn AS line_id, text FROM conversations)"


@query(sql_digests(_LINES, "line_id"))
def encode_lines(spark, d):
    lines = read(spark, d, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("line_id"), "text")
    return digests(book().encode(lines, "line_id"), "line_id")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_roundtrip(spark, d):
    t = book()
    return t.decode(t.encode(read(spark, d, "documents"))).select("doc_id", F.md5("text").alias("digest"))


_READABLE = "(VALUES " + ", ".join(f"({i}, '{t.hex().upper()}', '{t.decode('utf-8', 'replace').encode().hex().upper()}')" for i, t in VOCAB.items()) + ") AS v(token_id, token, readable)"


@query(f"SELECT token_id, token, readable FROM {_READABLE}")
def vocab_readable(spark, d):
    v = book().vocabulary(spark).withColumn("token", F.hex("token"))
    return v.select("token_id", "token", F.hex(F.encode(T.text_of_hex(F.col("token")), "UTF-8")).alias("readable"))


@query(f"SELECT item_id, pos, readable FROM ({sql_encoded('benchmark', 'item_id')}) JOIN {_READABLE} USING (token_id)")
def token_strings(spark, d):
    t = book()
    got = t.encode(read(spark, d, "benchmark"), "item_id").select("item_id", F.posexplode("ids").alias("pos", "token_id"))
    v = t.vocabulary(spark).select("token_id", F.hex(F.encode(T.text_of_hex(F.hex("token")), "UTF-8")).alias("readable"))
    return got.join(F.broadcast(v), "token_id").select("item_id", F.col("pos").cast("long").alias("pos"), "readable")


_ASCII = [(i, t) for i, t in VOCAB.items() if all(x < 128 for x in t)]


@query(f"SELECT pretoken, list_bool_and(list_transform(string_split(substr(w, 2, length(w) - 2), '><'), lambda x: NOT regexp_matches(x, '^[89A-F].$'))) AS ok FROM (SELECT pretoken, {sql_merged(sql_symbols('pretoken'))} AS w FROM ({SQL_COUNTS}))")
def tokenizable(spark, d):
    """Against a vocabulary without the bytes from 128 on."""
    small = spark.createDataFrame(_ASCII, "token_id int, token binary")
    return tokenizer.tokenizable(encode_pretokens(spark, d), small)


# ---- corpus --------------------------------------------------------------------------------------------------------
def _sizes(spark, d, *keep):
    docs = read(spark, d, "documents")
    ids = book().encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    return docs.select("doc_id", *keep, F.octet_length("text").cast("long").alias("n_bytes")).join(ids, "doc_id")


_SQL_SIZES = f"SELECT doc_id, lang, octet_length(encode(text))::BIGINT AS n_bytes, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_tokens FROM ({sql_encoded('documents', 'doc_id')}) GROUP BY doc_id) USING (doc_id)"
_RATIO = "sum(n_bytes)::BIGINT AS n_bytes, sum(n_tokens)::BIGINT AS n_tokens, round(sum(n_bytes)::DOUBLE / sum(n_tokens)::DOUBLE, 6) AS ratio"


@query(f"SELECT {_RATIO} FROM ({_SQL_SIZES})")
def compression_ratio(spark, d):
    return corpus.compression_ratio(_sizes(spark, d))


@query(f"SELECT lang, {_RATIO} FROM ({_SQL_SIZES}) GROUP BY lang")
def compression_by_lang(spark, d):
    return corpus.compression_ratio(_sizes(spark, d, "lang"), "lang")


def _cross_sql() -> str:
    parts = []
    for name, k in (("first", len(PAIRS) // 2), ("all", len(PAIRS))):
        for table in ("documents", "benchmark"):
            w = sql_merged(sql_symbols("p"), HEXES[:k])
            parts.append(f"SELECT '{name}' AS tokenizer, '{table}' AS corpus, sum(octet_length(encode(p)))::BIGINT AS n_bytes, sum(len(string_split({w}, '><')))::BIGINT AS n_tokens FROM (SELECT unnest({sql_pretokens('text')}) AS p FROM {table})")
    return "SELECT *, round(n_bytes::DOUBLE / n_tokens::DOUBLE, 6) AS ratio FROM (" + " UNION ALL ".join(parts) + ")"


@query(_cross_sql())
def compression_cross(spark, d):
    out = None
    for name, k in (("first", len(PAIRS) // 2), ("all", len(PAIRS))):
        t = tokenizer.Tokenizer(VOCAB, MERGES[:k])
        for table, key in (("documents", "doc_id"), ("benchmark", "item_id")):
            c = training.pretoken_counts(read(spark, d, table))
            w = t.words(c).join(c, "pretoken").select((F.octet_length("pretoken") * F.col("n")).alias("n_bytes"), (F.size(T.symbol_list(F.col("word"))) * F.col("n")).alias("n_tokens"))
            r = corpus.compression_ratio(w).select(F.lit(name).alias("tokenizer"), F.lit(table).alias("corpus"), "n_bytes", "n_tokens", "ratio")
            out = r if out is None else out.unionByName(r)
    return out


@query(f"SELECT token_id, token, (length(token) // 2)::INTEGER AS n_bytes FROM {SQL_VOCAB} ORDER BY n_bytes DESC, token_id LIMIT 1")
def longest_token(spark, d):
    return corpus.longest_token(book().vocabulary(spark))


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 10")
def sample_docs(spark, d):
    return corpus.sample_documents(read(spark, d, "documents"), 10).select("doc_id", "lang", "source")


@query(f"SELECT doc_id, n_tokens, (sum(n_tokens) OVER (ORDER BY doc_id) - n_tokens)::BIGINT AS start FROM ({_SQL_SIZES})")
def token_stream(spark, d):
    return corpus.stream_offsets(_sizes(spark, d).select("doc_id", "n_tokens"))


@query(f"""SELECT pos // 4096 AS block, count(*) AS n_tokens, md5({_IDS}) AS digest FROM (SELECT (row_number() OVER (ORDER BY doc_id, pos) - 1)::BIGINT AS pos, token_id
  FROM ({sql_encoded('documents', 'doc_id')})) GROUP BY 1""")
def encode_dataset(spark, d):
    """The stream as written, by blocks of 4,096 positions."""
    path = files.scratch(spark, "stream")
    corpus.encode_dataset(read(spark, d, "documents"), book(), path)
    return corpus.stream_blocks(spark.read.parquet(path), 4096)


@query(f"""SELECT pos // 4096 AS block, count(*) AS n_tokens, md5({_IDS}) AS digest FROM (SELECT (row_number() OVER (ORDER BY doc_id, pos) - 1)::BIGINT AS pos, token_id
  FROM ({sql_encoded('documents', 'doc_id')})) GROUP BY 1""")
def encode_files(spark, d):
    """The stream in flat binary files, read back in blocks of 4,096 positions."""
    path = files.scratch(spark, "tokens")
    corpus.encode_files(read(spark, d, "documents"), book(), path)
    rows = token_files.read_blocks(spark, path, 4096)
    return rows.select(F.floor(F.col("start") / 4096).alias("block"), F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"SELECT {_RATIO} FROM ({_SQL_SIZES}) JOIN documents USING (doc_id) WHERE octet_length(encode(text)) = length(text)")
def compression_of_tokenizable(spark, d):
    """Against a vocabulary without the bytes from 128 on: documents that need one are left out."""
    docs, small = read(spark, d, "documents"), tokenizer.Tokenizer(dict(_ASCII), MERGES)
    ids = small.encode(docs, unknown="null").select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_tokens"))
    return corpus.compression_ratio(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(ids, "doc_id"))


# ---- vectors -------------------------------------------------------------------------------------------------------
D, OUT, HEADS, GROUP = 64, 8, 4, 16


def grid(rows: int, cols: int, k: float) -> list[list[float]]:
    return [[round(math.sin(k * (i * cols + j)) / 8, 6) for j in range(cols)] for i in range(rows)]


def sql_grid(w) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in r) + "]" for r in w) + "]"


def sql_linear(x: str, w) -> str:
    return f"list_transform({sql_grid(w)}, lambda r: list_sum(list_transform(list_zip(r, {x}), lambda p: p[1] * p[2])))"


W1, W2, W3, WQ, WO = grid(OUT, D, 1.0), grid(D, OUT, 0.7), grid(OUT, D, 0.3), grid(D, D, 0.9), grid(D, D, 1.1)
WK, WV = grid(D, D, 0.5), grid(D, D, 0.2)
LN = [1 + j / 64 for j in range(D)]
_V = "(SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def flat(df: DataFrame, *keys: str, y: str = "y") -> DataFrame:
    """Long form, rounded; adding 0 turns -0 into 0."""
    return df.select(*keys, F.posexplode(y).alias("j", "v")).select(*keys, F.col("j").cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


def sql_flat(inner: str, keys: str) -> str:
    return f"SELECT {keys}, (generate_subscripts(y, 1) - 1)::BIGINT AS j, round(unnest(y), 6) + 0.0::DOUBLE AS v FROM ({inner})"


def vector_query(name: str, f, sql: str):
    def run(spark, d):
        return flat(vectors(spark, d).select("vec_id", f().alias("y")), "vec_id")

    run.__name__ = name
    query(sql_flat(f"SELECT vec_id, {sql} AS y FROM {_V}", "vec_id"))(run)


_SILU = "list_transform({0}, lambda v: v / (1 + exp(-v)))"
_NORM = "list_transform(list_zip(x, {0}), lambda p: p[1] / sqrt(list_sum(list_transform(x, lambda q: q * q)) / len(x) + 1e-5) * p[2])"
_LN_SQL = "[" + ", ".join(f"{v!r}::DOUBLE" for v in LN) + "]"
vector_query("silu", lambda: nn.silu(F.col("x")), _SILU.format("x"))
vector_query("softmax", lambda: nn.softmax(F.col("x")), "list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda q: exp(q - list_max(x)))))")
vector_query("rmsnorm", lambda: nn.rmsnorm(F.col("x"), LN), _NORM.format(_LN_SQL))
vector_query("linear", lambda: nn.linear(F.col("x"), W1), sql_linear("x", W1))
_SWIGLU = sql_linear(f"list_transform(list_zip({_SILU.format(sql_linear('x', W1))}, {sql_linear('x', W3)}), lambda p: p[1] * p[2])", W2)
vector_query("swiglu", lambda: nn.swiglu(F.col("x"), W1, W2, W3), _SWIGLU)


def sql_rope(x: str, pos: str, n: int) -> str:
    angle = f"({pos} * pow(10000::DOUBLE, -(2 * (i // 2))::DOUBLE / {n}))"
    return f"list_transform(range(0, {n}), lambda i: CASE WHEN i % 2 = 0 THEN {x}[i + 1] * cos({angle}) - {x}[i + 2] * sin({angle}) ELSE {x}[i] * sin({angle}) + {x}[i + 1] * cos({angle}) END)"


vector_query("rope", lambda: nn.rope(F.col("x"), F.col("vec_id") % 128, D, longest=128), sql_rope("x", "(vec_id % 128)", D))


@query("""SELECT label, vec_id, (j - 1)::BIGINT AS j, round(e / sum(e) OVER (PARTITION BY label, j), 6) + 0.0::DOUBLE AS v FROM (SELECT label, vec_id, j, exp(v - max(v) OVER (PARTITION BY label, j)) AS e
  FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings))""")
def softmax_axis0(spark, d):
    rows = vectors(spark, d).select("label", "vec_id", F.posexplode("x").alias("j", "v"))
    return nn.softmax_over(rows, "v", "label", "j").select("label", "vec_id", F.col("j").cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query(sql_flat(f"SELECT doc_id, x AS y FROM documents JOIN {_V} ON vec_id = doc_id * 7 % (SELECT count(*) FROM embeddings)", "doc_id"))
def embedding_lookup(spark, d):
    table = vectors(spark, d)
    ids = read(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7 % table.count()).alias("vec_id"))
    return flat(nn.embedding(ids, table, "vec_id"), "doc_id", y="x")


def sql_attention(rows: str, keep: str, d: int) -> str:
    """rows: (b, pos, q, k, v)."""
    return f"""SELECT b, pos, list(o ORDER BY j) AS y FROM (SELECT b, pos, j, sum(p * val) AS o FROM (SELECT b, pos, generate_subscripts(v, 1) AS j, unnest(v) AS val, e / sum(e) OVER (PARTITION BY b, pos, kpos) * 1.0 AS one, p FROM (
  SELECT *, e / sum(e) OVER (PARTITION BY b, pos) AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY b, pos)) AS e FROM (
  SELECT a.b, a.pos, c.pos AS kpos, c.v, CASE WHEN {keep} THEN list_sum(list_transform(list_zip(a.q, c.k), lambda t: t[1] * t[2])) / sqrt({d}::DOUBLE) ELSE -1.7976931348623157e308::DOUBLE END AS s
  FROM {rows} a JOIN {rows} c ON a.b = c.b)))) GROUP BY b, pos, j) GROUP BY b, pos"""


_QKV = f"(SELECT vec_id // {GROUP} AS b, vec_id % {GROUP} AS pos, x AS q, x AS k, x AS v FROM {_V})"


def _grouped(spark, d):
    return vectors(spark, d).select(F.floor(F.col("vec_id") / GROUP).alias("b"), (F.col("vec_id") % GROUP).alias("pos"), "x")


def _attend(spark, d, keep):
    r = _grouped(spark, d)
    return nn.attention(r.select("b", F.col("pos").alias("q_pos"), F.col("x").alias("q")), r.select("b", F.col("pos").alias("k_pos"), F.col("x").alias("k"), F.col("x").alias("v")), keep, D)


@query(sql_flat(sql_attention(_QKV, "c.pos <= a.pos", D), "b, pos"))
def attention(spark, d):
    return flat(_attend(spark, d, nn.causal).withColumnRenamed("q_pos", "pos"), "b", "pos", y="o")


@query(sql_flat(sql_attention(_QKV, "a.pos <> 3 AND (a.pos + c.pos) % 3 <> 0", D), "b, pos"))
def attention_tiled(spark, d):
    """attention_masked by tiles of 5 positions, two of them at a time."""
    r = _grouped(spark, d)
    keep = lambda q_pos, k_pos: (q_pos != 3) & ((q_pos + k_pos) % 3 != 0)
    o = tiles.attention(r.select("b", F.col("pos").alias("q_pos"), F.col("x").alias("q")), r.select("b", F.col("pos").alias("k_pos"), F.col("x").alias("k"), F.col("x").alias("v")), keep, tile=5, span=2)
    return flat(o.withColumnRenamed("q_pos", "pos"), "b", "pos", y="o")


@query(sql_flat(sql_attention(_QKV, "a.pos <> 3 AND (a.pos + c.pos) % 3 <> 0", D), "b, pos"))
def attention_masked(spark, d):
    """Row 3 of each group masks all keys: its weights are uniform."""
    keep = lambda q_pos, k_pos: (q_pos != 3) & ((q_pos + k_pos) % 3 != 0)
    return flat(_attend(spark, d, keep).withColumnRenamed("q_pos", "pos"), "b", "pos", y="o")


def sql_heads(turn: bool, source: str = _V) -> str:
    """WITH part and rows (b, pos, y)."""
    h = D // HEADS
    r = (lambda c: sql_rope(c, "pos", h)) if turn else (lambda c: c)
    rows = f"(SELECT b, pos, {r('q')} AS q, {r('k')} AS k, v FROM (SELECT b * {HEADS} + hd AS b, pos, q[hd * {h} + 1:hd * {h} + {h}] AS q, k[hd * {h} + 1:hd * {h} + {h}] AS k, v[hd * {h} + 1:hd * {h} + {h}] AS v FROM (SELECT vec_id // {GROUP} AS b, vec_id % {GROUP} AS pos, {sql_linear('x', WQ)} AS q, {sql_linear('x', WK)} AS k, {sql_linear('x', WV)} AS v FROM {source}), range({HEADS}) AS hh(hd)))"
    joined = f"SELECT b // {HEADS} AS b, pos, flatten(list(y ORDER BY b)) AS o FROM ({sql_attention('r', 'c.pos <= a.pos', h)}) GROUP BY 1, 2"
    return f"WITH r AS MATERIALIZED {rows}, y AS MATERIALIZED (SELECT b, pos, {sql_linear('o', WO)} AS y FROM ({joined})) "


def sql_block() -> str:
    norm, add = _NORM.format(_LN_SQL), "list_transform(list_zip({0}, {1}), lambda p: p[1] + p[2])"
    after = f"(SELECT b, pos, {add.format('x', 'y')} AS x FROM y JOIN (SELECT vec_id // {GROUP} AS b, vec_id % {GROUP} AS pos, x FROM {_V}) USING (b, pos))"
    normed = f"(SELECT b, pos, x AS x0, {norm} AS x FROM {after})"
    return sql_heads(True, f"(SELECT vec_id, {norm} AS x FROM {_V})") + sql_flat(f"SELECT b, pos, {add.format('x0', _SWIGLU)} AS y FROM {normed}", "b, pos")


def _weights(spark, block: int = tiles.BLOCK) -> DataFrame:
    return tiles.weights_table(spark, {"wq": WQ, "wk": WK, "wv": WV, "wo": WO}, block)


@query(sql_heads(False) + sql_flat("SELECT * FROM y", "b, pos"))
def mha(spark, d):
    return flat(nn.self_attention(_grouped(spark, d), HEADS, D, WQ, WK, WV, WO), "b", "pos")


@query(sql_heads(True) + sql_flat("SELECT * FROM y", "b, pos"))
def mha_rope(spark, d):
    """Weights from a table; sequences of 16 positions fit in a tile."""
    return flat(tiles.self_attention(_grouped(spark, d), HEADS, _weights(spark), 10_000.0, GROUP), "b", "pos")


@query(sql_heads(True) + sql_flat("SELECT * FROM y", "b, pos"))
def mha_rope_tiled(spark, d):
    """The same in tiles of 4 positions, projected by blocks of weights that are joined."""
    return flat(tiles.self_attention(_grouped(spark, d), HEADS, _weights(spark, 32), 10_000.0, most=0, tile=4), "b", "pos")


@query(sql_flat(f"SELECT vec_id, {sql_linear('x', W1)} AS y FROM {_V}", "vec_id"))
def linear_blocks(spark, d):
    """The product with weights from a table, by blocks."""
    return flat(tiles.linear(vectors(spark, d), "x", tiles.weights_table(spark, {"y": W1}, 24), ["y"], most=0), "vec_id")


@query(sql_block())
def transformer_block(spark, d):
    p = {"ln1": LN, "ln2": LN, "wq": WQ, "wk": WK, "wv": WV, "wo": WO, "w1": W1, "w2": W2, "w3": W3}
    return flat(nn.transformer_block(_grouped(spark, d), HEADS, D, p, 10_000.0, GROUP), "b", "pos", y="x")


def tiny_state(vocab: int = len(VOCAB), d: int = 16, ff: int = 24, layers: int = 2) -> dict:
    s = {"token_embeddings.weight": nn.init_embedding(vocab, d, 1), "ln_final.weight": 1 + nn.init_embedding(1, d, 2)[0] / 10, "lm_head.weight": nn.init_linear(vocab, d, 3)}
    for i in range(layers):
        s |= {f"layers.{i}.ln{k}.weight": 1 + nn.init_embedding(1, d, 10 * i + k)[0] / 10 for k in (1, 2)}
        s |= {f"layers.{i}.attn.{n}_proj.weight": nn.init_linear(d, d, 100 * i + k) for k, n in enumerate(("q", "k", "v", "output"))}
        s |= {f"layers.{i}.ffn.w1.weight": nn.init_linear(ff, d, 7 + i), f"layers.{i}.ffn.w2.weight": nn.init_linear(d, ff, 8 + i), f"layers.{i}.ffn.w3.weight": nn.init_linear(ff, d, 9 + i)}
    return s


@query()
def lm_logits(spark, d):
    """For every position of every benchmark item all logits, rounded."""
    ids = book().encode(read(spark, d, "benchmark"), "item_id").where(F.size("ids") > 0).withColumnRenamed("item_id", "b")
    out = nn.lm_logits(ids, tiny_state(), 2, 2)
    out = out.select("b", "logits", F.posexplode(F.sequence(F.lit(0), (F.size("logits") / len(VOCAB)).cast("int") - 1)).alias("pos", "at"))
    return out.select("b", "pos", F.transform(F.slice("logits", F.col("at") * len(VOCAB) + 1, len(VOCAB)), lambda v: F.round(v, 6)).alias("logits"))


# ---- training side -------------------------------------------------------------------------------------------------
_STREAM = "s AS (SELECT event_id - (SELECT min(event_id) FROM events) AS pos, user_id AS token_id FROM events)"


def sql_windows(starts: str, length: int, show) -> str:
    """Windows of the stream s at (sample_id, start) rows."""
    x = show(f"list(token_id ORDER BY pos) FILTER (pos < start + {length})")
    y = show("list(token_id ORDER BY pos) FILTER (pos > start)")
    return f"WITH {_STREAM}, w AS ({starts}) SELECT sample_id, start, {x} AS x, {y} AS y FROM w JOIN s ON pos BETWEEN start AND start + {length} GROUP BY sample_id, start"


def _stream(spark, d):
    e = read(spark, d, "events")
    low, n = e.agg(F.min("event_id"), F.count("*")).first()
    return e.select((F.col("event_id") - low).alias("pos"), F.col("user_id").alias("token_id")), n


_SHOWN = "array_to_string({0}, ',')".format


@query(sql_windows("SELECT range::BIGINT AS sample_id, range::BIGINT AS start FROM range((SELECT count(*) - 8 FROM events))", 8, _SHOWN))
def file_windows(spark, d):
    """Every start of the stream, from flat files."""
    stream, n = _stream(spark, d)
    path = files.scratch(spark, "tokens")
    token_files.write_stream(stream.groupBy(F.floor(F.col("pos") / 1024).alias("b")).agg(F.min("pos").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda r: r["token_id"]).alias("ids")), path, 4)
    starts = spark.range(n - 8).select(F.col("id").alias("sample_id"), F.col("id").alias("start"))
    return token_files.read_windows(starts, path, 8).select("sample_id", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(sql_windows("SELECT range::BIGINT AS sample_id, range::BIGINT AS start FROM range((SELECT count(*) - 8 FROM events))", 8, _SHOWN))
def batch_windows(spark, d):
    """Every start of the stream."""
    stream, n = _stream(spark, d)
    starts = spark.range(n - 8).select(F.col("id").alias("sample_id"), F.col("id").alias("start"))
    return train.windows(stream, starts, 8).select("sample_id", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(sql_windows("SELECT range::BIGINT AS sample_id, ('0x' || substr(md5('0:' || range), 1, 15))::BIGINT % (SELECT count(*) - 7 FROM events) AS start FROM range(32)", 7, _SHOWN))
def get_batch(spark, d):
    got = train.get_batch(_stream(spark, d)[0], 32, 7)
    return got.select("sample_id", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(f"SELECT round(avg(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[label % 64 + 1]), 6) AS loss FROM {_V}")
def cross_entropy(spark, d):
    return vectors(spark, d).agg(F.round(F.avg(train.cross_entropy(F.col("x"), F.col("label") % 64)), 6).alias("loss"))


@query("""WITH g AS (SELECT vec_id AS param, (j - 1)::BIGINT AS i, CASE WHEN vec_id % 6 <> 5 THEN g END AS g FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS g FROM embeddings))
  SELECT param, i, round(g * least(1.0::DOUBLE, 0.5 / ((SELECT sqrt(sum(g * g)) FROM g) + 1e-6)), 8) + 0.0::DOUBLE AS g FROM g""")
def grad_clip(spark, d):
    g = vectors(spark, d).select(F.col("vec_id").alias("param"), F.posexplode("x").alias("i", "g"))
    g = g.select("param", F.col("i").cast("long").alias("i"), F.when(F.col("param") % 6 != 5, F.col("g")).alias("g"))
    return train.clip_gradients(g, 0.5).select("param", "i", (F.round("g", 8) + 0.0).alias("g"))


_BIAS = math.sqrt(1 - 0.999**3)
_LR = 1e-3 * _BIAS / (1 - 0.9**3)


@query(f"""SELECT param, i, round(w * (1 - 1e-3 * 0.01) - {_LR!r} * m / (sqrt(v) + 1e-8 * {_BIAS!r}), 6) + 0.0::DOUBLE AS w, round(m, 8) + 0.0::DOUBLE AS m, round(v, 8) + 0.0::DOUBLE AS v
  FROM (SELECT param, i, w, 0.09 * 0.9 * w + 0.1::DOUBLE * w / 2 AS m, 0.05 * 0.999 * w * w + 0.001::DOUBLE * w / 2 * w / 2 AS v FROM (SELECT vec_id AS param, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i, unnest(embedding)::DOUBLE AS w FROM embeddings))""")
def adamw_step(spark, d):
    rows = vectors(spark, d).select(F.col("vec_id").alias("param"), F.posexplode("x").alias("i", "w"))
    w = F.col("w")
    rows = rows.select("param", F.col("i").cast("long").alias("i"), "w", (w / 2).alias("g"), (w * 0.09).alias("m"), (w * w * 0.05).alias("v"))
    got = train.adamw_step(rows, 3)
    return got.select("param", "i", (F.round("w", 6) + 0.0).alias("w"), (F.round("m", 8) + 0.0).alias("m"), (F.round("v", 8) + 0.0).alias("v"))


@query("""SELECT range::BIGINT AS it, round(CASE WHEN range < 7 THEN range / 7::DOUBLE WHEN range <= 21 THEN 0.1 + 0.5 * (1 + cos(pi() * (range - 7) / 14::DOUBLE)) * 0.9 ELSE 0.1 END, 6)::DOUBLE AS lr FROM range(25)""")
def lr_schedule(spark, d):
    return spark.range(25).select(F.col("id").alias("it"), F.round(train.cosine_rate(F.col("id"), 1.0, 0.1, 7, 21), 6).alias("lr"))
