"""Problem 8: encoding of the whole corpus with a public tokenizer.

Texts are split into pre-tokens by one built-in regular expression. A text chunk keeps its
documents as positions in the chunk's own list of distinct words, so what is shuffled is
each chunk's distinct words and not every occurrence. Each word of the corpus is encoded
once; its ids are joined back to the chunks, and the documents are put together by position.
"""

from __future__ import annotations

import importlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators.lineage import cut, read_table

#: Folder of the vocabulary files; the installed package if unset.
TOKENIZERS_ENV = "CORPUSKIT_TOKENIZERS"
#: Pre-tokens after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_WORDS = 200_000


def vocabulary_path(name: str, folder: str | None = None) -> str:
    folder = folder or os.environ.get(TOKENIZERS_ENV)
    if folder:
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


def load_ranks(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> dict[bytes, int]:
    import base64

    with open(vocabulary_path(name, folder), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The pre-token pattern of the rank files, with Unicode blanks as the tokenizer has them.
PRE_TOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _chunks(batches):
    """Rows of two kinds: a document with its word numbers, and a chunk's numbered words."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    serial = 0

    def rows(chunk, ids, lengths, flat):
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        n, m = len(ids), len(words)
        yield pa.record_batch(
            [
                pa.array([chunk] * n, pa.int64()), ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.astype(np.int32))),
                pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()),
            ],
            names=["chunk", "doc_id", "codes", "word", "code"],
        )
        for at in range(0, m, 50_000):
            k = min(50_000, m - at)
            yield pa.record_batch(
                [pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), words.slice(at, k), pa.array(np.arange(at, at + k, dtype=np.int32))],
                names=["chunk", "doc_id", "codes", "word", "code"],
            )

    for batch in batches:
        ids, words = batch.column(0), batch.column(1)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ids):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK_WORDS, side="right")))
            yield from rows((part << 32) + serial, ids.slice(at, to - at), lengths[at:to], words.slice(at, to - at).flatten())
            serial += 1
            at = to


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each row, without special tokens.

    Null and empty texts have an empty list; special-token strings are ordinary text. Rows
    are kept as they are, so a repeated doc_id comes out as often as it goes in; a null one
    stays null. ``doc_id`` must be a whole number.
    """
    path = vocabulary_path(vocabulary, folder)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PRE_TOKENS), F.lit(0))
    stored = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("words")).mapInArrow(_chunks, "chunk long, doc_id long, codes array<int>, word string, code int"))
    listed = stored.filter("code is not null").select("chunk", "word", "code")
    distinct = listed.select("word").distinct()

    def encode_words(batches):
        import base64

        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = None
        for batch in batches:
            if encoding is None:
                with open(path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            got = encoding.encode_ordinary_batch(batch.column(0).to_pylist(), num_threads=1)
            lengths = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter((i for ids in got for i in ids), np.int32, int(lengths.sum()))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["word", "word_ids"])

    encoded = distinct.mapInArrow(encode_words, "word string, word_ids array<int>")
    ids = listed.join(encoded, "word").select("chunk", "code", "word_ids")

    def assemble(texts, table):
        """The documents of one chunk from its words' ids, by gathers on flat arrays."""
        texts, table = texts.combine_chunks(), table.combine_chunks()
        if texts.num_rows == 0:
            return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        code = table["code"].combine_chunks().to_numpy() if table.num_rows else np.zeros(0, np.int32)
        word_ids = table["word_ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        lengths = np.zeros(len(code), np.int64)
        starts = np.zeros(len(code), np.int64)
        own = np.asarray(pc.list_value_length(word_ids)).astype(np.int64)
        flat = np.asarray(word_ids.flatten())
        lengths[code] = own
        starts[code] = np.concatenate([[0], np.cumsum(own)[:-1]]) if len(own) else own
        codes = texts["codes"].combine_chunks()
        per_text = np.asarray(pc.list_value_length(codes)).astype(np.int64)
        at = np.asarray(codes.flatten())
        n = lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[at], n)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[gather].astype(np.int32)) if total else pa.array([], pa.int32()))
        return pa.table({"doc_id": texts["doc_id"], "ids": lists})

    texts = stored.filter("codes is not null").select(F.col("chunk").alias("of"), "doc_id", "codes")
    return texts.groupBy("of").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>")


def token_table(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, bytes) of a rank file; as many rows as the vocabulary has."""
    ranks = load_ranks(vocabulary, folder)
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id unique, ids), by joining the token-byte table.

    An empty list gives an empty text; an id outside the table raises no error but leaves
    out its bytes; bytes that are no UTF-8 come out as replacement characters."""
    spread = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    # The table has the fixed size of a vocabulary.
    parts = spread.join(F.broadcast(table), "id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("hex")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.col("parts.hex"), "")), "UTF-8")
    texts = parts.select("doc_id", text.alias("text"))
    empty = encoded.filter(F.size("ids") == 0).select("doc_id", F.lit("").alias("text"))
    return texts.unionByName(empty)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``docs`` and its number of tokens ``n_tokens``, 0 for null and empty texts."""
    ids = encode(docs, "doc_id", text, vocabulary, folder)
    return docs.join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens and whether decoding gives its text back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = cut(encode(docs))
    texts = decode(ids, token_table(spark)).withColumnRenamed("text", "decoded")
    sizes = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.join(sizes, "doc_id").join(texts, "doc_id").select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))
