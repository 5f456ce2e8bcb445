"""Encoding of a corpus with a public byte-level BPE tokenizer, long texts in overlapping chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TOKENIZERS = "/opt/tokenizers"
#: Texts longer than this many code points are encoded in chunks; neighbours overlap by OVERLAP.
CHUNK, OVERLAP = 32_768, 1_024
#: A boundary so close to the end of a chunk may depend on what follows.
MARGIN = 4
#: The pre-token pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str, folder: str = TOKENIZERS):
    """The tiktoken encoding of a vocabulary, once per worker process; no special tokens."""
    import tiktoken

    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _encode(vocabulary: str, folder: str, counts_only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, folder)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            last = pa.array(list(map(len, ids)), pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "tokens" if counts_only else "ids"])

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = list(range(0, len(text), chunk))
                for at in range(0, len(starts), 256):
                    some = starts[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(some), pa.int64()), pa.array([s // chunk for s in some], pa.int64()), pa.array([text[s : s + chunk + overlap] for s in some], pa.string())], names=["doc_id", "chunk", "text"])

    return run


def _boundaries(chunk: int, overlap: int):
    """Starts of pre-tokens in the first and, counted from the next chunk's start, in the last overlap of a chunk.

    In the last overlap only those that follow a visible sign: how white space is split depends on what comes after
    it, so a piece must not end with any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _pattern().finditer
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(2).to_pylist():
                starts = [m.start() for m in find(text)]
                heads.append([s for s in starts if s <= overlap])
                tails.append([s - chunk for s in starts if chunk <= s <= len(text) - MARGIN and not text[s - 1].isspace()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["doc_id", "chunk", "head", "tail"])

    return run


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``doc_id``, ``piece`` and ``text``: long texts in pieces that are encoded apart.

    Chunks that overlap are split into pre-tokens by tasks of their own. Where two neighbours agree on a boundary the
    earlier piece ends and the next begins: from there on both would go on alike, as no pre-token looks back. Chunks
    between which none is found (say, within a word longer than the overlap) stay one piece; the others aren't touched.
    """
    chunks = long.mapInArrow(_chunks(chunk, overlap), "doc_id bigint, chunk bigint, text string").repartition("doc_id", "chunk")
    bounds = chunks.mapInArrow(_boundaries(chunk, overlap), "doc_id bigint, chunk bigint, head array<int>, tail array<int>")
    # one row per chunk of a document: where it begins a piece, and where it ends one
    order = Window.partitionBy("doc_id").orderBy("chunk")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    begins = bounds.select("doc_id", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(meet).alias("start"))
    placed = begins.withColumn("stop", F.lead("start").over(order)).withColumn("later", F.lead("chunk").over(order))
    placed = placed.withColumn("piece", F.max(F.when(F.col("start").isNotNull(), F.col("chunk"))).over(order))
    start = F.coalesce("start", F.lit(0))
    stop = F.when(F.col("later").isNull(), F.length("text")).otherwise(chunk + F.coalesce("stop", F.lit(0)))
    own = chunks.join(placed, ["doc_id", "chunk"]).select("doc_id", "piece", "chunk", F.substring(F.col("text"), start + 1, stop - start).alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    return own.groupBy("doc_id", "piece").agg(whole.alias("text"))


def _checked(chunk: int, overlap: int) -> None:
    if overlap >= chunk or overlap <= MARGIN:
        raise ValueError("the overlap must be shorter than a chunk and longer than the margin")


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, as if its whole text were encoded at once.

    Null and empty texts give an empty array. Texts of one chunk are encoded as they are, longer ones in pieces (see
    ``_pieces``) that are put together in order. ``doc_id`` is unique.
    """
    _checked(chunk, overlap)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(size <= chunk).mapInArrow(_encode(vocabulary, folder), "doc_id bigint, ids array<int>")
    encoded = _pieces(docs.where(size > chunk), chunk, overlap).mapInArrow(_encode(vocabulary, folder), "doc_id bigint, piece bigint, ids array<int>")
    stitched = encoded.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(stitched)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``text``: the tokens' raw bytes, concatenated. An empty array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, folder)
        for batch in batches:
            texts = [enc.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``keep`` columns (``doc_id`` among them, unique) and ``tokens``, the number of tokens of each whole text (0 for
    null and empty ones). Long texts are counted in the pieces they are encoded in."""
    _checked(chunk, overlap)
    size = F.coalesce(F.length(text), F.lit(0))
    docs = documents.where(size <= chunk).select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]) + ", tokens bigint"
    short = docs.mapInArrow(_encode(vocabulary, folder, counts_only=True), schema)
    long = documents.where(size > chunk)
    pieces = _pieces(long.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), chunk, overlap)
    counted = pieces.mapInArrow(_encode(vocabulary, folder, counts_only=True), "doc_id bigint, piece bigint, tokens bigint").groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("tokens").alias("tokens"))
    kept = long.select(*keep)
    return short.unionByName(kept.join(counted, kept[doc_id].cast("long") == counted["_doc"]).drop("_doc"))
