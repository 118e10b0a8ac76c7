"""Exact token counts of documents without materialising token ids.

A byte-pair tokenizer first splits a text into pre-tokens and then works inside
each, so a document's count is the sum, over its distinct pre-tokens, of their
frequency times their number of pieces. The pieces of a pre-token are counted
once in the whole corpus:

1. Each task splits its texts and keeps, for every block of documents, the
   distinct pre-tokens with the documents and frequencies they have there
   (postings). They are cut by a hash of the pre-token and packed, about a byte
   or two for each posting.
2. One shuffle brings all postings of a pre-token to one task, which counts its
   pieces and joins them to the postings: partial sums per document.
3. A second, smaller shuffle adds up the partial sums of each block.

What moves is bounded by the distinct (document, pre-token) pairs, packed; no
vocabulary is broadcast, and no hot pre-token makes a hot task, since a block
has it once.

Edge cases: null and empty texts count 0; every input row gives one output row,
so repeated rows and ids, and null ids, stay as they are; only ``doc_id`` and
``text`` are read; strings of special tokens are ordinary text; a very long text is
split whole, as a block of its own; an empty table gives an empty result; ids may be
of any type, and columns of other names don't matter.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.wordhash import batches

#: Where the tokenizers of the environment lie; a parameter of all functions here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def piece_counter(path: str, pattern: str) -> Callable[[str], int]:
    encode = encoding(path, pattern).encode_ordinary
    return lambda piece: len(encode(piece))


def split_block(texts: list[str | None], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block, and its postings by pre-token: index of the pre-token, of the document, and frequency."""
    import regex

    find = regex.compile(pattern).findall
    tokens: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = find(t)
            sizes[i] = len(found)
            tokens += found
    codes, words = pd.factorize(np.array(tokens, dtype=object)) if tokens else (np.zeros(0, np.int64), np.zeros(0, object))
    doc = np.repeat(np.arange(len(texts)), sizes)
    pairs, freq = np.unique(codes.astype(np.int64) * len(texts) + doc, return_counts=True)
    return words, pairs // max(1, len(texts)), pairs % max(1, len(texts)), freq


def _bytes(x: np.ndarray) -> bytes:
    """Values below 255 as a byte; others as 255 and, after all bytes, 4 bytes."""
    small = np.minimum(x, 255).astype(np.uint8)
    return small.tobytes() + x[x >= 255].astype("<u4").tobytes()


def _unbytes(b: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(b, "<u4", offset=n)
    return x


def pack_postings(words: list[str], at: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> bytes:
    """at is ascending, doc within it. Stored: the words, postings per word, steps between documents, frequencies."""
    step = np.diff(doc, prepend=0)
    head = np.flatnonzero(np.diff(at, prepend=-1))
    step[head] = doc[head]
    text = [w.encode("utf-8", "surrogatepass") for w in words]
    parts = [b"".join(text), _bytes(np.array([len(t) for t in text], dtype=np.int64)), _bytes(np.bincount(at, minlength=len(words))), _bytes(step), _bytes(freq)]
    sizes = np.array([len(words), len(at), *map(len, parts)], dtype="<i8").tobytes()
    return zlib.compress(sizes + b"".join(parts), 1)


def unpack_postings(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n, m, *sizes = np.frombuffer(raw, "<i8", 7).tolist()
    cuts = np.cumsum([56, *sizes]).tolist()
    text, lens, per, step, freq = (raw[a:b] for a, b in zip(cuts, cuts[1:]))
    ends = np.cumsum(_unbytes(lens, n)).tolist()
    words = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
    at = np.repeat(np.arange(n), _unbytes(per, n))
    doc = _unbytes(step, m)
    # Steps add up within each word.
    total = np.cumsum(doc)
    head = np.flatnonzero(np.diff(at, prepend=-1))
    before = np.zeros(n, np.int64)
    before[at[head]] = total[head] - doc[head]
    return words, at, total - before[at], _unbytes(freq, m)


def count_tokens(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens`` for every row."""
    spark = docs.sparkSession
    cuts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches(it, 1, block_bytes):
            # Row -1 of a block carries its ids, the others its postings.
            ids = b.column(0)
            head = pa.RecordBatch.from_arrays([ids], ["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            keys, blobs = [-1], [sink.getvalue().to_pybytes()]
            words, at, doc, freq = split_block(b.column(1).to_pylist(), pattern)
            if len(words):
                cut = (pd.util.hash_array(words, categorize=False) % np.uint64(cuts)).astype(np.int64)
                order = np.lexsort((at, cut[at]))
                at, doc, freq = at[order], doc[order], freq[order]
                edge = np.searchsorted(cut[at], np.arange(cuts + 1))
                for c in range(cuts):
                    part = at[edge[c] : edge[c + 1]]
                    if len(part):
                        new, own = np.unique(part, return_inverse=True)
                        keys.append(c)
                        blobs.append(pack_postings([words[i] for i in new], own, doc[edge[c] : edge[c + 1]], freq[edge[c] : edge[c + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([block] * len(keys), pa.int64()), pa.array(blobs, pa.binary())], ["cut", "block", "data"])
            block += 1

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(ranks, pattern)
        known: dict[str, int] = {}
        last = None
        for b in it:
            keys, blocks, blobs = [], [], []
            for cut, block, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if cut >= 0:
                    if cut != last:
                        known, last = {}, cut
                    words, at, doc, freq = unpack_postings(data)
                    for w in words:
                        if w not in known:
                            known[w] = pieces(w)
                    n = np.array([known[w] for w in words], dtype=np.int64)
                    each, own = np.unique(doc, return_inverse=True)
                    sums = np.bincount(own, weights=freq * n[at]).astype("<i8")
                    data = each.astype("<i4").tobytes() + sums.astype("<i8").tobytes()
                keys.append(cut)
                blocks.append(block)
                blobs.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["cut", "block", "data"])

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(total)], ["doc_id", "n_tokens"])

        last, ids, total = None, None, None
        for b in it:
            for cut, block, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if block != last:
                    if last is not None:
                        yield done()
                    # The ids come first, as -1 is the smallest cut.
                    ids = pa.ipc.open_stream(data).read_all().combine_chunks().column(0).combine_chunks()
                    last, total = block, np.zeros(len(ids), np.int64)
                else:
                    n = len(data) // 12
                    total[np.frombuffer(data, "<i4", n)] += np.frombuffer(data, "<i8", n, 4 * n)
        if last is not None:
            yield done()

    shape = "cut int, block bigint, data binary"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    slot = F.when(F.col("cut") < 0, F.pmod(F.xxhash64("block"), F.lit(cuts)).cast("int")).otherwise(F.col("cut"))
    by_cut = docs.select("doc_id", "text").mapInArrow(postings, shape).repartitionById(cuts, slot).sortWithinPartitions("cut")
    sums = by_cut.mapInArrow(counted, shape)
    by_block = sums.repartition("block").sortWithinPartitions("block", "cut")
    return by_block.mapInArrow(summed, f"doc_id {id_type}, n_tokens bigint")
