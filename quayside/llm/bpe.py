"""Byte-level BPE ids of whole texts from a table of distinct words, and texts from ids through the table of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blanks, bounded, bucketed, pack, span_hashes, text_blocks, unpack

#: Bytes of text whose words are numbered together, and of text for each group of words; a longer text is a chunk of its own.
CHUNK, GROUP = 24 << 20, 16 << 20
#: Tokens that are turned into bytes at once, and bytes of words that are encoded at once.
TOKENS, ENCODED = 1 << 17, 1 << 16


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def word_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words start: at each text, and before each run of white space. The tokens of a text are those of its words one after another.

    No token but white space spans such a place, and white space is tokenised by what follows it. A place behind white
    space beyond ASCII lies within its run and so starts no word.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    gap = blanks(buf)
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    after = first.copy()
    after[:1] = False
    after[1:] &= buf[:-1] >= 0x80
    at = np.flatnonzero(after)
    b = [buf[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    wide = (b[1] == 0xC2) & ((b[0] == 0x85) | (b[0] == 0xA0)) | (b[2] == 0xE1) & (b[1] == 0x9A) & (b[0] == 0x80)
    wide |= (b[2] == 0xE2) & ((b[1] == 0x80) & ((b[0] >= 0x80) & (b[0] <= 0x8A) | np.isin(b[0], (0xA8, 0xA9, 0xAF))) | (b[1] == 0x81) & (b[0] == 0x9F))
    wide |= (b[2] == 0xE3) & (b[1] == 0x80) & (b[0] == 0x80)
    first[at[wide & (at >= 2)]] = False
    first[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(first)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


def strings(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of strings or binaries of the given sizes that lie one after another in data."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a chunk: words in each text, the place of each word among the distinct ones, the most frequent first, and the hashes, sizes and bytes of these."""
    hashes, counts, starts, sizes, bufs, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], [], 0
    for t in texts:
        for _, _, buf, off in text_blocks(t):
            at = word_starts(buf, off)
            ends = np.append(at[1:], len(buf)) if len(at) else at
            hashes.append(span_hashes(buf, at, ends, cased=True))
            counts.append(np.diff(np.searchsorted(at, off)))
            starts.append(at + base)
            sizes.append((ends - at).astype(np.int32))
            bufs.append(buf)
            base += len(buf)
    n = np.concatenate(counts)
    code, uniq = pd.factorize(np.concatenate(hashes))
    if not len(uniq):
        return n, np.zeros(0, np.uint32), uniq, np.zeros(0, np.int64), np.zeros(0, np.uint8)
    first = np.empty(len(uniq), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(-np.bincount(code), kind="stable")
    rank = np.empty(len(uniq), np.uint32)
    rank[order] = np.arange(len(uniq))
    own = np.concatenate(sizes)[first[order]].astype(np.int64)
    return n, rank[code], uniq[order], own, gather(np.concatenate(bufs), np.concatenate(starts)[first[order]], own)


def chunked(docs: DataFrame, groups: int) -> DataFrame:
    """(chunk, doc_ids, n_words, places, words): texts of about CHUNK bytes together, each word of them as its place among the chunk's distinct words, and these, dealt to `groups` groups by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            n, places, h, sizes, data = words_of(texts)
            group = (h % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.cumsum(sizes) - sizes
            of, first = np.unique(group[order], return_index=True)
            packed = []
            for g, w in zip(of.tolist(), np.split(order, first[1:]) if len(of) else [], strict=True):
                text = gather(data, starts[w], sizes[w]).tobytes()
                packed.append({"group": g, "places": pack(np.diff(w, prepend=0)), "sizes": pack(sizes[w]), "words": pa.compress(text, codec="zstd", asbytes=True), "bytes": len(text)})
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (pa.chunked_array(ids).combine_chunks(), pa.array(n.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([pack(places)], pa.binary()), pa.array([packed], kind)], ["doc_ids", "n_words", "places", "words"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids.append(part.column(0))
                texts.append(part.column(1))
                size += part.column(1).nbytes
                if size >= CHUNK:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    kind = pa.list_(pa.struct([("group", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("bytes", pa.int64())]))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_ids array<long>, n_words array<long>, places binary, words array<struct<group:long,places:binary,sizes:binary,words:binary,bytes:long>>")
    return rows.withColumn("chunk", F.monotonically_increasing_id())


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one word after another, and how many each has.

    Words that start with white space and end otherwise are encoded in one go, since no token spans their limits; the bytes of
    the tokens then tell where each word ends.
    """
    piece_sizes = piece_table(path)[1]
    joined = [w[0] in " \t\n\v\f\r" and not w[-1].isspace() for w in words]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
    some = [k for k, j in enumerate(joined) if not j]
    i = 0
    together = [k for k, j in enumerate(joined) if j]
    while i < len(together):
        j, size = i, 0
        while j < len(together) and size < ENCODED:
            size += len(words[together[j]])
            j += 1
        own = [words[k] for k in together[i:j]]
        ids = np.array(tokenizer(path).encode("".join(own), add_special_tokens=False).ids, np.uint32)
        ends = np.cumsum([len(w.encode()) for w in own])
        reached = np.cumsum(piece_sizes[ids])
        at = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
        if (reached[at] == ends).all():
            for k, x in zip(together[i:j], np.split(ids, at[:-1] + 1), strict=True):
                out[k] = x
        else:
            some += together[i:j]
        i = j
    for i in range(0, len(some), 4096):
        part = some[i : i + 4096]
        for k, e in zip(part, tokenizer(path).encode_batch([words[k] for k in part], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), sizes


def encoded(words: DataFrame, path: str) -> DataFrame:
    """(chunk, places, sizes, ids) for words(chunk, group, places, sizes, words, bytes) in order of group: each distinct word of a group is encoded once."""

    def coded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = [unpack(x) for x in rows["sizes"].to_pylist()]
        data = b"".join(pa.decompress(w, decompressed_size=n, codec="zstd", asbytes=True) for w, n in zip(rows["words"].to_pylist(), rows["bytes"].to_pylist(), strict=True))
        every = np.concatenate(sizes).astype(np.int64)
        ends = np.cumsum(every)
        code, uniq = pd.factorize(span_hashes(np.frombuffer(data, np.uint8), ends - every, ends, cased=True))
        first = np.empty(len(uniq), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        ids, n = encode_words([data[e - s : e].decode() for s, e in zip(every[first].tolist(), ends[first].tolist(), strict=True)], path)
        at, starts = 0, np.cumsum(n) - n
        for k, s in enumerate(sizes):
            c = code[at : at + len(s)]
            at += len(s)
            yield pa.RecordBatch.from_arrays([rows["chunk"].combine_chunks().slice(k, 1), rows["places"].combine_chunks().slice(k, 1), pa.array([pack(n[c])]), pa.array([pack(gather(ids, starts[c], n[c]))])], ["chunk", "places", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and group[a] != now:
                    yield from coded(pa.concat_tables(held))
                    held = []
                now = group[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield from coded(pa.concat_tables(held))

    return words.select("chunk", "group", "places", "sizes", "words", "bytes").mapInArrow(run, "chunk long, places binary, sizes binary, ids binary")


def texts_of(ids: np.ndarray, sizes: np.ndarray, path: str) -> pa.Array:
    """The texts of ids that lie one after another, `sizes` of them each: the pieces joined, with U+FFFD for bytes that are no UTF-8."""
    starts, lengths, flat = piece_table(path)
    data = [gather(flat, starts[x], lengths[x]) for x in (ids[i : i + TOKENS] for i in range(0, len(ids), TOKENS))]
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    n = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])
    raw = strings(np.concatenate(data) if data else flat[:0], n, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of docs(doc_id, text, ...): little-endian unsigned 32-bit ids, those of the tokenizers library on the whole text.

    path names a byte-level vocabulary. Texts are split into words, runs of white space with what follows. A chunk of some
    texts numbers its distinct words, by 64-bit hashes, and keeps each text as places among these, so that even the
    commonest word travels once a chunk. Words are dealt to groups, whose number follows the size of the texts; there each
    distinct word is encoded once, and ids come back to their chunks, where they are joined by position. `decoded` adds the
    column text, what decode() makes of the ids. Special tokens in a text are recognised as the library does.

    Null and empty texts have no ids. Repeated rows are kept, each with its ids. Other columns are ignored. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    bounded(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(parts, size // GROUP)
    buckets = min(groups, 1 << 16)
    chunks = bucketed(chunked(docs, groups), "chunk", buckets)
    words = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.*").repartition(groups, "group").sortWithinPartitions("group")
    fills = encoded(words, path).repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("places", "sizes", "ids")).alias("fills"))
    rows = chunks.select("chunk", "doc_ids", "n_words", "places").hint("merge").join(fills, "chunk", "left").select("doc_ids", "n_words", "places", "fills")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs, n_words = (batch.column(c)[r].values for c in (0, 1))
                ends = np.concatenate([[0], np.cumsum(n_words.to_numpy())])
                places = unpack(batch.column(2)[r].as_py())
                fills = batch.column(3)[r].as_py() or []
                at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(f["places"]).astype(np.int64)) for f in fills)])
                more = np.concatenate([np.zeros(0, np.int64), *(unpack(f["sizes"]).astype(np.int64) for f in fills)])
                flat = np.concatenate([np.zeros(0, "<u4"), *(unpack(f["ids"]) for f in fills)])
                del fills
                starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                starts[at], sizes[at] = np.cumsum(more) - more, more
                a = 0
                while a < len(docs):  # some texts at a time
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, side="right")) - 1)
                    p = places[ends[a] : ends[b]]
                    ids = gather(flat, starts[p], sizes[p])
                    n = np.diff(np.concatenate([[0], np.cumsum(sizes[p])])[ends[a : b + 1] - ends[a]])
                    cols = [docs.slice(a, b - a), strings(ids.view(np.uint8), 4 * n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cols, texts_of(ids, n, path)] if decoded else cols, names)
                    a = b

    names = ["doc_id", "ids", "text"] if decoded else ["doc_id", "ids"]
    return rows.mapInArrow(assemble, "doc_id long, ids binary" + ", text string" * decoded)


@lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each id: starts, sizes, flat. Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    t = tokenizer(path)
    special = {k for k, v in t.get_added_tokens_decoder().items() if v}
    vocab = t.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        pieces[k] = piece.encode() if k in special else bytes(byte[c] for c in piece)
    sizes = np.array([len(p) for p in pieces])
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(pieces), np.uint8)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) for coded(doc_id, ids): every id's piece, special tokens too, one after another; bytes that are no UTF-8 become U+FFFD.

    The pieces are a table of the vocabulary's size, which is fixed and read where it is used. Null ids give an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                own = part.column(1).fill_null(b"")
                ids = np.frombuffer(b"".join(own.to_pylist()), "<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts_of(ids, pa.compute.binary_length(own).to_numpy() // 4, path)], ["doc_id", "ids", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")
