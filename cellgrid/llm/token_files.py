"""Token-id files in a byte- or bit-plane layout.

A file holds chunks of whole documents in ascending doc_id order. A chunk's ids (each document's ids, then the end id) are
cut into blocks of a fixed number of ids; each block, as little-endian 32-bit integers, is transposed into planes (byte plane
k holds byte k of every id, bit plane k holds bit k), and each plane is compressed with zstandard on its own. High planes of
a small vocabulary are constant and vanish. The chunk index (document ids and lengths, block and plane sizes) stands beside
the planes, so any chunk can be read alone. Spark's writer stores one row per chunk, so files go wherever Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_letters, slices, table, vocabulary_path, work_dir

BLOCK_IDS = 1 << 15
CHUNK_IDS = 1 << 19
MEMO_ENTRIES = 600_000

CHUNKS = "file_no int, chunk_no int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, plane_bytes array<int>, planes binary"
DOCS = "file_no int, chunk_no int, doc_no int, doc_id bigint, n_tokens bigint, ids_crc32 bigint, before bigint"


#: Pieces of these characters (ASCII signs, Latin-1 letters) split into pre-tokens as the library splits them, and NFC leaves them alone.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What a plain text doesn't have: characters other than ASCII and Latin-1 letters, and how the vocabulary's special strings begin.
_ODD = "[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|"
#: Between a letter and such a sign pre-tokens end, whatever stands around them.
_WORD_END = "([a-z\u00df-\u00f6\u00f8-\u00ff])([.,;:!?])"
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class PieceEncoder:
    """Encodes texts piece by piece, remembering pieces and pre-tokens.

    A tokenizer that drops white space encodes a text as the concatenation of what it gives for the pieces between spaces
    or line ends: no token spans white space, and neither NFC nor lower-casing looks across a space. A new piece of ASCII signs
    and Latin-1 letters is lower-cased and split into pre-tokens by the vocabulary's pattern, and the library's model merges each new
    one; any other piece the library encodes whole. Texts are then joins of remembered bytes.
    Texts of nothing but such characters and white space are lower-cased beforehand and cut between words and the signs after
    them too, so that fewer pieces are new. Arrow cuts the texts, numbers the distinct pieces and joins their ids.
    """

    def __init__(self, vocabulary: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kept = json.loads(self.tokenizer.to_str())
        marks = [t["content"] for t in kept["added_tokens"]]
        lower = "Lowercase" in json.dumps(kept["normalizer"]) and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in json.dumps(kept["pre_tokenizer"])
        self.marks = re.compile("|".join(map(re.escape, marks)) or "(?!)")
        self.splits = lower and all(_PLAIN.fullmatch(m) and "<|" in m for m in marks)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.pre: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.memo_entries = memo_entries

    def merged(self, p: str) -> bytes:
        """The ids of one lower-case pre-token, by the library's model."""
        ids = self.pre.get(p)
        if ids is None:
            own = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            ids = self.pre[p] = array("I", [t.id for t in self.model.tokenize(own)]).tobytes()
        return ids

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of new pieces."""
        memo, rest, plain, letters, mark = self.memo, [], _PLAIN.fullmatch, _LETTERS.fullmatch, self.marks.search
        for piece in new:
            if not self.splits:
                rest.append(piece)
            elif piece.isalpha() and (piece.isascii() or letters(piece)):
                memo[piece] = self.merged(piece.lower())
            elif plain(piece) and not ("<|" in piece and mark(piece)):
                memo[piece] = b"".join(map(self.merged, _PRE_TOKENS.findall(piece.lower())))
            else:
                rest.append(piece)
        for part in slices(rest, 20_000):
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[piece] = array("I", e.ids).tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.splits:
            texts = pc.if_else(pc.match_substring_regex(texts, _ODD), texts, pc.replace_substring_regex(pc.ascii_lower(texts), _WORD_END, "\\1 \\2"))
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = pieces.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        if len(self.pre) > self.memo_entries:
            self.pre.clear()
        self.learn([p for p in distinct if p not in self.memo])
        ids = pa.array(list(map(self.memo.__getitem__, distinct)), pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[pieces.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(vocabulary: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PieceEncoder(vocabulary)
    return _encoders[vocabulary]


def to_planes(block: np.ndarray, layout: str = "byte") -> list[bytes]:
    """The planes of a block of ids: 4 byte planes or 32 bit planes."""
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of n from its planes, of either layout."""
    if len(planes) == 4:
        raw = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.empty((n, 32), np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_chunk(encoded: list[bytes], layout: str = "byte", level: int = 3, block_ids: int = BLOCK_IDS) -> tuple[int, list[int], bytes]:
    """(number of ids, compressed size of each plane in order of block and plane, the compressed planes) of documents' ids."""
    ids = np.frombuffer(b"".join(encoded), "<u4")
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) for at in range(0, len(ids), block_ids) for p in to_planes(ids[at : at + block_ids], layout)]
    return len(ids), [len(p) for p in packed], b"".join(packed)


def unpack_chunk(n_ids: int, plane_bytes: list[int], planes: bytes, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """All ids of a chunk."""
    if not n_ids:
        return np.empty(0, "<u4")
    per_block = len(plane_bytes) // -(-n_ids // block_ids)
    expand, out, at, k = zstandard.ZstdDecompressor(), [], 0, 0
    for first in range(0, n_ids, block_ids):
        n, raw = min(block_ids, n_ids - first), []
        for _ in range(per_block):
            raw.append(expand.decompress(planes[at : at + plane_bytes[k]], max_output_size=4 * block_ids))
            at, k = at + plane_bytes[k], k + 1
        out.append(from_planes(raw, n))
    return np.concatenate(out)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, layout: str = "byte", level: int = 3) -> None:
    """Writes the ids of every text of `docs` (doc_id, text) to `path`, in ascending doc_id order over the files.

    The texts are dealt by ranges of doc_id and row and sorted within a range, so an id that many rows share is spread over
    ranges like any other ids; each range makes one file, and the file numbers follow the ranges. A null text is empty (its document is the end id alone); a null doc_id comes first; repeated
    doc_ids stay as separate documents, side by side. An empty table writes files without chunks.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, chunk_no, tool = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            n, sizes, planes = pack_chunk(held, layout, level)
            row = {"file_no": [file_no], "chunk_no": [chunk_no], "doc_ids": [list(ids)], "lengths": [[len(x) // 4 for x in held]], "n_ids": [n], "plane_bytes": [sizes], "planes": [planes]}
            return pa.RecordBatch.from_pydict(row, CHUNK_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, x in zip(part.column(0).to_pylist(), tool.encode(part.column(1)), strict=True):
                    ids.append(doc_id)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= CHUNK_IDS:
                        yield chunk()
                        chunk_no, size = chunk_no + 1, 0
                        ids.clear()
                        held.clear()
        if held:
            yield chunk()

    order = [F.col("doc_id").asc_nulls_first(), "row_no"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_no"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_rows.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


CHUNK_ARROW = pa.schema([("file_no", pa.int32()), ("chunk_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32, and where it is stored.

    `start` counts all ids before the document over all files: the index gives each chunk's number of ids, chunk starts
    are sums over the index (one row per chunk; no document passes through one task), and the rest is added in the chunk.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    per_file = chunks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    from pyspark.sql import Window

    files = per_file.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("file_start"))
    in_file = Window.partitionBy("file_no").orderBy("chunk_no")
    index = chunks.select("file_no", "chunk_no", (F.sum("n_ids").over(in_file) - F.col("n_ids")).alias("chunk_start"))
    starts = index.join(files, "file_no")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_chunk(row["n_ids"], row["plane_bytes"], row["planes"])
                ends = np.cumsum(row["lengths"])
                firsts = ends - row["lengths"]
                raw = memoryview(ids.astype("<u4").tobytes())
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["file_no"], np.int32)), pa.array(np.full(n, row["chunk_no"], np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)], pa.int64()), pa.array(firsts, pa.int64()),
                    ],
                    ["file_no", "chunk_no", "doc_no", "doc_id", "n_tokens", "ids_crc32", "before"],
                )

    docs = chunks.mapInArrow(decode, DOCS)
    return docs.join(starts, ["file_no", "chunk_no"]).select("doc_id", (F.col("chunk_start") + F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file_no", "chunk_no", "doc_no")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The exact way back: doc_id and its ids (with the end id) as an array, for small tables and tests."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = unpack_chunk(row["n_ids"], row["plane_bytes"], row["planes"]), np.cumsum(row["lengths"])
                lists = np.split(ids.astype(np.int64), ends[:-1])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))})

    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(decode, "doc_id bigint, ids array<bigint>")


def op2_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens through the files: doc_id, start, n_tokens, ids_crc32 and its place."""
    import uuid

    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
