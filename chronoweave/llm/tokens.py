"""Token ids in binary files: fixed-size id blocks, transposed into planes, each plane compressed, with a chunk index.

Documents are dealt to files by ranges of their id and sorted, so that the files in order hold the ids in ascending order of doc_id.
A row of a file is one chunk of at most ``BLOCK_IDS`` ids: its ids as little-endian unsigned 32-bit integers are transposed into byte
planes (or bit planes), each plane is compressed with zstandard, and the row's index holds the planes' lengths, the number of ids and
the checksum of the raw bytes, with id, place and length of the documents that lie in it, wholly or in part.  Reading needs no shuffle
but for the pieces of documents that cross from one chunk to the next.  Spark's writers commit the files, so a lost executor leaves no
part of one behind.

Defined results: null and empty texts have the end id alone; repeated doc_ids are documents of their own, next to each other; an empty
table gives empty files; other columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, documents, fresh_path, sliced, written

BLOCK_IDS = 1 << 16
#: Rows that are encoded at once.
SLICE_ROWS = 64
END_ID = 0
#: Rows that one file takes at most, on average.
FILE_ROWS = 8_000
CACHE_ENTRIES = 1_000_000
#: Files whose sizes are summed in one task, and files whose starts (12 bytes each) may be broadcast.
FILES_BLOCK, BROADCAST_FILES = 4096, 1_000_000


def pack_block(raw: bytes, planes: str = "byte", level: int = 3) -> tuple[bytes, list[int]]:
    """The compressed planes of 32-bit ids, one after the other, and their lengths."""
    import zstandard

    ids = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(ids, axis=1, bitorder="little")
        cut = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    elif planes == "byte":
        cut = [ids[:, k].tobytes() for k in range(4)]
    else:
        raise ValueError(f"unknown planes: {planes}")
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    packed = [packer.compress(p) for p in cut]
    return b"".join(packed), [len(p) for p in packed]


def unpack_block(payload: bytes, lengths: list[int], n: int) -> bytes:
    """The raw bytes that ``pack_block`` was given."""
    import zstandard

    reader, cut, at = zstandard.ZstdDecompressor(), [], 0
    for length in lengths:
        cut.append(reader.decompress(payload[at : at + length]))
        at += length
    if len(cut) == 4:
        return np.stack([np.frombuffer(p, dtype=np.uint8) for p in cut], axis=1).tobytes()
    bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little")[:n] for p in cut], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


class WordEncoder:
    """The tokenizer's ids of a text as bytes, with a bounded cache of words.

    The byte-level pre-tokenizer always cuts before a blank or a line end that stands alone between other characters, between a
    letter and a final stop or comma, and merges never cross its cuts: so the ids of such a text are those of its words, each with the
    blank before it.  A text with other white space, or what may be a special token, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> set[str]:
        """Cache the ids of ``words``; those that must not be encoded alone are returned."""
        cache, odd, ended, plain, other = self.cache, set(), [], [], []
        for w in words:
            core = w[1:] if w[:1] in ("\n", "\t") else w
            if core.split() != [core] or "<|" in core:
                odd.add(w)
            elif w[-1] in ".," and w[-2:-1].isalpha():
                ended.append(w)
                if w[:-1] not in cache and w[:-1] not in words:
                    (plain if w[:-1].isalpha() else other).append(w[:-1])
            else:
                (plain if w.isalpha() else other).append(w)
        plain, other = list(dict.fromkeys(plain)), list(dict.fromkeys(other))
        if plain:
            got = self.tokenizer.encode("".join(" " + w for w in plain), add_special_tokens=False)
            ids, word = np.asarray(got.ids, dtype="<u4"), np.asarray(got.word_ids)
            cuts = (np.flatnonzero(np.diff(word)) + 1) * 4
            if len(cuts) + 1 != len(plain):
                raise AssertionError("a word of letters alone is one pre-token")
            raw, ends = ids.tobytes(), [*cuts.tolist(), 4 * len(ids)]
            cache.update((w, raw[x:y]) for w, x, y in zip(plain, [0, *ends], ends, strict=False))
        if other:
            cache.update(zip(other, self._bytes([w if w[0] == "\n" else w[1:] if w[0] == "\t" else " " + w for w in other]), strict=True))
        if ended:
            stop = dict(zip(".,", self._bytes([".", ","]), strict=True))
            cache.update((w, cache[w[:-1]] + stop[w[-1]]) for w in ended)
        return odd

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        # A tab stands for the blank that the first word of a text doesn't have; a text that holds tabs of its own is encoded whole.
        whole = [t is not None and "\t" in t for t in texts]
        parts = [("\t" + t.replace("\n", " \n")).split(" ") if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        new = {w for words in parts for w in words if w not in cache}
        odd = self._learn(new) if new else set()
        out: list[bytes] = []
        for t, w, words in zip(texts, whole, parts, strict=True):
            if w or odd and not odd.isdisjoint(words):
                out += self._bytes([t])
            else:
                out.append(b"".join(map(cache.__getitem__, words)))
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, which tasks use again."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_DOC = pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64())])
_CHUNKS = pa.schema([
    ("file", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("lengths", pa.list_(pa.int32())),
    ("planes", pa.binary()), ("docs", pa.list_(_DOC)),
])
_CHUNKS_SQL = "file int, chunk long, n_ids long, crc32 long, lengths array<int>, planes binary, docs array<struct<doc_id: long, at: long, n_ids: long>>"


def _encode(path: str, end_id: int, planes: str):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encoder, file = _encoder(path), TaskContext.get().partitionId()
        held, at, chunk, docs = bytearray(), 0, 0, []

        def cut(raw: bytes):
            nonlocal chunk, docs
            payload, lengths = pack_block(raw, planes)
            row = (file, chunk, len(raw) // 4, zlib.crc32(raw), lengths, payload, [{"doc_id": d, "at": a, "n_ids": n} for d, a, n in docs])
            chunk += 1
            docs = [d for d in docs if d[1] + d[2] > chunk * BLOCK_IDS]
            return batch(_CHUNKS, ([x] for x in row))

        for b in sliced(batches, SLICE_ROWS, 1):
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                docs.append((doc, at, len(ids) // 4 + 1))
                at += len(ids) // 4 + 1
                held += ids
                held += end
                while len(held) >= 4 * BLOCK_IDS:
                    raw = bytes(held[: 4 * BLOCK_IDS])
                    del held[: 4 * BLOCK_IDS]
                    yield cut(raw)
        if held:
            yield cut(bytes(held))

    return run


_PIECES = pa.schema([
    ("file", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])
_PIECES_SQL = "file int, at long, doc_id long, n_tokens long, chunk long, ids_crc32 long, ids binary"


def _decode(whole: bool, digest: bool):
    """The documents that lie in one chunk, or else the pieces of those that don't."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first = r["chunk"] * BLOCK_IDS
                wanted = [d for d in r["docs"] if (d["at"] >= first and d["at"] + d["n_ids"] <= first + r["n_ids"]) == whole]
                if not wanted:
                    continue
                raw = unpack_block(r["planes"], r["lengths"], r["n_ids"])
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"file {r['file']}, chunk {r['chunk']}: the ids don't match their checksum")
                for d in wanted:
                    ids = raw[4 * max(0, d["at"] - first) : 4 * (d["at"] + d["n_ids"] - first)]
                    told = (zlib.crc32(ids), None) if whole and digest else (None, ids)
                    rows.append((r["file"], d["at"], d["doc_id"], d["n_ids"], r["chunk"], *told))
            yield batch(_PIECES, zip(*rows, strict=True) if rows else [[] for _ in _PIECES])

    return run


@dataclass
class TokenFiles:
    """Token files in a folder; a row is a chunk of ids with its index and the documents that it holds, wholly or in part."""

    spark: SparkSession
    path: str

    def write(self, docs: DataFrame, vocabulary: str, end_id: int = END_ID, planes: str = "byte", text: str = "text", row_id: str = "doc_id") -> TokenFiles:
        rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        n = rows.count()
        # Rows of one repeated or null id are ordered by a hash of the text, then by where they are read, so that they fill many files.
        rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
        order = ("doc_id", "hash", "place")
        ranged = rows.repartitionByRange(max(1, -(-n // FILE_ROWS)), *order).sortWithinPartitions(*order).select("doc_id", "text")
        ranged.mapInArrow(_encode(vocabulary, end_id, planes), _CHUNKS_SQL).write.parquet(self.path)
        return self

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(_CHUNKS_SQL).parquet(self.path)

    def read(self) -> DataFrame:
        """``(doc_id, start, n_tokens, ids)``, with ids as little-endian unsigned 32-bit integers, from the files alone."""
        return self._read("ids", F.col("ids"))

    def digests(self) -> DataFrame:
        """``(doc_id, start, n_tokens, ids_crc32)`` from the files alone."""
        return self._read("ids_crc32", F.coalesce("ids_crc32", F.crc32("ids")))

    def _read(self, name: str, value) -> DataFrame:
        digest = name == "ids_crc32"
        # Where each file begins: sums of blocks of files, then of the files of a block, so that no task and no driver has them all.
        sizes = self.chunks().groupBy("file").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("file") / FILES_BLOCK))
        before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))  # a row for each FILES_BLOCK files
        blocks = blocks.select("block", before(Window.partitionBy("all").orderBy("block")).alias("block_start"))
        table = sizes.withColumn("within", before(Window.partitionBy("block").orderBy("file"))).join(blocks, "block")
        table = written(table.select("file", (F.col("block_start") + F.col("within")).alias("file_start")), "starts")
        table = F.broadcast(table) if table.count() <= BROADCAST_FILES else table
        inside = self.chunks().mapInArrow(_decode(True, digest), _PIECES_SQL)
        pieces = self.chunks().mapInArrow(_decode(False, digest), _PIECES_SQL)
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), F.lit(b""), lambda s, x: F.concat(s, x.ids))
        across = pieces.groupBy("file", "at", "doc_id", "n_tokens").agg(joined.alias("ids"))
        both = inside.drop("chunk").unionByName(across.withColumn("ids_crc32", F.lit(None).cast("long")))
        return both.join(table, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", value.alias(name))


def write_tokens(docs: DataFrame, vocabulary: str, **options) -> TokenFiles:
    spark = docs.sparkSession
    return TokenFiles(spark, fresh_path(spark, "tokens")).write(docs, vocabulary, **options)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return write_tokens(documents(spark, sf_dir).select("doc_id", "text"), default_vocabulary()).digests()
