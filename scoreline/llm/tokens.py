"""Token ids in fixed-width bit-packed files.

A file set is a Parquet folder of segments. Each segment holds whole documents and is one binary value:

    8s magic, u32 width, u32 ids per block, u64 ids, u64 documents      (little endian)
    u8  x documents: 1 if the document has an id
    i64 x documents: document ids
    u64 x documents: end of each document, counted in ids
    u64 x blocks: byte offset of each block in the payload
    payload: ids of ``width`` bits, most significant bit first, each block starting on a byte

``width`` is the least number of bits that holds every id of the vocabulary. A block can be unpacked without the ones
before it, so ids at any place are reached by the block offsets.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, texts

MAGIC = b"TOKPACK1"
HEAD = struct.Struct("<8sIIQQ")
BLOCK = 4096
SEGMENT_IDS = 1 << 20
#: Words whose ids a worker keeps; beyond that the memory is emptied and fills anew, which changes no result.
CACHE_WORDS = 1 << 20

#: Tokenizers with these settings give a word the ids of its pieces in a row. Words of printable ASCII and letters of Latin-1 are cut into
#: pieces here, as far fewer of them differ than words do; all other words, and those that hold an added token, are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [CUT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

_cache: dict[tuple, tuple] = {}


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width to bytes, most significant bit first, padded to a byte at the end."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), 16 * BLOCK):
        rows = np.unpackbits(ids[i : i + 16 * BLOCK].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        parts.append(np.packbits(rows[:, 32 - width :]).tobytes())
    return b"".join(parts)


def unpack(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first n ids of data as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    out, raw = np.empty(n, np.uint32), np.frombuffer(data, np.uint8)
    for i in range(0, n, 16 * BLOCK):
        m = min(16 * BLOCK, n - i)
        rows = np.zeros((m, 32), np.uint8)
        rows[:, 32 - width :] = np.unpackbits(raw[i * width // 8 :], count=m * width).reshape(m, width)
        out[i : i + m] = np.packbits(rows).view(">u4")
    return out


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    if block % 8:
        raise ValueError("a block holds a multiple of 8 ids")
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64) if ids else np.zeros(0, np.uint64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = np.arange(0, -(-len(flat) // block), dtype=np.uint64) * np.uint64(block * width // 8)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, width, block, len(flat), len(doc_ids)), known.tobytes(), numbers.tobytes(), ends.astype("<u8").tobytes(), blocks.astype("<u8").tobytes(), pack(flat, width)])


class Segment:
    """Reads a segment; ids(start, stop) unpacks only the blocks that hold them."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.block, self.n_ids, self.n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        known = np.frombuffer(data, np.uint8, self.n_docs, at)
        numbers = np.frombuffer(data, "<i8", self.n_docs, at := at + self.n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at := at + 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block), at := at + 8 * self.n_docs).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * len(self.offsets) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block
        got = unpack(self.payload[self.offsets[first] :], self.width, stop - first * self.block)
        return got[start - first * self.block :]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the segment, ids) of every document."""
        every, start = self.ids(0, self.n_ids), 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            yield doc_id, start, every[start:end]
            start = end


def word_ids(tokenizer_file: str):
    """A function from a list of words to a dict with each word's ids as little-endian uint32 bytes.

    It holds for tokenizers that cut at white space and drop it, so that a text's ids are its words' ids in a row.
    """
    from tokenizers import Tokenizer

    key = (tokenizer_file,)
    if key not in _cache:
        loaded = Tokenizer.from_file(tokenizer_file)
        loaded.encode_special_tokens = False
        told = json.loads(loaded.to_str())
        cut = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and not told["post_processor"] and not told["model"].get("dropout")
        _cache[key] = (loaded, {}, {}, re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or r"(?!)") if cut else None)
    loaded, cache, pieces, added = _cache[key]

    def encoded(new: list[str]) -> Iterator[bytes]:
        for i in range(0, len(new), 1 << 14):
            for got in loaded.encode_batch_fast(new[i : i + (1 << 14)], add_special_tokens=False):
                yield np.array(got.ids, "<u4").tobytes()

    def of(words: list[bytes]) -> dict[bytes, bytes]:
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if len(new) + len(cache) > CACHE_WORDS:
            cache.clear()
            new = list(dict.fromkeys(words))
        whole, cut = [], {}
        for word in new:
            text = word.decode()
            if added is not None and PLAIN.fullmatch(text) and not added.search(text):
                cut[word] = PIECE.findall(text.lower())
            else:
                whole.append(word)
        cache.update(zip(whole, encoded([w.decode() for w in whole]), strict=True))
        wanted = dict.fromkeys(p for own in cut.values() for p in own)
        unseen = [p for p in wanted if p not in pieces]
        if len(unseen) + len(pieces) > CACHE_WORDS:
            pieces.clear()
            unseen = list(wanted)
        pieces.update(zip(unseen, encoded(unseen), strict=True))
        for word, own in cut.items():
            cache[word] = b"".join(map(pieces.__getitem__, own))
        return cache

    return of


def same_as_whole(tokenizer_file: str, piece: pa.RecordBatch, ids: list[np.ndarray]) -> None:
    """An error if the first text with ids, as a whole, has other ids than its words in a row: the tokenizer doesn't cut at white space."""
    own = texts(piece)
    at = next((i for i, t in enumerate(own) if t and t.encode().split()), None)
    if at is not None:
        whole = _cache[(tokenizer_file,)][0].encode(own[at], add_special_tokens=False).ids
        if whole != ids[at].tolist():
            raise ValueError(f"{tokenizer_file} does not cut texts at white space alone")


def ids_of(piece: pa.RecordBatch, of) -> list[np.ndarray]:
    """The ids of each text of the piece, its words' ids in a row; a different word is looked up once."""
    column = piece.column(piece.schema.get_field_index("text"))
    words = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))  # white space at an end gives an empty word, of no ids
    coded = words.values.dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    known = of([w for w in different if w])
    found = [known[w] if w else b"" for w in different]
    sizes, index = np.array([len(x) // 4 for x in found], np.int64), coded.indices.to_numpy()
    starts, many, flat = np.cumsum(sizes) - sizes, sizes[index], np.frombuffer(b"".join(found), "<u4")
    ends = np.append(0, np.cumsum(many))
    ids = flat[np.repeat(starts[index] - ends[:-1], many) + np.arange(ends[-1])]
    bounds = ends[words.offsets.to_numpy()]
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Encode docs (doc_id, text) and write segments in ascending doc_id order to the folder path.

    Texts are never cut; null texts are empty; null ids come first; rows of one id are in order of a hash of their texts. The
    ids are those of encoding the whole text, which is compared for one text of every batch. Other columns are not
    read. An empty table gives an empty file set.
    """

    def encode(batches):
        import os

        from pyspark import TaskContext
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        width = width_of(Tokenizer.from_file(tokenizer_file).get_vocab_size())
        of, part = word_ids(tokenizer_file), TaskContext.get().partitionId()
        end, seq, doc_ids, ids, held = np.array([end_id], "<u4"), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "first_doc_id": [doc_ids[0]], "n_ids": [held], "data": [write_segment(doc_ids, ids, width)]},
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc_id", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]),
            )

        for batch in batches:
            for piece in slices(batch):
                found = ids_of(piece, of)
                same_as_whole(tokenizer_file, piece, found)
                for doc_id, own in zip(texts(piece, "doc_id"), found, strict=True):
                    got = np.concatenate((own, end))
                    doc_ids.append(doc_id)
                    ids.append(got)
                    held += len(got)
                    if held >= SEGMENT_IDS:
                        yield row()
                        seq, doc_ids, ids, held = seq + 1, [], [], 0
        if doc_ids:
            yield row()

    # Ranges are cut by the text's hash too, so that rows of one id, or of none, may fill several.
    key = [F.col("doc_id").asc_nulls_first(), "h", "text"]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).repartitionByRange(*key[:2]).sortWithinPartitions(*key).drop("h")
    ordered.mapInArrow(encode, "part int, seq int, first_doc_id long, n_ids long, data binary").write.parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file set, from its bytes."""

    def decode(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                segment = Segment(data)
                found = [(d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in segment.documents()]
                n = len(found)
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["part", "seq", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "seq", "data").mapInArrow(decode, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    heads = segments.select("part", "seq", "first_doc_id", "n_ids")
    # One row a partition that wrote: few, and the only rows that meet in one task.
    parts = heads.groupBy("part").agg(F.min(F.coalesce("first_doc_id", F.lit(-(1 << 63)))).alias("first"), F.sum("n_ids").alias("total"))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("offset"))
    return found.join(heads, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs, read back from the file set that write_tokens makes of it.

    Null and empty texts have the end id alone. Rows without an id and repeated rows are documents of their own. Texts
    are read whole; columns other than doc_id and text are not read. An empty table gives no row.
    """
    spark = docs.sparkSession
    path = f"{shared_path(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_file, end_id, path)
    return read_tokens(spark.read.parquet(path))
