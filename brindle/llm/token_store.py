"""Token output as sorted-string-table shards, and lookups in them.

A shard holds documents in ascending order of their key:

    blocks   entries (shared key bytes u8, own key bytes u8, value bytes u32, own key bytes, value),
             compressed as one zstd frame, about BLOCK bytes before that; then crc32 of the frame u32
    index    for each block: bytes of its last key u8, the key, offset u64, size u32, entries u32
    filter   a Bloom filter over the keys
    footer   offsets and sizes of index and filter u64 each, entries u64, tokens u64, hashes of the
             filter u32, bytes of an id u32, magic of 8 bytes

A value is the document's place in the order of reading i64, or -1, and its ids in 2 or 4 bytes each, little-endian. A key is a byte 1 and the
document id, sign bit flipped, as 8 big-endian bytes; a null id is a byte 0. So keys sort as ids do,
and nulls come first.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE_ROWS, cut, release_memory, shared_dir, small_batches

MAGIC = b"BRNDSST2"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK = 256 << 10
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of a document's place.
PLACE = 8
#: Words whose ids a worker remembers.
KNOWN_WORDS = 150_000
#: Values that the sketch of the ids may hold, from which the shards' ranges are taken.
MOST_MARKS = 200_000
#: Shards of a table: of one with more than so many times shard_bytes of text they are larger.
MAX_SHARDS = 20_000


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes entries, which come in order of their keys, to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.held, self.last = [], 0, 0, b""
        self.index, self.keys, self.entries, self.tokens = [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.held, self.last = self.held + 1, key
        self.keys.append(xxhash.xxh3_128_digest(key))
        self.entries, self.tokens = self.entries + 1, self.tokens + (len(value) - PLACE) // self.width
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            frame = self.zip.compress(b"".join(self.block))
            self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<QII", self.at, len(frame), self.held))
            self._put(frame + struct.pack("<I", zlib.crc32(frame)))
            self.block, self.size, self.held = [], 0, 0

    def close(self) -> None:
        self._flush()
        index_at, index = self.at, b"".join(self.index)
        self._put(index)
        bits = max(64, BITS_PER_KEY * self.entries)
        bloom = np.zeros(bits, bool)
        halves = np.frombuffer(b"".join(self.keys), ">u8").reshape(-1, 2).astype(np.uint64)
        for i in range(HASHES):
            # the same places as _probes: (a + i * b) mod bits without overflow
            a, b = halves[:, 1] % np.uint64(bits), (halves[:, 0] | np.uint64(1)) % np.uint64(bits)
            bloom[(a + np.uint64(i) * b) % np.uint64(bits)] = True
        packed, bloom_at = np.packbits(bloom).tobytes(), self.at
        self._put(struct.pack("<Q", bits) + packed)
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(packed) + 8, self.entries, self.tokens, HASHES, self.width, MAGIC))


class Shard:
    """A written shard: footer, sparse index and filter in memory, blocks read as asked for."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        footer = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_size, self._bloom_at, self._bloom_size, self.entries, self.tokens, _, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a shard")
        data, at = self._read(index_at, index_size), 0
        self.last, self.blocks = [], []
        while at < len(data):
            n = data[at]
            self.last.append(data[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QII", data, at + 1 + n))
            at += 17 + n
        self._bloom = None

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, _ = self.blocks[i]
        frame = self._read(at, size + 4)
        if zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(frame[:-4]), 0, b""
        while at < len(data):
            shared, own, size = struct.unpack_from("<BBI", data, at)
            key = key[:shared] + data[at + 6 : at + 6 + own]
            at += 6 + own
            yield key, data[at : at + size]
            at += size

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            data = self._read(self._bloom_at, self._bloom_size)
            self._bloom = struct.unpack_from("<Q", data)[0], data[8:]
        bits, data = self._bloom
        return all(data[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, bits))

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4", offset=PLACE).astype(np.uint32)

    def place(self, value: bytes) -> int:
        return struct.unpack_from("<q", value)[0]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of a key, by the filter and a binary search of the index."""
        key, out = encode_key(doc_id), []
        if not self.may_hold(key):
            return out
        i = bisect.bisect_left(self.last, key)
        while i < len(self.blocks):
            got = [(k, v) for k, v in self.block(i) if k >= key]
            out += [self.ids(v) for k, v in got if k == key]
            if got and got[-1][0] > key:
                break
            i += 1
        return out

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, value in self.block(i):
                yield decode_key(key), self.ids(value)


class Encoder:
    """Token ids of many texts: white space only ever separates words here, so each word is encoded once."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores have tasks of their own, and threads hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        self._start()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool) if suffix else None
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        probe = ["Abc.,Def, x.a1$Y", "abc .,def , x .a 1$y"]
        self.plain = all("<|" in t.content for t in self.tokenizer.get_added_tokens_decoder().values()) and len({tuple(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in probe}) == 1

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.flat = array("q", [0]), array("I")

    def _keep(self, words: list[str]) -> None:
        """Forget all words but these, which are at hand and mostly common ones."""
        known, start, flat = self.known, self.start, self.flat
        self._start()
        for w in words:
            at = known.get(w)
            if at is not None:
                self.known[w] = len(self.known)
                self.flat.extend(flat[start[at] : start[at + 1]])
                self.start.append(len(self.flat))

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > KNOWN_WORDS:
            self._keep(words)
        known, new = self.known, [w for w in words if w not in self.known]
        letters = [w for w in new if w.isalpha()] if self.ends is not None else []
        parts = [letters[at : at + 500] for at in range(0, len(letters), 500)]
        # each of these words is one piece of the tokenizer, whose last id tells
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
                self.start.frombytes((ends + len(self.flat)).astype(np.int64).tobytes())
                self.flat.frombytes(ids.tobytes())
        new = [w for w in new if w not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = len(known)
                self.flat.extend(got.ids)
                self.start.append(len(self.flat))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end id; a null text is an empty one."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "").filter(pa.array(np.ones(n, bool)))
        # fewer words differ in lower case and without the signs after a letter, which the tokenizer
        # lower-cases and splits off anyway; but its special tokens are looked for before that
        if self.plain and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-&(-@\[-`{-~])", r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        values, parents = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(values), 0)
        values, parents = values.filter(full), parents.filter(full)
        coded = values.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)
        # a word's ids by its place; copies, as the buffers grow
        start, flat = np.array(self.start, np.int64), np.array(self.flat, np.uint32)
        size = np.diff(start).astype(np.int32)[place]
        ends = np.cumsum(size, dtype=np.int64)
        kind = np.int32 if len(flat) + (ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
        ids = flat[np.repeat((start[:-1][place] - (ends - size)).astype(kind), size) + np.arange(ends[-1] if len(ends) else 0, dtype=kind)]
        edge = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(parents.to_numpy(zero_copy_only=False).astype(np.int64), weights=size, minlength=n).astype(np.int64), out=edge[1:])
        return [np.append(ids[a:b], np.uint32(self.end_id)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _slices(texts: pa.Array, most: int = 6 << 20) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield texts.slice(at, stop - at)
        at = stop


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """This process's encoder, which remembers words from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 64 << 20, folder: str | None = None, place_col: str | None = None) -> DataFrame:
    """Write the table and return its manifest: (shard, uri, entries, tokens), in order of the keys.

    tokenizer_path: a file of the tokenizers library that every worker can open. A shard holds the
    documents of a range of ids, about shard_bytes of text. place_col: a number from 0 by which documents are to be
    read, kept with their ids. Files appear under their final name
    when they are whole; a task that runs again writes the same bytes.

    Null and empty texts are the end id alone; null ids come first; rows of equal id are adjacent
    entries, in order of their text's ids. An empty table has no shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:", "") if folder.startswith("file:") else folder
        folder = f"file://{folder}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.coalesce(F.col(place_col).cast("long"), F.lit(-1)) if place_col else F.lit(-1)).cast("long").alias("place"))
    held = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    shards = max(1, min(held["n"], -(-(held["b"] or 0) // shard_bytes), MAX_SHARDS))
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], min(100 * shards, MOST_MARKS))).first()[0] or [])) if shards > 1 else []

    width = encoder_of(tokenizer_path, end_id).width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cuts, squeeze = encoder_of(tokenizer_path, end_id), np.array(bounds, np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ids, place = batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts))
                at += len(texts)
                shard = np.searchsorted(cuts, pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False), side="left")
                kind = "<u2" if encoder.width == 2 else "<u4"
                packed = [squeeze.compress(x.astype(kind).tobytes()) for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, place, pa.array(packed, pa.binary())], ["shard", "doc_id", "place", "packed"])
        release_memory()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        spread = zstandard.ZstdDecompressor()
        now = writer = temporary = None

        def done() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            system.move(f"{root}/{temporary}", f"{root}/shard-{now:07d}.sst")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([f"{folder}/shard-{now:07d}.sst"]), pa.array([writer.entries], pa.int64()), pa.array([writer.tokens], pa.int64())], ["shard", "uri", "entries", "tokens"])

        try:
            for batch in batches:
                for shard, doc_id, place, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                    if shard != now:
                        if writer:
                            yield done()
                        now, temporary = shard, f".{uuid.uuid4().hex}.part"
                        writer = ShardWriter(system.open_output_stream(f"{root}/{temporary}"), width)
                    writer.add(encode_key(doc_id), struct.pack("<q", place) + spread.decompress(packed.as_py()))
            if writer:
                last, writer_done = done(), True
                writer = None
                yield last
        finally:
            if writer and not writer.out.closed:
                writer.out.close()

    packed = rows.mapInArrow(encode, "shard int, doc_id long, place long, packed binary")
    # a shard is a partition of its own
    dealt = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "packed")
    with small_batches(spark, 1500):
        return cut(dealt.mapInArrow(write, "shard int, uri string, entries long, tokens long"))


def read_shards(manifest: DataFrame, places: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards; start: ids of all before it, by key.

    places: with the column place, the document's place in the order of reading.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_SHARDS rows
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["place"] * places

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                for i in range(len(shard.blocks)):
                    rows = []
                    for key, value in shard.block(i):
                        ids = shard.ids(value)
                        rows.append((decode_key(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard.place(value)))
                        base += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[: len(names)]], names)

    spread = based.select("uri", "base").repartition(max(1, manifest.count()), "uri")
    return spread.mapInArrow(read, ", ".join(f"{n} long" for n in names))


def starts_by_place(read: DataFrame) -> DataFrame:
    """read_shards' rows of with_places' places with start as the ids of all documents before in the order of places.

    Running sums go file by file, over sums of files: of files there are few, and of a file's rows as many as one task wrote.
    """
    rows = read.withColumn("__file", F.floor(F.col("place") / F.lit(FILE_ROWS)).cast("long"))
    sums = rows.groupBy("__file").agg(F.sum("n_tokens").alias("__n"))
    before = sums.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("__file").orderBy("place")
    own = rows.withColumn("__own", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return own.join(F.broadcast(before), "__file").withColumn("start", F.col("__before") + F.col("__own")).drop("__file", "__before", "__own")
