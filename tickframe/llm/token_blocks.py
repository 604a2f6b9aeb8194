"""Token ids in patched frame-of-reference blocks.

Whole texts are encoded with a public tokenizer, an end id is appended to each, and the ids of all documents, in
ascending document order, are written as Parquet rows that hold packed blocks. The table can be read back by document
or by position.

A row of the table is a run of whole documents of one shard: ``shard, seq, first`` (ids of the shard before this row),
``n_ids, doc_ids, doc_lens`` and ``blocks``. Shards are ranges of doc_id; shard s holds smaller ids than shard s + 1.

Layout of ``blocks`` (little endian): u32 number of ids, u32 number of blocks b, then u32[b + 1] byte start of each
block in the packed area, u32[b] minimum, u8[b] width, u16[b] number of exceptions, the packed area, u8[e] exception
positions, u32[e] exception values. A block is 128 ids less their minimum, packed at the width that fits the chosen
percentile of them; the rest keep their low bits in place and their whole value in the exception list.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions

BLOCK = 128
PERCENTILE = 0.9
ROW_IDS = 65_536
#: Pieces of text that are not plain words, and plain lower-case words, that a Python worker keeps between batches; a cache is emptied beyond that.
CACHE_PIECES = 500_000
CACHE_WORDS = 900_000
#: Documents of a shard, about.
SHARD_DOCS = 200_000
#: Plain letters, each with one lower-case form, and the stops that may follow a word of them.
LETTERS = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
STOPS = ".,;:!?"
NOT_SPACE = re.compile("[^ \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall

TABLE_SCHEMA = "shard int, seq int, first long, n_ids int, doc_ids array<bigint>, doc_lens array<int>, blocks binary"


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Ids (unsigned 32 bit) as patched frame-of-reference blocks."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n, b = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.array([0, 0, 0], "<u4").tobytes()
    values = np.concatenate([ids, np.full(b * BLOCK - n, ids[-1], "<u4")]).reshape(b, BLOCK)
    least = values.min(axis=1)
    values = values - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    common = np.partition(values, at, axis=1)[:, at]
    width = np.ceil(np.log2(common.astype(np.float64) + 1)).astype(np.int64)
    beyond = (values.astype(np.uint64) >> width.astype(np.uint64)[:, None]) != 0
    rows, places = np.nonzero(beyond)
    starts = np.zeros(b + 1, "<u4")
    np.cumsum(width * (BLOCK // 8), out=starts[1:])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            size = 2 if w <= 16 else 4
            own = values[which].astype(f"<u{size}").view(np.uint8)
            if w < 8 * size:
                bits = np.unpackbits(own.reshape(len(which), BLOCK, size), axis=2, bitorder="little")[:, :, : int(w)]
                data = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
            else:
                data = own
            packed[starts[which].astype(np.int64)[:, None] + np.arange(data.shape[1])] = data
    return b"".join(
        (
            np.array([n, b], "<u4").tobytes(), starts.tobytes(), least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(),
            beyond.sum(axis=1).astype("<u2").tobytes(), packed.tobytes(), places.astype(np.uint8).tobytes(), values[rows, places].astype("<u4").tobytes(),
        )
    )


def unpack(data: bytes) -> np.ndarray:
    """The ids of packed blocks."""
    n, b = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if not n:
        return np.zeros(0, "<u4")
    at = 8
    starts = np.frombuffer(data, "<u4", b + 1, at).astype(np.int64)
    least = np.frombuffer(data, "<u4", b, at := at + 4 * (b + 1))
    width = np.frombuffer(data, np.uint8, b, at := at + 4 * b)
    count = np.frombuffer(data, "<u2", b, at := at + b)
    packed = np.frombuffer(data, np.uint8, int(starts[-1]), at := at + 2 * b)
    total = int(count.sum())
    places = np.frombuffer(data, np.uint8, total, at := at + len(packed))
    patches = np.frombuffer(data, "<u4", total, at + total)
    values = np.zeros((b, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            raw = packed[starts[which][:, None] + np.arange(int(w) * BLOCK // 8)]
            size = 2 if w <= 16 else 4
            if w < 8 * size:
                bits = np.zeros((len(which), BLOCK, 8 * size), np.uint8)
                bits[:, :, : int(w)] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
                raw = np.packbits(bits, axis=2, bitorder="little")
            values[which] = np.ascontiguousarray(raw).reshape(len(which), -1).view(f"<u{size}")
    values[np.repeat(np.arange(b), count), places] = patches
    return (values + least[:, None]).reshape(-1)[:n]


# The normalizer and the pre-tokenizer under which the ids of a text are those of its pieces between white space.
CUT_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each start and size, one after another."""
    at = np.arange(int(sizes.sum()))
    at += np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return values[at]


class WordEncoder:
    """Encodes whole texts with a tokenizer file whose pre-tokenizer drops white space and never joins text across it.

    A text's ids are then those of its white-space-separated pieces, one after another. Arrow numbers the distinct pieces
    of a batch; a plain word is encoded once per worker while the cache holds it, apart from the stops after it. Words of
    plain letters are encoded many to a call and told apart by the vocabulary's word-end suffix. A batch's ids are then
    gathered by these numbers. A file with any other normalizer or pre-tokenizer than CUT_AT_SPACE is
    recognised when it is loaded, and whole texts are given to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.marks = {t["content"][:2] for t in told["added_tokens"]} | {t["content"][:2].upper() for t in told["added_tokens"]}
        added = [t for t in told["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] or any(c.isspace() for c in t["content"])]
        plain = not told["model"].get("dropout") and not added and told["truncation"] is None and told["padding"] is None
        self.whole = not plain or {k: told[k] for k in CUT_AT_SPACE} != CUT_AT_SPACE
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_cores(self, cores: list[str]) -> list[bytes]:
        """The ids of words of plain lower-case letters."""
        if not self.ends.any():
            return self._encode(cores)
        found: list[bytes] = []
        for at in range(0, len(cores), 20_000):
            part = cores[at : at + 20_000]
            lines = [part[k : k + 200] for k in range(0, len(part), 200)]
            for line, enc in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, "<u4")
                cuts = (np.nonzero(self.ends[ids])[0] + 1).tolist()
                if len(cuts) == len(line):
                    raw = ids.tobytes()
                    found += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
                else:
                    found += self._encode(line)
        return found

    def _spaced(self, text: str) -> str:
        """The text with ASCII white space alone, and in lower case as the normalizer makes it, where that is certain: Latin-1 without the mark of added tokens, which count as they stand."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return " ".join(NOT_SPACE(text))
        if not any(t in text for t in self.marks):
            text = text.lower()
        return " ".join(NOT_SPACE(text)) if "\x85" in text or "\xa0" in text else text

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another, and how many each has: letters and a closing run of stops are separate words to the pre-tokenizer."""
        for cache, most in ((self.known, CACHE_PIECES), (self.cores, CACHE_WORDS), (self.tails, CACHE_WORDS)):
            if len(cache) > most:
                cache.clear()
        core = pc.ascii_rtrim(pieces, characters=STOPS)
        plain = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        words = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        ends = pc.utf8_ltrim(pieces.filter(plain), characters=LETTERS).dictionary_encode()
        low, tail, rest = (x.to_numpy(zero_copy_only=False).tolist() for x in (words.dictionary, ends.dictionary, pieces.filter(pc.invert(plain))))
        parts: list[bytes] = []
        for cache, own, learn in ((self.cores, low, self._learn_cores), (self.tails, tail, self._encode), (self.known, rest, self._encode)):
            found = list(map(cache.get, own))
            new = [at for at, x in enumerate(found) if x is None]
            told = learn([own[at] for at in new])
            for at, x in zip(new, told, strict=True):
                found[at] = cache[own[at]] = x
            parts += found
        parts.append(b"")
        # Each piece is two parts: its letters and its stops, or all of it and nothing.
        is_plain = plain.to_numpy(zero_copy_only=False)
        pair = np.full((len(pieces), 2), len(parts) - 1)
        pair[is_plain, 0] = words.indices.to_numpy()
        pair[is_plain, 1] = ends.indices.to_numpy() + len(low)
        pair[~is_plain, 0] = np.arange(len(rest)) + len(low) + len(tail)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        return ragged(np.frombuffer(b"".join(parts), "<u4"), start[pair.reshape(-1)], size[pair.reshape(-1)]), size[pair].sum(axis=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.whole:
            return self._encode(texts)
        split = pc.ascii_split_whitespace(pa.array(map(self._spaced, texts), pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids, size = self._ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        start = np.cumsum(size) - size
        size = size[which]
        found = ragged(ids, start[which], size)
        cuts = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy()].tolist()
        return [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_batches(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch with about that many characters of text, as (first row, texts); null texts are empty."""
    texts, first, size = [], 0, 0
    for at, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield first, texts
            texts, first, size = [], at + 1, 0
    if texts:
        yield first, texts


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents to a block table at path.

    Null texts are empty and give the end id alone. Null ids come last; rows that share an id stand next to each other,
    ordered by a hash of their token ids, then by these. Rows of one id, or of none, may so take several shards if they
    are many. Other columns are ignored; an empty input gives an empty table; texts may have any length.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Range bounds from the ids alone: the texts are read once, and encoded before the shuffle.
    n, n_ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    shards = max(shuffle_partitions(spark), -(-n // SHARD_DOCS))
    of_none = -(-shards * (n - n_ids) // n) if n > n_ids else 0
    first_none = max(1, shards - of_none)
    shards = first_none + of_none
    places = [i / first_none for i in range(1, first_none)]
    bounds = np.array(docs.agg(F.percentile_approx("doc_id", places, max(10_000, 4 * first_none))).first()[0] if places and n_ids else [], np.int64)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                ids = batch.column("doc_id").slice(first, len(texts))
                rows = [x + end for x in enc.encode(texts)]
                mixed = np.fromiter((xxhash.xxh3_64_intdigest(x) >> 33 for x in rows), np.int64, len(rows))
                # An id that bounds repeat is spread over the shards they part, in the order of the hash.
                known = ids.fill_null(0).to_numpy()
                low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
                shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), first_none + (mixed * of_none >> 31), low + (mixed * (high - low + 1) >> 31))
                narrow = [np.frombuffer(x, "<u4") for x in rows]
                narrow = [x.astype("<u2") if len(x) and x.max() < 65_536 else x for x in narrow]
                yield pa.record_batch(
                    [
                        pa.array(shard.astype(np.int32)), ids, pa.array(mixed), pa.array([len(x) // 4 for x in rows], pa.int32()),
                        pa.array([x.tobytes() for x in narrow], pa.binary()),
                    ],
                    ["shard", "doc_id", "mixed", "n", "ids"],
                )

    def lay(batches):
        held: list[np.ndarray] = []
        doc_ids: list = []
        shard, seq, first, size = None, 0, 0, 0

        def row():
            ids = np.concatenate(held)
            lens = [len(x) for x in held]
            return pa.record_batch(
                [pa.array([v], f.type) for v, f in zip([shard, seq, first, len(ids), doc_ids, lens, pack(ids)], ROW, strict=True)], [f.name for f in ROW]
            )

        for batch in batches:
            for s, doc, n, data in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n", "ids")), strict=True):
                if held and (s != shard or size + n > ROW_IDS):
                    yield row()
                    seq, first = seq + 1, first + size
                    held, doc_ids, size = [], [], 0
                if s != shard:
                    shard, seq, first = s, 0, 0
                held.append(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4"))
                doc_ids.append(doc)
                size += n
        if held:
            yield row()

    ROW = pa.schema(
        [("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("blocks", pa.binary())]
    )
    encoded = docs.mapInArrow(encode, "shard int, doc_id long, mixed long, n int, ids binary")
    laid = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "mixed", "ids")
    laid.mapInArrow(lay, TABLE_SCHEMA).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a block table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, first_block (its first block's number in the row)."""
    rows = spark.read.schema(TABLE_SCHEMA).parquet(path)
    # One total per shard; there are as many shards as shuffle partitions when the table was written.
    totals = sorted((r.shard, r.total) for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("total")).collect())
    bases, before = {}, 0
    for shard, total in totals:
        bases[shard], before = before, before + total

    def crc(batches):
        for batch in batches:
            for shard, first, doc_ids, lens, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "doc_ids", "doc_lens", "blocks")), strict=True):
                ids = unpack(data).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
                raw = memoryview(ids.tobytes())
                yield pa.record_batch(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(cuts[:-1] + first + bases[shard], pa.int64()), pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()), pa.array(cuts[:-1] // BLOCK, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "first_block"],
                )

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long, first_block long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a block table with their ids: doc_id, ids array<long>."""

    def decode(batches):
        for batch in batches:
            for doc_ids, lens, data in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "doc_lens", "blocks")), strict=True):
                ids = unpack(data).astype(np.int64)
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return spark.read.schema(TABLE_SCHEMA).parquet(path).mapInArrow(decode, "doc_id long, ids array<bigint>")


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write docs as token blocks (to path, or to the shared folder) and return what the table says of each document."""
    path = path or new_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, tokenizer, end_id)
    return read_token_blocks(docs.sparkSession, path)
