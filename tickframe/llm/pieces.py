"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

The distinct units of a batch (runs of spaces with what follows them; no piece reaches over their ends) are joined to
one text. A suffix array over it, sorted as far as the longest piece, gives every piece's occurrences as a range found
by binary search. The occurrences are edges, kept in a table by place and length. Where no edge covers a border
between two characters nothing can join across it, so it cuts its unit into segments. Relaxing starts from single
characters and joins, in every segment at once, the pair whose union has the best score (the leftmost of equals), until
no union is a piece: that is the model's own order. A join renews the two pairs it touches and no others. Segments longer
than LONG take the same steps from a heap, so time grows no faster than n log n with a unit's length. Units are numbered
by Arrow, and the ids of all texts gathered by these numbers.

Characters that are no piece become their bytes' pieces, or the unknown piece where the model has none.
"""

from __future__ import annotations

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .token_blocks import text_batches

SPACE = "▁"
#: Characters of a batch's distinct units that one suffix array covers; a longer unit has one of its own.
INDEX_CHARS = 350_000
#: Characters of a segment from which on its pairs are kept in a heap.
LONG = 64


class PieceModel:
    """Pieces of a model file, and encoding and decoding with them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(sp))
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, -1, np.int64)
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
        normal = [(sp.id_to_piece(i), -sp.get_score(i), i) for i in ids if i not in special]
        for piece, _, _ in normal:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"units cannot be cut before spaces: piece {piece!r}")
        # Rank 0 has the best score; equal scores keep one rank, so that the leftmost wins among them.
        levels = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}))}
        alone = [(ord(p), i) for p, _, i in normal if len(p) == 1]
        self.singles = np.full(max((c for c, _ in alone), default=0) + 2, -1, np.int64)
        for c, i in alone:
            self.singles[c] = i
        # Row 0 is no piece; longer pieces have higher rows.
        longer = sorted((x for x in normal if len(x[0]) > 1), key=lambda x: (len(x[0]), x[0]))
        self.ids = np.array([-1, *(i for _, _, i in longer)], np.int64)
        self.ranks = np.array([len(levels), *(levels[s] for _, s, _ in longer)], np.int64)
        self.lengths = np.array([0, *(len(p) for p, _, _ in longer)], np.int64)
        self.longest = max(int(self.lengths.max()), 1)
        # Letters of these pieces count from 2 on, all other characters are 1, ends of units 0.
        letters = sorted(set("".join(p for p, _, _ in longer)))
        self.letters = np.ones(max(map(ord, letters), default=0) + 2, np.int64)
        self.letters[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.chars = np.zeros((len(self.ids), self.longest), np.int64)
        for row, (p, _, _) in enumerate(longer, 1):
            self.chars[row, : len(p)] = self.letters[[ord(c) for c in p]]
        # As many letters as fit a number, and each row's least number and the one after its greatest.
        self.bits = (len(letters) + 1).bit_length()
        self.reach = min(62 // self.bits, self.longest)
        self.low = np.zeros(len(self.ids), np.int64)
        for t in range(self.reach):
            self.low = self.low << self.bits | self.chars[:, t]
        self.high = self.low + (1 << self.bits * (self.reach - np.minimum(self.lengths, self.reach)))
        self.high[0] = self.low[0]
        self.raw = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.raw_array = pa.array(self.raw, pa.large_binary())

    # Encoding

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_all([t.encode("utf-8", "surrogatepass") for t in texts])
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all UTF-8 texts one after the other, and the place after each text's last one."""
        normal = [self.processor.normalize(t) if t else b"" for t in texts]
        data, ends = np.frombuffer(b"".join(normal), np.uint8), np.cumsum([len(t) for t in normal], dtype=np.int64)
        if not len(data):
            return np.zeros(0, "<u4"), ends
        cuts = _unit_borders(data, ends)
        units = _binary(cuts, data).dictionary_encode()
        each = _binary(*self._encode_units(units.dictionary)).take(units.indices)
        _, offsets, ids = each.buffers()
        found = np.frombuffer(offsets, np.int64)[: len(each) + 1]
        return np.frombuffer(ids, "<u4", found[-1] // 4), found[np.searchsorted(cuts, ends)] // 4

    def _encode_units(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units one after the other, and the bytes before each unit's ids."""
        _, offsets, data = units.buffers()
        borders = np.frombuffer(offsets, np.int64)[: len(units) + 1]
        data = np.frombuffer(data, np.uint8, borders[-1])
        text = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[borders]  # before each unit
        size = chars + np.arange(len(chars))
        ids, counts, first = [], [], 0
        while first < len(units):
            last = min(int(np.searchsorted(size, size[first] + INDEX_CHARS)), len(units))
            part, of_units = self._match(text[chars[first] : chars[last]], np.diff(chars[first : last + 1]))
            ids.append(part)
            counts.append(of_units)
            first = last
        return np.concatenate([[0], np.cumsum(np.concatenate(counts)) * 4]), np.concatenate(ids)

    def _match(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of these lengths, given as their characters one after the other, and how many each has."""
        ends = np.cumsum(lengths + 1) - 1  # a place after each unit stands between it and the next
        text = np.zeros(ends[-1] + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = chars
        code = self.letters[np.minimum(text, len(self.letters) - 1)]
        code[ends] = 0
        edges, far = self._edges(code, np.repeat(ends, lengths + 1))
        size = self._relax(edges, far)
        size[ends] = 0
        starts = np.nonzero(size)[0]
        size = size[starts]
        ids = self.ids[edges[starts * (self.longest + 1) + size]]
        alone = np.nonzero(size == 1)[0]
        ids[alone] = self.singles[np.minimum(text[starts[alone]], len(self.singles) - 1)]
        counts = np.searchsorted(starts, ends)
        odd = np.nonzero(ids < 0)[0]
        if len(odd):
            found, which = np.unique(text[starts[odd]], return_inverse=True)
            instead = [self._fallback(chr(c)) for c in found.tolist()]
            length = np.array([len(x) for x in instead])
            many = np.ones(len(ids), np.int64)
            many[odd] = length[which]
            before = np.concatenate([[0], np.cumsum(many)])
            ids = np.repeat(ids, many)
            ids[_ranges(before[odd], many[odd])] = np.concatenate(instead)[_ranges((np.cumsum(length) - length)[which], length[which])]
            counts = before[counts]
        return ids.astype("<u4"), np.diff(counts, prepend=0)

    def _fallback(self, char: str) -> list[int]:
        ids = [int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if min(ids) < 0 else ids

    def _edges(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece's row at place * (longest + 1) + length, 0 where none is, and the greatest length at each place."""
        suffixes, packed = self._suffixes(code, ends)
        low, high = np.searchsorted(packed, self.low), np.searchsorted(packed, self.high)
        padded = np.concatenate([code, np.zeros(self.longest, np.int64)])
        for t in range(self.reach, self.longest):
            live = np.nonzero((self.lengths > t) & (low < high))[0]
            if not len(live):
                break
            c = self.chars[live, t]
            low[live], high[live] = (self._bound(suffixes, padded, t, c + up, low[live], high[live]) for up in (0, 1))
        count = high - low
        places, lengths = suffixes[_ranges(low, count)], np.repeat(self.lengths, count)
        edges = np.zeros(len(code) * (self.longest + 1), np.min_scalar_type(len(self.ids)))
        edges[places * (self.longest + 1) + lengths] = np.repeat(np.arange(len(count)), count)
        far = np.ones(len(code), np.int64)
        far[places] = lengths  # the longest of a place comes last
        return edges, far

    def _suffixes(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of what follows them, as far as the longest piece or their unit's end, and the numbers of their first characters.

        Those that agree in as many characters as fit a number, all of their unit, are sorted by twice as many each time.
        """
        n, reach = len(code), self.reach
        padded = np.concatenate([code, np.zeros(reach, np.int64)])
        key = code
        for t in range(1, reach):
            key = key << self.bits | padded[t : t + n]
        suffixes = np.argsort(key)
        packed = key[suffixes]
        new = np.ones(n, bool)
        new[1:] = packed[1:] != packed[:-1]
        left = ends - np.arange(n)
        slots = np.arange(n)
        while reach < self.longest:
            same = ~new[slots]
            same[:-1] |= same[1:]
            slots = slots[same]
            slots = slots[left[suffixes[slots]] >= reach]  # whole groups: none of their characters is a unit's end
            if not len(slots):
                break
            order = np.zeros(n + reach, np.int64)
            order[suffixes] = np.cumsum(new)
            places = suffixes[slots]
            key = order[places] * (n + 1) + order[places + reach]
            by = np.argsort(key)
            suffixes[slots], key = places[by], key[by]
            new[slots[1:]] = key[1:] != key[:-1]
            reach *= 2
        return suffixes, packed

    @staticmethod
    def _bound(suffixes: np.ndarray, text: np.ndarray, t: int, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range of the suffix array, the first place whose t-th character is c or above."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.nonzero(low < high)[0]
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            less = text[suffixes[mid] + t] < c[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)

    def _relax(self, edges: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The length of the symbol at each place when no neighbours join to a piece any more; 0 inside symbols."""
        n = len(far)
        size, back = np.ones(n + 1, np.int64), np.ones(n + 1, np.int64)  # of the symbol here, of the one before
        places = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = np.maximum.accumulate(places + far)[:-1] <= places[1:]
        first = np.nonzero(new)[0]
        many = np.diff(np.append(first, n))
        for i in np.nonzero(many > LONG)[0].tolist():
            self._relax_long(int(first[i]), int(many[i]), edges, size)
        some = (many > 1) & (many <= LONG)
        first, many = first[some], many[some]
        # Rank of joining each symbol with the next one of its segment, then its place there: the least is the leftmost of the best.
        none = int(self.ranks[0]) * LONG
        at = _ranges(first, many)
        key = self._ranks(edges, at, 2) * LONG + at - np.repeat(first, many)
        while len(first):
            slot = np.cumsum(many) - many
            best = np.minimum.reduceat(key, slot)
            live = best < none
            if not live.all():
                key = key[np.repeat(live, many)]
                first, many, best = first[live], many[live], best[live]
                slot = np.cumsum(many) - many
            place = best % LONG
            left = first + place
            old = size[left]
            joined = old + size[left + old]
            size[left], size[left + old], back[left + joined] = joined, 0, joined
            key[slot + place + old] = none
            key[slot + place] = self._ranks(edges, left, joined + size[left + joined]) * LONG + place
            inner = np.nonzero(place)[0]
            left, place, joined, slot = left[inner], place[inner], joined[inner], slot[inner]
            old = back[left]
            key[slot + place - old] = self._ranks(edges, left - old, old + joined) * LONG + place - old
        return size[:n]

    def _ranks(self, edges: np.ndarray, places: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """The ranks of the pieces of these lengths at these places; where there is none, row 0's."""
        return self.ranks[edges[places * (self.longest + 1) + np.where(lengths <= self.longest, lengths, 0)]]

    def _relax_long(self, first: int, n: int, edges: np.ndarray, size: np.ndarray) -> None:
        """_relax for the n characters from first on, which are one segment: pairs in a heap by rank and place."""
        width = self.longest + 1
        own, ranks = memoryview(edges[first * width : (first + n) * width]), memoryview(self.ranks)
        gone, none = -2, -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self._ranks(edges, first + np.arange(n), 2)  # rank of joining a symbol with the next
        pair = np.where(pair < self.ranks[0], pair, none).tolist()
        heap = [r * n + p for p, r in enumerate(pair) if r >= 0]
        heapify(heap)

        def look(p: int, end: int) -> None:
            """Renew the pair of p, which would reach up to end."""
            row = own[p * width + end - p] if end - p < width else 0
            pair[p] = none
            if row:
                pair[p] = ranks[row]
                heappush(heap, ranks[row] * n + p)

        while heap:
            rank, p = divmod(heappop(heap), n)
            if pair[p] != rank:
                continue
            q = after[p]
            end = after[p] = after[q]
            pair[q] = gone
            if end < n:
                before[end] = p
                look(p, after[end])
            else:
                pair[p] = none
            if before[p] >= 0:
                look(before[p], end)
        starts = np.array([p for p, r in enumerate(pair) if r != gone], np.int64)
        size[first : first + n] = 0
        size[first + starts] = np.diff(np.append(starts, n))

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, space marks as spaces, bytes as UTF-8, without the space put before a text."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """As decode, in UTF-8, for many texts whose ids stand one after the other, with the place after each text's last one."""
        found = self.raw_array.take(pa.array(ids))
        _, offsets, data = found.buffers()
        borders = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends])].tolist()
        data = memoryview(data) if borders[-1] else b""
        return [bytes(data[a:b]).removeprefix(b" ") for a, b in zip(borders, borders[1:], strict=False)]


def _unit_borders(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units of UTF-8 texts with these ends begin, and the end: before runs of spaces, around line ends, and between texts."""
    one, two, three = SPACE.encode()
    spaces = np.nonzero(data[:-2] == one)[0]
    spaces = spaces[(data[spaces + 1] == two) & (data[spaces + 2] == three)]
    lines = np.nonzero(data == ord("\n"))[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[spaces[np.diff(spaces, prepend=-3) != 3]] = True
    begins[lines] = begins[lines + 1] = begins[ends] = begins[0] = True
    return np.nonzero(begins)[0]


def _binary(borders: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(data)])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs: doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), exact, ids.

    exact says whether decoding the ids gives the text back. Null texts count as empty and give no ids. Repeated rows
    give repeated rows; other columns are ignored. Texts of any length are encoded whole, with spaces or without, in time
    about in proportion. Nothing is shuffled, and nothing is kept from one batch to the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                texts = [t.encode("utf-8", "surrogatepass") for t in texts]
                ids, ends = pieces.encode_all(texts)
                borders = np.concatenate([[0], ends])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(borders.tolist(), ends.tolist(), strict=False)]
                exact = [back == t for back, t in zip(pieces.decode_all(ids, ends), texts, strict=True)]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, len(texts)), pa.array(np.diff(borders)), pa.array(crcs, pa.int64()), pa.array(exact, pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids.view(np.int32))),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "exact", "ids"],
                )

    return rows.mapInArrow(tidied(run), "doc_id long, n_ids long, ids_crc32 long, exact boolean, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""

    def run(batches):
        pieces = model(path)
        for batch in batches:
            texts = [None if not x.is_valid else pieces.decode(np.array(x.as_py(), np.int64)) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, text string")
