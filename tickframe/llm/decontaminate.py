"""Benchmark decontamination by a prefix-filtered set join.

A window of a benchmark item is matched where a document holds all its words in order. Since containment must be
complete, a window's necessary prefix is one token: its rarest word, by a count over the whole corpus. Documents are
probed at the places of such words only; a place must leave room for the words before and after it (position) within
the document (length), and the words there are then compared with the window's.

A benchmark of up to SENT_CHARS characters is sent to the executors as an index, and no text is moved. A larger one is
joined: documents give the places of prefix words with the words around them, and these meet the windows by that word.
Either way the corpus is read a fixed number of times, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidied, words_of

WINDOW = 10
#: Characters of a benchmark that is sent as an index.
SENT_CHARS = 2_000_000
#: Bits that tell which words to look at when the benchmark is joined: 512 kB whatever its size; a word that is taken by mistake costs a row.
WORD_BITS = 22
#: Parts that the windows of one word are dealt over, and words counted before a Python worker hands counts on.
SALT, COUNTED = 16, 500_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows_of(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def _plain(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")


def _is_small(benchmark: DataFrame, sent_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) <= sent_chars


def _windows(benchmark: DataFrame, window: int) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of a small benchmark with the items they are of."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for w in windows_of(row.text, window):
            found[w].add(row.item_id)
    return found


def _rarity(docs: DataFrame, vocabulary: frozenset[bytes]) -> Counter:
    """In how many documents each word of the vocabulary occurs, over the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(sent.value.intersection(words_of(text.as_py())))
        yield pa.record_batch([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({bytes(r.word): r.n for r in rows})


def _index(windows: dict[tuple[bytes, ...], set[str]], rarity: Counter) -> dict:
    """Rarest word -> (place in the window, length) -> joined words -> items."""
    index: dict = defaultdict(lambda: defaultdict(dict))
    for words, items in windows.items():
        rare = min(words, key=lambda w: (rarity[w], w))
        index[rare][words.index(rare), len(words)][b" ".join(words)] = tuple(items)
    return {w: [(at, n, found) for (at, n), found in x.items()] for w, x in index.items()}


def probe(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, end) of every occurrence of an indexed window, and the items these are of."""
    spans, items, total = [], set(), len(words)
    for place, word in enumerate(words):
        if word in index:
            for at, n, found in index[word]:
                start = place - at
                if start >= 0 and start + n <= total and (who := found.get(b" ".join(words[start : start + n]))):
                    spans.append((start, start + n))
                    items.update(who)
    return spans, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, sent_chars: int = SENT_CHARS) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean. Benchmark rows without an item_id or without words are ignored;
    rows that repeat an item_id add their windows to that item. Repeated documents give repeated rows. Columns of docs
    other than doc_id and text are ignored. Texts of any length are read whole. An empty benchmark leaves every document
    clean.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = _plain(benchmark)
    if not _is_small(benchmark, sent_chars):
        return _told_by_join(docs, _hits_by_join(docs, benchmark, window))
    windows = _windows(benchmark, window)
    sent = docs.sparkSession.sparkContext.broadcast(_index(windows, _rarity(docs, frozenset(w for x in windows for w in x)) if windows else Counter()))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                spans, items = probe(words, sent.value)
                hit = np.zeros(len(words) + 1, np.int64)
                if spans:
                    both = np.array(spans)
                    np.add.at(hit, both[:, 0], 1)
                    np.add.at(hit, both[:, 1], -1)
                n = int((np.cumsum(hit) > 0).sum())
                out.append((doc, len(words), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], RESULT.replace(",", "").split()[::2])

    return docs.mapInArrow(tidied(run), RESULT)


def _bit(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - WORD_BITS)


def _bitmap(words: DataFrame):
    """A broadcast of the bits of the words in column word: bytes, one bit per value that _bit can take."""

    def bits(batches):
        seen: set[int] = set()  # 2 ** WORD_BITS values at most
        for batch in batches:
            seen.update(_bit(w.encode()) for w in batch.column("word").to_pylist())
        yield pa.record_batch([pa.array(sorted(seen), pa.int64())], ["bit"])

    found = words.select("word").mapInArrow(tidied(bits), "bit long").distinct().toArrow().column("bit").to_numpy()
    flags = np.zeros(1 << WORD_BITS, bool)
    flags[found] = True
    return words.sparkSession.sparkContext.broadcast(np.packbits(flags, bitorder="little").tobytes())


def _hits_by_join(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, own (hash of the text), start, n, item_id of every occurrence of a window, for a benchmark of any size."""

    def cut(batches):
        for batch in batches:
            rows = [(item, [x.decode() for x in w]) for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True) for w in sorted(windows_of(text.as_py(), window))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["item_id", "words"])

    items = settle(benchmark.mapInArrow(tidied(cut), "item_id string, words array<string>").distinct())
    windows = settle(items.select("words").distinct())
    each = windows.select("words", F.posexplode("words").alias("at", "word"))
    wanted = _bitmap(each)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(w for w in set(words_of(text.as_py())) if (b := _bit(w)) >= 0 and wanted.value[b >> 3] >> (b & 7) & 1)
                if len(total) > COUNTED:
                    yield pa.record_batch([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                    total.clear()
        yield pa.record_batch([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rarity = docs.select("text").mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    salted = rarity.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a common word of many windows is met in parts
    ranked = each.withColumn("salt", F.expr(f"pmod(xxhash64(words), {SALT})").cast("int")).join(salted, ["word", "salt"], "left")
    prefix = settle(ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rare")).select("words", "rare.word", "rare.at"))
    sent = _bitmap(prefix)

    def places(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                for place, w in enumerate(words):
                    b = _bit(w)
                    if sent.value[b >> 3] >> (b & 7) & 1:
                        out.append((doc, own, place, w.decode(), [x.decode() for x in words[max(0, place - window + 1) : place]], [x.decode() for x in words[place : place + window]]))
                if len(out) > 20_000:
                    yield told(out)
                    out = []
            yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], ["doc_id", "own", "place", "word", "left", "right"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    probed = keyed.mapInArrow(tidied(places), "doc_id long, own long, place int, word string, left array<string>, right array<string>")
    probed = probed.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, place), {SALT})").cast("int"))
    spread = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = probed.join(spread, ["word", "salt"]).filter((F.size("left") >= F.col("at")) & (F.size("right") >= F.size("words") - F.col("at")))  # position and length
    same = F.concat(F.slice("left", F.size("left") - F.col("at") + 1, F.col("at")), F.slice("right", 1, F.size("words") - F.col("at"))) == F.col("words")
    found = met.filter(same).select("doc_id", "own", (F.col("place") - F.col("at")).alias("start"), F.size("words").alias("n"), "words").distinct()
    return settle(found.join(items, "words").select("doc_id", "own", "start", "n", "item_id"))


def _told_by_join(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """contamination's rows from the occurrences, which are reduced per document before they meet it."""
    spans = hits.groupBy("doc_id", "own").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    reduced = spans.select(F.col("doc_id").alias("of"), F.col("own").alias("of_own"), hit.cast("long").alias("n_hit"), "items")

    def count(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("own"), pa.array([len(words_of(t.as_py())) for t in batch.column("text")], pa.int64())], ["doc_id", "own", "n_words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("own"), "text").mapInArrow(tidied(count), "doc_id long, own long, n_words long")
    joined = rows.join(reduced, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, sent_chars: int = SENT_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns stay, and rows are treated as in contamination().

    With a benchmark that is sent, texts are probed and filtered in place, without a shuffle.
    """
    benchmark, names, schema = _plain(benchmark), docs.columns, docs.schema
    at = [n.lower() for n in names].index("text")
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _is_small(benchmark, sent_chars):
        goes = _hits_by_join(corpus, benchmark, window).select(F.col("doc_id").alias("__of"), F.col("own").alias("__own")).distinct()
        own = F.xxhash64(docs[names[at]].cast("string"))
        return docs.join(goes, docs["doc_id"].cast("long").eqNullSafe(goes["__of"]) & (own == goes["__own"]), "left_anti")
    windows = _windows(benchmark, window)
    if not windows:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(_index(windows, _rarity(corpus, frozenset(w for x in windows for w in x))))

    def keep(batches):
        for batch in batches:
            clean = [not probe(words_of(t.as_py()), sent.value)[0] for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidied(keep), schema)
