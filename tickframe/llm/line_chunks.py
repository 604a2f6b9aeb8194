"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last WINDOW lines ends a chunk wherever it is divisible by DIVISOR, and nothing else
does, so inserted or removed lines move no boundary beyond their neighbours. A chunk of several lines that occurs more
than once in the corpus stays at its first place (smallest doc_id, then the text's hash, then the place in the text) and
goes everywhere else.

Chunks see a passage only where a boundary falls right, so whole_dedup also compares line runs: from each line on, and up
to each line, the shortest run of RUN_WORDS words. A repeated passage of so many words is the union of such runs, whatever
its neighbours are. A text of several lines and fewer words is one run, so later copies of a text leave no fragments but of
single lines.

Hashes of all chunks and runs are counted first. Only bodies whose hash repeats are read again and compared byte by byte:
they meet by hash and body, once per task, and where two bodies share a hash, each body counts alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, fresh, join_counted, release, settle, tidied

WINDOW = 2
DIVISOR = 3
#: A repeated run of lines with so many words goes whole.
RUN_WORDS = 50
#: Chunks and runs handed over at once by a Python worker, and bytes of bodies.
ROWS, BYTES = 20_000, 4 << 20
#: Repeated hashes that are broadcast to the second reading; more of them meet the bodies by a shuffle.
SENT_HASHES = 500_000
MASK, FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: Letters of scripts that put no space between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Words and what may end them: then words of letters and digits are those between white space.
PLAIN_ASCII = re.compile("(?:[A-Za-z0-9]+[.,;:!?]*(?:[ \t]+|$))*+").fullmatch
#: So many of them count as a word.
UNSPACED_A_WORD = 2


def n_words(line: str) -> int:
    """Words between white space, or of letters and digits, or by the length in characters where the script has no spaces: the most of these."""
    n = len(line.split())
    if line.isascii():
        return n if PLAIN_ASCII(line) else max(n, len(line.encode().translate(WORD_BYTES).split()))
    return max(n, len(line.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()), len(UNSPACED.findall(line)) // UNSPACED_A_WORD)


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, in order; they cover all lines."""
    out: list[tuple[int, int]] = []
    start, rolled, hashes = 0, 0, [0] * WINDOW
    leaves = pow(FACTOR, WINDOW, 1 << 64)
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (rolled * FACTOR + h - hashes[i % WINDOW] * leaves) & MASK
        hashes[i % WINDOW] = h
        if (rolled >> 32) % DIVISOR == 0:
            out.append((start, i + 1))
            start = i + 1
    return out + [(start, len(lines))] if start < len(lines) else out


def line_runs(words: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each run of RUN_WORDS words that has fewer without its first or without its last line.

    words: the number of words of each line. Runs begin and end with lines that have words. Whether a run counts depends
    on its own lines only, so it counts at each of its places; any passage of RUN_WORDS words is covered by the runs in
    it, but for lines without words at its ends. A text of several lines that is shorter than that is one run.
    """
    at = [(i, n) for i, n in enumerate(words) if n]
    out = set()
    last, total = 0, 0
    for first, (i, n) in enumerate(at):  # the shortest run from each line on
        while last < len(at) and total < RUN_WORDS:
            total += at[last][1]
            last += 1
        if total < RUN_WORDS:
            break
        out.add((i, at[last - 1][0] + 1))
        total -= n
    first, total = 0, 0
    for i, n in at:  # the shortest run up to each line
        total += n
        while total - at[first][1] >= RUN_WORDS:
            total -= at[first][1]
            first += 1
        if total >= RUN_WORDS:
            out.add((at[first][0], i + 1))
    if len(at) > 1 and not out:
        out.add((at[0][0], at[-1][0] + 1))  # a whole text of several short lines, however its chunks fall
    return sorted(out)


def body_hash(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def candidates(text: str | None, runs: bool, hashed: Callable[[bytes], bytes] = body_hash) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first line, line after the last, hash, body) of what may go from a text: its chunks of several lines with a word, and its runs."""
    lines = (text or "").split("\n")
    words = [n_words(x) for x in lines]
    found = {(a, b) for a, b in chunk_lines(lines) if b - a > 1 and any(words[a:b])}
    if runs:
        found.update(line_runs(words))
    if found:
        data = (text or "").encode("utf-8", "surrogatepass")
        starts, at = [0], -1
        while (at := data.find(b"\n", at + 1)) >= 0:
            starts.append(at + 1)
        starts.append(len(data) + 1)
        for a, b in sorted(found):
            body = data[starts[a] : starts[b] - 1]
            yield a, b, hashed(body), body


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.col("text").cast("string").alias("text"))


def _parts(docs: DataFrame, runs: bool, bodies: bool, hashed: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, own (hash of the text), a, b and hash of every candidate, and its body if wanted."""
    names = ["doc_id", "own", "a", "b", "hash", *(("body",) if bodies else ())]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()][: len(names)]

    def emit(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for doc, own, text in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), batch.column("text"), strict=True):
                for row in candidates(text.as_py(), runs, hashed):
                    size += len(row[-1]) if bodies else 0
                    for c, v in zip(cols, (doc, own, *row), strict=False):
                        c.append(v)
                if len(cols[0]) >= ROWS or size >= BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                    cols, size = [[] for _ in names], 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return _keyed(docs).mapInArrow(tidied(emit), "doc_id long, own long, a int, b int, hash binary" + (", body binary" if bodies else ""))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own", "a")


def _goes(found: DataFrame) -> DataFrame:
    """The ranges that go, of places that have their first place beside them. A run that overlaps its own first place takes out only what is after that."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
    after = F.when(same, F.greatest("a", F.col("first.a") + F.col("b") - F.col("a"))).otherwise(F.col("a"))
    return found.filter(~_place().eqNullSafe(F.col("first"))).select("doc_id", "own", after.alias("a"), "b").filter("a < b")


def repeated_lines(docs: DataFrame, runs: bool, hashed: Callable[[bytes], bytes] = body_hash) -> DataFrame:
    """doc_id, own (hash of the text) and drop: the ranges of lines that go (a, and b after the last), for the texts that lose any. Evaluated once."""
    parts = settle(_parts(docs, runs, False, hashed))
    # Map-side sums keep a chunk that a third of all texts hold to a row per task.
    classes = settle(parts.groupBy("hash").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1"))
    hashes = classes.select("hash")
    again = _parts(docs, runs, True, hashed).join(F.broadcast(hashes) if classes.count() <= SENT_HASHES else hashes, "hash", "left_semi")
    # Grouping by the body compares the bytes.
    clash = settle(again.groupBy("hash", "body").count().groupBy("hash").agg(F.count("*").alias("bodies")).filter("bodies > 1").select("hash"))
    some = not clash.isEmpty()
    clean = classes.join(clash, "hash", "left_anti") if some else classes
    goes = _goes(join_counted(parts, clean, "hash", "n", parts.count()))
    if some:  # two bodies of one hash: each is a class of its own
        apart = settle(_parts(docs, runs, True, hashed).join(clash, "hash", "left_semi"))
        own = apart.groupBy("hash", "body").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1")
        goes = goes.unionByName(_goes(apart.join(own, ["hash", "body"])))
    told = settle(goes.groupBy("doc_id", "own").agg(F.collect_set(F.struct("a", "b")).alias("drop")))
    for done in (parts, classes):
        release(done)
    return told


def without_lines(text: str | None, drop: list[dict[str, int]] | None) -> str | None:
    if text is None or not drop:
        return text
    lines, kept, at = text.split("\n"), [], 0
    for a, b in sorted((x["a"], x["b"]) for x in drop):
        kept += lines[at:a]
        at = max(at, b)
    return "\n".join(kept + lines[at:])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of text; all rows and columns stay, and a text may become empty.

    Null and empty texts stay as they are. Rows that repeat both doc_id and text are treated alike: what stays in one
    stays in all of them. Null ids come last in the order of places.
    """
    return _without(docs, repeated_lines(docs, runs=False))


def whole_dedup(docs: DataFrame) -> DataFrame:
    """dedup_lines, and repeated line runs of RUN_WORDS words or more go too, whatever stands around them.

    Of all places of a run the first stays. Every line that goes has an equal line at an earlier place, so none is lost.
    """
    return _without(docs, repeated_lines(docs, runs=True))


def _without(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    names, goes = docs.columns, repeated
    at = [n.lower() for n in names].index("text")
    # The whole row travels as one struct, so no column of docs can clash with what is added.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    keyed = goes.select(F.col("doc_id").alias("of"), F.col("own").alias("of_own"), "drop")
    joined = rows.join(keyed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own")), "left")
    flat = joined.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("drop").alias(fresh(names)))

    def take_out(batches):
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)
            if drops.null_count < len(drops):
                texts = pa.array([without_lines(t.as_py(), d.as_py()) if d.is_valid else t.as_py() for t, d in zip(batch.column(at), drops, strict=True)], batch.schema.field(at).type)
                batch = batch.set_column(at, batch.schema.field(at), texts)
            yield batch.select(range(len(names)))

    return flat.mapInArrow(tidied(take_out), docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_lines and n_kept (lines before and after), n_chars and kept_chars, kept_sha256 of the text that stays.

    Null and empty texts have one empty line, of which none is kept. Repeated rows give repeated results; other columns are ignored.
    """
    rows = whole_dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("text").cast("string").alias("before")).select("doc_id", "text", F.size(F.split(F.coalesce("before", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.length(F.coalesce("before", F.lit(""))).cast("long").alias("n_chars")))
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    return rows.select("doc_id", "n_lines", kept.alias("n_kept"), "n_chars", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
