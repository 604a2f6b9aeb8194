"""URL filters: a list of host and path rules, and association rules that Spark's FP-growth mines from labelled URLs.

A URL becomes a set of tokens (scheme, every host label, registered domain, first path part, extension, every query
key). FP-growth over the tokens and the label of labelled URLs gives rules {tokens} -> label. Rules below the least
support, count or confidence go, so do rules that luck could have made, and rules with a part of their tokens that does
as well. The rest decide by an inverted index: a rule fits when all its tokens were met.

Tokens that stand in exactly the same labelled URLs are one item to FP-growth, and any of them counts as it in a match:
what always comes together would else give every subset of itself as a rule. Tokens rarer than the least support cannot
be in a rule and are left out before mining.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The list, as verdict and host with path.
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT = 0.0005
#: Labelled URLs that hold a rule's tokens and its label, at least.
MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
#: Chance that any of the rules tested passes although its tokens say nothing about the label.
ALPHA = 0.01
#: Rules that are collected and broadcast; more of them are matched by a join.
SENT_RULES = 200_000
BLOCK, ALLOW = "=block", "=allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = re.split("[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def tokens_of(url: str | None) -> list[str]:
    """The tokens of a URL, sorted; null and what has no ``://`` give none."""
    host, path = split_url(url)
    if not host and not path:
        return []
    labels = [x for x in host.split(":")[0].split(".") if x]
    out = {f"scheme {url[: url.find('://')].lower()}"} | {f"label {x}" for x in labels}
    if len(labels) > 1:
        out.add(f"domain {'.'.join(labels[-2:])}")
    parts = [x for x in path.split("/") if x]
    if parts:
        out.add(f"top {parts[0]}")
        name, dot, end = parts[-1].rpartition(".")
        if dot and name and end:
            out.add(f"ends {end}")
    query = url.partition("#")[0].partition("?")[2]
    out |= {f"key {x.partition('=')[0]}" for x in query.split("&") if x}
    return sorted(out)


@dataclass(frozen=True)
class Rules:
    """(tokens, blocks, confidence) with an inverted index from tokens to rules. of: the item that a token counts as."""

    rules: tuple[tuple[frozenset[str], bool, float], ...]
    of: dict[str, str] = field(default_factory=dict)

    def items(self, tokens: list[str]) -> set[str]:
        return {self.of.get(t, t) for t in tokens}

    def index(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = defaultdict(list)
        for i, (tokens, _, _) in enumerate(self.rules):
            for t in tokens:
                found[t].append(i)
        return dict(found)

    def matcher(self):
        """A function from tokens to (verdict, confidence): of the fitting rules the surest decides, then the longer, then block; none: allow."""
        index = self.index()
        need = [len(r[0]) for r in self.rules]

        def match(tokens: list[str]) -> tuple[str, float | None]:
            met: dict[int, int] = defaultdict(int)
            for t in self.items(tokens):
                for i in index.get(t, ()):
                    met[i] += 1
            best = max(((self.rules[i][2], need[i], self.rules[i][1]) for i, n in met.items() if n == need[i]), default=None)
            return ("block" if best and best[2] else "allow"), best[0] if best else None

        return match


def pruned(rules: list[tuple[frozenset[str], bool, float]]) -> list[tuple[frozenset[str], bool, float]]:
    """The rules without those of which a part of the tokens gives the same label at least as surely."""
    kept: list[tuple[frozenset[str], bool, float]] = []
    index: dict[str, list[int]] = defaultdict(list)
    for tokens, blocks, confidence in sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
        met: dict[int, int] = defaultdict(int)
        for t in tokens:
            for i in index[t]:
                met[i] += 1
        if any(n == len(kept[i][0]) and kept[i][1] == blocks and kept[i][2] >= confidence for i, n in met.items()):
            continue
        for t in tokens:
            index[t].append(len(kept))
        kept.append((tokens, blocks, confidence))
    return kept


def labelled_tokens(labelled: DataFrame) -> DataFrame:
    """items: the distinct tokens of each labelled URL, with its label. labelled: url, block (boolean; null rows are ignored)."""

    def run(batches):
        for batch in batches:
            items = [t + [BLOCK if b else ALLOW] for u, b in zip(batch.column("url").to_pylist(), batch.column("block").to_pylist(), strict=True) if (t := tokens_of(u))]
            yield pa.record_batch([pa.array(items, pa.list_(pa.string()))], ["items"])

    return labelled.select(F.col("url").cast("string"), F.col("block").cast("boolean")).filter("url is not null and block is not null").mapInArrow(run, "items array<string>")


def _items(labelled: DataFrame, least: int) -> tuple[DataFrame, dict[str, str]]:
    """items of each labelled URL, without the tokens of fewer than `least` of them, and the item that each token counts as.

    A token that counts is in `least` URLs or more, so there are at most (tokens of an average URL) * total / least of them.
    """
    each = labelled.select("uid", F.explode("items").alias("token"))
    where = F.xxhash64("uid"), F.xxhash64("uid", F.lit(1))
    common = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(where[0]).alias("x"), F.bit_xor(where[1]).alias("y")).filter(F.col("n") >= least)
    named = settle(common.filter(~F.col("token").isin(BLOCK, ALLOW)))
    first = named.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    of = {r.token: r.item for r in named.join(first, ["n", "x", "y"]).select("token", "item").toLocalIterator()} | {BLOCK: BLOCK, ALLOW: ALLOW}
    sent = labelled.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([sorted({sent.value[t] for t in x if t in sent.value}) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))], ["items"])

    return labelled.select("items").mapInArrow(run, "items array<string>"), of


def _luck(n: Column, share: Column, base: Column) -> Column:
    """A bound on the log of the chance that a share of n or more has the label, if each has it with chance base (Chernoff)."""
    none = F.lit(0.0)
    hit = F.when(share > 0, share * F.log(share / base)).otherwise(none)
    miss = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(none)
    return F.when(share > base, -n * (hit + miss)).otherwise(none)


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> tuple[DataFrame, dict[str, str]]:
    """(antecedent, block, confidence) of the rules that pass, not pruned, and the item that each token counts as.

    labelled: url, block. A rule's support is the share of labelled URLs that hold its tokens and its label. Rows with a
    null are ignored, and so are URLs without tokens. Each repeated row counts. URLs of any length give all their tokens.
    """
    spark = labelled.sparkSession
    rows = settle(labelled_tokens(labelled).withColumn("uid", F.monotonically_increasing_id()))
    total, blocked = rows.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    least = max(min_count, math.ceil(min_support * total - 1e-9))
    if total < least:
        return spark.createDataFrame([], "antecedent array<string>, block boolean, confidence double"), {}
    items, of = _items(rows, least)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(items)
    tested = max(1, model.freqItemsets.filter(F.array_contains("items", BLOCK) | F.array_contains("items", ALLOW)).count())
    label = F.element_at("consequent", 1)
    base = F.when(label == BLOCK, blocked / total).otherwise(1 - blocked / total)
    held = F.col("support") * total / F.col("confidence")
    found = model.associationRules.filter(label.isin(BLOCK, ALLOW)).withColumn("luck", _luck(held, F.col("confidence"), base))
    return found.filter(F.col("luck") <= math.log(alpha / tested)).select("antecedent", (label == BLOCK).alias("block"), "confidence"), of


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> Rules | tuple[DataFrame, dict[str, str]]:
    """Rules from labelled URLs, as mined() finds them: pruned and on the driver if there are at most SENT_RULES, else as a frame, for judge()."""
    rows, of = mined(labelled, min_support, min_confidence, min_count, alpha)
    rows = settle(rows)
    if rows.count() > SENT_RULES:
        return rows, of
    return Rules(tuple(pruned([(frozenset(r.antecedent), r.block, float(r.confidence)) for r in rows.collect()])), of)


def listed(host: str, path: str, rules: list[tuple[str, str]] | tuple = LISTED) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule whose host is host or a domain above it and whose path begins path."""
    best = None
    for verdict, rule in rules:
        of, slash, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


RESULT = "page_id long, host string, path string, rule string, verdict string, confidence double"


def judge(pages: DataFrame, rules: Rules | tuple[DataFrame, dict[str, str]], rule_list=LISTED) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, confidence (of the mined rule that decided, else null).

    Null URLs and URLs without ``://`` have an empty host and path, and are allowed unless a listed rule fits. Repeated
    rows are judged each; URLs of any length are read whole; other columns of pages are ignored.
    """
    many = not isinstance(rules, Rules)
    sent = pages.sparkSession.sparkContext.broadcast(Rules((), rules[1]) if many else rules)

    def run(batches):
        told = sent.value
        match = told.matcher()
        for batch in batches:
            out = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                known = listed(host, path, rule_list)
                tokens = [] if known else tokens_of(url)
                verdict, confidence = (known[0], None) if known else match(tokens)
                out.append((page, host, path, known[1] if known else None, verdict, confidence, *((sorted(told.items(tokens)),) if many else ())))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), *((pa.list_(pa.string()),) if many else ())]
            names = ["page_id", "host", "path", "rule", "verdict", "confidence", *(("items",) if many else ())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return _by_join(rows.mapInArrow(run, RESULT + ", items array<string>"), rules[0]) if many else rows.mapInArrow(run, RESULT)


def _by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdicts of rows (with items) by rules too many to send: a rule meets the pages that hold its rarest item, and fits if they hold the rest."""
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()))
    each = rows.filter("rule is null").select("uid", "items", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("n"))
    rules = rules.withColumn("id", F.monotonically_increasing_id())
    spread = rules.select("id", F.explode("antecedent").alias("item")).join(often, "item", "left")
    rarest = spread.groupBy("id").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    keyed = rules.join(rarest, "id").select("item", "antecedent", "block", "confidence")
    fits = each.join(keyed, "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    best = fits.groupBy("uid").agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), "block")).alias("best"))
    told = rows.drop("confidence").join(best, "uid", "left")
    verdict = F.when(F.col("best.block"), "block").otherwise(F.col("verdict"))
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("best.confidence").alias("confidence"))


def held_out(labelled: DataFrame, **options) -> tuple[int, int, float, int]:
    """Rules from two thirds of the labelled URLs (by hash), judged on the rest: URLs blocked, rightly so, the share to be blocked, URLs judged."""
    third = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    rules = mine(labelled.filter(~third), **options)
    rest = settle(labelled.filter(third).filter("url is not null and block is not null"))
    told = judge(rest.select(F.col("block").cast("long").alias("page_id"), "url"), rules, ())
    hit, right, share, n = told.agg(F.count_if(F.col("verdict") == "block"), F.count_if((F.col("verdict") == "block") & (F.col("page_id") == 1)), F.avg("page_id"), F.count("*")).first()
    return hit, right, share or 0.0, n


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of the pages whose document has a label: its number ends the URL's path; toxic or low-quality documents are to be blocked.

    Null labels say nothing against a document; of several labels of one document the worst counts. Repeated pages count each.
    """
    doc = F.regexp_extract(F.col("url"), r"://[^/?#]*/(?:[^?#]*/)?(\d{1,18})(?:\.\w+)?/?(?:[?#]|$)", 1)
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    return pages.select("url", F.when(doc != "", doc).cast("long").alias("doc_id")).filter("doc_id is not null").join(told, "doc_id").select("url", "block")
