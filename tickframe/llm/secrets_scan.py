"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans. The sha256 of each candidate's value is counted over the whole corpus by distinct
repositories and owners: a value that many owners hold, or several in many repositories, is a copied example; one that
few hold, or one owner in whatever many repositories, looks live. Spans of the base kinds always stay; spans of the
further kinds stay only where their value is owner-specific.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, prefix_sums, settle

#: A value that more owners than this hold, and more than this share of all owners, is taken for a widely copied example.
MOST_OWNERS, OWNER_SHARE = 3, 0.01
#: So is one that several owners hold in more repositories than this.
MOST_REPOS = 6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int = 0  # the part that is the secret
    least: int = 1  # characters it has at least; shorter matches are consumed and dropped
    base: bool = True
    full: str | None = None  # what is scanned for, with the secret as group 1, where the pattern (the SQL has it) falls short of the secret


#: A private key's lines up to its END line, else its run of base64 lines; with RFC 1421 headers, and line ends as escapes.
#: Possessive, so that Java repeats without recursion.
PEM_FULL = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:(?:\\[nr]|\s)*+(?:Proc-Type|DEK-Info): *+[A-Za-z0-9,-]++){0,4}+"
    r"(?:[^-]*+(?=-----END )|(?:\\[nr]|\s)*+[A-Za-z0-9+/]{16,}+={0,2}+(?:(?:\\[nr]|\s)++[A-Za-z0-9+/]{32,}+={0,2}+)*+(?:(?:\\[nr]|\s)++[A-Za-z0-9+/]++={1,2}+)?+|))"
    r"(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?+"
)

# The kinds in the order in which spans of one start are listed. Runs of one character class with a least
# length are the same spans as all runs without those that are too short.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Kind("access", "AKIA[A-Z0-9]{16,}"),
    Kind("hex", "[0-9a-f]{24,}"),
    Kind("forge", "gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Kind("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Kind("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", base=False, full=PEM_FULL),
    Kind("url", r"://[^\s:/@]+:([^\s:/@]{6,})@", 1, 6, base=False),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}
SPAN = "struct<start:bigint,ord:int,end:bigint,value:string>"


def _spans(text: Column, kind: Kind) -> Column:
    """All leftmost, non-overlapping matches with their places in code points: the text between matches gives the places."""
    sought = kind.full or kind.pattern
    pattern = F.lit(sought)
    whole, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1 if kind.full else kind.group))
    if kind.name == "pem":  # one key is one value, however its lines end; a header without a key is its own value
        bare = F.transform(values, lambda v: F.regexp_replace(v, r"\\[nr]|\s", ""))
        values = F.zip_with(whole, bare, lambda m, v: F.when(v == "", m).otherwise(v))
    between = F.split(text, sought, -1)
    ends = prefix_sums(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint")))
    rows = F.arrays_zip(whole.alias("m"), values.alias("v"), ends.alias("e"))
    own = F.transform(
        F.filter(rows, lambda x: F.length(x["v"]) >= kind.least),
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(ORDER[kind.name]).alias("ord"), x["e"].alias("end"), x["v"].alias("value")),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(sought), own.cast(f"array<{SPAN}>")).otherwise(none)


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repo: str | tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document, without its text: uid, doc_id, owner, repo, spans (candidates of every kind). Evaluated once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    repo_cols = (repo,) if isinstance(repo, str) else repo
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repo_cols)])).alias("repo"),
        F.concat(*[_spans(body, k) for k in KINDS]).alias("spans"),
    )
    return settle(rows.withColumn("uid", F.monotonically_increasing_id()))


def findings(found: DataFrame, most_owners: int = MOST_OWNERS, owner_share: float = OWNER_SHARE, most_repos: int = MOST_REPOS) -> DataFrame:
    """Every candidate with its value's frequency: uid, doc_id, kind, start, end, hash, n_repos, n_owners, copied.

    A value is copied if more owners hold it than most_owners and than owner_share of all owners, or if several owners
    hold it in more than most_repos repositories. Counts are reduced per (value, repository, owner) before they meet per
    value, so a value that a third of all rows hold adds one row per repository only. A null owner or repository counts
    as one of its own.
    """
    each = settle(found.select("uid", "doc_id", "owner", "repo", F.explode("spans").alias("s")).select("uid", "doc_id", "owner", "repo", "s.*").withColumn("hash", F.sha2(F.col("value"), 256)).drop("value"))
    owned = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    freq = settle(owned.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")))
    owners = found.select("owner").distinct().count()
    limit = max(most_owners, owner_share * owners)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    copied = (F.col("n_owners") > limit) | ((F.col("n_owners") > 1) & (F.col("n_repos") > most_repos))
    joined = join_counted(each, freq, "hash", "n", each.count()).withColumn("copied", copied)
    return joined.select("uid", "doc_id", F.element_at(names, F.col("ord") + 1).alias("kind"), "ord", "start", "end", "hash", "n_repos", "n_owners", "copied")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repo: str | tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS, owner_share: float = OWNER_SHARE, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live.

    Null and empty texts have no spans; texts of any length are scanned whole, in time about in proportion. Repeated rows are scanned each; they count once per repository and owner.
    Columns other than doc_id, text, owner and repository are ignored.
    """
    n_base = sum(k.base for k in KINDS)
    found = candidates(docs, owner=owner, repo=repo)
    judged = findings(found, most_owners, owner_share, most_repos).groupBy("uid").agg(
        F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied")).alias("n_live"),
        F.collect_list(F.when((F.col("ord") < n_base) | ~F.col("copied"), F.struct("start", "ord", "end"))).alias("kept"),
    )
    bare = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    base = F.filter(bare, lambda s: s["ord"] < n_base)
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == ORDER[name])).cast("long").alias(f"n_{name}")

    return found.join(judged, "uid", "left").select(
        "doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.coalesce("kept", empty)).alias("spans"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
