"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate credentials in each text. Over the whole corpus, candidates are
aggregated by the hash of their value, by repositories and owners: a value that many owners
hold, for the number of owners there are, or that stands in very many repositories of each of
its owners, is an example that went from hand to hand or a placeholder of boilerplate; one
that few repositories of few owners hold looks like a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.llm.common import field, map_text, plain

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "generic")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
GENERIC_ENTROPY = 3.5
LIVE_ENTROPY = 2.5
# A value is widely copied if so many owners hold it, and more the more owners there are
# (see example_owners), or if so many repositories do on the average of its owners.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    """Bits per character of a value's own character frequencies."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of each candidate of a text, in order."""
    out = []
    low = text.lower()  # ASCII letters only matter, and they are lower-cased alike
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text)
                if len(m[2]) >= ASSIGN_CHARS]
    longest = max(map(len, text.split()), default=0)
    if longest >= ACCESS_CHARS and "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)
                if len(m[0]) >= ACCESS_CHARS]
    if longest >= HEX_CHARS:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if longest >= 20:
        out.sort()
        k, end = 0, 0  # of the base spans that begin before a match, the furthest end
        base = list(out)
        for m in GENERIC.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                end = max(end, base[k][2])
                k += 1
            v = m[0]
            if end <= m.start() and re.search("[0-9]", v) and re.search("[A-Z]", v) \
                    and re.search("[a-z]", v) and entropy(v) >= GENERIC_ENTROPY:
                out.append((m.start(), 3, m.end(), v))
    return sorted(out)


_CAND = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("hash", T.StringType()),
    T.StructField("strong", T.BooleanType())]))
_SCAN = [field("n_assign", "long"), field("n_access", "long"), field("n_hex", "long"),
         field("base_sha256", "string"), field("_cand", _CAND)]


def _scan(texts: list) -> list:
    out: list[list] = [[], [], [], [], []]
    for t in texts:
        got = find(t) if t else []
        kinds = Counter(k for _, k, _, _ in got)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in got if k < 3)
        for x, y in zip(out, (kinds[0], kinds[1], kinds[2], hashlib.sha256(base.encode()).hexdigest(),
                              [{"start": a, "kind": k, "end": b, "strong": entropy(v) >= LIVE_ENTROPY,
                                "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()}
                               for a, k, b, v in got])):
            x.append(y)
    out[4] = pa.array(out[4], pa.list_(pa.struct([
        ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
        ("hash", pa.string()), ("strong", pa.bool_())])))
    return out


def example_owners(owners: int, least: int = EXAMPLE_OWNERS) -> int:
    """Owners that have to hold a value before it counts as widely copied, of so many owners
    in all: what two or three can have by accident or theft in a small corpus, more can in a
    large one, so the number grows with each doubling."""
    return max(least, 1 + math.ceil(math.log2(max(owners, 1))))


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) from (hash, owner, repo) rows: distinct owners, and
    distinct repositories of them, that hold a value. Null owners are one owner. Every
    step combines within tasks first, so a value in a third of all rows is no hot key."""
    held = cands.select("hash", "owner", "repo").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("k"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("k").alias("n_repos"))


def secrets(df: DataFrame, text_col: str = "text", owner_col: str = "source",
            repo_col: str = "doc_id", keep: list[str] | None = None,
            least_owners: int = EXAMPLE_OWNERS, least_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``keep`` columns (default: all) plus, for each row:

    ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` (base spans as
    kind:start:end); ``spans`` (base spans and those of generic high-entropy values that
    are live); ``n_live`` and ``n_example``; ``found``, an array of (start, end, kind,
    owners, repos, verdict). The verdict is ``example`` for a value that as many owners hold
    as :func:`example_owners` says for the owners of all rows, ``least_owners`` at least, or
    ``least_repos`` repositories for each of its owners; else ``live``, or ``weak`` for a
    value of few distinct characters. Positions are code points, ends exclusive.

    A null or empty text holds nothing. Each row of the input gives one row, repeated rows
    and null keys too (a null owner is an owner like any other); input columns named like
    an output give way to it; an empty table stays empty.
    """
    from ticketspark.session import materialize
    df = plain(df)
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "found"]
    src = df.select("*", F.col(f"`{owner_col}`").alias("_owner"), F.col(f"`{repo_col}`").alias("_repo"))
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    seen = map_text(src, text_col, _SCAN, _scan, [*kept, "_owner", "_repo"])
    seen = materialize(seen.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    cands = seen.select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"),
                        F.posexplode("_cand").alias("pos", "c")).select(
        "_row", "pos", "owner", "repo", F.col("c.hash").alias("hash"))
    # written first: a join of two shuffled sides can split the rows of a hot value
    stats = materialize(ownership(cands), "secret-owners")
    by_row = cands.select("_row", "pos", "hash").join(stats, "hash").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("pos", "n_owners", "n_repos"))).alias("_stats"))
    kind = F.array(*map(F.lit, KINDS))
    wide = example_owners(seen.select("_owner").distinct().count(), least_owners)

    def judged(c, s):
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.get(kind, c["kind"]).alias("kind"),
            s["n_owners"].alias("owners"), s["n_repos"].alias("repos"),
            F.when((s["n_owners"] >= wide) | (s["n_repos"] >= least_repos * s["n_owners"]), "example").when(
                c["strong"], "live").otherwise("weak").alias("verdict"))

    # only rows with candidates are joined; the others' texts are not shuffled
    some = F.size("_cand") > 0
    hit = seen.where(some).join(by_row, "_row").withColumn("found", F.filter(
        F.zip_with("_cand", "_stats", judged),
        lambda x: (x["kind"] != KINDS[3]) | (x["verdict"] == "live")))
    out = hit.drop("_stats").unionByName(seen.where(~some).withColumn(
        "found", F.array().cast(hit.schema["found"].dataType)))

    def of(verdict):
        return F.size(F.filter("found", lambda x: x["verdict"] == verdict)).cast("long")

    return out.select(*[F.col(f"`{c}`") for c in kept], "n_assign", "n_access", "n_hex", "base_sha256",
                      F.array_join(F.transform("found", lambda x: F.concat_ws(
                          ":", x["kind"], x["start"], x["end"])), ",").alias("spans"),
                      of("live").alias("n_live"), of("example").alias("n_example"), "found")


def redact(df: DataFrame, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``df`` without ``found_col``, the spans in it that aren't examples replaced in the
    text by their kind in angle brackets (overlapping spans by the first one's kind)."""
    @F.pandas_udf(T.StringType())
    def mask(text, found):
        return text.combine(found, _mask)
    hit = F.exists(F.col(found_col), lambda x: x["verdict"] != "example")
    return df.withColumn(text_col, F.when(hit, mask(F.when(hit, F.col(text_col)), found_col)).otherwise(
        F.col(text_col))).drop(found_col)


def _mask(text: str | None, found) -> str | None:
    if text is None or found is None:
        return text
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if x["verdict"] == "example":
            continue
        if x["start"] >= end:
            out += [text[end:x["start"]], f"<{x['kind']}>"]
        end = max(end, x["end"])
    return "".join([*out, text[end:]])
