"""SimHash near-duplicates by vantage-point trees.

Fingerprints are partitioned by a vantage-point tree: each inner node splits them by
their Hamming distance to a fingerprint. The triangle inequality bounds which shards can
hold partners of a fingerprint; it visits those only, so all pairs within the distance are
found. Inside a shard the same tree goes on down to small leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import field, map_text, plain
from ticketspark.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
# Fingerprints of a shard aimed at; a shard of over 4 times as many is dealt in blocks.
SHARD_ROWS = 4096
# Guests of a group at most, in multiples of the rows of a shard.
GUESTS = 64
# Fingerprints sampled for each shard to place the tree's splits, and their sum's bound.
SAMPLE_PER_SHARD, MAX_SAMPLE = 64, 1 << 18
_BLOCK = 1 << 15


def fingerprints(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text (bytes or None) as uint64."""
    ones = np.zeros((len(texts), 64), np.int64)
    n = np.zeros(len(texts), np.int64)
    held: list[int] = []
    of: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            doc = np.array(of)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            ones[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            held.clear()
            of.clear()

    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        if not words:
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size).tolist()
        end = end.tolist()
        n[i] = max(1, len(words) - shingle + 1)
        if len(words) <= shingle:
            held.append(digest(line, SEED))
            of.append(i)
        else:
            for k in range(0, int(n[i]), _BLOCK):
                stop = min(k + _BLOCK, int(n[i]))
                held += [digest(line[a:b], SEED) for a, b in
                         zip(start[k:stop], end[k + shingle - 1:stop + shingle - 1])]
                of += [i] * (stop - k)
                if len(held) >= _BLOCK:
                    flush()
    flush()
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


# ------------------------------------------------------------------- the tree over shards

@dataclass
class Tree:
    """Inner nodes: vantage point, radius, children (a leaf k is written as ~k). Inside
    the radius, itself included, is the first child's side."""
    vantage: list[int]
    radius: list[int]
    child: list[tuple[int, int]]
    leaves: int

    def route(self, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, leaf, is it at home there): for each fingerprint its
        home, and the leaves where it has to look for partners. A pair of two shards is
        looked for from the inner side's member only, where their ways part."""
        if not self.vantage:
            return np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        out = []
        stack = [(0, np.arange(len(fp)), np.ones(len(fp), bool))]
        while stack:
            node, at, home = stack.pop()
            if node < 0:
                out.append((at, np.full(len(at), ~node), home))
                continue
            if not len(at):
                continue
            d = np.bitwise_count(fp[at] ^ np.uint64(self.vantage[node])).astype(np.int64)
            r = self.radius[node]
            inner = d <= r
            # home stays on its own side; a guest goes wherever a partner can be
            go_in = np.where(home, inner, d - bits <= r)
            go_out = np.where(home, ~inner | (d + bits > r), d + bits > r)
            stack.append((self.child[node][0], at[go_in], home[go_in]))
            stack.append((self.child[node][1], at[go_out], (home & ~inner)[go_out]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def _split(fp: np.ndarray, bits: int, tries: int = 12) -> tuple[int, int] | None:
    """The vantage point and radius that part a sample evenly with the fewest fingerprints
    within ``bits`` of the border; None if no radius parts it."""
    best = None
    for v in fp[np.linspace(0, len(fp) - 1, min(tries, len(fp))).astype(int)]:
        count = np.bincount(np.bitwise_count(fp ^ v), minlength=65)
        below = np.cumsum(count)
        pad = np.concatenate([np.zeros(bits, np.int64), below, np.full(bits, below[-1])])
        near = (pad[2 * bits:] - pad[:len(pad) - 2 * bits]) / len(fp)
        even = np.minimum(below, len(fp) - below) / len(fp)
        score = np.where(even >= 0.2, near - 0.5 * even, np.inf)
        r = int(np.argmin(score))
        if score[r] < np.inf and (best is None or score[r] < best[0]):
            best = (score[r], int(v), r)
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int, bits: int) -> Tree:
    tree = Tree([], [], [], 0)

    def grow(fp: np.ndarray, depth: int) -> int:
        cut = _split(fp, bits) if depth and len(fp) > 8 else None
        if cut is None:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        v, r = cut
        node = len(tree.vantage)
        tree.vantage.append(v)
        tree.radius.append(r)
        tree.child.append((0, 0))
        inner = np.bitwise_count(fp ^ np.uint64(v)) <= r
        tree.child[node] = (grow(fp[inner], depth - 1), grow(fp[~inner], depth - 1))
        return node

    grow(np.sort(sample), depth)
    return tree


# ---------------------------------------------------------------------- inside a shard

class Sets:
    """Disjoint sets over 0..n-1, joined in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(fp: np.ndarray, home: np.ndarray, bits: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected by pairs of a shard within ``bits``: pairs
    of two that are at home, or of one and a guest. They form a forest, so their number
    is below the shard's rows however many pairs there are."""
    sets = Sets(len(fp))
    stack = [(np.flatnonzero(home), np.arange(len(fp)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > leaf:
            some = fp[h[:: max(1, len(h) // 256)]]
            cut = _split(np.sort(some), bits, 4)
            if cut is not None:
                v, r = np.uint64(cut[0]), cut[1]
                dh = np.bitwise_count(fp[h] ^ v).astype(np.int64)
                dq = np.bitwise_count(fp[q] ^ v).astype(np.int64)
                q_in, q_out = q[dq - bits <= r], q[dq + bits > r]
                h_in, h_out = h[dh <= r], h[dh > r]
                # where bounds hardly prune, comparing is cheaper
                if len(h_in) * len(q_in) + len(h_out) * len(q_out) < 0.95 * len(h) * len(q):
                    stack += [(h_in, q_in), (h_out, q_out)]
                    continue
        step = max(1, (1 << 19) // min(len(h), 4096))
        for b in range(0, len(h), 4096):
            hb = h[b:b + 4096]
            for k in range(0, len(q), step):
                i, j = np.nonzero(np.bitwise_count(fp[q[k:k + step], None] ^ fp[hb][None, :]) <= bits)
                x, y = q[k:k + step][i], hb[j]
                apart = x != y
                if apart.any():
                    sets.join(x[apart], y[apart])
    root = sets.find(np.arange(len(fp)))
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def dealt(distinct: DataFrame, fp_col: str = "fp", bits: int = MAX_BITS,
          shard_rows: int = SHARD_ROWS, guest_rows: int | None = None) -> DataFrame:
    """(leaf, block, fp, home): groups of some ``4 * shard_rows`` fingerprints at home and
    ``guest_rows`` (``GUESTS`` times ``shard_rows``) guests at most, such that each pair within
    ``bits`` shares a group in which one of the two at least is at home."""
    guest_rows = guest_rows or GUESTS * shard_rows
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / shard_rows)))
    size = min(MAX_SAMPLE, SAMPLE_PER_SHARD << depth)
    share = min(1.0, size / max(n, 1))
    # by hash, so that reruns sample alike; at most some more than ``size`` fingerprints
    sample = distinct.where(F.pmod(F.xxhash64(F.lit("sample"), fp_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = np.array([r[0] for r in sample.select(fp_col).collect()], np.int64).view(np.uint64)
    tree = build_tree(got, depth, bits)

    def at_home(batches):
        for pdf in batches:
            fp = pdf[fp_col].to_numpy().view(np.uint64)
            _, leaf, home = tree.route(fp, bits)
            k = np.bincount(leaf, minlength=tree.leaves)
            own = np.bincount(leaf[home], minlength=tree.leaves)
            yield pd.DataFrame({"leaf": np.flatnonzero(k), "n": own[k > 0], "every": k[k > 0]})

    one = distinct.select(fp_col)
    # a row for each leaf of the tree, whose size the sample bounds
    sizes = one.mapInPandas(at_home, "leaf long, n long, every long").groupBy("leaf").agg(
        F.sum("n").alias("n"), F.sum("every").alias("every")).collect()
    blocks, parts = np.ones(tree.leaves, np.int64), np.ones(tree.leaves, np.int64)
    for leaf, k, every in sizes:
        if k > 4 * shard_rows:
            blocks[leaf] = -(-k // (2 * shard_rows))
        if every > guest_rows:
            parts[leaf] = -(-2 * every // guest_rows)

    def deal(batches):
        for pdf in batches:
            fp = pdf[fp_col].to_numpy().view(np.uint64)
            at, leaf, home = tree.route(fp, bits)
            k, p = blocks[leaf], parts[leaf]
            own = np.where(home, (fp[at] % np.uint64(1_000_003)).astype(np.int64) % k, -1)
            part = (fp[at] % np.uint64(1_000_033)).astype(np.int64) % p
            # one at home is so in all parts of its block, and a guest of all later blocks; a
            # block's guests are dealt over its parts
            rest = k - 1 - own
            times = np.where(home, p + rest, k)
            row = np.repeat(np.arange(len(at)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            at_home = home[row] & (nth < p[row])
            later = np.where(home, own + 1 - p, 0)[row] + nth
            block = np.where(at_home, own[row] * p[row] + nth, later * p[row] + part[row])
            yield pd.DataFrame({"leaf": leaf[row], "block": block, "fp": fp[at[row]].view(np.int64),
                                "home": at_home})

    return one.mapInPandas(deal, "leaf long, block long, fp long, home boolean")


def links(distinct: DataFrame, fp_col: str = "fp", bits: int = MAX_BITS,
          shard_rows: int = SHARD_ROWS, guest_rows: int | None = None) -> DataFrame:
    """(a, b) links between distinct fingerprints (64-bit integers) which connect all pairs
    that differ in ``bits`` bits at most."""
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    groups = dealt(distinct, fp_col, bits, shard_rows, guest_rows)
    return groups.groupBy("leaf", "block").applyInPandas(search, "a long, b long")


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None, shingle: int = SHINGLE, bits: int = MAX_BITS,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``keep`` columns (default: all) plus ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links of ``bits`` differing bits at
    most) and ``kept`` (true on one row of each component, of its smallest id).

    Equal fingerprints are one class, whatever their number, and are linked as classes. A
    null or empty text, or one without words, has fingerprint zero and is linked like
    any other; a text of fewer words than a shingle is one shingle. Every input row
    gives one row, repeated rows and null ids too (null only if no id is in reach, and
    never smallest otherwise); input columns named like an output give way; an empty
    table stays empty.
    """
    from ticketspark.session import materialize
    df = plain(df)
    names = ["fingerprint", "component_id", "kept"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    src = df.select("*", F.col(f"`{id_col}`").alias("_id"))
    fps = map_text(src, text_col, [field("_fp", "long")],
                   lambda texts: [fingerprints(texts, shingle).view(np.int64)],
                   [*kept, "_id"], binary=True)
    fps = materialize(fps.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
    distinct = materialize(fps.groupBy(F.col("_fp").alias("fp")).agg(first.alias("first")), "distinct-fp")
    labels = components(links(distinct, "fp", bits, shard_rows))
    # (fp, first row of its component): only fingerprints with links have a label
    named = materialize(distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "first"), "named-fp")
    tops = materialize(named.groupBy("label").agg(F.min("first").alias("top")), "component-top")
    top = materialize(named.join(tops, "label").select(F.col("fp").alias("_fp"), "top"), "fp-top")
    return fps.join(top, "_fp").select(
        *[F.col(f"`{c}`") for c in kept], F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("top._id").alias("component_id"), (F.col("_row") == F.col("top._row")).alias("kept"))
