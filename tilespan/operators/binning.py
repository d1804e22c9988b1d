"""Rolling hierarchical majority: every window of a sequence gets the deepest label that a majority supports."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NOVEL
from ..functions.intervals import coalesce_runs
from .storage import spread

WINDOW, STEP, MAJORITY, NOVEL_MIN = 101, 1, 0.5, 0.5


class Tree:
    """A label tree in the driver (a few hundred nodes at most): children, subtrees and depths, with an unnamed root above several roots."""

    def __init__(self, edges: DataFrame, labels: Sequence[str]):
        up = {r.child: r.parent for r in edges.select("child", "parent").collect()}
        tops = sorted({p for p in up.values() if p not in up})
        self.root = tops[0] if len(tops) == 1 else ""
        self.parent = dict(up) if len(tops) == 1 else {**dict.fromkeys(tops, ""), **up}
        self.parent.update({x: self.root for x in labels if x not in self.parent and x not in (self.root, NOVEL)})
        self.children: dict[str, list[str]] = {}
        for child in sorted(self.parent):
            self.children.setdefault(self.parent[child], []).append(child)
        self.depth, self.below = {self.root: 0}, {}
        stack = [self.root]
        while stack:
            node = stack.pop()
            for child in self.children.get(node, []):
                self.depth[child] = self.depth[node] + 1
                stack.append(child)
        for x in sorted(self.depth, key=self.depth.get, reverse=True):
            self.below[x] = {x}.union(*(self.below[c] for c in self.children.get(x, [])))


def descend(weights: DataFrame, edges: DataFrame, keys: Sequence[str], majority: float = MAJORITY, scope: str = "node", novel_min: float = NOVEL_MIN, labels: Sequence[str] | None = None) -> DataFrame:
    """keys, feature: the majority label of each window of weights (keys, feature, w).

    novel wins if it holds novel_min of the weight, else it is left out. From the root down, the heaviest child (then the
    deepest, then the last by name) is entered while its subtree holds more than majority of the node's weight (scope node) or of
    all (window). If none is entered at the top, the heaviest label wins. The tree is compiled into columns: one aggregation
    gives a window's weight of every label, subtree weights are sums of those, each node's heaviest child is a greatest(), and
    the way down is one CASE. labels: those that may occur; read from weights if not given.
    """
    keys = list(keys)
    labels = sorted(labels if labels is not None else (r[0] for r in weights.select("feature").distinct().collect()))
    tree = Tree(edges, labels)
    held = weights.where("w > 0").groupBy(*keys).agg(*[F.sum(F.when(F.col("feature") == x, F.col("w")).otherwise(0)).alias(f"_w{k}") for k, x in enumerate(labels)])
    column = {x: F.col(f"_w{k}") for k, x in enumerate(labels)}
    known = [x for x in labels if x != NOVEL]

    def total(names):
        return sum((column[x] for x in names if x in column and x != NOVEL), F.lit(0))

    inner = [n for n in tree.children if tree.below[n] & set(known)]
    sub = {n: f"_s{k}" for k, n in enumerate(sorted(tree.depth)) if tree.below[n] & set(known)}
    held = held.withColumns({c: total(sorted(tree.below[n])) for n, c in sub.items()})
    best = {}
    for k, n in enumerate(sorted(inner)):
        tried = [F.struct(F.col(sub[c]).alias("w"), F.lit(tree.depth[c]).alias("d"), F.lit(c).alias("n")) for c in tree.children[n] if c in sub]
        if tried:
            best[n] = f"_b{k}", (tried[0] if len(tried) == 1 else F.greatest(*tried))
    flat = [F.struct(column[x].alias("w"), F.lit(tree.depth.get(x, 1)).alias("d"), F.lit(x).alias("n")) for x in known]
    held = held.withColumns({c: e for c, e in best.values()} | {"_all": total(known), "_novel": column.get(NOVEL, F.lit(0))} | {"_flat": (flat[0] if len(flat) == 1 else F.greatest(*flat))["n"] if flat else F.lit(NOVEL)})

    def down(node):
        here = F.col("_flat") if node == tree.root else F.lit(node)
        if node not in best:
            return here
        top = F.col(best[node][0])
        base = F.col(sub[node]) if scope == "node" and node in sub else F.col("_all")
        deeper = F.lit(None).cast("string")
        for child in tree.children[node]:
            if child in sub:
                deeper = F.when(top["n"] == child, down(child)).otherwise(deeper)
        return F.when((top["w"] > 0) & (top["w"] > majority * base), deeper).otherwise(here)

    everything = F.col("_all") + F.col("_novel")
    is_novel = (F.col("_novel") > 0) & ((F.col("_novel") >= novel_min * everything) | (F.col("_all") == 0))
    return held.select(*keys, F.when(is_novel, NOVEL).otherwise(down(tree.root)).alias("feature"))


def windows(rows: DataFrame, window: int, step: int, chunk: int = 1 << 16) -> DataFrame:
    """seq_id, start, end (of the tile), low, high (of the window around its centre), in the sequence's own coordinates. Tiles are listed by chunks of so many, so that no row holds all of a long sequence's."""
    span = rows.groupBy("seq_id").agg(F.min("start").alias("_s"), F.max("end").alias("_e")).withColumn("_len", F.col("_e") - F.col("_s"))
    size = step * chunk
    chunks = span.select("seq_id", "_s", "_len", F.explode(F.expr(f"sequence(0L, (_len - 1) div {size})")).alias("_c"))
    tiles = chunks.select("seq_id", "_s", "_len", F.explode(F.expr(f"sequence(_c * {size}L, least(_len - 1, (_c + 1) * {size}L - 1), {step}L)")).alias("_p"))
    centre = F.least(F.col("_len") - 1, F.col("_p") + step // 2)
    return tiles.select("seq_id", (F.col("_s") + F.col("_p")).alias("start"), (F.col("_s") + F.least(F.col("_p") + step, F.col("_len"))).alias("end"),
                        (F.col("_s") + F.greatest(F.lit(0), centre - (window - 1) // 2)).alias("low"), (F.col("_s") + F.least(F.col("_len"), centre + window // 2 + 1)).alias("high"))


def window_weights(rows: DataFrame, tiles: DataFrame, window: int) -> DataFrame:
    """seq_id, start, end, feature, w: label lengths in each window, to be summed. Rows and windows meet in coordinate bins a window wide."""
    size = max(window, 64)
    a = tiles.withColumn("_bin", F.explode(F.sequence(F.expr(f"low div {size}"), F.expr(f"(high - 1) div {size}"))))
    b = rows.select("seq_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "feature").withColumn("_bin", F.explode(F.sequence(F.expr(f"_s div {size}"), F.expr(f"(_e - 1) div {size}"))))
    met = a.join(b, ["seq_id", "_bin"]).withColumn("w", F.least("high", "_e", (F.col("_bin") + 1) * size) - F.greatest("low", "_s", F.col("_bin") * size))
    return met.select("seq_id", "start", "end", "feature", "w").where("w > 0")


def bin_strided(rows: DataFrame, edges: DataFrame, window: int = WINDOW, step: int = 10, majority: float = MAJORITY, scope: str = "node", novel_min: float = NOVEL_MIN) -> DataFrame:
    """One label for each tile of step bases, by the window around its centre; equal neighbours joined."""
    labels = [r[0] for r in rows.select("feature").distinct().collect()]
    called = descend(window_weights(rows, windows(rows, window, step), window), edges, ["seq_id", "start", "end"], majority, scope, novel_min, labels)
    return coalesce_runs(called.select("seq_id", "start", "end", "feature"))


class Descent:
    """The descent for many windows at once, as outcomes: a row of weights (a column a label) gives the number of the node it ends at,
    names + that number where the heaviest label stood in for a root that nothing was entered from. Shares are compared in whole numbers."""

    def __init__(self, labels: Sequence[str], parents: dict[str, str], majority: float = MAJORITY, scope: str = "node", novel_min: float = NOVEL_MIN):
        self.names = sorted(set(labels) | set(parents) | set(parents.values()))
        self.scope, self.share, self.novel_share = scope, Fraction(str(majority)), Fraction(str(novel_min))
        at = {n: k for k, n in enumerate(self.names)}
        tops = sorted({p for p in parents.values() if p not in parents})
        root = tops[0] if len(tops) == 1 else None
        self.label = np.array([at[x] for x in labels], np.int64)
        self.novel = at.get(NOVEL)
        lines = [[n] for n in self.names]
        for line in lines:
            while line[-1] in parents:
                line.append(parents[line[-1]])
        depth = [len([x for x in line if x != root]) if line[0] in parents or line[0] in tops else 1 for line in lines]
        self.rank = np.empty(len(self.names))
        self.rank[sorted(range(len(self.names)), key=lambda k: (depth[k], self.names[k]))] = np.arange(len(self.names))
        self.member = np.zeros((len(self.names), len(self.names)), np.int64)  # row a label's, column a node's: the label lies below it
        for k, line in enumerate(lines):
            self.member[k, [at[x] for x in line if x != root]] = 1
        self.children: dict[int | None, list[int]] = {}
        for n in self.names:
            if n != root:
                up = parents.get(n)
                self.children.setdefault(None if up is None or up == root else at[up], []).append(at[n])

    def __call__(self, weights: np.ndarray) -> np.ndarray:
        raw = np.zeros((len(weights), len(self.names)), np.int64)
        raw[:, self.label] = weights
        total = raw.sum(1)
        called = np.zeros(len(raw), bool)
        if self.novel is not None:
            novel = raw[:, self.novel].copy()
            called = (novel > 0) & ((novel * self.novel_share.denominator >= self.novel_share.numerator * total) | (novel == total))
            raw[:, self.novel] = 0
            total = total - novel
        below = raw @ self.member
        flat = np.where(raw == raw.max(1, keepdims=True), self.rank, -1).argmax(1)
        out = len(self.names) + flat
        todo = [(None, np.arange(len(raw)), total)]
        while todo:
            node, rows, base = todo.pop()
            own = np.array(self.children.get(node, []), np.int64)
            if not len(own) or not len(rows):
                continue
            heavy = below[np.ix_(rows, own)]
            top = heavy.max(1)
            pick = own[np.where(heavy == top[:, None], self.rank[own], -1).argmax(1)]
            enters = (top > 0) & (top * self.share.denominator > self.share.numerator * (base if self.scope == "node" else total[rows]))
            for k in np.unique(pick[enters]):
                mine = rows[enters & (pick == k)]
                out[mine] = k
                todo.append((int(k), mine, below[mine, k]))
        if self.novel is not None:
            out[called] = self.novel
        return out

    def called(self, outcome: np.ndarray) -> np.ndarray:
        return np.array(self.names, object)[outcome % len(self.names)]


class Covers:
    """How many bases of each label lie before a place, over all intervals of a batch laid on one line."""

    def __init__(self, start: np.ndarray, end: np.ndarray, label: np.ndarray, labels: int):
        order = np.lexsort((start, label))
        self.start, self.end = start[order], end[order]
        self.first = np.searchsorted(label[order], np.arange(labels + 1))
        self.done = np.concatenate(([0], np.cumsum(self.end - self.start)))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A row for each window [low, high), a column for each label."""
        out = np.zeros((len(low), len(self.first) - 1), np.int64)
        for k, (a, b) in enumerate(pairwise(self.first.tolist())):
            start, end, done = self.start[a:b], self.end[a:b], self.done[a : b + 1]
            for place, sign in ((high, 1), (low, -1)):
                n = np.searchsorted(start, place, "right")
                last = np.maximum(n - 1, 0)
                out[:, k] += sign * (done[n] - done[0] - np.where(n > 0, np.maximum(0, end[last] - place), 0))
        return out


def changes(descent: Descent, covers: Covers, points: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and outcomes enough to tell the outcome of every place. points: places in order between which all weights run straight,
    each in the piece (a number) of that index, whose sequence's bounds are low and high.

    Where weights run straight, the places of one outcome lie together: entering a child, ranking it first and stopping are all
    half-lines or stretches. So equal outcomes at both ends of a stretch hold in between, and unequal ones are told apart by halving.
    """

    def outcomes(at, own):
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 1 << 14):  # the table of weights has a column a label
            x, s, e = at[k : k + (1 << 14)], low[own[k : k + (1 << 14)]], high[own[k : k + (1 << 14)]]
            out[k : k + (1 << 14)] = descent(covers.between(np.maximum(s, x - before), np.minimum(e, x + after + 1)))
        return out

    found = outcomes(points, piece)
    places, results = [points], [found]
    left, right, one, two, own = points[:-1], points[1:], found[:-1], found[1:], piece[:-1]
    same = piece[1:] == own
    left, right, one, two, own = (x[same] for x in (left, right, one, two, own))
    while True:
        apart = (one != two) & (right - left > 1)
        if not apart.any():
            break
        left, right, one, two, own = (x[apart] for x in (left, right, one, two, own))
        mid = (left + right) // 2
        here = outcomes(mid, own)
        places.append(mid)
        results.append(here)
        left, right = np.concatenate((left, mid)), np.concatenate((mid, right))
        one, two, own = np.concatenate((one, here)), np.concatenate((here, two)), np.concatenate((own, own))
    places, results = np.concatenate(places), np.concatenate(results)
    order = np.argsort(places, kind="stable")
    return places[order], results[order]


def bin_exact(rows: DataFrame, edges: DataFrame, window: int = WINDOW, majority: float = MAJORITY, scope: str = "node", novel_min: float = NOVEL_MIN, piece: int = 1 << 20) -> DataFrame:
    """The majority label of every base of sequences that rows tile, equal neighbours joined.

    Weights of a sliding window run straight between the places where one of its ends meets an interval's: only these are evaluated, and
    between them as many as tell where the label changes, so work follows intervals and not bases. A sequence is dealt in pieces of so many bases,
    each with the intervals its windows reach, and pieces are read in batches that hold several. A share of exactly majority enters nothing.
    """
    parents = {r.child: r.parent for r in edges.select("child", "parent").collect()}  # a label tree
    before, after = (window - 1) // 2, window // 2
    span = rows.groupBy("seq_id").agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    met = rows.select("seq_id", "start", "end", "feature").join(span, "seq_id")
    dealt = met.withColumn("_p", F.explode(F.expr(f"sequence((greatest(_s, start - {after}) - _s) div {piece}, (least(_e, end + {before}) - 1 - _s) div {piece})")))

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        s, e, base, end_ = (pdf[c].to_numpy(np.int64) for c in ("start", "end", "_s", "_e"))
        labels, code = np.unique(pdf["feature"].to_numpy(object), return_inverse=True)
        new = np.append(True, (pdf["seq_id"].to_numpy()[1:] != pdf["seq_id"].to_numpy()[:-1]) | np.diff(pdf["_p"].to_numpy()).astype(bool))
        own, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        first = base[heads] + pdf["_p"].to_numpy(np.int64)[heads] * piece  # the piece's own bases
        last = np.minimum(end_[heads], first + piece)
        reach = last - first + window + 2
        move = np.concatenate(([0], np.cumsum(reach)[:-1])) - first + before + 1  # lays the pieces side by side
        s, e = np.maximum(s, (first - before)[own]), np.minimum(e, (last + after)[own])
        keep = s < e
        covers = Covers((s + move[own])[keep], (e + move[own])[keep], code[keep], len(labels))
        bends = np.concatenate([x + d for x in (s, e) for d in (before, -1 - after)] + [first, last - 1])
        whose = np.concatenate([own] * 4 + [np.arange(len(heads))] * 2)
        bends = np.clip(bends, first[whose], last[whose] - 1) + move[whose]
        points, at = np.unique(bends, return_index=True)
        descent = Descent(labels.tolist(), parents, majority, scope, novel_min)
        places, outcome = changes(descent, covers, points, whose[at], base[heads] + move, end_[heads] + move, before, after)
        owner = np.searchsorted(first + move, places, "right") - 1
        start = np.flatnonzero(np.append(True, (outcome[1:] % len(descent.names) != outcome[:-1] % len(descent.names)) | (owner[1:] != owner[:-1])))
        o = owner[start]
        begin = places[start] - move[o]
        until = np.append(begin[1:], 0)
        ends = np.append(o[1:] != o[:-1], True)
        return pd.DataFrame({"seq_id": pdf["seq_id"].to_numpy()[heads[o]], "start": begin, "end": np.where(ends, last[o], until), "feature": descent.called(outcome[start])})

    def run(parts):
        held: list[pd.DataFrame] = []
        for pdf in parts:
            if not len(pdf):
                continue
            held.append(pdf)
            if sum(map(len, held)) >= 1 << 15:
                both = pd.concat(held, ignore_index=True)
                tail = (both["seq_id"].to_numpy() == both["seq_id"].iloc[-1]) & (both["_p"].to_numpy() == both["_p"].iloc[-1])
                if not tail.all():  # the last piece may go on
                    yield several(both[~tail])
                held = [both[tail].reset_index(drop=True)]
        if held:
            yield several(pd.concat(held, ignore_index=True))

    laid = spread(dealt, "seq_id", "_p").sortWithinPartitions("seq_id", "_p", "start")
    return coalesce_runs(laid.mapInPandas(run, "seq_id string, start long, end long, feature string"))


def bin_annotations(rows: DataFrame, edges: DataFrame, window: int = WINDOW, step: int = STEP, **options) -> DataFrame:
    """Exact for step 1, else by tiles of step bases."""
    return bin_exact(rows, edges, window, **options) if step == 1 else bin_strided(rows, edges, window, step, **options)
