"""Connected components, and linking inside groups without listing their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored
from shelfline.operators.scale import HotKeys, salted_join


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, longs): the smallest node of its component.

    Alternating large and small stars: every round hangs neighbours below smaller ones, in a number of
    rounds that grows with the logarithm of the nodes.  Minima combine before the shuffle, and the edges of
    a hub are dealt to several tasks.  Each round is written to the shared folder.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    now = stored(edges.select(low, high).where("low < high").distinct(), "edges")
    measure = _measured(now)
    for _ in range(most_rounds):
        if not measure.totals()[0]:
            break
        now = stored(_small_star(_large_star(now, measure)), "edges")
        before, measure = measure.totals(), _measured(now)
        if measure.totals() == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    # settled: every edge goes from a root to a node of its component
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)


def _measured(edges: DataFrame) -> HotKeys:
    """One pass for the hubs, and for number and hash, which are equal for equal sets of edges."""
    marked = edges.select(F.col("low").alias("u"), F.xxhash64("low", "high").alias("mark"))
    return HotKeys(marked, "u", sums=["mark"])


def _large_star(edges: DataFrame, measure: HotKeys) -> DataFrame:
    """Every larger neighbour of a node is hung below the smallest of the node and its neighbours."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    down = edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
    return salted_join(down, least, ["u"], spread=["v"], measure=measure).select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    hung = edges.join(least, "high").where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
    return hung.unionByName(least.select(F.col("m").alias("low"), "high")).distinct()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups at a time, from rows sorted by their first ``keys`` columns.

    What follows the last border of a batch waits for the next one, so memory holds a batch and a group.
    """
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(rest, columns)]
        last = group_starts(columns[:keys])[-1]
        if last:
            yield [c[:last] for c in columns]
        rest = [c[last:] for c in columns]
    if rest is not None:
        yield rest


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where the rows of sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def forest(near: Callable[[int, np.ndarray], np.ndarray], candidates: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``near`` connects, at most one less than there are nodes.

    ``near(i, js)`` says which of ``js`` are linked to ``i``.  Each of ``firsts`` is held against those of
    ``candidates`` that are not connected to it yet.
    """
    label = np.arange(max(int(candidates.max(initial=-1)), int(firsts.max(initial=-1))) + 1)
    out: list[tuple[int, int]] = []
    for i in firsts.tolist():
        js = candidates[label[candidates] != label[i]]
        if not len(js):
            continue
        js = js[near(i, js)]
        if not len(js):
            continue
        found, first = np.unique(label[js], return_index=True)
        out += [(i, int(j)) for j in js[first]]
        label[np.isin(label, found)] = label[i]
    return out
