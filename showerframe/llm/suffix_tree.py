"""Substring dedup: prefix-partitioned suffix trees over words.

Suffixes are partitioned by the words that all their windows share (``Rule.core``), and the partitions are packed into groups
of bounded size. A group sorts its suffixes and builds the tree of their common prefixes; the internal nodes, from the depth
of the shared prefix down, give the repeats, extended to the left by the words before the suffix. Suffixes are those at the
sampled positions of ``repeats``, one of which every window has."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from showerframe.llm import repeats
from showerframe.llm.common import table
from showerframe.llm.repeats import Rule
from showerframe.llm.suffix_array import order_of

RULE = Rule(words=True, length=35, cover=16, gram=3)


def internal_nodes(common: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Internal nodes of the tree of sorted suffixes, from the length each shares with the one before: first and last suffix,
    depth of the parent and own depth. The root has depth -1 and is left out."""
    open_nodes = [(-1, 0)]
    for i, shared in enumerate([*common[1:].tolist(), -1], 1):
        left = i - 1
        while open_nodes[-1][0] > shared:
            depth, left = open_nodes.pop()
            yield left, i - 1, max(shared, open_nodes[-1][0]), depth
        if open_nodes[-1][0] < shared:
            open_nodes.append((shared, left))


def tree_repeats(rule: Rule, core: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes],
                 right: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, offset, same offset) of every repeated window of some partitions' suffixes, in a list of one length."""
    order, common = order_of(core, right, 8)
    most = rule.length - rule.core
    low, high, order = low.tolist(), high.tolist(), order.tolist()
    members, offsets = [], []
    for first, last, above, depth in internal_nodes(common):
        inside = order[first:last + 1]
        for length in range(above + 1, min(depth, most) + 1):  # words behind the shared prefix
            offset = most - length                             # words before it
            same = defaultdict(list)
            for m in inside:
                if low[m] <= offset <= high[m]:
                    before = left[m]
                    same[before[len(before) - 8 * offset:]].append(m)
            for group in same.values():
                if len(group) > 1:
                    members += group
                    offsets += [offset] * len(group)
    at = np.array(offsets, np.int64)
    return [(np.array(members, np.int64), at, at)]


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 35 words. Null and empty texts have no words; equal texts of
    35 words or more, repeated rows included, are removed whole (``repeats.report``)."""
    out = repeats.report(RULE, tree_repeats, table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumnRenamed("n", "n_words").select("doc_id", "n_words", "n_removed", "kept_sha256")
