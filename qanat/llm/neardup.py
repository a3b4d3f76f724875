"""Problem 5: records that repeat others with small edits, insertions or in another order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.graph import components
from qanat.llm.overlap import at_least, block_count, candidates, possible, profile, share, with_words
from qanat.llm.runtime import cut

#: Texts whose links one task holds before it passes them on.
HELD = 1 << 19


def measured(rows: DataFrame, threshold: float, objective: bool) -> tuple[DataFrame, DataFrame]:
    """(records, pairs): records (row_id, text_id, n) and candidate pairs (a, b, words_a, words_b) of different texts."""
    blocks = block_count(rows)
    records, bitmaps, sketches, packed = profile(rows, objective, threshold, blocks)
    likely = cut(possible(candidates(packed, sketches, threshold, blocks), bitmaps, threshold))
    return records, with_words(likely, rows, records, objective)


def verified(batch: pa.RecordBatch, threshold: float):
    """(a, b, share) of the batch's pairs that reach the threshold."""
    for x, y, wx, wy in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "words_a", "words_b"))):
        both, either = share(np.frombuffer(wx, np.uint64), np.frombuffer(wy, np.uint64))
        if at_least(both, either, threshold):
            yield x, y, both / either


def near_texts(rows: DataFrame, threshold: float = 0.6, objective: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, pairs): records (row_id, text_id, n) and pairs (a, b, share) of different texts whose shared share is at least ``threshold``.

    The sparse incidence matrix of texts by word n-grams, in blocks of columns, is multiplied with its transpose;
    overlap counts below the bound that the sizes give are discarded, the rest is measured exactly on all five-word
    shingles (see ``overlap``). Texts under five words have no shingles and no
    partner but their copies (equal text_id). Empty tables give no rows.
    """
    records, pairs = measured(rows, threshold, objective)

    def verify(batches):
        for b in batches:
            out = list(verified(b, threshold))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "share"])

    return records, pairs.mapInArrow(verify, "a bigint, b bigint, share double")


def near_pairs(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: every pair of records at or above the threshold, copies included.

    Copies of a text without any shingle are no pair: a share of nothing is not measured.
    """
    records, pairs = near_texts(rows, threshold)
    has = records.where("n > 0").select("row_id", "text_id")
    a, b = has.toDF("row_id_a", "a"), has.toDF("row_id_b", "b")
    near = pairs.join(a, "a").join(b, "b").select(F.least("row_id_a", "row_id_b").alias("row_id_a"), F.greatest("row_id_a", "row_id_b").alias("row_id_b"))
    several = has.groupBy("text_id").agg(F.count("*").alias("c")).where("c > 1")
    copies = has.join(several.select("text_id"), "text_id", "left_semi").select("row_id", "text_id")
    same = copies.toDF("row_id_a", "a").join(copies.toDF("row_id_b", "b"), F.expr("a = b AND row_id_a < row_id_b")).select("row_id_a", "row_id_b")
    return near.union(same)


class Forest:
    """Links of one task: how many each text has, and only so many of them as keep the same texts tied."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[up]
        return x

    def add(self, a: int, b: int) -> None:
        for x in (a, b):
            self.links[x] = self.links.get(x, 0) + 1
        p, q = self.find(a), self.find(b)
        if p != q:
            self.root[max(p, q)] = min(p, q)
            self.edges.append((a, b))

    def batch(self) -> pa.RecordBatch:
        """(a, b, links): edges without links, then texts (as a) with theirs."""
        a, b = [x for x, _ in self.edges] + list(self.links), [y for _, y in self.edges] + [None] * len(self.links)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(self.edges) + list(self.links.values()), pa.int64())], ["a", "b", "links"])


def near_groups(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(row_id, text_class, links, group_id): one row per record.

    ``text_class`` is the smallest row_id with the same words, ``links`` the number of different texts at or above
    the threshold, ``group_id`` the smallest row_id that is tied to the record through copies and links. Records
    under five words are tied to their copies only. The groups are those of the pairs of ``near_pairs``, at the same threshold.

    Pairs leave no task: it passes on each text's number of links and a forest of them, so a family of texts that are all near one
    another costs a row for each text and task, not one for each two texts.
    """
    records, pairs = measured(rows, threshold, True)

    def tie(batches):
        forest = Forest()
        for batch in batches:
            for a, b, _ in verified(batch, threshold):
                forest.add(a, b)
            if len(forest.links) >= HELD:
                yield forest.batch()
                forest = Forest()
        yield forest.batch()

    tied = cut(pairs.mapInArrow(tie, "a bigint, b bigint, links bigint"))
    heads = records.groupBy("text_id").agg(F.min("row_id").alias("text_class"))
    links = tied.where("b IS NULL").groupBy(F.col("a").alias("text_id")).agg(F.sum("links").alias("links"))
    classes = heads.join(links, "text_id", "left").na.fill(0, ["links"])
    a, b = heads.toDF("a", "u"), heads.toDF("b", "v")
    parts = components(tied.where("b IS NOT NULL").select("a", "b").join(a, "a").join(b, "b").select("u", "v"))
    classes = classes.join(parts, F.col("text_class") == F.col("node"), "left").select("text_id", "text_class", "links", F.coalesce("component", "text_class").alias("group_id"))
    return records.select("row_id", "text_id").join(classes, "text_id").select("row_id", "text_class", "links", "group_id")
