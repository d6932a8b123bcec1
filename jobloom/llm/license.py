"""License scan by ordered signature rules over the words of a text.

A text becomes its words in lower case with one blank between them. A rule is tried only where all its keywords are among
the words. Overlaps are resolved by priority: a detection goes if its words lie inside those of a kept one of higher
priority, or of the same priority and longer (of equal ones the first rule stays). The base rules are plain phrases,
found wherever their words stand consecutively; they are never suppressed and suppress nothing.

Every whole text is scanned where it is read; nothing is shuffled.

Defined cases: a null or empty text has no words, no detections, no labels and score 0; repeated rows are scanned one by
one; equal detections of one label count once in labels and each in n_base.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import extended, pick, raw, table, words
from jobloom.llm.license_rules import RULES

NAME = "op5_license_scan"
SQL = None
#: Phrases whose places are all counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_CONFIDENCE = 0.6


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    confidence: float
    label: str
    keywords: frozenset[bytes]
    pattern: re.Pattern


class Rules:
    """The rules, by one of their keywords: the one that the fewest rules have, which is the most telling."""

    def __init__(self, text: str = RULES, base: tuple[tuple[str, str], ...] = BASE):
        rows = [[part.strip() for part in line.split("|", 2)] for line in text.strip().splitlines()]
        self.all: list[Rule] = []
        for i, (head, keywords, pattern) in enumerate(rows):
            priority, confidence, label = head.split()
            compiled = re.compile(rf"(?<= )(?:{pattern})(?= )".encode())
            self.all.append(Rule(i, int(priority), float(confidence), label, frozenset(keywords.encode().split()), compiled))
        shared = defaultdict(int)
        for rule in self.all:
            for k in rule.keywords:
                shared[k] += 1
        self.by_keyword: dict[bytes, list[Rule]] = defaultdict(list)
        for rule in self.all:
            self.by_keyword[min(rule.keywords, key=lambda k: (shared[k], k))].append(rule)
        self.base = [(f" {phrase} ".encode(), frozenset(phrase.encode().split()), label) for phrase, label in base]
        self.gate = frozenset(self.by_keyword) | {k for _, own, _ in self.base for k in own}

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """All places (start, end, label) of the base phrases, and the kept detections, with their confidence."""
        if self.gate.isdisjoint(w):
            return [], []
        present = set(w)
        text = b" " + b" ".join(w) + b" "
        places, found = [], []
        for phrase, own, label in self.base:
            at = text.find(phrase) if own <= present else -1
            while at >= 0:
                places.append((at, at + len(phrase) - 1, label))
                at = text.find(phrase, at + 1)
        for k in self.by_keyword.keys() & present:
            for rule in self.by_keyword[k]:
                if rule.keywords <= present:
                    found += [(m.start() - 1, m.end(), rule) for m in rule.pattern.finditer(text)]
        if not places and not found:
            return [], []
        starts = np.cumsum([0, *(len(x) + 1 for x in w)])  # of the blank before each word, and of the last blank
        number = lambda at: int(np.searchsorted(starts, at))
        places = sorted((number(a), number(b), label) for a, b, label in places)
        kept = suppressed([(number(a), number(b), rule) for a, b, rule in found])
        return places, [(a, b, rule.label, rule.confidence) for a, b, rule in kept]


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections [start, end) that lie in no kept one of their priority or a higher one, by place."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []
    levels = defaultdict(list)
    for d in found:
        levels[d[2].priority].append(d)
    for priority in sorted(levels, reverse=True):
        far = -1
        for a, b, rule in sorted(levels[priority], key=lambda d: (d[0], -d[1], d[2].order)):
            i = bisect_right(starts, a)
            if b > far and (not i or b > reach[i - 1]):
                kept.append((a, b, rule))
                far = b
        kept.sort(key=lambda d: (d[0], -d[1], d[2].order))
        starts = [d[0] for d in kept]
        reach = np.maximum.accumulate([d[1] for d in kept]).tolist() if kept else []
    return kept


@lru_cache(maxsize=1)
def default_rules() -> Rules:
    return Rules()


_PLACE = [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]


def scan(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs (text and keys): keys, n_words, base and detections, places of words [start, end) with labels."""
    names = ["n_words", "base", "detections"]
    types = [pa.int64(), pa.list_(pa.struct(_PLACE)), pa.list_(pa.struct([*_PLACE, ("confidence", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = default_rules()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in raw(batch.column("text")):
                w = words(text)
                base, found = rules.scan(w)
                out[0].append(len(w))
                out[1].append([dict(zip(("start", "end", "label"), d)) for d in base])
                out[2].append([dict(zip(("start", "end", "label", "confidence"), d)) for d in found])
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), *(pa.array(x, t) for x, t in zip(out, types))], [*keys, *names])

    place = "start: bigint, end: bigint, label: string"
    docs = pick(docs, list(dict.fromkeys([*keys, "text"])))
    return docs.mapInArrow(run, extended(docs, [*keys], f"n_words long, base array<struct<{place}>>, detections array<struct<{place}, confidence: double>>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    listed = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    own, more = F.col("base.label"), F.col("detections.label")
    best = F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), listed(own).alias("base_labels"), listed(F.concat(own, more)).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
    )
