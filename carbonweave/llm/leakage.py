"""Evaluation texts leaking into training text: which document holds which test item, and where.

One Aho-Corasick automaton over the normalised items, as sequences of word numbers, scans each text once,
word by word, with every word's offsets in the original text kept. The patterns are the items cut into
pieces of half the least run: a run of `least` words of an item holds at least one whole piece, so every
leak is met, at one automaton node per item word instead of one per word and window. From a hit the run
is walked out to both sides, against the item and the text, which gives its true length and place.

Scale: no shuffle at all; documents stream past the automaton, which reaches each worker process once by
broadcast. Items are a stated set, read in order of their ids, never more than one block of them at a
time; a block holds up to BLOCK_WORDS words (tens of thousands of items), and only a set beyond that costs
a further scan per block. An id's texts are never parted, so no pair comes out of two blocks.

Defined results: words are runs of letters and digits with case ignored; null or empty texts and items
hold no words; items of fewer than `least` words cannot leak; an item that repeats under several ids
is reported under each; a pair comes out once with its first and last offset and the length of its longest
run of words; texts are scanned whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
#: Words of items that one automaton holds, some tens of bytes each.
BLOCK_WORDS = 5_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text or "")]


class LeakScanner:
    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS) -> None:
        self.least = least
        self.number: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            seq = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            if len(seq) >= least and item not in owners.setdefault(seq, []):
                owners[seq].append(item)
        self.sequences = list(owners)
        self.owners = list(owners.values())
        size = (least + 1) // 2
        patterns: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, seq in enumerate(self.sequences):
            for at in range(0, len(seq) - size + 1, size):
                patterns.setdefault(seq[at : at + size], []).append((k, at + size - 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, places in patterns.items():
            self.automaton.add_word(seq, places)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> first offset, last offset, words in its longest unbroken run."""
        if self.empty:
            return {}
        spans, numbers = [], []
        for m in _WORD.finditer(text):
            spans.append(m.span())
            numbers.append(self.number.get(m.group().casefold(), 0))
        out: dict[int, tuple[int, int, int]] = {}
        #: Per sequence and shift against the text, how far it has been walked.
        walked: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter(tuple(numbers)):
            for k, at in places:
                shift = end - at
                if walked.get((k, shift), -1) >= end:
                    continue
                seq = self.sequences[k]
                low, high = end, end
                while low > 0 and low - shift > 0 and numbers[low - 1] == seq[low - 1 - shift]:
                    low -= 1
                while high + 1 < len(numbers) and high + 1 - shift < len(seq) and numbers[high + 1] == seq[high + 1 - shift]:
                    high += 1
                walked[k, shift] = high
                if high - low + 1 >= self.least:
                    for item in self.owners[k]:
                        a, b, n = out.get(item, (spans[low][0], 0, 0))
                        out[item] = (min(a, spans[low][0]), max(b, spans[high][1]), max(n, high - low + 1))
        return out


def _blocks(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their ids, parted where a block is full, never within an id."""
    block: list[tuple[int, str]] = []
    size = 0
    for item, text in items:
        if size >= BLOCK_WORDS and item != block[-1][0]:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(_WORD.findall(text))
    yield block


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """doc id, item id, first_offset, last_offset, words: every document that holds `least` or more consecutive words of an item."""
    sc = docs.sparkSession.sparkContext
    listed = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").orderBy("item")
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    kind = docs.schema[id_col].dataType.simpleString()

    def scanned(block: list[tuple[int, str]]) -> DataFrame:
        scanner = sc.broadcast(LeakScanner(block, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for item, hit in scanner.value.scan(text).items():
                        rows.append(k)
                        found.append((item, *hit))
                cols = list(zip(*found)) if found else [()] * 4
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(list(cols[0]), pa.int64()), *(pa.array(list(c), pa.int32()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "item", "first_offset", "last_offset", "words"])

        return src.mapInArrow(run, f"doc {kind}, item bigint, first_offset int, last_offset int, words int")

    hits = reduce(DataFrame.unionByName, map(scanned, _blocks((r[0], r[1]) for r in listed.toLocalIterator())))
    return hits.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "first_offset", "last_offset", "words")
