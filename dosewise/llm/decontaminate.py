"""Benchmark decontamination with one Aho-Corasick automaton over windows of normalised benchmark words.

A text is normalised to words (A-Z in lower case, every other ASCII character but digits and letters a separator). Each
distinct benchmark word gets a private character, so a text becomes a string with a character per word - one and the same
for all words no benchmark item has - and a window a string of at most 13 characters. The automaton then reports every
window's end in one scan, and a hit's words are mapped back to character offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_rows, quoted, text_bytes

WINDOW = 13
#: Benchmark words in one automaton, about; larger benchmarks are dealt into blocks, a task of their own each.
BLOCK_WORDS = 200_000
#: Fixed by the definition of a word: ASCII but 0-9, A-Z and a-z separates words; A-Z is lower-cased.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NORMALISE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))

RESULT = "doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


class WindowAutomaton:
    """The automaton of some benchmark items ``(id, text)``."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.characters: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for item, text in items:
            coded = "".join(self._character(w) for w in words(text))
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                found.setdefault(coded[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, owners in found.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def _character(self, word: bytes) -> str:
        known = self.characters.get(word)
        if known is None:
            code = 1 + len(self.characters)
            known = self.characters[word] = chr(code if code < 0xD800 else code + 0x800)  # past the surrogates
        return known

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges ``[start, end)`` that lie in an occurrence of a window, and the items that occur."""
        if self.empty:
            return [], set()
        get = self.characters.get
        coded = "".join([get(w, "\0") for w in text_words])
        spans, items = [], set()
        for end, (length, owners) in self.automaton.iter(coded):
            items.update(owners)
            spans.append((end + 1 - length, end + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMALISE))]
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(heads[places[a][0]]), int(heads[places[b - 1][1]])) for a, b in spans]


def pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """``item, text, n_words``: the items' words, a longer item than a block in pieces that have its windows between them."""
    items = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"), text_bytes(text_col).alias("text"))

    def make():
        def row(item, text):
            own = words(text)
            starts = range(0, max(1, len(own) - window + 1), block_words) if own else ()
            cuts = [own[at : at + block_words + window - 1] for at in starts]
            return item, [{"text": b" ".join(cut), "n_words": len(cut)} for cut in cuts]

        return row

    cut = map_rows(items, "item string, parts array<struct<text:binary,n_words:int>>", make)
    return cut.select("item", F.inline("parts")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Hits of benchmark windows in every whole text.

    Returns per row of ``docs``: ``doc_id, n_words, n_hit`` (words inside any occurrence), ``n_items, items_sha256,
    contaminated`` (a hit, and hits make a twentieth of the words or more), ``items`` (sorted ids as strings) and ``spans``
    (hit ranges as character offsets in the text).

    A benchmark of ``block_words`` words or less is one automaton, and texts are scanned where they are read. A larger one is
    dealt into blocks (an item longer than a block is cut, without losing a window): the texts are read once a block in tasks
    of their own, so that a task has one block's automaton at a time and the driver one block's items; only hits are shuffled,
    by the text's digest, and merged per text. Null texts have no words, on either side; an item with a null id counts as the
    id ``''``; rows are independent, so repeated rows and null keys give a row each. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    listed = materialise(pieces(benchmark, item_col, item_text_col, window, block_words))
    blocks = max(1, -(-int(listed.agg(F.sum("n_words")).first()[0] or 0) // block_words))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = RESULT.format(kind=kind)
    if blocks == 1:
        own = spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in listed.select("item", "text").collect()])

        def whole():
            automaton = WindowAutomaton(own.value, window)

            def row(doc, text):
                text_words = words(text)
                spans, items = automaton.scan(text_words)
                return result(doc, len(text_words), spans, items, offsets(text, spans))

            return row

        return map_rows(texts, schema, whole)

    dealt = listed.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    shared = [spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in dealt.where(F.col("block") == n).collect()]) for n in range(blocks)]

    def in_block():
        held: list = [None, None]  # the block and its automaton

        def row(block, text):
            if block != held[0]:
                held[:] = None, None  # the last one goes before the next is built
                held[:] = block, WindowAutomaton(shared[block].value, window)
            spans, items = held[1].scan(words(text))
            places = offsets(text, spans)
            where = [{"low": a, "high": b, "start": c, "end": d} for (a, b), (c, d) in zip(spans, places, strict=True)]
            return digest_of(text), block, sorted(items), where

        return row

    hit = "digest binary, block int, items array<string>, spans array<struct<low:bigint,high:bigint,start:bigint,end:bigint>>"
    every = [texts.select(F.lit(n).alias("block"), "text") for n in range(blocks)]
    found = map_rows(reduce(DataFrame.union, every), hit, in_block).where(F.size("items") > 0)
    # equal texts have equal hits: one row for each text and block, so a group has no more rows than there are blocks
    by_text = found.groupBy("digest", "block").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))
    by_text = by_text.groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def counted():
        def row(doc, text):
            return doc, digest_of(text), len(words(text))

        return row

    def merging():
        def row(doc, n_words, items, spans):
            spans = [(s["low"], s["high"], s["start"], s["end"]) for s in spans or ()]
            ranges = merged([s[:2] for s in spans])
            first, last = {s[0]: s[2] for s in spans}, {s[1]: s[3] for s in spans}
            return result(doc, n_words, ranges, set(items or ()), [(first[a], last[b]) for a, b in ranges])

        return row

    rows = map_rows(texts, f"doc_id {kind}, digest binary, n_words bigint", counted)
    return map_rows(rows.join(by_text, "digest", "left").select("doc_id", "n_words", "items", "spans"), schema, merging)


def digest_of(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def result(doc: object, n_words: int, spans: list[tuple[int, int]], items: set[str], places: list[tuple[int, int]]) -> tuple:
    n_hit, names = sum(b - a for a, b in spans), sorted(items)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return doc, n_words, n_hit, len(names), digest, n_hit > 0 and 20 * n_hit >= n_words, names, [{"start": a, "end": b} for a, b in places]
