"""Token counts of sections, by attributing the tokens of whole documents.

A document is encoded once, so that token boundaries are those of the whole text. The encoder's tokens
spell the text's bytes without gaps, so cumulated byte lengths are exact offsets. Tokens and sections are
then joined as sorted intervals. A token that crosses a boundary goes to one section by a stated rule:
``start`` gives it to the section of its first byte, ``majority`` to the one that holds most of
its bytes, the earlier one on ties.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import named, prepared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("start", "majority")
SCHEMA = "doc_id long, section long, name string, char_start long, char_end long, n_tokens long, n_crossing long"


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str):
    """The tokenizer of the content of a vocabulary file of ranks, and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attributed(starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross its boundary.

    Tokens are disjoint sorted [starts, stops); sections too, [begins, ends), and may leave gaps. A token that no
    section's bytes meet is counted nowhere; with ``start`` neither is one that starts in a gap.
    """
    n = len(begins)
    if not n or not len(starts):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    at = np.searchsorted(begins, starts, side="right") - 1
    inside = (at >= 0) & (starts < ends[np.maximum(at, 0)])
    home = np.where(inside, at, -1)
    if rule == "majority":
        first, last = np.searchsorted(ends, starts, side="right"), np.searchsorted(begins, stops, side="left") - 1
        for i in np.flatnonzero((last > first) | ((last >= 0) & (first <= last) & (home < 0))):
            own = np.arange(first[i], last[i] + 1)
            held = np.minimum(ends[own], stops[i]) - np.maximum(begins[own], starts[i])
            home[i] = own[held.argmax()] if held.max() > 0 else -1
    counted = home >= 0
    crosses = counted & ((starts < begins[np.maximum(home, 0)]) | (stops > ends[np.maximum(home, 0)]))
    return np.bincount(home[counted], minlength=n), np.bincount(home[crosses], minlength=n)


def cut_sections(own: list | None, n_chars: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Of sections (name, start, stop) of a text: given bounds within the text, the bounds that count, and names.

    Sections are ordered by start, then as given; where one begins before those ahead of it end, it counts from there, so no character counts for
    two. A null section, one with a null bound and one that ends before it begins are empty, at their start or 0.
    """
    rows = [(s["name"], s["start"], s["stop"]) if s is not None else (None, None, None) for s in own or []]
    given = np.zeros((len(rows), 2), dtype=np.int64)
    for i, (_, start, stop) in enumerate(rows):
        begin = min(max(start or 0, 0), n_chars)
        given[i] = begin, max(begin, min(stop, n_chars)) if start is not None and stop is not None else begin
    order = np.lexsort((np.arange(len(rows)), given[:, 0]))
    counted = given[order]
    before = np.maximum.accumulate(np.concatenate([[0], counted[:, 1]]))[:-1]
    counted[:, 0] = np.maximum(counted[:, 0], before)
    counted[:, 1] = np.maximum(counted[:, 1], counted[:, 0])
    out = np.zeros_like(given)
    out[order] = counted
    return given, out, [name for name, _, _ in rows]


def count_in_sections(starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """attributed, for disjoint sections in any order, of which some may be empty and count nothing."""
    filled = np.flatnonzero(ends > begins)
    order = filled[np.argsort(begins[filled], kind="stable")]
    tokens, over = np.zeros(len(begins), dtype=np.int64), np.zeros(len(begins), dtype=np.int64)
    tokens[order], over[order] = attributed(starts, stops, begins[order], ends[order], rule)
    return tokens, over


def section_token_counts(docs: DataFrame, sections: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Tokens of each section of each document: doc_id, section, name, char_start, char_end, n_tokens, n_crossing.

    docs: doc_id, text, and by name a column of sections, array<struct<name, start, stop>> of code point ranges; without one, sections
    are the text's lines with their line ends, which cover it, so their counts add up to the document's tokens.
    Bounds are cut to the text. Sections may come in any order; a character in several counts for the one of least start, the first
    given on ties. Null sections, null bounds and ranges that end before they begin hold nothing. n_crossing of a section's tokens reach
    beyond what counts for it. A null or empty text has no sections; other columns are ignored, whatever their names; repeated rows are
    counted each; a very long text is encoded whole; an empty table gives an empty result. vocabulary is read on the driver and sent to the
    workers (a file of fixed size).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    prepared(spark)
    with open(vocabulary, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())
    text = F.col("text").cast("string")
    cuts = sections is not None  # a plain value: tasks can't hold columns
    given = [] if sections is None else [named(sections).cast("array<struct<name:string,start:long,stop:long>>").alias("sections")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(held.value, pattern)
        for batch in it:
            cut = batch.column(2).to_pylist() if cuts else [None] * batch.num_rows
            ids, number, names, start, stop, count, crossing = ([] for _ in range(7))
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cut, strict=True):
                if not text:
                    continue
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                ascii_only = len(data) == len(text)
                places = None if ascii_only else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                if not cuts:
                    breaks = np.flatnonzero(data == 10) + 1
                    begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(data)]])
                    if begin[-1] == len(data):
                        begin, end = begin[:-1], end[:-1]
                    chars = (begin, end) if ascii_only else (np.searchsorted(places, begin), np.searchsorted(places, end))
                    labels = ["line"] * len(begin)
                else:
                    told, counted, labels = cut_sections(own, len(text))
                    chars = told.T
                    begin, end = counted.T if ascii_only else places[counted.T]
                ends = np.cumsum(lengths[np.fromiter(encoding.encode_ordinary(text), dtype=np.int64)])
                tokens, over = count_in_sections(np.concatenate([[0], ends[:-1]]), ends, begin, end, rule)
                ids += [doc_id] * len(begin)
                number.append(np.arange(len(begin)))
                names += labels
                for to, x in ((start, chars[0]), (stop, chars[1]), (count, tokens), (crossing, over)):
                    to.append(x)
            flat = [np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (number, start, stop, count, crossing)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat[0]), pa.array(names, pa.string()), *[pa.array(x) for x in flat[1:]]], [c.split()[0] for c in SCHEMA.split(", ")])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *given)
    return ready.mapInArrow(batches, SCHEMA)
