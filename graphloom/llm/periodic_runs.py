"""Runs: stretches of words that repeat with a period, found by probing a harmonic grid.

With w[i] the words of a text, a run of period p and length 3p or more holds w[i] = w[i + p] on 2p places in a row or
more, so on two neighbouring multiples of p. For each p, only the places jp are tested: n/1 + n/2 + n/3 + ... tests in
all. Where jp and (j + 1)p both pass, the match is extended to both sides by comparing chunks of growing size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let, named, prepared, words

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Grid places that are probed at once, and words that a step of an extension compares at first.
GRID, CHUNK = 65_536, 32
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def grid(n: int, low: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Periods and places jp of the probes with periods from low on, about GRID of them; and the next period."""
    periods = np.arange(low, min(n // LEAST_EXPONENT, low + GRID) + 1)
    counts = (n - 1) // periods - 1  # jp + 2p is a word
    upto = max(1, int(np.searchsorted(np.cumsum(counts), GRID, side="right")))
    periods, counts = periods[:upto], counts[:upto]
    of = np.repeat(periods, counts)
    j = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return of, j * of, int(periods[-1]) + 1


def first_mismatch(w: np.ndarray, at: int, p: int) -> int:
    """The least i >= at with w[i] != w[i + p]; n - p if there is none."""
    stop, size = len(w) - p, CHUNK
    while at < stop:
        upto = min(at + size, stop)
        differ = w[at:upto] != w[at + p : upto + p]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = upto, size * 2
    return stop


def last_mismatch(w: np.ndarray, at: int, p: int) -> int:
    """The greatest i < at with w[i] != w[i + p]; -1 if there is none."""
    size = CHUNK
    while at > 0:
        low = max(0, at - size)
        differ = (w[low:at] != w[low + p : at + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - 1 - k
        at, size = low, size * 2
    return -1


def find_runs(w: np.ndarray, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of word numbers w, by start, then period.

    A run has its smallest period and can't be extended; length is least_length and three periods at least. Periods are tried from 1
    on; places jp from which a found run reaches beyond (j + 2)p are passed over: a run through both would have a divisor of p as its
    period, and so be the found one.
    """
    n, low, runs = len(w), 1, []
    reach = np.zeros(n, dtype=np.int64)  # the furthest end of the runs that hold a place
    while low <= n // LEAST_EXPONENT:
        periods, places, low = grid(n, low)
        first, second = w[places], w[places + periods]
        hit = np.flatnonzero((first == second) & (second == w[places + 2 * periods]) & (reach[places] <= places + 2 * periods))
        done, of = 0, 0  # of period of, places before done are settled
        for p, at in zip(periods[hit].tolist(), places[hit].tolist(), strict=True):
            if (p == of and at < done) or reach[at] > at + 2 * p:
                continue
            start, stop = last_mismatch(w, at, p) + 1, first_mismatch(w, at, p)
            length, of, done = stop - start + p, p, stop
            if stop > at + p and length >= max(least_length, LEAST_EXPONENT * p):  # else the two places match by different stretches
                runs.append((start, length, p))
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones that of least start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """The runs of each text: key, n_words, runs (start, length, period, by start, then period), highest (its greatest exponent), collapsed.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly, and numbered from 0. collapsed is the text's words, one space between them, without those that a
    run holds after its first period. A null or empty text has no words, no runs, a null highest and an empty collapsed text. Repeated rows
    count each; other columns are ignored, whatever their names; a very long text is one row in one task, in memory of a few times its size; an
    empty table gives an empty result. Texts are independent, so nothing is shuffled.
    """
    prepared(docs.sparkSession)
    schema = f"key bigint, n_words bigint, runs array<{RUN}>, highest {RUN}, collapsed string"
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_rows = lambda runs: [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, found, best, collapsed = [], [], [], []
            for value in batch.column(1).to_pylist():
                own = (value or "").encode().split()  # bytes part at exactly these characters
                known: dict[bytes, int] = {}
                w = np.fromiter((known.setdefault(x, len(known)) for x in own), dtype=np.int64, count=len(own))
                runs = find_runs(w, least_length) if len(own) >= LEAST_EXPONENT else []
                counts.append(len(own))
                found.append(as_rows(runs))
                best.append(as_rows([highest(runs)])[0] if runs else None)
                if runs:
                    own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs))]
                collapsed.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), pa.array(collapsed, pa.string())],
                ["key", "n_words", "runs", "highest", "collapsed"],
            )

    ready = docs.select(named(key).cast("long").alias("key"), named(text).cast("string").alias("text"))
    return ready.mapInArrow(batches, schema).withColumnRenamed("key", key)


def repeated_tail(text: Column, key: Column) -> Column:
    """The text, for some keys with a tail that repeats: with h = crc32(key), g = h div 10 and n words, where h mod 10 is 0, each word i >= a becomes word a + (i - a) mod p.

    a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Such a text comes back as its words with one space between them; others stay as they are.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        passes = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(own, (a + 1).cast("int"), p.cast("int")), passes))
        whole = F.concat(F.slice(own, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise("")

    return F.when(F.pmod(h, F.lit(10)) == 0, let(words(text), planted)).otherwise(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of periodic_runs: key, n_runs, start, length, period and exponent_milli of the highest run, and SHA-256 of the list of runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("highest")
    return found.select(
        named(key),
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("highest.length * 1000 div highest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
