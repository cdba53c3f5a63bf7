"""Secret scans: fixed patterns, and the guess cost of values in a credential's context.

The guess cost of a value is the least sum, over all ways to cut it into segments, of the bits that an
attacker needs for each: a word by its rank and case, a date, a copy of what the value holds before, a
walk over neighbouring keys, a series of the alphabet or digits, or characters by brute force, each from all the classes that
its segment uses. The price of walks, series, copies and brute force grows by a fixed amount a character, so
dynamic programming over the value's positions, with one state for each way that an open segment may go on, finds the least
cost over all segments of any length in time linear in the value's. A value that costs enough is a secret even if no pattern knows it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepared

#: The base patterns, the least length of what they must match, and the order of kinds.
ASSIGN = re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: Contexts in which a value is weighed: a credential's name, then = or :.
CONTEXT = re.compile(r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|private[_-]?key|credential|auth|bearer)[\"']?[\x20\t]*(?:[:=]|=>)[\x20\t]*[\"']?([^\s\"'<>,;]+)", re.ASCII)
#: A bearer token after white space: any value in a header, else one with a digit or mixed case, so that prose about bearers has none.
BEARER = re.compile(r"(?:(?i:authorization[\"']?[\x20\t]*[:=][\x20\t]*[\"']?bearer)|\b(?i:bearer)(?=[\x20\t]+[\"']?[^\s\"'<>,;]*?(?:[0-9]|[a-z][A-Z])))[\x20\t]+[\"']?(?![:=])([^\s\"'<>,;]+)", re.ASCII)
#: Common words of passwords, most frequent first.
WORDS = """password 123456 qwerty admin welcome letmein monkey dragon iloveyou master sunshine princess football secret login
test hello default changeme user root guest access token example sample public private server database demo please enter your
value none null true false string here insert replace placeholder dummy temp code pass word key name company summer winter spring autumn
love baby angel michael jordan shadow superman batman trustno1 whatever freedom flower orange banana cookie computer internet""".split()
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
#: Further words come from a vocabulary file of ranks, read on the driver: see vocabulary_ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEET = str.maketrans("@4310$5!7", "aaeiossit")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
MIN_VALUE, MIN_BITS = 8, 40.0

#: Prices in bits. Every segment pays SEGMENT; a walk starts at one of 47 keys, turns to one of eight neighbours or goes straight
#: on; a series starts at one of 36 letters and digits, goes up or down and then on; a copy starts at one of the places before it.
SEGMENT = 1.0
WALK_START, WALK_TURN, WALK_ON = log2(47), 3.0, 0.6
SERIES_START, SERIES_WAY, SERIES_ON = log2(36), 1.0, 0.3
COPY_ON, SHORTEST = 0.4, 3
#: Dates by form: a year of two hundred, with a month, with a day.
YEAR, MONTH, DAY, PART = r"(?:19|20)[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"[-/.]?"
DATES = ((re.compile(YEAR), log2(200)), (re.compile(YEAR + PART + MONTH), log2(200 * 12)), (re.compile(f"{YEAR}{PART}{MONTH}{PART}{DAY}|{DAY}{PART}{MONTH}{PART}{YEAR}"), log2(200 * 366)))
DATE_LENGTHS = (4, 6, 7, 8, 9, 10)

NEVER = float("inf")
DIGIT, SMALL, CAPITAL, SIGN, OTHER = 1, 2, 4, 8, 16
#: Bits of one character by the set of classes it may come from: digits, lower and upper case, other ASCII, the rest.
CLASS_BITS = [log2(max(1, sum(size for k, size in enumerate((10, 26, 26, 33, 1000)) if mask >> k & 1))) for mask in range(32)]
_KEY_AT = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


def vocabulary_ranks(content: bytes) -> dict[str, int]:
    """WORDS, then the words of a vocabulary file (base64 token, rank; a line each) in its order, with ranks from 1.

    Its words are the tokens of a space and four or more letters A-Z of either case: tokens within words would make words of chance.
    """
    ranks = dict(RANKS)
    for _, token in sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, content.splitlines())):
        found = re.fullmatch(rb" ([A-Za-z]{4,})", token)
        if found:
            ranks.setdefault(found[1].decode().lower(), len(ranks) + 1)
    return ranks


def _class_of(c: str) -> int:
    return OTHER if not c.isascii() else DIGIT if c.isdigit() else SMALL if c.islower() else CAPITAL if c.isupper() else SIGN


def _key_way(a: str, b: str) -> tuple[int, int] | None:
    """The way from a key to a neighbouring one, else None."""
    p, q = _KEY_AT.get(a), _KEY_AT.get(b)
    if p is None or q is None or a == b or abs(p[0] - q[0]) > 1 or abs(p[1] - q[1]) > 1:
        return None
    return q[0] - p[0], q[1] - p[1]


def _series_way(a: str, b: str) -> int | None:
    """1 or -1 from a letter or digit to the next or the one before, else None."""
    alike = a.isascii() and b.isascii() and ((a.isdigit() and b.isdigit()) or (a.isalpha() and b.isalpha()))
    return ord(b) - ord(a) if alike and abs(ord(b) - ord(a)) == 1 else None


#: How walks and series may be cased: no capital; capitals alone; a capital first; any, at a bit a character. For each, what a character costs
#: by its class at the front and after it, to begin with and further on.
CASES = (
    (lambda own: 0.0 if own != CAPITAL else NEVER, lambda own: 0.0 if own != CAPITAL else NEVER),
    (lambda own: 1.0 if own != SMALL else NEVER, lambda own: 0.0 if own != SMALL else NEVER),
    (lambda own: 1.0 if own == CAPITAL else NEVER, lambda own: 0.0 if own != CAPITAL else NEVER),
    (lambda own: 1.0, lambda own: 1.0),
)


class _Run:
    """The least cost of an open walk or series by its casing and length (1, 2, 3 or more)."""

    def __init__(self, start: float, turn: float, on: float, must_go_on: bool) -> None:
        self.start, self.turn, self.on, self.other = start, turn, on, NEVER if must_go_on else turn
        self.open = [[NEVER] * 3 for _ in CASES]

    def goes(self, before: float, own: int, usable: bool, way: object, last_way: object) -> float:
        """Take one more character, which way leads to; before is the least cost without it. Returns the least cost of a run that ends here."""
        further = NEVER if way is None else self.on if way == last_way else self.other
        for held, (first, after) in zip(self.open, CASES, strict=True):
            rest = after(own)
            held[2] = min(held[1], held[2]) + further + rest
            held[1] = held[0] + (NEVER if way is None else self.turn) + rest
            held[0] = before + self.start + SEGMENT + first(own) if usable else NEVER
        return min(held[2] for held in self.open)


def _earlier_suffixes(text: str) -> list[int]:
    """For each prefix of text the length of its longest suffix that also ends before: the links of a suffix automaton, built a character at a time."""
    follow: list[dict[str, int]] = [{}]
    link, length, last, out = [-1], [0], 0, []
    for c in text:
        new, at = len(length), last
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            to = follow[at][c]
            if length[to] != length[at] + 1:
                split = len(length)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = split
                while at >= 0 and follow[at].get(c) == to:
                    follow[at][c] = split
                    at = link[at]
                to = split
            link[new] = to
        last = new
        out.append(length[link[new]])
    return out


def _word_bits(piece: str, low: str, plain: str, ranks: dict[str, int]) -> float:
    """Bits of a word: its rank; a bit for signs in letters' stead; nothing, one bit (capitals alone or a capital first) or a bit a character for case."""
    straight, signed = ranks.get(low), ranks.get(plain)
    if straight is None and signed is None:
        return NEVER
    rank = min(log2(straight + 1) if straight else NEVER, log2(signed + 1) + (low != plain) if signed else NEVER)
    return rank + (0 if piece == low else 1 if piece in (low.upper(), low.capitalize()) else len(piece)) + SEGMENT


def guess_bits(value: str, ranks: dict[str, int] = RANKS, longest: int | None = None) -> float:
    """Bits of the cheapest segmentation of a value; 0 for an empty one. longest: the length of the longest word, if known.

    Eight letters and digits by brute force cost 48.6 bits where both cases and digits occur, 42.4 with one case and digits, 46.6 with
    both cases, and 38.6 with one case alone; a capital at the front of lower case costs one bit. Two brute-force segments never
    follow each other: they are one, of both's classes.
    """
    n, low = len(value), value.translate(LOWER)
    plain, longest = low.translate(LEET), longest or max(map(len, ranks))
    used = [_class_of(c) for c in value]
    all_used = 0
    for u in used:
        all_used |= u
    brute = dict.fromkeys((m for m in range(1, 32) if m | all_used == all_used), NEVER)  # open brute-force segments by their classes
    walk, series = _Run(WALK_START, WALK_TURN, WALK_ON, False), _Run(SERIES_START, SERIES_WAY, SERIES_ON, True)
    key_way = series_way = None
    best, closed = [0.0], 0.0  # closed: the least cost up to here that doesn't end in brute force
    known, copies = _earlier_suffixes(value), deque()  # copies: places to start one from, by rising cost (place, cost but for what length adds)
    for i in range(1, n + 1):
        own, before = used[i - 1], best[i - 1]
        for mask, spent in brute.items():
            begun = closed + SEGMENT if mask & own else closed + SEGMENT + 1 if own == CAPITAL and mask & SMALL else NEVER
            brute[mask] = min(begun, spent if mask & own else NEVER) + CLASS_BITS[mask]
        last_key, last_series = key_way, series_way
        key_way = _key_way(low[i - 2], low[i - 1]) if i > 1 else None
        series_way = _series_way(low[i - 2], low[i - 1]) if i > 1 else None
        cost = walk.goes(before, own, low[i - 1] in _KEY_AT, key_way, last_key)
        cost = min(cost, series.goes(before, own, own in (DIGIT, SMALL, CAPITAL), series_way, last_series))
        for k in range(SHORTEST, min(longest, i) + 1):
            bits = _word_bits(value[i - k : i], low[i - k : i], plain[i - k : i], ranks)
            if bits < NEVER:
                cost = min(cost, best[i - k] + bits)
        for k in DATE_LENGTHS:
            if k <= i and used[i - 1] == used[i - k] == DIGIT:
                for form, bits in DATES:
                    if form.fullmatch(value, i - k, i):
                        cost = min(cost, best[i - k] + bits + SEGMENT)
        place = i - SHORTEST
        if place >= 1:
            from_here = best[place] + log2(place) - COPY_ON * place
            while copies and copies[-1][1] >= from_here:
                copies.pop()
            copies.append((place, from_here))
        while copies and copies[0][0] < i - known[i - 1]:
            copies.popleft()
        if copies:
            cost = min(cost, copies[0][1] + COPY_ON * i + SEGMENT)
        closed = cost
        best.append(min(cost, min(brute.values())))
    return best[n]


def secret_spans(text: str, ranks: dict[str, int] = RANKS, longest: int | None = None) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the secrets of a text, in code points, by start, then kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted((a, b) for a, b, _ in spans)
    begins, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    values = [m.span(1) for m in CONTEXT.finditer(text)]
    known = [a for a, _ in values]  # in order, and apart from each other
    for m in BEARER.finditer(text):
        at = bisect_left(known, m.end(1))
        if at == 0 or values[at - 1][1] <= m.start(1):
            values.append(m.span(1))
    for start, stop in values:
        before = bisect_left(begins, stop)  # base spans that begin before the value ends
        met = before > 0 and furthest[before - 1] > start
        if stop - start >= MIN_VALUE and not met and guess_bits(text[start:stop], ranks, longest) >= MIN_BITS:
            spans.append((start, stop, "guess"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    docs: doc_id and text; other columns are ignored, whatever their names. A null text counts as empty and has no spans;
    repeated rows are scanned each; a very long text is scanned whole, a value in time linear in its length; an empty table gives an empty result.
    base_sha256 is the hex digest of the spans of the three fixed patterns; spans holds those and the ones of kind guess. vocabulary, a file of
    fixed size, adds ranked words to WORDS; it is read on the driver and its words are sent to the workers.
    """
    spark = docs.sparkSession
    prepared(spark)
    ranks = RANKS
    if vocabulary is not None:
        with open(vocabulary, "rb") as file:
            ranks = vocabulary_ranks(file.read())
    held = spark.sparkContext.broadcast((ranks, max(map(len, ranks))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts: list[list[int]] = [[], [], [], []]
            digests, texts = [], []
            for text in batch.column(1):
                spans = secret_spans(text.as_py() or "", *held.value)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in spans))
                digests.append(hashlib.sha256(joined([s for s in spans if s[2] != "guess"]).encode()).hexdigest())
                texts.append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(texts)], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(batches, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
