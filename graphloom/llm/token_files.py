"""Token ids as Parquet files: encoded documents in order, with an index, for reads of chosen documents and token ranges.

A row is a document: part, doc_id, first (ids before it in its part), n_tokens, ids. Rows are in ascending doc_id order within a part and over
parts, and a part is one file. The id list is dictionary-encoded (or delta-encoded), the sorted number columns are delta-encoded, row
groups have a bounded size, and the writer adds page indexes, so a filter on doc_id, part or first reads only pages that can
match, and a query that names no ids never reads them. The table index holds what came before each part, so a place in the whole
sequence of ids is found without the id lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import named, prepared

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 2
#: Words up to so many bytes are remembered, and so many of them at most; memory of a worker doesn't follow the input.
WORD_BYTES, WORDS_HELD = 64, 500_000
#: ASCII signs that are neither letters nor digits nor white space, and ends of words made of them that are remembered.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
SIGNS_HELD = 10_000
#: Texts are encoded so many characters at a time, and new words so many at once.
CHUNK_CHARS, WORDS_AT_ONCE = 4_000_000, 20_000
ENCODINGS = ("dictionary", "delta")
ROW_GROUP_BYTES, ROW_GROUP_ROWS, PAGE_BYTES, PAGE_ROWS = 32 << 20, 50_000, 128 << 10, 1000
SCHEMA = "part int, doc_id long, first long, n_tokens long, ids array<int>"


class WordIds:
    """Ids of texts, little-endian 32-bit, by the ids of their words; each word is encoded when first met, and words met again are remembered.

    encode gives ids and places of tokens in a text. letters, if given, gives the ids of a word of a-z, and then a word of ASCII letters
    with signs behind is those of its letters in lower case and of its signs.
    """

    def __init__(self, encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]], letters: Callable[[str], list[int]] | None = None) -> None:
        self.encode, self.letters, self.held, self.signs, self.again = encode, letters, {}, {b"": b""}, set()

    def _learn(self, words: list[bytes]) -> None:
        if self.letters is not None:
            rest = []
            for w in words:
                stem = w.rstrip(SIGNS)
                signs = self.signs.get(w[len(stem) :])
                if stem.isalpha() and len(w) <= WORD_BYTES and signs is not None:
                    self.held[w] = np.array(self.letters(stem.lower().decode()), dtype="<i4").tobytes() + signs
                else:
                    rest.append(w)
            words = rest
        self._learn_together(words)

    def _learn_together(self, words: list[bytes]) -> None:
        """Encode words with a space between; a token belongs to the word that its first character stands in."""
        texts = [w.decode() for w in words]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        ids, places = self.encode(" ".join(texts))
        owner = np.searchsorted(starts, np.array([a for a, _ in places], dtype=np.int64), side="right") - 1
        bounds = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        data = np.array(ids, dtype="<i4").tobytes()
        self.held.update(zip(words, [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        words = [t.encode().split() for t in texts]  # bytes part at white space of ASCII only
        asked = set().union(*words)
        known = asked & self.held.keys()
        new = list(asked - known)
        if self.letters is not None:
            tails = {w[len(w.rstrip(SIGNS)) :] for w in new} - self.signs.keys()
            self._learn_together(own := [t for t in tails if len(t) < 4])
            self.signs |= {t: self.held[t] for t in own} if len(self.signs) < SIGNS_HELD else {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[at : at + WORDS_AT_ONCE])
        out = [b"".join(map(self.held.__getitem__, own)) for own in words]
        self.again |= known
        for w in new:
            if len(w) > WORD_BYTES:
                self.held.pop(w, None)
        if len(self.held) > WORDS_HELD:
            self.held = {w: self.held[w] for w in self.again} if len(self.again) < WORDS_HELD // 2 else {}
            self.again = set()
        return out


@lru_cache(maxsize=2)
def text_encoder(vocabulary: bytes) -> Callable[[list[str]], list[bytes]]:
    """What gives the ids of whole texts, little-endian 32-bit, by a tokenizer's content.

    If the tokenizer drops white space, then no token, normalisation or merge reaches over a space: the ids of a text are those of its parts between
    spaces, tabs and line ends, one after another, and words are remembered. That is tried on the tokenizer itself; else each text is encoded as it stands.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode())
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    spaces = " \t\n\x0b\x0c\r"
    if any(ids(space) for space in (*spaces, " \n ")) or any(ids(f"a{space}b") != ids("a") + ids("b") for space in spaces):
        return lambda texts: [np.array(ids(t), dtype="<i4").tobytes() for t in texts]

    def placed(text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    letters = lambda word: [t.id for t in tokenizer.model.tokenize(word)]
    signs = [bytes([c]).decode() for c in SIGNS]
    tried = [("Ab", "ab"), ("Z", "z"), ("theQUICKbrown", "thequickbrown"), ("xqzjk", "xqzjk")]
    parted = all(ids(f"{x}{y}{z}") == letters(low) + ids(f"{y}{z}") for x, low in tried for y in signs for z in ("", "*", "'", ">"))
    return WordIds(placed, letters if parted and all(ids(x) == letters(low) for x, low in tried) else None).of


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about CHUNK_CHARS characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_token_files(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int | None = END,
    encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, row_group_rows: int = ROW_GROUP_ROWS,
    page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode each whole text, append the id end if any, and write the ids in ascending key order to path/ids, and path/index.

    Null and empty texts are documents of the end id alone; null keys come first; repeated keys are ordered by a hash of their texts, and equal
    rows are each a document. Other columns are ignored, whatever their names. An empty table gives files of no rows. A very long text is one
    row, encoded whole. One shuffle deals rows to ranges of keys (and of texts for a repeated key); a task encodes its range in order. The file
    vocabulary (of fixed size) is read on the driver and sent to the workers.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    prepared(spark)
    with open(vocabulary, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = text_encoder(held.value), b"" if end is None else np.array([end], dtype="<i4").tobytes()
        context, first = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        for batch in it:
            own = [ids + tail for part_ in chunks([t or "" for t in batch.column(1).to_pylist()]) for ids in ids_of(part_)]
            sizes = np.array([len(ids) // 4 for ids in own], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(np.frombuffer(b"".join(own), dtype="<i4")))
            starts = pa.array(first + offsets[:-1])
            first += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), batch.column(0), starts, pa.array(sizes), ids], ["part", "doc_id", "first", "n_tokens", "ids"])

    rows = docs.select(named(key).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.mapInArrow(batches, SCHEMA).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for c in ("part", "doc_id", "first", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer = writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.block.row.count.limit", row_group_rows)
    writer = writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    writer.parquet(f"{path}/ids")
    parts = documents(spark, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("before", before).write.parquet(f"{path}/index")  # a row for each file


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written token files."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/ids")


def token_rows(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before), n_tokens and, if asked, ids.

    A condition on doc_id, part, first or n_tokens is pushed down to row groups and pages; without ids the lists are not read.
    """
    rows = documents(spark, path) if where is None else documents(spark, path).where(where)
    index = spark.read.parquet(f"{path}/index").select(F.col("part").alias("of"), "before")
    joined = rows.join(index, F.col("part") == F.col("of"))
    return joined.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids at places [start, stop) of the whole sequence: doc_id, start, ids, for each document that has some there.

    The index tells the parts that the range meets, and which places of them; other parts' files are skipped by their statistics.
    """
    index = spark.read.parquet(f"{path}/index").where((F.col("before") < stop) & (F.col("before") + F.col("n_tokens") > start))
    parts = index.agg(F.min("part").alias("low"), F.max("part").alias("high")).first()
    if parts.low is None or stop <= start:
        return token_rows(spark, path, F.lit(False)).select("doc_id", "start", "ids")
    found = token_rows(spark, path, F.col("part").between(parts.low, parts.high)).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    begin, upto = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    own = F.slice("ids", (begin + 1).cast("int"), (upto - begin).cast("int"))
    return found.select("doc_id", (F.col("start") + begin).alias("start"), own.alias("ids"))


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens of rows of token files as read back, and ids_crc32: of the ids as little-endian unsigned 32-bit integers."""
    prepared(rows.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(3)
            data = lists.values.to_numpy().astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
