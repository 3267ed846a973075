"""Phrases whose words stand together more often than their parts would have it.

Count-min sketches, one for a share of the partitions, overestimate and never underestimate when they are merged, so that a phrase
whose estimate is under the threshold is not frequent. They are made twice over: of phrases of one and two words, then of
those of three and four words whose parts are left, which spares the second ones nearly all phrases that stand once. What
is kept of a merged sketch is a bit for each cell. A last pass counts the survivors exactly, as texts. Scores and subsumption
are joins of the frequent phrases alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, released, table
from .components import shared_folder

LONGEST, LEAST, TOP = 4, 30, 2000
#: What a score is scaled by, and the share (in hundredths) of a phrase's places from which a longer one stands for it.
SCALE, SHARE = 2_000_000, 80
#: Sizes of the phrases that are sketched together. Later ones are sketched only where all their parts survive.
ROUNDS = ((1, 2), (3, 4))
#: Rows of a sketch, the least and most cells of a row, and bytes of text for a cell between them.
DEPTH, NARROWEST, WIDEST, CELL = 3, 1 << 16, 1 << 27, 64
#: Cells of a piece of the sketch, the unit that is merged.
PIECE = 1 << 16
#: Bytes of text that are turned into arrays at once.
BLOCK = 2 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of some texts: their numbers, hashes with their language's, and pieces, which phrases don't leave."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs: list[str] = sorted(set(langs))
        place = {x: i for i, x in enumerate(self.langs)}
        texts = [x.translate(_LOWER) for x in texts]
        tokens = pc.split_pattern(pa.array([b"\n".join(texts).replace(b"\n", b" \n ")], pa.large_binary()), " ").values.dictionary_encode()
        ids, self.words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary.to_pylist()
        number = {w: i for i, w in enumerate(self.words) if len(w) < 2}
        ends = ids == number.get(b"\n", -1)
        word = ~ends & (ids != number.get(b"", -1))
        of_piece = np.repeat(np.array([place[x] for x in langs], np.int64), [x.count(b"\n") + 1 for x in texts])
        self.ids = ids[word]
        self.piece = np.cumsum(ends, dtype=np.int32)[word]
        self.lang = of_piece[self.piece]
        del tokens, texts, ids, ends, word
        self.own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)[self.ids]
        self.seed = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)[self.lang]

    def hashed(self, passed: Sequence[Survivors] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the phrases of n words, for n from 1. A phrase's place is that of its first word.

        ``passed`` are the merged sketches of the first rounds: what one doesn't hold is left out, as is every longer phrase around it.
        """
        total = len(self.ids)
        places, h = np.arange(total), _mixed(self.seed ^ self.own)
        for n in range(1, LONGEST + 1):
            for sizes, sketch in zip(ROUNDS, passed, strict=False):
                if n in sizes:
                    inside = sketch.holds(h)
                    places, h = places[inside], h[inside]
            yield n, places, h
            there = np.zeros(total + 1, bool)
            there[places] = True
            inside = (places + n < total) & there[places + 1]
            places, h = places[inside], h[inside]
            inside = self.piece[places] == self.piece[places + n]
            places, h = places[inside], h[inside]
            h = _mixed(h * _M[0] + self.own[places + n])


def _cells(h: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; ``width`` is at most 2^32."""
    low = ((h >> np.uint64(32)) * np.uint64(2 * row + 1) + h) & np.uint64(0xFFFFFFFF)
    return ((low * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


class Survivors:
    """Which cells of a merged sketch count enough: a bit for each, packed, by row and piece; a piece that lacks has none."""

    def __init__(self, bits: dict[tuple[int, int], bytes], width: int):
        self.width = width
        empty = [bytes((min(PIECE, width - k) + 7) // 8) for k in range(0, width, PIECE)]
        self.rows = [np.frombuffer(b"".join(bits.get((row, k), x) for k, x in enumerate(empty)), np.uint8) for row in range(DEPTH)]

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be that of a frequent phrase."""
        there = np.ones(len(h), bool)
        for row, bits in enumerate(self.rows):
            cells = _cells(h, self.width, row)
            there &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
        return there


def _add(sketch: np.ndarray, cells: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add counts (of one byte) to cells, of which several may be the same; what would pass ``most`` stays there."""
    both = np.sort((cells.astype(np.uint64) << np.uint64(8)) | counts)
    at = (both >> np.uint64(8)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    if len(first):
        sums = np.add.reduceat((both & np.uint64(255)).astype(np.uint32), first)
        sketch[at[first]] = np.minimum(sketch[at[first]] + sums, most)


def _blocks(batches) -> Iterator[Block]:
    """Blocks of batches (lang, text)."""
    for part in chunks(batches, 1, BLOCK):
        langs = part.column(0).to_pylist()
        texts = [b"" if x is None else x for x in part.column(1).cast(pa.binary()).to_pylist()]
        yield Block(langs, texts)


def width_for(n_bytes: int) -> int:
    """Cells of a row of a sketch for texts of so many bytes. It decides how many phrases survive, never what is found."""
    return min(WIDEST, max(NARROWEST, n_bytes // CELL))


def survivors(texts: DataFrame, least: int, width: int, sketches: int, passed: list) -> dict[tuple[int, int], bytes]:
    """A bit for each cell of the merged sketch of one round over texts (lang, text): whether it counts ``least`` or more; by row and piece.

    ``passed`` are the broadcast bits of the rounds before. A sketch is that of a share of the partitions, ``sketches`` of them at most. It goes out in pieces, of which each is merged by
    itself. Its size is ``width`` and so bounded. Cells stop at ``least`` (or at 255, where it is greater), as more says no more.
    """
    most, sizes = min(least, 255), ROUNDS[len(passed)]

    def add(batches):
        sketch, before = np.zeros((DEPTH, width), np.uint8), [Survivors(x.value, width) for x in passed]
        for block in _blocks(batches):
            for n, _, h in block.hashed(before):
                if n in sizes:
                    distinct, counts = np.unique(h, return_counts=True)
                    counts = np.minimum(counts, most).astype(np.uint64)
                    for row in range(DEPTH):
                        _add(sketch[row], _cells(distinct, width, row), counts, most)
                if n == sizes[-1]:
                    break
        for row in range(DEPTH):
            for k in range(0, width, PIECE):
                cells = sketch[row, k : k + PIECE]
                if cells.any():
                    kept = zlib.compress(cells.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k // PIECE], pa.int32()), pa.array([kept], pa.binary())], ["row", "piece", "cells"])
        released()

    def merge(key: tuple[pa.Scalar, ...], held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in held:
            for x in batch.column("cells").to_pylist():
                cells = np.frombuffer(zlib.decompress(x), np.uint8).astype(np.uint16)
                total = cells if total is None else np.minimum(total + cells, most)
        bits = np.packbits(total >= most).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([bits], pa.binary())], ["row", "piece", "bits"])

    shares = texts.coalesce(sketches).mapInArrow(add, "row int, piece int, cells binary")
    merged = shares.groupBy("row", "piece").applyInArrow(merge, "row int, piece int, bits binary")
    return {(r["row"], r["piece"]): bytes(r["bits"]) for r in merged.toLocalIterator()}


def counted(texts: DataFrame, passed: list, width: int) -> DataFrame:
    """lang, phrase, size and f of every surviving phrase of texts (lang, text), and at size 0 the words of each language.

    ``passed`` are the broadcast bits of all rounds. A phrase is numbered by the number of its beginning and its last word, so that
    equal numbers are equal words. One survives where both parts of a word less do, too: they are no rarer.
    """

    def run(batches):
        before = [Survivors(x.value, width) for x in passed]
        for block in _blocks(batches):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for k, n in enumerate(np.bincount(block.lang, minlength=len(block.langs)).tolist()):
                for column, x in zip(rows, (block.langs[k], "", 0, n), strict=True):
                    column.append(x)
            total, base = len(block.ids), len(block.words) + 1
            names = np.full(total, -1, np.int64)
            for n, places, _ in block.hashed(before):
                begin = block.lang[places] if n == 1 else names[places]
                _, first, inverse, f = np.unique(begin * base + block.ids[places + n - 1], return_index=True, return_inverse=True, return_counts=True)
                names = np.full(total, -1, np.int64)
                names[places] = inverse
                for at in places[first].tolist():
                    rows[0].append(block.langs[block.lang[at]])
                    rows[1].append(b" ".join([block.words[i] for i in block.ids[at : at + n].tolist()]).decode())
                rows[2].extend([n] * len(first))
                rows[3].extend(f.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], ["lang", "phrase", "size", "f"])
        released()

    found = texts.mapInArrow(run, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def _part(begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("w", begin, size), " ")


def phrase_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language the ``top`` phrases of two to four words with ``least`` places
    or more, by score; l and r count the parts at the cut that scores lowest.

    A null language is ``und``; null and empty texts have no words; repeated rows count again; ties go to more places, then to the smaller
    phrase (in bytes). No texts, no rows. A phrase inside a longer one that has four fifths of its places is left out.
    ``width`` (cells of a row of a sketch) changes how many phrases are counted in vain, and no result.
    """
    shared_folder(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width or width_for(n_bytes)
    # A sketch for each core. Shares are smaller where there are more of them, and so emptier are their sketches, which are sent compressed.
    sketches = docs.sparkSession.sparkContext.defaultParallelism
    passed: list = []
    for _ in ROUNDS:
        passed.append(docs.sparkSession.sparkContext.broadcast(survivors(texts, least, width, sketches, list(passed))))
    counts = counted(texts, passed, width).where((F.col("f") >= least) | (F.col("size") == 0)).checkpoint()
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("size > 0").select("lang", "phrase", F.col("f").alias("of"))
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cut = found.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("size")).alias("_r"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("_l"), F.col("of").alias("l")), ["lang", "_l"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("_r"), F.col("of").alias("r")), ["lang", "_r"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"({SCALE} * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    longer = found.where("size > 2").withColumn("w", F.split("phrase", " ")).withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)))
    longer = longer.groupBy("lang", _part(F.col("_i"), F.col("_n")).alias("phrase")).agg(F.max("a").alias("inside"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * wide("inside") < SHARE * wide("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of all ``documents``."""
    return phrase_collocations(table(spark, sf_dir, "documents").select("lang", "text"))
