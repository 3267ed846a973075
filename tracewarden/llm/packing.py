"""Packing token sequences into windows by non-negative least squares.

Within a block of documents, what is left of each document after whole windows is counted in
a histogram of quantised lengths. Shallow combinations of lengths that fill a window are the
columns of a matrix; non-negative least squares finds how often each is to be used so that
the histogram is consumed. The counts are rounded down, carried out, and what remains is
packed greedily, cutting documents at window ends.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, released, table, texts

WINDOW, BINS = 4096, 64
#: Tokens held at once by a task; a longer document makes a block of its own.
BLOCK_TOKENS = 1 << 22
MOST_UNITS = 400_000
#: Words given to the tokenizers library as one text; each ends with a token that ends a word.
JOINED = 64


def combinations(bins: int) -> np.ndarray:
    """Columns: how many pieces of each bin (1 to ``bins``, at row bin-1) fill a window of ``bins`` units.

    Pairs, triples, and k equal pieces with one more that fills the rest; each at most once.
    """
    found = set()
    for i in range(1, bins + 1):
        for j in range(i, bins + 1 - i):
            rest = bins - i - j
            found.add((i, j) if rest == 0 else tuple(sorted((i, j, rest))))
        k, rest = divmod(bins, i)
        found.add((i,) * k + ((rest,) if rest else ()))
    out = np.zeros((bins, len(found)))
    for c, pieces in enumerate(sorted(found)):
        for p in pieces:
            out[p - 1, c] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson).

    A zero or empty ``b`` gives zeros.
    """
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * n):
        pull = np.where(free, -np.inf, a.T @ (b - a @ x))
        if pull.max(initial=-np.inf) <= least:
            break
        free[pull.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            below = free & (trial <= 0)
            if not below.any():
                x = trial
                break
            step = (x[below] / (x[below] - trial[below] + 1e-300)).min()
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


_TABLES: dict[int, np.ndarray] = {}


def pack_block(lengths: list[int], window: int = WINDOW, bins: int = BINS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold every token of every item once.

    Zero lengths give no piece. Sequences but the last ones are full; the last tokens go to
    sequences of powers of two, which need no padding.
    """
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    unit = window // bins
    shelves: list[list[int]] = [[] for _ in range(bins + 1)]
    begun = [0] * len(lengths)
    for i, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            out.append((i, start, window, seq, 0))
            seq += 1
        begun[i] = n - n % window
        if n % window:
            shelves[-(-(n % window) // unit)].append(i)
    if bins not in _TABLES:
        _TABLES[bins] = combinations(bins)
    a = _TABLES[bins]
    x = np.floor(nnls(a, np.array([len(s) for s in shelves[1:]], float)) + 1e-6).astype(int)
    gaps: list[tuple[int, int]] = []  # sequence, tokens used
    for c in np.argsort(-x, kind="stable"):
        if x[c] == 0:
            break
        need = [(b + 1, int(k)) for b, k in enumerate(a[:, c]) if k]
        for _ in range(min([int(x[c]), *(len(shelves[b]) // k for b, k in need)])):
            used = 0
            for b, k in need:
                for _ in range(k):
                    i = shelves[b].pop()
                    n = lengths[i] - begun[i]
                    out.append((i, begun[i], n, seq, used))
                    used += n
            if used < window:
                gaps.append((seq, used))
            seq += 1
    # What remains: the shortest fill the gaps, then the longest are laid end to end.
    rest = [i for s in shelves for i in s]
    low, high = 0, len(rest) - 1

    def lay(i: int, most: int, s: int, used: int) -> int:
        n = min(lengths[i] - begun[i], most)
        out.append((i, begun[i], n, s, used))
        begun[i] += n
        return n

    short = []
    for s, used in gaps:
        while used < window and low <= high:
            used += lay(rest[low], window - used, s, used)
            low += begun[rest[low]] == lengths[rest[low]]
        if used < window:
            short.append(s)
    left = sum(lengths[i] - begun[i] for i in rest[low : high + 1])
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        used = 0
        while used < room:
            used += lay(rest[high], room - used, seq, used)
            high -= begun[rest[high]] == lengths[rest[high]]
        seq += 1
        left -= room
    # Nothing was left for these: their pieces are laid anew, end to end.
    if short:
        lost = set(short)
        again = [p for p in out if p[3] in lost]
        out = [p for p in out if p[3] not in lost]
        out += _end_to_end([p[:3] for p in again], seq, window)
    return _numbered(out)


def _end_to_end(pieces: list[tuple[int, int, int]], seq: int, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces one after the other in full windows and, for the last tokens, powers of two."""
    out, left, k, done = [], sum(p[2] for p in pieces), 0, 0
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        used = 0
        while used < room:
            i, start, n = pieces[k]
            take = min(n - done, room - used)
            out.append((i, start + done, take, seq, used))
            used, done = used + take, done + take
            if done == n:
                k, done = k + 1, 0
        seq, left = seq + 1, left - room
    return out


def _numbered(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The same pieces with sequences numbered from 0 without holes."""
    names: dict[int, int] = {}
    return [(i, start, n, names.setdefault(s, len(names)), at) for i, start, n, s, at in pieces]


class UnitIds:
    """Ids of texts by the tokenizers library, one unit between white space at a time.

    The vocabulary drops white space before it cuts words, so no token crosses a unit; equal units
    are encoded once. Held units are bounded: at the bound those that the chunk does not need go.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.held: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.odd = re.compile("[\u0130\u0250-\U0010ffff]").search
        # Only after letters and digits that neither normalising nor lowering ends with another kind of character.
        self.stop = re.compile("([.,])(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,])(?=[\t-\r ])").sub

    def learn(self, units: list[str]) -> None:
        """Encode units that are not held yet."""
        held = self.held
        if len(held) > MOST_UNITS:
            held = self.held = {u: x for u in units if (x := held.get(u)) is not None}
        new = [u for u in units if u not in held]
        words = [u for u in new if u.isalpha()]
        others = [u for u in new if not u.isalpha()]
        lots = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.ends[flat]) + 1) * 4
            if len(ends) != len(lot):
                others += lot
                continue
            flat, at = flat.tobytes(), 0
            for u, end_at in zip(lot, ends.tolist(), strict=True):
                held[u] = flat[at:end_at]
                at = end_at
        for u, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            held[u] = np.array(e.ids, "<u4").tobytes()

    def encode(self, given: list[str], end: int) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text, then ``end``."""
        cut = pc.ascii_split_whitespace(pa.array(map(self.cut, given), pa.large_string()))
        begin = cut.offsets.to_numpy()
        coded = cut.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(units)
        spelt = [*map(self.held.__getitem__, units), np.array([end], "<u4").tobytes()]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        flat = np.frombuffer(b"".join(spelt), "<u4")
        order = np.insert(coded.indices.to_numpy(), begin[1:] - begin[0], len(units))
        n = sizes[order]
        after = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[order] - (after - n), n) + np.arange(len(after) and after[-1])]
        stops = after[begin[1:] - begin[0] + np.arange(len(given))] if len(given) else np.zeros(0, np.int64)
        return np.split(ids, stops[:-1]) if len(given) else []

    def cut(self, text: str) -> str:
        """A text without a stop or comma that ends a word (a blank divides them), in lower case where that is the
        vocabulary's own lowering. No token crosses ASCII white space in it."""
        if "<|" not in text and not self.odd(text):
            text = text.lower()
        return self.stop(r" \1", text)


_MADE: dict[str, UnitIds] = {}


def pack_tokens(df: DataFrame, path: str, end: int, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise and pack every row of ``df``, each partition in blocks of about ``block_tokens``; no shuffle.

    One row per piece: ``key``, start, length, ids (array of int), ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is its end id alone. Repeated rows are packed as often as they stand
    there; null keys stay null. A sequence never spans blocks; its id has the partition in its high bits.
    An empty table gives no rows. Other columns of ``df`` are left out.
    """
    return _pack(df, path, end, window, block_tokens, text, key, True)


def _pack(df: DataFrame, path: str, end: int, window: int, block_tokens: int, text: str, key: str, with_ids: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        if path not in _MADE:
            _MADE[path] = UnitIds(path)
        part, begun = TaskContext.get().partitionId(), 0

        def packed(keys: list, ids: list[np.ndarray]):
            nonlocal begun
            counts = [len(x) for x in ids]
            pieces = pack_block(counts, window)
            item, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            cuts = [ids[i][s : s + n] for i, s, n, _, _ in pieces]
            columns = [pa.array(keys, key_type).take(pa.array(item)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(np.array(counts, np.int64)[item]), pa.array((part << 40) + begun + seq), pa.array(offset)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([c.view("<i4") for c in cuts], pa.list_(pa.int32())))
                names.append("ids")
            begun += int(seq.max()) + 1
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=20_000)

        keys, ids, held, key_type = [], [], 0, None
        for batch in chunks(batches, 1):
            key_type = batch.column(0).type
            keys += batch.column(0).to_pylist()
            for x in _MADE[path].encode(texts(batch.column(1)), end):
                ids.append(x)
                held += len(x)
            if held >= block_tokens:
                yield from packed(keys, ids)
                keys, ids, held = [], [], 0
        if ids:
            yield from packed(keys, ids)
        del keys, ids
        released(_MADE)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def op10_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens; one row per piece."""
    import public_tokenizers

    return _pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, WINDOW, BLOCK_TOKENS, "text", "doc_id", False)
