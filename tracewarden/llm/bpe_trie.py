"""BPE encoding and decoding over a prefix-sharing trie of distinct words.

Of all ways to cut a prefix of a word into tokens, BPE keeps one, and it ends with the
only token that ends there and may stand after the last token of the prefix before it.
So a prefix is known by its last token alone. Distinct words are put in order, which is
the depth-first order of their trie; the path down to the present node is a stack of last
tokens, and a prefix that words share is computed once.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table, texts

#: The published pre-tokenisation pattern of byte-level BPE; white space is that of Unicode.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Units kept between chunks, and answers about neighbouring tokens.
MOST_UNITS, MOST_PAIRS = 400_000, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieBpe:
    """A byte-level BPE vocabulary file of the tokenizers library. Made once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.ids = {spell(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        # Numbered in the order of merging; single bytes first.
        self.order: dict[bytes, int] = {bytes((b,)): b for b in range(256)}
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(256)), list(range(256))
        for pair in model["merges"]:
            a, b = (spell(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            word = a + b
            if word not in self.order:
                self.order[word] = len(self.left)
                self.left.append(self.order[a])
                self.right.append(self.order[b])
            self.merged[self.order[a] << 20 | self.order[b]] = self.order[word]
        self.out = [self.ids.get(w, -1) for w in self.order]
        self.length = [len(w) for w in self.order]
        self._automaton()
        self.beside: dict[int, bool] = {}
        self.taken: dict[int, int] = {}
        self.names = {i: str(i) for i in self.bytes_of}
        self.odd = regex.compile(rf"[{SPACE}] (?:[{SPACE}]|$)").search
        self.stop = re.compile(rf"([.,])(?<=[^\W_][.,])(?=[{SPACE}])").sub
        self.units: dict[str, tuple[str, int, bytes]] = {}
        self.find = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _automaton(self) -> None:
        """Aho-Corasick over the tokens: a state is a token's prefix, ``longest`` the longest token that it
        ends with, ``shorter`` of a token the next token that it ends with. Steps are filled in when first taken."""
        self.step: dict[int, int] = {}
        step, parent, token = self.step, [(0, 0)], [-1]
        for word, t in self.order.items():
            at = 0
            for b in word:
                if (following := step.get(at << 8 | b)) is None:
                    following = step[at << 8 | b] = len(token)
                    token.append(-1)
                    parent.append((at, b))
                at = following
            token[at] = t
        depth = [0] * len(token)
        for i in range(1, len(token)):
            depth[i] = depth[parent[i][0]] + 1
        self.fail, self.longest, self.shorter = [0] * len(token), token, [-1] * len(self.left)
        for i in sorted(range(1, len(token)), key=depth.__getitem__):
            at, b = parent[i]
            if at:
                self.fail[i] = self._walk(self.fail[at], b)
            if token[i] >= 0:
                self.shorter[token[i]] = token[self.fail[i]]
            else:
                token[i] = token[self.fail[i]]

    def _walk(self, at: int, byte: int) -> int:
        step, fail, seen = self.step, self.fail, []
        while (to := step.get(at << 8 | byte)) is None and at:
            seen.append(at)
            at = fail[at]
        return to or 0

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between tokens ``a`` and ``b``: undo their merges, the latest
        first, and see that no pair across the boundary would have been merged before that."""
        left, right, merged, limit = self.left, self.right, self.merged, 1 << 30
        while True:
            if merged.get(a << 20 | b, 1 << 30) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words given in ascending order without repeats."""
        length, beside, out, longest, shorter, step = self.length, self.beside, self.out, self.longest, self.shorter, self.taken
        for kept in (beside, step):
            if len(kept) > MOST_PAIRS:
                kept.clear()
        last, states = [-1], [0]  # by depth: the last token of the prefix, and the automaton's state
        before, found = b"", []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            depth = shared
            for byte in word[shared:]:
                depth += 1
                taken = state << 8 | byte
                if (to := step.get(taken)) is None:
                    to = step[taken] = self._walk(state, byte)
                state = to
                token = longest[state]
                while (previous := last[depth - length[token]]) >= 0:
                    pair = previous << 20 | token
                    if (fits := beside.get(pair)) is None:
                        fits = beside[pair] = self.may_follow(previous, token)
                    if fits:
                        break
                    token = shorter[token]
                last.append(token)
                states.append(state)
            ids, depth = [], len(word)
            while depth:
                token = last[depth]
                ids.append(out[token])
                depth -= length[token]
            ids.reverse()
            found.append(ids)
            before = word
        return found

    def units_of(self, text: str) -> list[str]:
        """Cut a text so that pre-tokens never cross a cut and units repeat: before single blanks, and
        before a stop or comma that ends a word."""
        if "\0" in text or "  " in text or not text or self.odd(text):
            return self.find(text)
        units = self.stop("\0\\1", text).replace(" ", "\0 ").split("\0")
        return units if units[0] else units[1:]

    def learn(self, units: set[str]) -> None:
        """Encode units that are not held yet; at the bound, those not needed now go."""
        if len(self.units) > MOST_UNITS:
            self.units = {u: x for u in units if (x := self.units.get(u))}
        held, find, names, spell = self.units, self.find, self.names, self.bytes_of
        whole, mixed = {}, {}
        for u in units:
            if u not in held:
                if u.isalpha() or u[0] == " " and u[1:].isalpha():
                    whole[u.encode()] = u
                else:
                    mixed[u] = [w.encode() for w in find(u)]
        words = sorted(whole.keys() | {w for ws in mixed.values() for w in ws})
        ids = dict(zip(words, self.encode_sorted(words), strict=True))
        for w, u in whole.items():
            flat = ids[w]
            held[u] = ",".join([names[i] for i in flat]), len(flat), b"".join([spell[i] for i in flat])
        for u, ws in mixed.items():
            flat = [i for w in ws for i in ids[w]]
            held[u] = ",".join([names[i] for i in flat]), len(flat), b"".join([spell[i] for i in flat])

    def encode_chunk(self, given: list[str]) -> list[list[list[str] | int]]:
        """Each text as segments: a list of units or the id of a special token; all units are then held."""
        segments = []
        for text in given:
            parts = self.parts(text) if self.parts and any(s in text for s in self.special) else [text]
            segments.append([self.special[p] if k % 2 else self.units_of(p) for k, p in enumerate(parts) if p])
        self.learn({u for s in segments for part in s if not isinstance(part, int) for u in part})
        return segments


def _join(bpe: TrieBpe, segments: list) -> tuple[str, int, bytes]:
    """Comma-joined ids, their number and the bytes that they stand for."""
    held, texts_, n, spelt = bpe.units, [], 0, []
    for part in segments:
        if isinstance(part, int):
            texts_.append(str(part))
            n += 1
            spelt.append(bpe.bytes_of[part])
        else:
            got = [held[u] for u in part]
            texts_ += [x[0] for x in got]
            n += sum([x[1] for x in got])
            spelt += [x[2] for x in got]
    return ",".join(texts_), n, b"".join(spelt)


_MADE: dict[str, TrieBpe] = {}


def bpe(path: str) -> TrieBpe:
    """The worker's own copy of the vocabulary at ``path`` (a file on every executor)."""
    if path not in _MADE:
        _MADE[path] = TrieBpe(path)
    return _MADE[path]


def bpe_encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``n_tokens`` for each row. Null and empty texts have no ids.

    Texts of any length are taken whole; equal texts have equal ids; rows are neither joined nor
    dropped, so repeated and null keys stay as they are. Other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1):
            b = bpe(path)
            found = [_join(b, s)[0] for s in b.encode_chunk(texts(batch.column(1)))]
            ids = [[int(i) for i in x.split(",")] if x else [] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], [key, "ids", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_tokens long")


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` for each row of ids; bytes that are not UTF-8 become U+FFFD, unknown ids are an error.

    Null ids give a null text, no ids the empty text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            spell = bpe(path).bytes_of
            out = [None if x is None else b"".join(map(spell.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text of ``documents`` and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        for batch in chunks(batches, 1):
            b = bpe(path)
            n, ids, back = [], [], []
            for s in b.encode_chunk(texts(batch.column(1))):
                listed, count, spelt = _join(b, s)
                n.append(count)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                back.append(hashlib.sha256(spelt.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
