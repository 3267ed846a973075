"""Secret scans: fixed rules, and a character convolutional network over every candidate.

Candidates are all long runs of key characters, with digits or without. The network reads a candidate
together with what stands before and after it, in classes of their own. It learns from findings that are labelled by the rules, with and without
the words that led the rules to them, and from generated ones of kinds that no rule knows. Other runs of the documents are
not known to be harmless: a first network leaves out those that look like keys, and the others teach the second one.
It is calibrated and its threshold chosen on findings of their own, and the threshold keeps the asked recall.

All distinct candidates of all texts teach it, dealt to lots of bounded size: each epoch walks every lot from the same
weights, and the mean over the lots begins the next one. Generated findings stand in every lot.
"""

from __future__ import annotations

import copy
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, released, table, texts
from .components import shared_folder

#: Rows of the documents' findings in a lot, about; there are as many lots as that takes, in so many partitions at most.
LOT_ROWS, LOT_PARTS = 8192, 256
RECALL = 0.98
EPOCHS = 10
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_HEXES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_KEYS = bytes(107 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_.=-") else 32 for b in range(256))
BEFORE, AFTER, PIECE = 24, 8, 64
#: Characters on each side of a candidate whose prose words make harmless compounds.
AROUND = 256
#: Classes: 0 nothing, each printable ASCII character its own, other blanks, everything else, the candidate's border;
#: then the same again for characters around the candidate, so that a key beside it isn't taken for the candidate.
OUTSIDE, EMBED, WIDTH, FILTERS = 99, 12, 5, 24
CLASSES = 2 * OUTSIDE
BLANK, OTHER, BORDER = 96, 97, 98

Span = tuple[int, int, int, int]  # start, kind, end, where the value starts


def base_spans(text: str, plain: bytes) -> list[Span]:
    """Findings of the rules in order. ``plain``: the text with one ASCII byte for each character."""
    out: list[Span] = []
    if b":" in plain or b"=" in plain:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in plain:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in plain.translate(_HEXES):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, plain: bytes) -> list[tuple[int, int]]:
    """Runs of 16 key characters or more."""
    if b"k" * 16 not in plain.translate(_KEYS):
        return []
    return [m.span() for m in CANDIDATE.finditer(text)]


def few_digits(value: str) -> bool:
    return sum("0" <= c <= "9" for c in value) < 2


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


_CODES = {chr(b): b - 31 for b in range(32, 127)} | dict.fromkeys("\t\n\r", BLANK)


def coded(parts: tuple[str, str, str]) -> list[list[int]]:
    """Rows of class numbers of equal width: a row for each piece of the candidate, with its surroundings at the ends."""
    before, value, after = parts
    code = lambda s, first=0: [first + _CODES.get(c, OTHER) for c in s]
    cuts = [value[k : k + PIECE] for k in range(0, max(1, len(value) - WIDTH + 1), PIECE - WIDTH + 1)]
    rows = []
    for k, cut in enumerate(cuts):
        left = code(before, OUTSIDE) if k == 0 else []
        right = code(after, OUTSIDE) if k == len(cuts) - 1 else []
        row = [0] * (BEFORE - len(left)) + left + [BORDER] + code(cut) + [BORDER] + right
        rows.append(row + [0] * (BEFORE + PIECE + AFTER + 2 - len(row)))
    return rows


@dataclass
class Network:
    """Embedding, convolution, maximum over all places and mean over the candidate's, logistic output; ``scale`` and ``shift`` calibrate it."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    rest: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of each row (row, place, filter), and the share of each place in the mean.

        The convolution adds up what each class gives at each place of a window, which is worked out once.
        """
        places = rows.shape[1] - WIDTH + 1
        rows = rows.astype(np.intp)
        found = self.bias + sum(np.take(self.embed @ self.kernel[j * EMBED : (j + 1) * EMBED], rows[:, j : j + places], axis=0) for j in range(WIDTH))
        middle = rows[:, WIDTH // 2 : rows.shape[1] - WIDTH // 2]
        inside = ((middle > 0) & (middle < BORDER)).astype(float)
        return np.maximum(found, 0), inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        h, share = self.hidden(rows)
        return np.concatenate([h.max(axis=1), np.einsum("rp,rpf->rf", share, h)], axis=1)

    def logit(self, given: list[list[list[int]]]) -> np.ndarray:
        """Uncalibrated outputs; a candidate of several rows takes the maximum over all of them."""
        out = []
        for k in range(0, len(given), 256):
            some = given[k : k + 256]
            at = np.cumsum([0, *map(len, some)])[:-1]
            rows = np.array([r for g in some for r in g], np.int64)
            h = np.concatenate([self.pooled(rows[i : i + 256]) for i in range(0, len(rows), 256)])
            out.append(np.maximum.reduceat(h, at) @ self.out + self.rest)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, given: list[list[list[int]]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(given) + self.shift, -40, 40)))


#: Prefixes of published kinds of keys, and words that lead to a key.
PREFIXES = ("ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_test_", "sk-", "xoxb-", "xoxp-", "npm_", "AIza", "ya29.", "SG.", "hf_", "pypi-", "dop_v1_", "shpat_", "eyJ")
LEADS = ("password=", "token = \"", "secret: ", "api_key='", "key=", "auth ", "Bearer ", "credential: ", "the value ", "use ", "", "")


def generated(n: int = 1200, seed: int = 11) -> list[tuple[tuple[str, str, str], int]]:
    """Findings of many kinds and harmless runs, made from a seed, so that there is always something to learn from."""
    rng = np.random.default_rng(seed)
    letters = "etaoinshrdlucmfw"
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda chars, a, b: "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(a, b)))
    syllables = ("tion", "ent", "her", "sch", "lich", "ung", "ment", "ando", "ique", "para", "con", "ver", "ge", "der", "ion", "able")
    word = lambda: draw(letters, 2, 9)
    spoken = lambda k: "".join(syllables[i] for i in rng.integers(0, len(syllables), k))
    out = []
    for k in range(n):
        value = [draw("0123456789abcdef", 18, 65), "AKIA" + draw(alnum[26:], 16, 17), draw(alnum, 16, 60), draw(alnum + "+/", 30, 60) + "=", PREFIXES[k // 6 % len(PREFIXES)] + draw(alnum, 16, 44), "-".join(draw("0123456789abcdef", m, m + 1) for m in (8, 4, 4, 4, 12))][k % 6]
        bare = draw(alnum[:52], 16, 17 + k % 3 * 8)
        at = int(rng.integers(0, len(bare)))
        few = [bare, bare[:at] + str(k % 10) + bare[at + 1 :], bare + "=" if k % 8 == 2 else bare, PREFIXES[k // 4 % len(PREFIXES)] + bare][k % 4]
        for secret, lead in ((value, LEADS[k % len(LEADS)]), (few, LEADS[k // 3 % len(LEADS)])):
            out.append(((f"{word()} {word()} {lead}"[-BEFORE:], secret, [" ", "\" ", "\n", "."][k % 4] + word()[: AFTER - 2]), 1))
        harmless = [f"{word()}.{rng.integers(10, 99)}.{word()}.example.com", "-".join(str(x) for x in rng.integers(100, 9999, 5)), str(rng.integers(10**15, 10**16)), f"{word()}/{word()}-{word()}/page{rng.integers(10, 999)}.html", f"{word()}_{word()}_{word()}{rng.integers(10, 99)}", f"2024-{k % 12 + 1:02}-{k % 28 + 1:02}_{word()}_{word()}", f"mail{rng.integers(10, 99)}.{word()}{word()}.example", spoken(6) + str(k % 100)][k % 8]
        words = [[draw(letters, 4, 9), spoken(2)][k // 10 % 2] for _ in range(4)]
        plain = ["".join(words), "".join(words).capitalize() + ".", "".join(w.capitalize() for w in words), "_".join(words).upper(), "-".join(words[:3]), "/".join(["", *words]), f"mail{k % 10}.{words[0]}.example.com", f"www.{words[0]}.{words[1]}.example", "".join(words).upper(), "=-._"[k // 10 % 4] * int(rng.integers(16, 60))][k % 10]
        for run in (harmless, plain, spoken(5)):
            if len(run) >= 16:
                out.append(((f"{word()} {word()} {[word(), '', LEADS[k % len(LEADS)]][k % 3]} "[-BEFORE:], run, f" {word()}"[:AFTER]), 0))
    return out


PROSE = re.compile(r"(?<![^\s(\"'])[A-Z]?[a-z]{2,14}(?=[\s,.;:!?)])")


def prose(text: str, start: int, end: int) -> list[str]:
    """Prose words around a candidate, ``AROUND`` characters to each side, in small letters."""
    return [w.lower() for w in PROSE.findall(f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}")]


def compounds(words: list[str], least: int = 1800, seed: int = 13) -> list[tuple[tuple[str, str, str], int]]:
    """Harmless runs put together from ``words`` of prose, so that long words in the documents' own languages are known.

    Each word stands in one at least; words are dealt again until ``least`` are made.
    """
    words = sorted(set(words))
    rng = np.random.default_rng(seed)
    out, dealt = [], 0
    order = rng.permutation(len(words))
    while words and (dealt < len(words) or len(out) < least):
        k, run = len(out), ""
        while len(run) < 16:
            run += words[order[dealt % len(words)]]
            dealt += 1
        pick = lambda: words[rng.integers(0, len(words))]
        run = [run, run.capitalize(), run.upper(), run][k % 4] + "." * (k // 4 % 2)
        before = f"{pick()} {pick()} " if k % 3 else f"{pick()}. {pick().capitalize()} {pick()} "
        out.append(((before[-BEFORE:], run, f" {pick()}"[:AFTER]), 0))
    return out


@dataclass
class Lot:
    """Coded findings: the rows of all of them, and of each the number of rows, its label, whether it has few digits,
    its fold (equal values share one), and whether it is taught."""

    rows: np.ndarray
    sizes: np.ndarray
    secret: np.ndarray
    few: np.ndarray
    fold: np.ndarray
    taught: np.ndarray

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.rows, self.sizes, self.secret, self.few, self.fold, self.taught)]

    @staticmethod
    def unpacked(columns: list[bytes]) -> Lot:
        rows, sizes, *marks = (np.frombuffer(c, t) for c, t in zip(columns, (np.uint8, np.int64, bool, bool, np.uint8, bool), strict=True))
        return Lot(rows.reshape(-1, BEFORE + PIECE + AFTER + 2), sizes, *marks)

    def rows_of(self, some: np.ndarray) -> np.ndarray:
        """The rows of the findings ``some``, one after the other."""
        sizes = self.sizes[some]
        skipped = (np.cumsum(self.sizes) - self.sizes)[some] - (np.cumsum(sizes) - sizes)
        return self.rows[np.repeat(skipped, sizes) + np.arange(sizes.sum())]

    def logit(self, net: Network, some: np.ndarray) -> np.ndarray:
        """As ``Network.logit``, for the findings ``some``."""
        out = [np.zeros(0)]
        for k in range(0, len(some), 256):
            rows, sizes = self.rows_of(some[k : k + 256]), self.sizes[some[k : k + 256]]
            h = np.concatenate([net.pooled(rows[i : i + 256]) for i in range(0, len(rows), 256)])
            out.append(np.maximum.reduceat(h, np.cumsum(sizes) - sizes) @ net.out + net.rest)
        return np.concatenate(out)


def lot(sure: list[tuple[tuple[str, str, str], int]], others: list[tuple[tuple[str, str, str], int]] = ()) -> Lot:
    """``sure`` findings are taught from the start, ``others`` not yet."""
    sure, others = sorted(set(sure)), sorted(set(others))
    both = sure + others
    rows = [np.array(coded(x), np.uint8) for x, _ in both]
    return Lot(
        np.concatenate([np.zeros((0, BEFORE + PIECE + AFTER + 2), np.uint8), *rows]),
        np.array([len(r) for r in rows], np.int64),
        np.array([y for _, y in both], bool),
        np.array([few_digits(x[1]) for x, _ in both], bool),
        np.array([zlib.crc32(x[1].encode()) % 5 for x, _ in both], np.uint8),
        np.arange(len(both)) < len(sure),
    )


_LEARNT = ("embed", "kernel", "bias", "out")


def _fresh() -> Network:
    rng = np.random.default_rng(5)
    return Network(rng.normal(0, 0.3, (CLASSES, EMBED)), rng.normal(0, 0.2, (EMBED * WIDTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), 0.0)


@dataclass
class Learner:
    """A network and the moments of its gradients (Adam)."""

    net: Network = field(default_factory=_fresh)
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for moments in (self.first, self.second):
            moments.update({k: np.zeros_like(getattr(self.net, k)) for k in _LEARNT if k not in moments})

    def fixed(self) -> np.ndarray:
        """All numbers in units of 2^-40, whose sums over lots don't depend on an order; second moments by their roots."""
        parts = [getattr(self.net, k) for k in _LEARNT] + [self.first[k] for k in _LEARNT] + [np.sqrt(self.second[k]) for k in _LEARNT]
        return np.rint(np.concatenate([*(p.ravel() for p in parts), [self.net.rest]]) * 2.0**40).astype(np.int64)

    def mean(self, total: np.ndarray, n: int) -> Learner:
        """The learner whose numbers are ``total``, a sum over ``n`` of them, shared out."""
        numbers, at, parts = total / n / 2.0**40, 0, []
        for k in _LEARNT * 3:
            shape = getattr(self.net, k).shape
            parts.append(numbers[at : at + int(np.prod(shape))].reshape(shape).copy())
            at += int(np.prod(shape))
        n = len(_LEARNT)
        return Learner(Network(*parts[:n], float(numbers[at])), dict(zip(_LEARNT, parts[n : 2 * n], strict=True)), dict(zip(_LEARNT, (p**2 for p in parts[2 * n :]), strict=True)))

    def epoch(self, given: Lot, number: int, epochs: int) -> Learner:
        """What an epoch over the taught findings of three folds makes of this learner."""
        new = copy.deepcopy(self)
        net = new.net
        some = np.flatnonzero(given.taught & (given.fold < 3))
        target = given.secret[some].astype(float)
        share_of_secrets = target.mean() if len(target) else 0.5
        weight = np.where(target == 1, 0.5 / max(share_of_secrets, 1e-3), 0.5 / max(1 - share_of_secrets, 1e-3))
        rate = 0.01 * (1 - number / epochs)
        step = number * -(-len(some) // 64)
        shuffled = np.random.default_rng([5, number]).permutation(len(some))
        for k in range(0, len(some), 64):
            b = shuffled[k : k + 64]
            grads = _gradients(net, given.rows_of(some[b]), given.sizes[some[b]], target[b], weight[b])
            net.rest -= rate * grads.pop("rest")
            step += 1
            for name, g in grads.items():
                new.first[name] = 0.9 * new.first[name] + 0.1 * g
                new.second[name] = 0.99 * new.second[name] + 0.01 * g**2
                getattr(net, name)[...] -= rate * (new.first[name] / (1 - 0.9**step)) / (np.sqrt(new.second[name] / (1 - 0.99**step)) + 1e-8)
        return new


def _gradients(net: Network, rows: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for a batch of findings; a finding's response is the largest of all its rows, as in ``Network.logit``.

    However many rows findings have, 256 are held at once, and only rows with a largest response are walked back.
    """
    held = net.hidden(rows) if len(rows) <= 256 else None
    each = []
    for k in range(0, len(rows), 256):
        responses, share = held or net.hidden(rows[k : k + 256])
        each.append(np.concatenate([responses.max(axis=1), np.einsum("rp,rpf->rf", share, responses)], axis=1))
    each, begin = np.concatenate(each), np.cumsum(sizes) - sizes
    h = np.maximum.reduceat(each, begin)
    # The first row of a finding with the largest response of a filter, and with its largest mean.
    row = np.minimum.reduceat(np.where(each == np.repeat(h, sizes, axis=0), np.arange(len(rows))[:, None], len(rows)), begin)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.rest, -40, 40)))
    d = (p - target) * weight / len(target)
    dh = d[:, None] * net.out
    grads = {"embed": np.zeros_like(net.embed), "kernel": 1e-4 * net.kernel, "bias": np.zeros_like(net.bias), "out": h.T @ d + 1e-4 * net.out, "rest": d.sum()}
    used = np.arange(len(rows)) if held else np.unique(row)
    row = np.searchsorted(used, row)
    for k in range(0, len(used), 256):
        part = rows[used[k : k + 256]]
        responses, share = held or net.hidden(part)
        here = (row >= k) & (row < k + 256)
        means = np.zeros((len(part), FILTERS))
        i, f = np.nonzero(here[:, FILTERS:])
        means[row[i, FILTERS + f] - k, f] = dh[i, FILTERS + f]
        back = share[:, :, None] * means[:, None, :]
        i, f = np.nonzero(here[:, :FILTERS])
        top = row[i, f] - k
        back[top, responses.argmax(axis=1)[top, f], f] += dh[i, f]
        back *= responses > 0
        grads["bias"] += back.sum(axis=(0, 1))
        # What reaches each class at each place of a window: rows of ``wide`` added up by class.
        wide = np.zeros((len(part), part.shape[1] + WIDTH - 1, FILTERS))
        wide[:, WIDTH - 1 : WIDTH - 1 + back.shape[1]] = back
        wide = wide.reshape(-1, FILTERS)
        order = np.argsort(part, axis=None, kind="stable")
        classes, starts = np.unique(part.ravel()[order], return_index=True)
        at = order + (order // part.shape[1] + 1) * (WIDTH - 1)
        for j in range(WIDTH):
            reached = np.add.reduceat(wide[at - j], starts, axis=0)
            some = slice(j * EMBED, (j + 1) * EMBED)
            grads["kernel"][some] += net.embed[classes].T @ reached
            grads["embed"][classes] += reached @ net.kernel[some].T
    return grads


#: Outputs are counted in steps of 1 / STEPS, rounded down.
STEPS = 1024


def counted(net: Network, given: Lot) -> np.ndarray:
    """Rows (fold, secret, few digits, output in steps, count) of the taught findings of the two folds that nothing learns from."""
    some = np.flatnonzero(given.taught & (given.fold >= 3))
    z = np.floor(np.clip(given.logit(net, some), -64, 64) * STEPS).astype(np.int64)
    keys, n = np.unique(np.stack([given.fold[some], given.secret[some], given.few[some], z], axis=1).astype(np.int64), axis=0, return_counts=True)
    return np.concatenate([keys, n[:, None]], axis=1)


def calibrated(net: Network, counts: np.ndarray, recall: float) -> Network:
    """Calibrate on the fourth fold, and choose the threshold on the fifth.

    The threshold lets one harmless run in a thousand through, and is lower where the asked recall needs that.
    """
    from .toxicity import logistic

    fold, y, few, steps, n = counts.T
    z = steps / STEPS
    c = fold == 3
    net.shift, net.scale = map(float, logistic(np.stack([np.ones(c.sum()), z[c]], axis=1), y[c].astype(float), n[c].astype(float), 0.01))
    score = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -40, 40)))

    def placed(some: np.ndarray, place: Callable[[int], int]) -> list[float]:
        """The score at a place among all findings ``some`` in order."""
        order = np.flatnonzero(some)[np.argsort(score[some], kind="stable")]
        upto = np.cumsum(n[order])
        return [float(score[order[np.searchsorted(upto, place(int(upto[-1])), side="right")]])] if len(order) else []

    quiet = max([0.5, *placed((fold == 4) & (y == 0), lambda m: int(0.999 * (m - 1)))])
    right = [placed((fold == 4) & (y == 1) & (few == k), lambda m: int((1 - recall) * m)) for k in (1, 0)]
    net.threshold = min([quiet, *(x for r in right for x in r)])
    return net


def fit(found: list[tuple[tuple[str, str, str], int]], recall: float = RECALL, epochs: int = EPOCHS) -> Network:
    """Train on three in five findings, calibrate on a fourth, and choose the threshold on the fifth."""
    return _fit(lot(found), recall, epochs)


def _fit(given: Lot, recall: float, epochs: int) -> Network:
    learner = Learner()
    for k in range(epochs):
        learner = learner.epoch(given, k, epochs)
    return calibrated(learner.net, counted(learner.net, given), recall)


def joined(a: Lot, b: Lot) -> Lot:
    return Lot(*(np.concatenate([getattr(a, f.name), getattr(b, f.name)]) for f in fields(Lot)))


def _taught(made: Lot, found: list[tuple[tuple[str, str, str], int]], words: list[str]) -> Lot:
    """Generated findings (``made``) and ``found``; those of label 0 are not taught yet.

    Findings of the rules also stand without what led to them, and the prose ``words`` around all of them make harmless compounds.
    """
    bare = [((f"{before[:8]} ", value, after), 1) for (before, value, after), y in found if y]
    return joined(made, lot(compounds(words) + [x for x in found if x[1]] + bare, [x for x in found if not x[1]]))


def more_taught(given: Lot, first: Network) -> Lot:
    """Findings not taught yet are now, but for those that the ``first`` network takes for secrets."""
    others = np.flatnonzero(~given.taught)
    z = given.logit(first, others)
    taught = given.taught.copy()
    taught[others] = first.scale * z + first.shift < 0
    return Lot(given.rows, given.sizes, given.secret, given.few, given.fold, taught)


def fit_unlabelled(found: list[tuple[tuple[str, str, str], int]], words: list[str], recall: float = RECALL) -> Network:
    """Fit on generated findings and on ``found``, whose label 0 only says that no rule knows them: those that a
    network fitted without them takes for secrets teach nothing."""
    given = _taught(lot(generated()), found, words)
    return _fit(more_taught(given, _fit(given, recall, EPOCHS)), recall, EPOCHS)


def _plain(text: str) -> bytes:
    return text.encode("ascii", "replace")


def labelled(text: str) -> list[tuple[tuple[str, str, str], int]]:
    """Candidates of a text; label 1 where a finding of the rules overlaps."""
    plain = _plain(text)
    runs = candidates(text, plain)
    if not runs:
        return []
    spans = base_spans(text, plain)
    return [(surroundings(text, a, b), int(any(s < b and a < e for s, _, e, _ in spans))) for a, b in runs]


_LOT = ("rows", "sizes", "secret", "few", "fold", "taught")
_LOTS = "lot int, " + ", ".join(f"{c} binary" for c in _LOT)


def _lots_of(batches) -> Iterator[tuple[int, Lot]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(0)[r].as_py(), Lot.unpacked([batch.column(1 + i)[r].as_py() for i in range(len(_LOT))])


def _lot_batch(number: int, given: Lot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([c], pa.binary()) for c in given.packed())], ["lot", *_LOT])


def lots(documents: DataFrame, text: str = "text", most: int = LOT_ROWS) -> DataFrame:
    """Every distinct candidate of all texts and every prose word around one, dealt by a hash to lots of about ``most`` rows: a row a lot."""
    shared_folder(documents.sparkSession)

    def run(batches):
        for batch in chunks(batches, 0):
            whole = list(texts(batch.column(0)))
            found = {x for t in whole for x in labelled(t)}
            found |= {((w, "", ""), 2) for t in whole for span in candidates(t, _plain(t)) for w in prose(t, *span)}
            parts = list(zip(*((*p, y) for p, y in sorted(found)), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in parts[:3]), pa.array(parts[3], pa.int32())], ["before", "value", "after", "label"])

    found = documents.select(text).mapInArrow(run, "before string, value string, after string, label int").distinct().checkpoint()
    # Three words make a compound, and findings of the rules stand twice.
    rows = F.when(F.col("label") == 2, 1 / 3).otherwise((F.col("label") + 1) * F.ceil(F.length("value") / (PIECE - WIDTH + 1)))
    n = max(1, -int(-(found.agg(F.sum(rows)).first()[0] or 0) // most))

    made = documents.sparkSession.sparkContext.broadcast(lot(generated()))  # of fixed size

    def dealt(group):
        before, value, after, label = (group.column(c).to_pylist() for c in ("before", "value", "after", "label"))
        given = _taught(made.value, [((b, v, a), y) for b, v, a, y in zip(before, value, after, label, strict=True) if y < 2], [b for b, y in zip(before, label, strict=True) if y == 2])
        return pa.Table.from_batches([_lot_batch(group.column("lot")[0].as_py(), given)])

    mixed = F.pmod(F.xxhash64("before", "value", "after"), F.lit(n)).cast("int")
    return found.withColumn("lot", mixed).groupBy("lot").applyInArrow(dealt, _LOTS).repartitionById(min(n, LOT_PARTS), F.col("lot") % min(n, LOT_PARTS)).checkpoint()


def _fit_lots(given: DataFrame, recall: float, epochs: int) -> Network:
    """As ``fit``, over all lots; what comes to the driver is a sum of weights a partition, and counts of outputs."""
    context = given.sparkSession.sparkContext
    learner = Learner()
    for k in range(epochs):
        shared = context.broadcast(learner)

        def learnt(batches, k=k, shared=shared):
            total, n = 0, 0
            for _, one in _lots_of(batches):
                total, n = total + shared.value.epoch(one, k, epochs).fixed(), n + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])
            released()

        sums = given.mapInArrow(learnt, "n long, total binary").collect()  # at most LOT_PARTS rows of fixed size
        learner = learner.mean(sum(np.frombuffer(r["total"], np.int64) for r in sums), sum(r["n"] for r in sums))
        shared.destroy()
    net = learner.net
    shared = context.broadcast(net)
    names = ["fold", "secret", "few", "steps", "n"]

    def scored(batches):
        for _, one in _lots_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counted(shared.value, one).T], names)
        released()

    counts = given.mapInArrow(scored, ", ".join(f"{c} long" for c in names)).groupBy(names[:-1]).agg(F.sum("n").alias("n")).collect()  # as many as there are outputs in steps
    shared.destroy()
    return calibrated(net, np.array(sorted(map(tuple, counts)), np.int64).reshape(-1, 5), recall)


def train(documents: DataFrame, text: str = "text", recall: float = RECALL, most: int = LOT_ROWS) -> Network:
    """Fit on all distinct candidates in all texts, the prose words around them and generated findings, as ``fit_unlabelled`` does."""
    given = lots(documents, text, most)
    if given.isEmpty():
        return fit_unlabelled([], [], recall)
    first = given.sparkSession.sparkContext.broadcast(_fit_lots(given, recall, EPOCHS))

    def judged(batches):
        for number, one in _lots_of(batches):
            yield _lot_batch(number, more_taught(one, first.value))
        released()

    return _fit_lots(given.mapInArrow(judged, _LOTS).checkpoint(), recall, EPOCHS)


def scan(text: str, net: Network) -> list[tuple[int, int, int, int, float]]:
    """All spans (start, kind, end, value start, score) of a text in order; rules score 1."""
    plain = _plain(text)
    spans = base_spans(text, plain)
    runs = candidates(text, plain)
    out = [(*s, 1.0) for s in spans]
    if runs:
        scores = net.score([coded(surroundings(text, *r)) for r in runs])
        out += [(a, 3, b, a, float(p)) for (a, b), p in zip(runs, scores, strict=True) if p >= net.threshold and not any(s < b and a < e for s, _, e, _ in spans)]
    return sorted(out)


def find_secrets(df: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans`` (kind, start, end, value_start, score) of each row, in characters.

    Null and empty texts have no spans. Rows stay one for one, repeated and null keys too; other
    columns are left out. Spans of the rules may overlap those of another rule; the network's never do.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("score", pa.float64())])
        for batch in chunks(batches, 1):
            found = [[{"kind": KINDS[k], "start": s, "end": e, "value_start": v, "score": p} for s, k, e, v, p in scan(t, shared.value)] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], [key, "spans"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long,value_start:long,score:double>>")


def redacted(text: str, net: Network, mark: str = "[REDACTED]") -> str:
    """The text with the values of all spans, joined where they overlap, replaced by ``mark``."""
    merged: list[list[int]] = []
    for v, e in sorted((v, e) for _, _, e, v, _ in scan(text, net)):
        if merged and v < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([v, e])
    cuts = [0, *(x for span in merged for x in span), len(text)]
    return mark.join(text[a:b] for a, b in list(pairwise(cuts))[::2])


def redact_secrets(df: DataFrame, net: Network, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with the values of secrets in ``text`` replaced; null stays null, other columns and their order stay."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    place = df.columns.index(text)

    def run(batches):
        for batch in chunks(batches, place):
            new = [None if t is None else redacted(t, shared.value, mark) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def op8_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``: counts by rule, a digest of the rules' spans, and all spans."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(train(documents))

    def run(batches):
        for batch in chunks(batches, 1):
            rows = []
            for t in texts(batch.column(1)):
                found = scan(t, shared.value)
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in found]
                base = ",".join(n for n, x in zip(named, found, strict=True) if x[1] < 3)
                rows.append((*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(named), sum(x[1] == 3 for x in found)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"])

    return documents.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")
