"""Garbled text from a wrong character encoding: find it and restore the original.

A character trigram model (Witten-Bell style interpolation down to single characters) is trained on
the clean records of the corpus. Every chain "encode as X, decode as Y" that a string, or a stretch of
it, allows is scored; the likeliest is accepted if it beats the string as it stands by a margin set on
held-out records, as they are and garbled on purpose. Accepted strings are tried again, so text garbled
twice is undone twice, and one garbled differently in two places in both.

Cases with a defined result: null, empty and pure ASCII texts are clean; a text that holds U+FFFD is
garbled even if no chain helps (``restored`` is then null); repeated rows get the same result each;
ties between chains go to the earlier chain; texts of any length are scored whole; extra columns are
ignored; an empty corpus yields a model that changes nothing but still reports U+FFFD.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.codepoints import COUNT_SCHEMA, KEYED_SCHEMA, KeyTally, Lookup, Tally, flatten, gather, gather_keys, keyed, map_keys, portions, row_sums

# Code pages a text may have been read in by mistake (X) or written in (Y). Bytes
# without a character in a Windows code page stand for the control character of the same number.
SINGLE_BYTE = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp437", "cp850", "cp852", "cp866",
    "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic", "mac-greek", "iso8859-2", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-15", "cp874",
)
MULTI_BYTE = ("cp932", "gb18030", "big5", "euc_jp", "cp949")
WRITTEN_SINGLE = (
    "cp1252", "cp1251", "koi8-r", "cp866", "cp1253", "cp1256", "cp1250", "cp874", "iso8859-5", "iso8859-6", "mac-cyrillic", "mac-roman", "cp437", "cp850",
    "iso8859-2", "iso8859-7", "cp1254", "cp1255", "cp1257", "cp852", "koi8-u", "mac-greek", "iso8859-15",
)
WRITTEN_MULTI = ("cp932", "euc_jp", "gb18030", "big5", "cp949")
# What compatibility normalisation makes of characters that stand for single bytes.
UNFOLD = ((" ̃", "˜"), ("1⁄4", "¼"), ("1⁄2", "½"), ("3⁄4", "¾"), (" ̧", "¸"), (" ̈", "¨"), (" ́", "´"), (" ̄", "¯"), ("μ", "µ"), ("...", "…"), ("TM", "™"))

#: Single characters between which the probability of one never seen is divided.
CHARACTERS = 1 << 16
REPLACED = 0xFFFD


@functools.cache
def _decode_table(codec: str) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out[b] = b if codec.startswith("cp12") and 0x80 <= b < 0xA0 else REPLACED
    return out


def _ngram_keys(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of trigrams, bigrams and single characters ending at each point; and which points are no marks in front.

    ``points`` has two marks before and one behind each text; digits count as one character.
    """
    p = np.where((points >= 0x30) & (points <= 0x39), np.uint32(0x30), points)
    p1 = np.concatenate([np.zeros(1, p.dtype), p[:-1]])
    p2 = np.concatenate([np.zeros(2, p.dtype), p[:-2]]) if len(p) > 1 else np.zeros_like(p)
    real = np.ones(len(p), dtype=bool)
    starts = offsets[:-1]
    real[starts] = False
    real[starts + 1] = False
    return keyed(3, p2, p1, p), keyed(2, p1, p), keyed(1, p), real


class CharModel:
    """Interpolated character trigram model over exact counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, margin: float = 3.0, beyond: float = -9.0):
        self._set(Lookup(keys, counts), float(counts[(keys & np.uint64(3)) == 1].sum()), margin, beyond)

    @classmethod
    def over(cls, counts: Lookup, single: float) -> CharModel:
        """The model over a table of counts in which single characters occur so often."""
        out = cls.__new__(cls)
        out._set(counts, single, 3.0, -9.0)
        return out

    def _set(self, counts: Lookup, single: float, margin: float, beyond: float) -> None:
        self.counts, self.margin, self.beyond = counts, margin, beyond
        self.gains: Gains | None = None
        self.shared: Broadcast | None = None
        marks = self.counts.of(keyed(1, np.array([2], dtype=np.uint32)))[0]  # those in front follow nothing
        self.total = single - marks

    def __getstate__(self) -> dict:
        return self.__dict__ | {"gains": None, "shared": None}

    def share(self, spark: SparkSession) -> Broadcast:
        """The model for all workers, sent once, so that what a worker learns of windows holds for all jobs that judge by it."""
        if self.shared is None or self.shared._sc is not spark.sparkContext:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def log_probs(self, points: np.ndarray, offsets: np.ndarray, less_one: bool = False) -> np.ndarray:
        """ln P of each point given the two before it; 0 at the marks in front.

        ``less_one``: n-grams with a character outside ASCII count once less, since the text may have been counted itself.
        """
        if not len(points):
            return np.zeros(0)
        k3, k2, k1, real = _ngram_keys(points, offsets)
        n1, n2, n3 = self.counts.of(k1), self.counts.of(k2), self.counts.of(k3)
        if less_one:
            high = points > 127
            n1 -= high
            high2 = high.copy()
            high2[1:] |= high[:-1]
            n2 -= high2
            high2[2:] |= high[:-2]
            n3 -= high2
            for n in (n1, n2, n3):
                np.maximum(n, 0.0, out=n)
        prob = (n1 + 0.02) / (self.total + 0.02 * CHARACTERS)
        before1 = np.concatenate([[1.0], n1[:-1]])
        prob = (n2 + 4.0 * prob) / (np.maximum(before1, n2) + 4.0)
        before2 = np.concatenate([[1.0], n2[:-1]])
        prob = (n3 + 4.0 * prob) / (np.maximum(before2, n3) + 4.0)
        out = np.log(prob)
        out[~real] = 0.0
        return out

    def bounds(self) -> np.ndarray:
        """By code point below 0x10000: ln of the greatest probability that the character can have behind any two others."""
        n = self.counts.of(keyed(1, np.arange(1 << 16, dtype=np.uint32)))
        n[0x31:0x3A] = n[0x30]
        prob = (n + 0.02) / (self.total + 0.02 * CHARACTERS)
        for _ in range(2):
            prob = (n + 4.0 * prob) / (n + 4.0)
        out = np.log(prob)
        out[0xFFFF] = 0.0  # stands for all beyond
        return out

    def pair_bounds(self, chars: np.ndarray) -> np.ndarray:
        """ln of the greatest probability that each of the characters (columns) can have behind each (rows), whatever stands before both."""
        first, second = np.repeat(chars, len(chars)), np.tile(chars, len(chars))
        digit = lambda c: np.where((c >= 0x30) & (c <= 0x39), np.uint32(0x30), c)
        first, second = digit(first), digit(second)
        n = self.counts.of(keyed(2, first, second))
        prob = (self.counts.of(keyed(1, second)) + 0.02) / (self.total + 0.02 * CHARACTERS)
        prob = (n + 4.0 * prob) / (np.maximum(self.counts.of(keyed(1, first)) - 1, n) + 4.0)
        prob = np.minimum(1.0, (n + 4.0 * prob) / (n + 4.0))
        return np.log(prob).reshape(len(chars), len(chars))

    def score(self, texts: list[str], whole: bool = True) -> np.ndarray:
        """ln P of each text; of a part of a text, without its end, if not ``whole``.

        Texts and what chains make of them are compared with one count less, so that no record speaks for itself.
        """
        if not texts:
            return np.zeros(0)
        points, offsets = flatten(texts, 2, 1 if whole else 0)
        return row_sums(self.log_probs(points, offsets, less_one=True), offsets)


@functools.cache
def _to_latin(x: str) -> dict[int, int]:
    """Character -> Latin-1 character of the same byte, so that one C-level call can encode."""
    table = _decode_table(x)
    out = {int(table[b]): b for b in range(255, 127, -1) if table[b] != REPLACED}
    out |= {c: REPLACED for c in range(128, 256) if c not in out}
    return out


def _raw(text: str, x: str) -> bytes | None:
    try:
        return text.translate(_to_latin(x)).encode("latin-1") if x in SINGLE_BYTE else text.encode(x)
    except UnicodeEncodeError:
        return None


class _Masks(dict):
    """By character, a bit for each codec X: it can write the character; the bytes may begin, or go on with, a UTF-8 sequence."""

    def __missing__(self, c: str) -> tuple[int, int, int]:
        can = begins = goes_on = 0
        for i, x in enumerate(SINGLE_BYTE + MULTI_BYTE):
            raw = _raw(c, x)
            if raw is not None:
                can |= 1 << i
                begins |= (0xC2 <= raw[0] < 0xF5) << i
                goes_on |= (0x80 <= raw[0] < (0xC0 if x in SINGLE_BYTE else 0x100)) << i
        self[c] = can, begins, goes_on
        return self[c]


_masks = _Masks()
_WIDE_ONLY = ((1 << len(MULTI_BYTE)) - 1) << len(SINGLE_BYTE)


def _writers(text: str) -> int:
    """The codecs X that can write all characters, as bits."""
    out = -1
    for c in set(text):
        out &= _masks[c][0]
        if not out:
            break
    return out


_RUN, _TWO = re.compile("[^\x00-\x7f]+"), re.compile("[^\x00-\x7f]{2}")
#: A character outside ASCII that is no space and no invisible mark; those alone are unusual spacing, no garble.
_SPEAKING = re.compile("[^\x00-\x7f\u0085\u00a0\u00ad\u1680\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: Results by run of characters outside ASCII, kept while there are fewer than this.
KEPT_RUNS = 200_000
_runs: dict[str, tuple[tuple[int, str], ...]] = {}


def _utf8_run(run: str) -> tuple[tuple[int, str], ...]:
    """(number of X, text) for each codec X under which the run's bytes are UTF-8."""
    got = _runs.get(run)
    if got is None:
        out = []
        may = _masks[run[0]][1] & (_masks[run[1]][2] if len(run) > 1 else _WIDE_ONLY)
        may = may and may & _writers(run)
        for i, x in enumerate(SINGLE_BYTE + MULTI_BYTE) if may else ():
            if may >> i & 1 and (raw := _raw(run, x)) is not None:
                try:
                    out.append((i, raw.decode("utf-8")))
                except UnicodeDecodeError:
                    pass
        got = tuple(out)
        if len(_runs) < KEPT_RUNS:
            _runs[run] = got
    return got


def utf8_chains(text: str, depth: int = 3) -> Iterator[tuple[str, str]]:
    """Chains "encode as X, decode as UTF-8" that the whole text allows; a clean text has none, found at its first run."""
    runs = _RUN.findall(text)
    common: dict[int, None] | None = None
    forms = []
    for run in runs:
        form = dict(_utf8_run(run))
        common = dict.fromkeys(form) if common is None else {i: None for i in common if i in form}
        if not common:
            return
        forms.append(form)
    gaps = _RUN.split(text)
    names = SINGLE_BYTE + MULTI_BYTE
    deeper: dict[str, list[tuple[str, str]]] = {}
    for i in common or ():
        got = "".join(g + f for g, f in zip(gaps, [*(form[i] for form in forms), ""]))
        yield f"{names[i]}>utf-8", got
        if depth > 1 and not got.isascii() and got not in deeper:
            deeper[got] = list(utf8_chains(got, depth - 1))
            for name, again in deeper[got]:
                yield f"{names[i]}>utf-8 {name}", again


#: A window: runs of characters outside ASCII with at most one ASCII character, no line end, between them.
_WINDOW = re.compile("[^\x00-\x7f]+(?:[\x00-\x09\x0b-\x7f][^\x00-\x7f]+)*")
#: Full stops written without a space behind them, where a window may end.
_STOPS = re.compile("(?<=[。！？｡])(?=.)", re.DOTALL)


def windows(text: str) -> list[tuple[int, int, int, int]]:
    """The text's windows: where each begins and ends, and where what it is judged with begins and ends, up to two ASCII characters on both sides.

    A model of three characters sees no further than from one window to the next, so what a chain gains on a text is the sum
    of its gains on the windows. Those of spaces and invisible marks alone are left out.
    """
    out = []
    stops = _STOPS.search(text) is not None
    for m in _WINDOW.finditer(text):
        a, end = m.span()
        left = a - 2 if a > 1 and text[a - 2] < "\x80" else max(0, a - 1)  # the character beside a window is ASCII, the second one may not be
        ends = [k.start() for k in _STOPS.finditer(text, a, end)] if stops else []
        for b in (*ends, end):
            if _SPEAKING.search(text, a, b):
                right = b if b < end else b + 2 if text[b + 1 : b + 2] < "\x80" else b + 1
                out.append((a, b, left, min(right, len(text))))
            a = left = b
    return out


#: Characters outside ASCII up to which a text may be UTF-8 all of whose continuation bytes were folded to ASCII.
FEW_SIGNS = 3


class _Bits:
    """By code point below 0x10000, bits for the codecs X: it can write the character; there is a beginning of a UTF-8 sequence
    and its continuation within the character's bytes; its last byte begins one; its first one goes on with one; its first byte, or
    one behind, is outside ASCII; and is one that goes on with a sequence. In multi-byte codecs no byte folded to ASCII goes on."""

    def __init__(self) -> None:
        self.known = np.zeros(1 << 16, dtype=bool)
        self.can, self.inner, self.ends, self.starts, self.high, self.high2, self.cont, self.cont2 = (np.zeros(1 << 16, dtype=np.uint32) for _ in range(8))

    def learn(self, low: np.ndarray) -> None:
        seen = np.zeros(1 << 16, dtype=bool)
        seen[low] = True
        for c in np.flatnonzero(seen & ~self.known):
            char = chr(c)
            for i, x in enumerate(SINGLE_BYTE + MULTI_BYTE):
                raw = _raw(char, x) if c != REPLACED else None
                if raw is not None:
                    bit = np.uint32(1 << i)
                    self.can[c] |= bit
                    goes_on = _GOES_ON if i < len(SINGLE_BYTE) else _CONTINUES
                    for table, holds in (
                        (self.inner, any(_BEGINS[b] and goes_on[d] for b, d in zip(raw, raw[1:]))), (self.ends, _BEGINS[raw[-1]]), (self.starts, goes_on[raw[0]]),
                        (self.high, raw[0] > 127), (self.high2, any(b > 127 for b in raw[1:])), (self.cont, _CONTINUES[raw[0]]), (self.cont2, any(_CONTINUES[b] for b in raw[1:])),
                    ):
                        if holds:
                            table[c] |= bit
            self.known[c] = True

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each of the texts, none of them empty: the codecs that can write it, and those under which enough UTF-8 sequences
        begin and go on: a third of its bytes outside ASCII begin one, and one of them, in a text of more than a few such characters,
        with a byte that is no ASCII now; for multi-byte codecs a quarter begin one, and two in five can go on with one."""
        points, offsets = flatten(texts)
        low = np.where(points < 1 << 16, points, 0xFFFF)
        self.learn(low)
        at = np.flatnonzero(points > 127)
        start = np.searchsorted(at, offsets)
        here, behind = low[at], low[np.minimum(at + 1, len(low) - 1)]
        last = np.zeros(len(points) + 1, dtype=bool)
        last[offsets[1:] - 1] = True  # a text's last character is followed by none
        follows = np.where(last[at], np.uint32(0), self.starts[behind])
        pair = self.inner[here] | (self.ends[here] & follows)
        whole = np.where(behind > 127, pair, self.inner[here])
        opens = np.zeros(len(texts), dtype=np.uint32)
        some = np.flatnonzero(np.diff(start) > 0)
        if len(some):
            first = start[:-1][some]
            ones = lambda bits: np.add.reduceat((bits >> np.uint32(i)) & np.uint32(1), first)  # noqa: E731, B023
            for i in range(len(SINGLE_BYTE + MULTI_BYTE)):
                pairs = ones(pair)
                if pairs.any():
                    high = ones(self.high[here]) + ones(self.high2[here])
                    enough = (pairs > 0) & (pairs * (3 if i < len(SINGLE_BYTE) else 4) >= high)
                    if i >= len(SINGLE_BYTE):
                        enough &= 5 * (ones(self.cont[here]) + ones(self.cont2[here])) >= 2 * high
                    opens[some] |= enough.astype(np.uint32) << np.uint32(i)
            short = np.diff(start)[some] <= FEW_SIGNS
            opens[some] &= np.where(short, np.uint32(0xFFFFFFFF), np.bitwise_or.reduceat(whole, first))
        return np.bitwise_and.reduceat(self.can[low], offsets[:-1]), opens


_bits = _Bits()
#: Windows whose results are kept by one task, and the least gain of a chain that is kept: a window on which the chain
#: loses more is taken for one that does not belong to the chain's stretch.
KEPT_WINDOWS, FLOOR = 120_000, -8.0
#: The least that counts for a window that is valid UTF-8.
LEAST_VALID = -2.0
#: What it costs to begin or end a chain's stretch inside a text.
SWITCH = 4.0


@functools.cache
def _byte_table(x: str) -> np.ndarray:
    """By code point below 0x10000 the byte of a character that the single-byte codec can write."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    out[:128] = np.arange(128)
    for c, b in _to_latin(x).items():
        if b != REPLACED:
            out[c] = b
    return out


@functools.cache
def _strict_table(codec: str) -> np.ndarray:
    """Code point of each byte; -1 if the codec knows none."""
    out = np.full(256, -1, dtype=np.int64)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            pass
    return out


@functools.cache
def _pair_table(codec: str) -> np.ndarray:
    """By two bytes: the character that a multi-byte codec reads the first one, or both, as; -1 for none, -2 where longer sequences begin."""
    out = np.full(1 << 16, -1, dtype=np.int32)
    for b in range(256):
        try:
            out[b << 8 : (b + 1) << 8] = ord(bytes([b]).decode(codec))
            continue
        except UnicodeDecodeError:
            pass
        for d in range(256):
            try:
                out[b << 8 | d] = ord(bytes([b, d]).decode(codec))
            except UnicodeDecodeError:
                if (codec == "gb18030" and 0x30 <= d <= 0x39) or (codec == "euc_jp" and b == 0x8F):
                    out[b << 8 | d] = -2
    return out


@functools.cache
def _pair_steps(codec: str) -> np.ndarray:
    """By two bytes: how many of them the character takes; far beyond any text where longer sequences begin."""
    table = _pair_table(codec).reshape(256, 256)
    alone = (table >= 0).all(axis=1)  # no second byte is right behind a first one whatever it is
    return np.where(table == -2, 1 << 40, np.where(alone, 1, 2)[:, None]).ravel()


def gains_of(model: CharModel) -> Gains:
    """The model's gains, kept with it for all tasks of a Python worker."""
    if model.gains is None:
        model.gains = Gains(model)
    return model.gains


class Gains:
    """What each chain gains on a window, remembered by window.

    A form is scored unless even the greatest probability that its characters have anywhere leaves it below FLOOR.
    """

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[float, dict[str, tuple[float, str]], bool, float]] = {}
        #: The same for windows that are their texts' only ones, where nothing below the model's margin is of use to judge a text.
        self.alone: dict[str, tuple[float, dict[str, tuple[float, str]], bool, float]] = {}
        self.most = model.bounds()
        chars = np.unique(np.concatenate([_strict_table(y) for y in WRITTEN_SINGLE]))
        pairs = model.pair_bounds(np.maximum(chars, 0).astype(np.uint32)).astype(np.float32)
        pairs[chars < 0] = pairs[:, chars < 0] = -1e9
        #: By two bytes, the greatest ln P of the second one's character behind the first one's.
        self.most_of_pair = {}
        for y in WRITTEN_SINGLE:
            at = np.searchsorted(chars, _strict_table(y))
            self.most_of_pair[y] = pairs[at[:, None], at].ravel()
        #: The same for the characters of multi-byte encodings, whatever stands before them.
        self.most_of_wide = {}
        for y in WRITTEN_MULTI:
            table = _pair_table(y)
            self.most_of_wide[y] = np.where(table >= 0, self.most[np.clip(table, 0, 0xFFFF)], np.where(table == -1, -1e9, 1e9))

    def learn(self, some: list[str], alone: bool = False) -> None:
        some = list(dict.fromkeys(some))
        known = self.alone if alone else self.known
        if len(known) > KEPT_WINDOWS:
            kept = {w: known[w] for w in some if w in known}
            known.clear()
            known |= kept
        new = [w for w in some if w not in known]
        for part in portions(new, 1 << 16):
            self._learn(new[part], known, self.model.margin - 0.01 if alone else FLOOR)  # bounds are rounded

    def _learn(self, new: list[str], known: dict[str, tuple[float, dict[str, tuple[float, str]], bool, float]], least: float) -> None:
        points, offsets = flatten(new, 2, 1)
        logs = self.model.log_probs(points, offsets, less_one=True)
        base, foreign = row_sums(logs, offsets), row_sums(np.where(points > 127, logs, 0.0), offsets)
        writers, pairs = _bits.of(new)
        forms: dict[tuple[int, str], list[str]] = defaultdict(list)
        for k, window in enumerate(new):
            for name, got in utf8_chains(window, 1):
                forms[k, got].append(name)
        self._bytewise(new, writers, base + least, forms)
        for k in np.flatnonzero(pairs):
            for name, got in damaged_forms(new[k], int(pairs[k])):
                forms[int(k), got].append(name)
        results: list[dict[str, tuple[float, str]]] = [{} for _ in new]
        keys = list(forms)
        for start in range(0, len(keys), AT_A_TIME):
            some = keys[start : start + AT_A_TIME]
            for (k, got), score in zip(some, self.model.score([got for _, got in some])):
                gain = float(score - base[k])
                if forms[k, got][0].endswith(">utf-8"):  # that it is valid UTF-8 speaks for it, even if its characters are rare
                    gain = max(gain, LEAST_VALID)
                if gain > FLOOR:
                    for name in forms[k, got]:
                        if name not in results[k] or gain > results[k][name][0]:
                            results[k][name] = gain, got
        for window, result, log in zip(new, results, foreign.tolist()):
            known[window] = max((g for g, _ in result.values()), default=0.0), result, any(g > 0 and ">utf-8" in name for name, (g, _) in result.items()), log

    def _bytewise(self, new: list[str], writers: np.ndarray, least: np.ndarray, forms: dict[tuple[int, str], list[str]]) -> None:
        """Chains to the single-byte and multi-byte encodings; the latter's characters may take in ASCII bytes."""
        points, offsets = flatten(new)
        low = np.where(points < 1 << 16, points, 0xFFFF)
        wide: list[tuple[int, str, list[str]]] = []
        raws: dict[tuple[int, bytes], list[str]] = {}
        for i, x in enumerate(SINGLE_BYTE):
            at = np.flatnonzero(writers >> np.uint32(i) & np.uint32(1))
            if len(at):
                sizes = np.diff(offsets)[at]
                start = np.concatenate([[0], np.cumsum(sizes)])
                raw = _byte_table(x)[low[np.arange(start[-1]) + np.repeat(offsets[at] - start[:-1], sizes)]].tobytes()
                for k, a, b in zip(at.tolist(), start.tolist(), start[1:].tolist()):
                    raws.setdefault((k, raw[a:b]), []).append(x)
        self._single(raws, least, forms)
        for i, x in enumerate(MULTI_BYTE, len(SINGLE_BYTE)):
            for k in np.flatnonzero(writers >> np.uint32(i) & np.uint32(1)):
                raw = _raw(new[k], x)
                if raw is not None:
                    raws.setdefault((int(k), raw), []).append(x)
        keys = list(raws)
        for r, i in np.argwhere(self._readable([raw for _, raw in keys], least[[k for k, _ in keys]])).tolist():
            (k, raw), y = keys[r], WRITTEN_MULTI[i]
            xs = raws[keys[r]]
            if y not in xs:
                try:
                    wide.append((k, raw.decode(y), [f"{x}>{y}" for x in xs]))
                except UnicodeDecodeError:
                    pass
        if wide:
            points, offsets = flatten([got for _, got, _ in wide])
            most = np.add.reduceat(self.most[np.where(points < 1 << 16, points, 0xFFFF)], offsets[:-1])
            for r in np.flatnonzero(most > least[[k for k, _, _ in wide]]):
                k, got, names = wide[r]
                forms[k, got] += names

    def _readable(self, raws: list[bytes], enough: np.ndarray) -> np.ndarray:
        """Which byte strings (rows) each multi-byte encoding (columns) may read as characters likely enough: all that it reads so, and few besides."""
        out = np.zeros((len(raws), len(WRITTEN_MULTI)), dtype=bool)
        if not raws:
            return out
        joined = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(raw) for raw in raws])
        starts = np.concatenate([[0], ends[:-1]])
        behind = np.append(joined[1:], 0)
        behind[ends[ends > starts] - 1] = 0  # no second byte
        pair = joined << 8 | behind
        least = enough - 1e-6  # sums may differ in their last digits
        for i, y in enumerate(WRITTEN_MULTI):
            most, steps = self.most_of_wide[y], _pair_steps(y)
            live = np.flatnonzero(ends > starts)
            at, total = starts[live], np.zeros(len(live))
            while len(live):
                here = pair[at]
                total, at = total + most[here], at + steps[here]
                likely = total > least[live]
                over = at >= ends[live]
                out[live[likely & over], i] = True
                on = likely & ~over
                live, at, total = live[on], at[on], total[on]
        return out

    def _single(self, raws: dict[tuple[int, bytes], list[str]], least: np.ndarray, forms: dict[tuple[int, str], list[str]]) -> None:
        if not raws:
            return
        keys = list(raws)
        joined = np.frombuffer(b"".join(raw for _, raw in keys), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum([len(raw) for _, raw in keys])])[:-1]
        pair = joined.astype(np.int64)
        pair[1:] += joined[:-1].astype(np.int64) << 8
        pair[start] = joined[start].astype(np.int64) | 0x20 << 8
        enough = least[[k for k, _ in keys]]
        for y, most in self.most_of_pair.items():
            of_each = most[pair]
            of_each[start] = np.where(of_each[start] < -1e8, -1e9, 0.0)  # what stands before the window is not known
            for r in np.flatnonzero(np.add.reduceat(of_each, start) > enough):
                (k, raw), xs = keys[r], raws[keys[r]]
                if y not in xs:
                    forms[k, raw.decode(y)] += [f"{x}>{y}" for x in xs]

    def best(self, text: str, own: list[tuple[int, int, int, int]], enough: float, alone: bool = False) -> Iterator[tuple[float, str, str]]:
        """Chains that gain more than ``enough`` on the text or on stretches of it: gain, name and result."""
        judged = [text[left:right] for _, _, left, right in own]
        results = [(self.alone if alone else self.known)[w] for w in judged]
        if sum(r[0] for r in results if r[0] > 0) <= enough:
            return
        if len(own) == 1:
            (_, _, left, right), found = own[0], results[0][1]
            name = max(found, key=lambda n: found[n][0])
            yield found[name][0], name, text[:left] + found[name][1] + text[right:]
            return
        worth: dict[str, float] = {}
        for r in results:
            for name, (gain, _) in r[1].items():
                if gain > 0:
                    worth[name] = worth.get(name, 0.0) + gain
        seen = set()
        for name, most in worth.items():
            if most <= enough:
                continue
            forms = tuple(r[1].get(name) for r in results)
            if forms in seen:
                continue
            seen.add(forms)
            gain, inside = _stretches([f and f[0] for f in forms])
            changed = sum(b - a for (a, b, _, _), w, f, use in zip(own, judged, forms, inside) if use and f[1] != w)
            if gain > enough and (all(inside) or changed > 1):  # one character alone is no stretch
                out, at = [], 0
                for (_, _, left, right), form, use in zip(own, forms, inside):
                    if not use:
                        continue
                    got = form[1]
                    out += [text[at:left], got[max(0, at - left) :]]  # two windows may be judged with the same characters between them
                    at = right
                yield gain, name if all(inside) else f"{name} of a part", "".join(out) + text[at:]


def _stretches(gains: list[float | None]) -> tuple[float, list[bool]]:
    """The likeliest stretches of windows for a chain that gains so much on each (None: it cannot be applied there): the sum and the windows inside."""
    out, chain = 0.0, -np.inf
    back: list[tuple[bool, bool]] = []
    for i, gain in enumerate(gains):
        into, stay = out - (SWITCH if i else 0.0), chain
        leave = chain - SWITCH
        back.append((leave > out, stay >= into))
        out, chain = max(out, leave), (max(into, stay) + gain if gain is not None else -np.inf)
    state, inside = chain >= out, []
    total = max(out, chain)
    for leave, stay in reversed(back):
        inside.append(state)
        state = stay if state else leave
    return total, inside[::-1]


@functools.cache
def _folded_bytes(x: str) -> dict[int, int]:
    """ASCII byte -> the continuation byte whose character in X compatibility normalisation turns into it."""
    out = {}
    for b in range(0xBF, 0x7F, -1):
        plain = unicodedata.normalize("NFKC", chr(_decode_table(x)[b]))
        if len(plain) == 1 and plain.isascii():
            out[ord(plain)] = b
    return out


#: Bytes that begin no UTF-8 sequence, and sequences that are whole.
_GONE_ON = re.compile(b"(?:[\x00-\xc1\xf5-\xff]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def mend(raw: bytes, x: str = "latin-1", space: int | None = None) -> bytes:
    """UTF-8 with some continuation bytes folded to ASCII or (U+00AD) dropped: put them back where one is due.

    A space there was a continuation byte itself, or stands behind one that was lost: ``space`` says which to put in front of it.
    """
    out = bytearray()
    folded = _folded_bytes(x)
    at, end = 0, len(raw)
    while at < end:
        if m := _GONE_ON.match(raw, at):
            out += m.group()
            at = m.end()
            continue
        out.append(raw[at])
        due = 1 if raw[at] < 0xE0 else 2 if raw[at] < 0xF0 else 3
        at += 1
        while due and at < end:
            b, due = raw[at], due - 1
            if 0x80 <= b < 0xC0 or (b in folded and (b != 0x20 or space is None)):
                out.append(folded.get(b, b) if b < 0x80 else b)
                at += 1
                continue
            out.append(space if b == 0x20 and space is not None else 0xAD)
            if not due or not 0x80 <= b < 0xC0:
                break
    return bytes(out)


_LOST = re.compile("\ufffd+")
#: A beginning of a UTF-8 sequence that isn't gone on with.
_BROKEN = re.compile(b"[\xc2-\xf4](?![\x80-\xbf])|[\xe0-\xf4][\x80-\xbf](?![\x80-\xbf])|[\xf0-\xf4][\x80-\xbf]{2}(?![\x80-\xbf])")
_ASCII_OR_LOST = re.compile("[\x00-\x7f\ufffd]")
_CONTINUES = np.array([0x80 <= b < 0xC0 for b in range(256)])
_BEGINS, _GOES_ON = (np.array([re.fullmatch(p, bytes([b])) is not None for b in range(256)]) for p in (b"[\xc2-\xf4]", b"[\x80-\xbf 123ao]"))


def damaged_forms(text: str, codecs: int) -> Iterator[tuple[str, str]]:
    """What may be left of UTF-8 that was changed after it was garbled; what stays unreadable is U+FFFD.

    ``codecs`` are those under which enough UTF-8 sequences begin, as bits.
    """
    read: dict[bytes, str] = {}
    while codecs:
        i = (codecs & -codecs).bit_length() - 1
        codecs &= codecs - 1
        x = (SINGLE_BYTE + MULTI_BYTE)[i]
        seen = {text}
        if i < len(SINGLE_BYTE):
            raw = text.translate(_lossy(x)).encode("latin-1", "replace")
            raws = dict.fromkeys((raw, mend(raw, x), mend(raw, x, 0xA0), mend(raw, x, 0xAD)) if _BROKEN.search(raw) else (raw,))
        else:
            raws = {b"\xff".join(part.encode(x, "replace") for part in text.split("\ufffd")): None}
        for raw in raws:
            if raw not in read:
                got = _LOST.sub("\ufffd", raw.decode("utf-8", "replace"))
                lost = got.count("\ufffd")
                read[raw] = got if lost * 4 <= len(got) and lost < len(got) - len(_ASCII_OR_LOST.findall(got)) else text
            got = read[raw]
            if got not in seen:
                seen.add(got)
                yield f"{x}>utf-8 in part", got


@functools.cache
def _lossy(x: str) -> dict[int, int]:
    """As ``_to_latin``, but characters that are lost have the byte 0xFF."""
    return {c: 0xFF if b == REPLACED else b for c, b in _to_latin(x).items()} | {REPLACED: 0xFF}


def _mend_pairs(raw: bytes, x: str) -> bytes:
    """Text of two-byte characters with some second bytes folded to ASCII: put them back."""
    out, due, folded = bytearray(), False, _folded_bytes(x)
    for b in raw:
        out.append(folded.get(b, b) if due and b != 0x20 else b)
        due = not due and b >= 0xA1
    return bytes(out)


def altered_forms(text: str, form: str) -> Iterator[tuple[str, str]]:
    """Chains to single-byte and multi-byte encodings for text that was compatibility-normalised after it was garbled; ``form`` is its unfolded form."""
    seen = {text}
    for x in ("cp1252", "latin-1"):
        raw = _raw(form, x)
        if raw is None:
            continue
        for y in WRITTEN_SINGLE + WRITTEN_MULTI if form != text else ():
            got = raw.decode(y, "replace")
            if got not in seen and got.count("\ufffd") * 4 <= len(got):
                seen.add(got)
                yield f"{x}>{y} in part", got
        mended = _mend_pairs(raw, x)
        for y in ("euc_jp", "gb18030", "cp949") if mended != raw else ():
            got = mended.decode(y, "replace")
            if got not in seen and got.count("\ufffd") * 4 <= len(got):
                seen.add(got)
                yield f"{x}>{y} in part", got


_FOLDED = re.compile("|".join(re.escape(a) for a, _ in UNFOLD))


def _unfolded(text: str) -> str:
    for a, b in UNFOLD if _FOLDED.search(text) else ():
        text = text.replace(a, b)
    return text


_CONTROL = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


def restore(texts: list[str], model: CharModel, gains: Gains | None = None, rounds: int = 6) -> tuple[list[str | None], list[str], np.ndarray]:
    """For each text its restored form (None: leave it), the chains applied and whether it is garbled."""
    n = len(texts)
    best: list[str | None] = [None] * n
    path = [""] * n
    garbled = np.zeros(n, dtype=bool)
    if not n:
        return best, path, garbled
    garbled |= np.fromiter((_CONTROL.search(t) is not None for t in texts), bool, n)
    if not model.total:  # nothing was learned: no text is likelier than another
        return best, path, garbled
    gains = gains_of(model) if gains is None else gains
    live = [i for i in range(n) if _SPEAKING.search(texts[i])]
    current = dict(zip(live, (texts[i] for i in live)))
    for k in range(rounds):
        after = []
        found, means = _best_chains([current[i] for i in live], model, gains)
        if not k:
            garbled[live] |= means < model.beyond
        for i, (gain, name, got) in zip(live, found):
            if gain > model.margin:
                path[i] = f"{path[i]} {name}".strip()
                current[i] = best[i] = got
                garbled[i] = True
                if not got.isascii():
                    after.append(i)
        live = after
    return best, path, garbled


def judge(texts: list[str], model: CharModel) -> np.ndarray:
    """Which texts are garbled: what ``restore`` tells of them, without their restored forms, so in one round and up to the first chain that is accepted."""
    garbled = np.fromiter((_CONTROL.search(t) is not None for t in texts), bool, len(texts))
    live = [i for i, t in enumerate(texts) if not garbled[i] and _SPEAKING.search(t)] if model.total else []
    found, means = _best_chains([texts[i] for i in live], model, judging=True)
    garbled[live] = (means < model.beyond) | np.fromiter((gain > model.margin for gain, _, _ in found), bool, len(found))
    return garbled


#: Forms that are scored at a time.
AT_A_TIME = 20_000
#: Chains that gain less than this on a text are not considered; no margin is below it.
LEAST = 1.0


#: Characters outside ASCII from which on a text is garbled, even if no chain restores it, where their mean ln P is below the model's ``beyond``.
SOME = 5


def _best_chains(texts: list[str], model: CharModel, gains: Gains | None = None, judging: bool = False) -> tuple[list[tuple[float, str, str]], np.ndarray]:
    """The likeliest chain of each text, or of stretches of it: its gain over the text itself, its name and its result. And the mean
    ln P of each text's characters outside ASCII, 0 where there are fewer than SOME. If ``judging``, any chain that gains more than the
    model's margin stands for the likeliest, and none need be found for a text whose mean is below ``beyond``."""
    out: list[tuple[float, str, str]] = [(0.0, "", "")] * len(texts)
    means = np.zeros(len(texts))
    if not texts:
        return out, means
    gains = gains_of(model) if gains is None else gains
    cut = [windows(t) for t in texts]
    judged = [[t[left:right] for _, _, left, right in own] for t, own in zip(texts, cut)]
    perhaps = [False] * len(texts)
    points, offsets = flatten(texts)
    numbers = row_sums(points > 127, offsets).astype(np.int64).tolist()
    size = start = 0
    for k, own in enumerate(judged):  # a portion's windows are looked up before others can take their place
        size += len(own)
        if size < KEPT_WINDOWS and k + 1 < len(texts):
            continue
        gains.learn([w for some in judged[start : k + 1] if not (judging and len(some) == 1) for w in some])
        if judging:
            gains.learn([some[0] for some in judged[start : k + 1] if len(some) == 1], alone=True)
        for j in range(start, k + 1):
            alone = judging and len(judged[j]) == 1
            for found in gains.best(texts[j], cut[j], model.margin if judging else LEAST, alone):
                if found[0] > out[j][0] + 1e-6:
                    out[j] = found
                if judging and found[0] > model.margin:
                    break
            known = [(gains.alone if alone else gains.known)[w] for w in judged[j]]
            perhaps[j] = any(w[2] for w in known)
            if known and numbers[j] >= SOME:
                means[j] = sum(w[3] for w in known) / numbers[j]
        start, size = k + 1, 0
    if judging:
        open_ = [k for k in range(len(texts)) if out[k][0] <= model.margin and means[k] >= model.beyond]
        still = [out[k] for k in open_]
        _try_altered([texts[k] for k in open_], still, [perhaps[k] for k in open_], [numbers[k] for k in open_], model)
        for k, found in zip(open_, still):
            out[k] = found
    else:
        _try_altered(texts, out, perhaps, numbers, model)
    return out, means


def _try_altered(texts: list[str], out: list[tuple[float, str, str]], perhaps: list[bool], numbers: list[int], model: CharModel) -> None:
    """Forms of whole texts that were changed after they were garbled: of those that change when compatibility normalisation is
    undone, have a window that gains by a chain to UTF-8 (``perhaps``), or are written outside ASCII for the most part (``numbers``: so many characters
    of each); where no strict UTF-8 chain was accepted."""
    rest, unfolded, foreign = [], [], []
    for k, text in enumerate(texts):
        if text and not (out[k][0] > model.margin and out[k][1].endswith(">utf-8")):
            form = _unfolded(text)
            mostly = 2 * (numbers[k] if form == text else sum(map(len, _RUN.findall(form)))) >= len(form)
            if perhaps[k] or form != text or mostly:
                rest.append(k)
                unfolded.append(form)
                foreign.append(mostly)
    if not rest:
        return
    changed = [j for j, k in enumerate(rest) if unfolded[j] != texts[k]]
    owner: list[int] = []
    names: list[str] = []
    forms: list[str] = []

    def add(k: int, options: Iterator[tuple[str, str]]) -> None:
        for name, got in options:
            owner.append(k)
            names.append(name)
            forms.append(got)

    if changed:
        pairs = _bits.of([unfolded[j] for j in changed])[1]
        for j, codecs in zip(changed, pairs.tolist()):
            add(rest[j], damaged_forms(unfolded[j], codecs))
    pairs = _bits.of([texts[k] for k in rest])[1]
    for k, form, mostly, codecs in zip(rest, unfolded, foreign, pairs.tolist()):
        if perhaps[k]:
            add(k, damaged_forms(texts[k], codecs))
        if mostly and _TWO.search(form):
            add(k, altered_forms(texts[k], form))
    base: dict[int, float] = dict(zip(rest, model.score([texts[k] for k in rest])))
    for start in range(0, len(forms), AT_A_TIME):
        part = slice(start, start + AT_A_TIME)
        for k, name, got, score in zip(owner[part], names[part], forms[part], model.score(forms[part])):
            if score - base[k] > out[k][0] + 1e-6:
                out[k] = float(score - base[k]), name, got


@functools.cache
def _kinds() -> np.ndarray:
    """By code point below 0x10000: 1 lower case, 2 upper case, 4 accented Latin letter or Latin-1 sign, 8 letter outside ASCII."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        out[c] = s.islower() | s.isupper() << 1 | (0xA0 <= c < 0x250) << 2 | (c > 127 and s.isalpha()) << 3
    return out


def _looks_clean(texts: list[str]) -> np.ndarray:
    """Records to train on.

    Left out: U+FFFD, control or private-use characters, any chain back to UTF-8, a majority of
    accented Latin letters and Latin-1 signs, and words outside ASCII that change from lower to upper case.
    """
    out = np.ones(len(texts), dtype=bool)
    foreign_at = [i for i, t in enumerate(texts) if not t.isascii()]
    out[foreign_at] = _foreign_looks_clean([texts[i] for i in foreign_at])
    return out


def _foreign_looks_clean(texts: list[str]) -> np.ndarray:
    points, offsets = flatten(texts, 1, 0)
    low = np.where(points < 1 << 16, points, 0xFFFF)
    odd = ((points >= 0x80) & (points < 0xA0)) | ((points >= 0xE000) & (points < 0xF900)) | (points == REPLACED)
    kind = _kinds()[low]
    sums = lambda x: np.add.reduceat(x.astype(np.int32), offsets[:-1]) if texts else np.zeros(0)
    accented = sums(kind & 4 > 0)
    letters = sums((kind & 3 > 0) | (kind & 8 > 0))
    mixed = np.zeros(len(points), dtype=bool)
    mixed[1:] = (kind[:-1] & 1 > 0) & (kind[1:] & 10 == 10)
    foreign = sums(kind & 8 > 0)
    clean = (sums(odd) == 0) & (accented * 2.5 <= letters) & (sums(mixed) * 20 <= foreign)
    for i, text in enumerate(texts):
        if clean[i]:
            clean[i] = next(utf8_chains(text), None) is None
    return clean


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams of the records to train on; those of records held out (``held``, if there is such a column) are counted apart."""
    tally = KeyTally()
    for batch in batches:
        held = batch["held"].to_numpy(dtype=bool) if "held" in batch else np.zeros(len(batch), dtype=bool)
        whole = batch["text"].tolist()
        for part, out in ((p, h) for p in portions(whole) for h in (False, True)):
            texts = [t for t, h in zip(whole[part], held[part]) if h == out]
            keep = _looks_clean(texts)
            points, offsets = flatten([t for t, k in zip(texts, keep) if k], 2, 1)
            if len(points):
                k3, k2, k1, real = _ngram_keys(points, offsets)
                context = real.copy()  # the second mark in front too, as what first characters follow
                context[offsets[:-1] + 1] = True
                tally.add(np.concatenate([k3[real], k2[context], k1[context]]), int(out))
    yield tally.frame()


#: Width and number of the steps in which gains are counted and margins considered, in ln P of a whole text.
GAIN_STEP, GAIN_STEPS = 0.25, 48
#: Chains used to garble held-out records when the margin is set.
PROBES = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("koi8-r", "cp1251"), ("cp1251", "latin-1"), ("cp1253", "latin-1"), ("cp1256", "cp1252"), ("cp1252", "cp1251"))


def _probe(text: str, y: str, x: str) -> str | None:
    try:
        raw = text.encode(y)
    except UnicodeEncodeError:
        return None
    if x in SINGLE_BYTE:
        return "".join(map(chr, _decode_table(x)[list(raw)]))
    return None


CLEAN, GARBLED, HIDDEN, UNCLEAR, MEANS = range(5)
#: The share of clean held-out rows without a likelier form that may lie below ``beyond``.
FEW = 0.001


def _gain_batches(batches: Iterator[pd.DataFrame], model: CharModel) -> Iterator[pd.DataFrame]:
    """Held-out records by side and step of their gain: as they are if they look clean; garbled on purpose; of those,
    the ones that look clean still; and how many do not look clean."""
    tally = Tally((4 + 2) * GAIN_STEPS)
    for batch in batches:
        whole = batch["text"].tolist()
        for part in portions(whole):
            keep = _looks_clean(whole[part])
            clean = [t for t, k in zip(whole[part], keep) if k]
            bad = [g for t in clean if (g := _probe(t, *PROBES[zlib.crc32(t.encode("utf-8", "surrogatepass")) % len(PROBES)])) and g != t]
            for side, texts in ((CLEAN, clean), (GARBLED, bad)):
                chains, means = _best_chains(texts, model)
                found = np.array([g for g, _, _ in chains])
                step = np.clip(found / GAIN_STEP, 0, GAIN_STEPS - 1).astype(np.int64)
                tally.add(side * GAIN_STEPS + step)
                if side == CLEAN and texts:
                    mean = means[(means < 0) & (found <= LEAST)]
                    tally.add(MEANS * GAIN_STEPS + np.clip(-mean / GAIN_STEP, 0, 2 * GAIN_STEPS - 1).astype(np.int64))
                if side == GARBLED and texts:
                    tally.add(HIDDEN * GAIN_STEPS + step[_looks_clean(texts)])
            tally.add(np.full(int((~keep).sum()), UNCLEAR * GAIN_STEPS))
    yield tally.frame()


def best_margin(gains: np.ndarray, default: float) -> float:
    """The margin that judges fewest held-out rows wrongly, false accepts and misses together; of equal ones the nearest to ``default``.

    Some rows that look clean were garbled before. As many as gain the most are taken for such, and with them their share of
    lower gains, as rows garbled on purpose that look clean have them. Misses are weighted by the number of garbled rows, for
    which those that do not look clean stand.
    """
    clean, bad, hidden, unclear = gains.reshape(4, GAIN_STEPS)
    if not clean.sum() or not bad.sum():
        return default
    sure = slice(GAIN_STEPS * 3 // 4, None)
    garbled_before = hidden * clean[sure].sum() / hidden[sure].sum() if hidden[sure].any() else np.zeros(GAIN_STEPS)
    left = (clean - garbled_before)[::-1].cumsum()[::-1]
    accepted = np.maximum.accumulate(np.maximum(left, 0.0)[::-1])[::-1]  # gain at or over the step's lower bound
    missed = np.concatenate([[0], bad.cumsum()[:-1]]) * max(1.0, unclear.sum()) / bad.sum()
    wrong = accepted + missed
    steps = np.arange(int(LEAST / GAIN_STEP), GAIN_STEPS)  # below chance decides
    best = steps[wrong[steps] <= wrong[steps].min() + 1e-9] * GAIN_STEP
    return float(best[np.argmin(np.abs(best - default))])


def best_beyond(means: np.ndarray, default: float) -> float:
    """The greatest mean ln P, ``default`` at the most, below which no more than a FEW of the clean held-out rows lie."""
    below = means[::-1].cumsum()[::-1]  # rows whose mean is at most minus the step's lower bound
    fits = np.flatnonzero(below <= FEW * means.sum())
    return min(default, -float(fits[0]) * GAIN_STEP) if len(fits) else -2.0 * GAIN_STEPS * GAIN_STEP


def fit(texts: DataFrame, held_out: int = 64, most: int | None = None) -> CharModel:
    """Train on all clean records of ``texts`` (a column ``text``), with all their n-grams; with at most ``most`` longer ones only if that is given.

    The margin, and how unlikely a text must be to be garbled without a likelier form, are set by one text in ``held_out``, chosen
    by a hash, with a model that has not seen them; then they are counted too.
    """
    held = F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0
    some = texts.select("text", held.alias("held")).filter("text is not null and text <> ''")
    counts = some.mapInPandas(_count_batches, KEYED_SCHEMA)
    if most is None:
        of_all, of_seen, single, single_seen = map_keys(counts)
        model, seen = CharModel.over(of_all, single), CharModel.over(of_seen, single_seen)
    else:
        kept = gather_keys(counts, most)
        keys, n = kept["key"].to_numpy().view(np.uint64), kept["n"].to_numpy()
        model, seen = CharModel(keys, n + kept["held"].to_numpy()), CharModel(keys[n > 0], n[n > 0])
    shared = texts.sparkSession.sparkContext.broadcast(seen)
    rows = some.filter("held").select("text").filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    gains = gather(rows.mapInPandas(lambda it: _gain_batches(it, shared.value), COUNT_SCHEMA), (4 + 2) * GAIN_STEPS)
    model.margin = best_margin(gains[: 4 * GAIN_STEPS], model.margin)
    model.beyond = best_beyond(gains[4 * GAIN_STEPS :], model.beyond)
    shared.destroy()
    return model


RESULT_SCHEMA = "rec_kind string, rec_key long, text string, restored string, chain string"


class Repairer:
    """Restores strings one batch after another in one task, remembering repeated strings and runs."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[str | None, str, bool]] = {}
        self.judged: dict[str, bool] = {}

    def __call__(self, texts: list[str]) -> list[tuple[str | None, str, bool]]:
        """(restored text or None, chain, garbled) for each text."""
        if len(self.known) > KEPT_RUNS:
            self.known.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        for part in portions(new):
            self.known |= zip(new[part], zip(*restore(new[part], self.model)))
        return [self.known[t] for t in texts]

    def mask(self, texts: list[str | None]) -> np.ndarray:
        """Which texts are garbled; null and ASCII texts are not."""
        out = np.zeros(len(texts), dtype=bool)
        at = [i for i, t in enumerate(texts) if isinstance(t, str) and not t.isascii()]
        if len(self.judged) > KEPT_RUNS:
            self.judged.clear()
        new = [t for t in dict.fromkeys(texts[i] for i in at) if t not in self.judged]
        for part in portions(new):
            self.judged |= zip(new[part], judge(new[part], self.model).tolist())
        out[at] = [self.judged[texts[i]] for i in at]
        return out


def repair(records: DataFrame, model: CharModel) -> DataFrame:
    """The garbled rows of ``records`` (rec_kind, rec_key, text) with their restored text and the chain.

    Row-local: no shuffle. ASCII rows never leave the JVM.
    """
    shared = model.share(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for batch in batches:
            results = repairer(batch["text"].tolist())
            batch = batch.assign(restored=pd.Series([r[0] for r in results], index=batch.index, dtype=object), chain=[r[1] for r in results])
            yield batch[np.array([r[2] for r in results], dtype=bool)][["rec_kind", "rec_key", "text", "restored", "chain"]]

    rows = records.select("rec_kind", "rec_key", "text").filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    return rows.mapInPandas(run, RESULT_SCHEMA)


def garbled_keys(records: DataFrame, model: CharModel) -> DataFrame:
    """``rec_key`` of the garbled rows of ``records`` (rec_key, text), without what they were. Row-local."""
    shared = model.share(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for batch in batches:
            yield batch[repairer.mask(batch["text"].tolist())][["rec_key"]]

    return records.select("rec_key", "text").filter(F.col("text").rlike("[^\\x00-\\x7f]")).mapInPandas(run, "rec_key long")


def corpus_strings(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """The strings the problem is about: text_items.str and candidate_exports.normalized_text."""
    a = items.select(F.lit("item").alias("rec_kind"), F.col("item_key").alias("rec_key"), F.col("str").alias("text"))
    b = candidates.select(F.lit("candidate").alias("rec_kind"), F.col("candidate_key").alias("rec_key"), F.col("normalized_text").alias("text"))
    return a.unionByName(b)


def garbled(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Affected rows of both tables, restored where possible."""
    strings = corpus_strings(items, candidates)
    return repair(strings, fit(strings))
