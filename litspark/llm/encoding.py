"""Problem 3: text decoded with a wrong encoding, found and restored by character n-gram models."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.sources.tables import written

#: The smoothing of the model, of pairs and of the characters of a class.
SMOOTHING, SYMBOLS, OF_CLASS = 0.2, 400, 0.1
#: Share of all characters beyond ASCII from which a character is a symbol of its own; rarer ones are symbols by the block.
OWN_SYMBOL = 2e-5
#: Gain from which a record may count as misread, and from which a single sentence may.
LEAST_GAIN, SENTENCE_GAIN = 6.0, 4.0
#: What a lost character costs.
LOST_COST = 4.0
#: Characters that are scored at a time.
AT_A_TIME = 2_000_000
# Encodings as which UTF-8 is misread, and pairs (read as, written in) of other misreadings.
UTF8_READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "iso8859-15", "cp1254", "cp866")
AGAIN = ("cp1252", "cp1250", "cp1251", "mac_roman")
LATIN = (
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
)
CYRILLIC = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp866", "cp1251"), ("cp1251", "cp866"),
)
DOUBLE_BYTE = (("cp1252", "gb18030"), ("cp1251", "gb18030"), ("mac_roman", "gb18030"))
SINGLE_BYTE = LATIN + CYRILLIC
#: Characters that texts are likely to have been written with; others that a chain yields are chance hits.
LIKELY = re.compile("[\u00a0-\u024f\u0370-\u052f\u1e00-\u1eff\u2010-\u203a\u20a0-\u20bf\u2100-\u22ff\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef]")
LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
BEYOND = re.compile("[^\x00-\x7f]+")
#: Ideographs and syllables of East Asia: a class of characters each.
EAST = ((0x3400, 0xA000), (0xAC00, 0xD7B0))
POINTS = 1 << 16


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a single-byte codec, and back; unused bytes are control characters."""
    chars = "".join(bytes((b,)).decode(codec, "ignore") or chr(b) for b in range(256))
    back = {ch: b for b, ch in reversed(list(enumerate(chars)))}
    back |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in back}
    return chars, back


@lru_cache(maxsize=None)
def _bytes(codec: str) -> np.ndarray:
    """The byte of each code point in a single-byte codec, -1 where it has none."""
    of = np.full(POINTS, -1, np.int16)
    for ch, b in _table(codec)[1].items():
        of[ord(ch)] = b
    return of


@lru_cache(maxsize=None)
def _read_again(read_as: str, written_in: str) -> np.ndarray:
    """Each code point as it reads in the single-byte encoding that it was written in."""
    out, chars = np.arange(POINTS, dtype=np.uint16), _table(written_in)[0]
    for ch, b in _table(read_as)[1].items():
        if b >= 0x80:
            out[ord(ch)] = ord(chars[b])
    return out


@lru_cache(maxsize=None)
def _marked(pattern: re.Pattern) -> np.ndarray:
    """Whether each code point matches a class of characters."""
    return np.array([pattern.match(chr(c)) is not None for c in range(POINTS)])


@lru_cache(maxsize=1)
def _ends() -> tuple[np.ndarray, np.ndarray]:
    """Code points that end a sentence, and white space."""
    ends, space = np.zeros(POINTS, bool), np.zeros(POINTS, bool)
    ends[[ord(c) for c in ".!?\n。"]] = True
    space[[c for c in range(POINTS) if chr(c).isspace()]] = True
    return ends, space


@lru_cache(maxsize=1)
def _sequences() -> tuple[np.ndarray, np.ndarray]:
    """For each code point a bit for each codec of UTF8_READ_AS in which it begins or continues a sequence."""
    lead, tail = np.zeros(POINTS, np.uint16), np.zeros(POINTS, np.uint16)
    for k, codec in enumerate(UTF8_READ_AS):
        b = _bytes(codec)
        lead[(b >= 0xC2) & (b <= 0xEF)] |= 1 << k
        tail[(b >= 0x80) & (b <= 0xBF)] |= 1 << k
    return lead, tail


@lru_cache(maxsize=1)
def _double_byte() -> np.ndarray:
    """The character of each pair of bytes from 0x80, U+FFFD where there is none."""
    out = np.full((128, 128), 0xFFFD, np.uint16)
    for a in range(1, 127):
        for b in range(128):
            ch = bytes((a + 128, b + 128)).decode("gb18030", "replace")
            if len(ch) == 1 and ord(ch) < POINTS:
                out[a, b] = ord(ch)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line break before each and after the last, and where each begins; above 2**16 all are one."""
    whole = "\n" + "\n".join(texts) + "\n"
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.minimum(c, POINTS - 1).astype(np.uint16), begins


def _collapsed(c: np.ndarray) -> np.ndarray:
    """Code points with the ideographs and the syllables of East Asia as one each."""
    c = c.astype(np.int64)
    for low, high in EAST:
        c[(c >= low) & (c < high)] = low
    return c


def _from_utf8(c: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with the UTF-8 sequences that were read in ``codec`` read again, and which of them to keep."""
    b = _bytes(codec)[c]
    keep, out = np.ones(len(c), bool), c.copy()
    tail = (b >= 0x80) & (b <= 0xBF)
    at = np.flatnonzero((b[:-1] >= 0xC2) & (b[:-1] <= 0xDF) & tail[1:])
    new = ((b[at] & 0x1F) << 6) | (b[at + 1] & 0x3F)
    good = _marked(LIKELY)[new]
    out[at[good]] = new[good]
    keep[at[good] + 1] = False
    if codec != "cp866":  # its letters are leads of three bytes and tails too
        at = np.flatnonzero((b[:-2] >= 0xE0) & (b[:-2] <= 0xEF) & tail[1:-1] & tail[2:])
        new = ((b[at].astype(np.int64) & 0x0F) << 12) | ((b[at + 1] & 0x3F) << 6) | (b[at + 2] & 0x3F)
        good = _marked(LIKELY)[new] & (new >= 0x800)
        out[at[good]] = new[good]
        keep[at[good] + 1] = keep[at[good] + 2] = False
    return out, keep


class Model:
    """Smoothed bigrams of characters beyond ASCII and their neighbours.

    Pairs of two ASCII characters are the same in every reading of a text and cancel out, so they
    are left out. Rare characters, and those of East Asia, are drawn from a class: a pair is of
    classes, and a character of a class has its own smoothed chance in it.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys, counts = np.asarray(keys, np.int64), np.asarray(counts, float)
        single, self.symbol = keys < POINTS, np.zeros(POINTS, np.uint16)
        seen = np.zeros(POINTS)
        seen[keys[single]] = counts[single]
        beyond = seen[128:].sum()
        points = np.arange(POINTS)
        east = np.full(POINTS, -1)
        for k, (low, high) in enumerate(EAST):
            east[low:high] = k
        own = (points < 128) | ((seen >= max(1.0, OWN_SYMBOL * beyond)) & (east < 0))
        # symbols: characters of their own, then the classes of East Asia, then the blocks of 256
        kinds = np.where(own, points, np.where(east >= 0, POINTS + east, POINTS + 2 + (points >> 8)))
        names, symbol = np.unique(kinds, return_inverse=True)
        self.symbol, n = symbol.astype(np.uint16), len(names)
        of_class = np.bincount(symbol, ~own * (seen + OF_CLASS), n)[symbol]
        self.emission = np.where(own, 0.0, np.log((seen + OF_CLASS) / np.maximum(of_class, OF_CLASS))).astype(np.float32)
        total = np.bincount(symbol, seen, n)
        pairs = np.zeros(n * n)
        a, b = (keys[~single] >> 16) - 1, keys[~single] & 0xFFFF
        np.add.at(pairs, symbol[a].astype(np.int64) * n + symbol[b], counts[~single])
        chances = (pairs.reshape(n, n) + SMOOTHING) / (total[:, None] + SMOOTHING * SYMBOLS)
        self.chances, self.size = np.log(chances).astype(np.float32).ravel(), n
        self.readings: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"readings": {}}

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probability of each character of ``b`` after that of ``a``."""
        return self.chances[self.symbol[a].astype(np.int32) * self.size + self.symbol[b]] + self.emission[b]

    def reading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and emissions of all code points as they read by the single-byte chain ``k``."""
        if k not in self.readings:
            new = _read_again(*SINGLE_BYTE[k])
            self.readings[k] = self.symbol[new].astype(np.int32), self.emission[new]
        return self.readings[k]

    def score(self, c: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Log probability of the pairs beyond ASCII of each text."""
        at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
        of = owner[np.where(c[at] > 127, at, at + 1)]
        return np.bincount(of, self.of(c[at], c[at + 1]), texts)


class Readings:
    """The likeliest reading of each of some texts: ``gain`` in log probability and ``chain``, with ``lost`` and ``utf8`` marks."""

    def __init__(self, texts: list[str], model: Model | None):
        self.texts, n = texts, len(texts)
        self.whole, self.begins = _codes(texts)
        # only characters beyond ASCII and their neighbours count
        beyond = self.whole > 127
        near = beyond.copy()
        near[1:] |= beyond[:-1]
        near[:-1] |= beyond[1:]
        near[self.begins] = True
        self.place = np.flatnonzero(near)
        self.c = self.whole[self.place]
        self.owner = np.minimum(np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(self.place, self.begins))), n - 1)
        self.owner = np.append(self.owner, np.full(len(self.c) - len(self.owner), n - 1, np.int32))
        self.gain, self.chain = np.zeros(n), [None] * n
        self.lost = np.bincount(self.owner, _marked(LOST)[self.c], n) > 0
        self.utf8 = np.zeros(n, bool)
        self.model = model
        self.base = model.score(self.c, self.owner, n) if model else None
        self._utf8()
        if model:
            self._single_byte()
            self._double_byte()
            self._east()

    def _part(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and owners of the chosen texts; each begins with its line break."""
        at = chosen[self.owner]
        c, owner = self.c[at], self.owner[at]
        return np.append(c, np.uint16(10)), np.append(owner, owner[-1] if len(owner) else 0)

    def _offer(self, c: np.ndarray, owner: np.ndarray, changed: np.ndarray, chain: tuple) -> None:
        """Takes the reading of the changed texts where it is the likeliest so far."""
        lost = np.bincount(owner, c == 0xFFFD, len(self.texts))
        gain = self.model.score(c, owner, len(self.texts)) - self.base - LOST_COST * lost
        for i in np.flatnonzero(changed & (gain > self.gain)):
            self.gain[i], self.chain[i] = gain[i], chain

    def _utf8(self) -> None:
        """UTF-8 read in a single-byte encoding, once, twice or three times."""
        lead, tail = _sequences()
        n, bits = len(self.texts), lead[self.c[:-1]] & tail[self.c[1:]]
        at = np.flatnonzero(bits)
        for k, codec in enumerate(UTF8_READ_AS):
            hit = np.zeros(n, bool)
            hit[self.owner[at[(bits[at] >> k) & 1 > 0]]] = True
            if not hit.any():
                continue
            once = self._again(*self._part(hit), codec, (codec,))
            if once is None:
                continue
            self.utf8 |= once[2]
            if self.model:
                for again in dict.fromkeys((*AGAIN, codec)):
                    twice = self._again(once[0], once[1], again, (codec, again))
                    if twice is not None:
                        self._again(twice[0], twice[1], again, (codec, again, again))

    def _again(self, c: np.ndarray, owner: np.ndarray, codec: str, chain: tuple) -> tuple | None:
        """The texts that ``codec`` changes, read again: code points, owners, which texts."""
        out, keep = _from_utf8(c, codec)
        changed = np.bincount(owner, ~keep, len(self.texts)) > 0
        if not changed.any():
            return None
        at = keep & changed[owner]
        out, owner = np.append(out[at], np.uint16(10)), owner[at]
        owner = np.append(owner, owner[-1])
        if self.model:
            self._offer(out, owner, changed, ("utf-8", chain))
        return out, owner, changed

    def _sentences(self) -> np.ndarray:
        """The number of the sentence of each character; marks and white space after it belong to a sentence."""
        ends, space = _ends()
        c = self.whole
        marks = np.append(0, np.cumsum(ends[c], dtype=np.int32))
        plain = np.flatnonzero(~space[c])
        before = np.append(0, plain[:-1])
        opens = np.zeros(len(c), bool)
        # end marks since the character before, but for marks that follow each other at once
        opens[plain] = (marks[plain] > marks[before]) & ~(ends[c[plain]] & (plain == before + 1))
        opens[self.begins[:-1]] = True
        return np.cumsum(opens, dtype=np.int32) - 1

    def _single_byte(self) -> None:
        """One single-byte encoding for another: sentence by sentence, or the text as a whole."""
        c, m = self.c, self.model
        at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
        if not len(at):
            return
        a, b = c[at], c[at + 1]
        self.sentence = self._sentences()
        of = np.where(a > 127, at, at + 1)
        owner, sentence = self.owner[of], self.sentence[self.place[of]]
        # sentences with characters beyond ASCII, numbered anew
        new = np.diff(sentence, prepend=-1) > 0
        of, used, owner = np.cumsum(new) - 1, sentence[new], owner[new]
        before = m.of(a, b)
        self.used, self.sentence_gains = used, np.zeros((len(SINGLE_BYTE), len(used)), np.float32)
        opens = np.flatnonzero(np.diff(owner, prepend=-1))
        texts = owner[opens]
        for k in range(len(SINGLE_BYTE)):
            symbol, emission = m.reading(k)
            more = m.chances[symbol[a] * m.size + symbol[b]] + emission[b] - before
            gains = np.bincount(of, more, len(used))
            self.sentence_gains[k] = gains
            whole = np.add.reduceat(gains, opens)
            parts = np.add.reduceat(np.where(gains > SENTENCE_GAIN, gains, 0.0), opens)
            gain = np.maximum(whole, parts)
            for j in np.flatnonzero(gain > self.gain[texts]):
                self.gain[texts[j]] = gain[j]
                self.chain[texts[j]] = ("single", k, bool(parts[j] >= whole[j]))

    def _double_byte(self) -> None:
        """Double-byte text read in a single-byte encoding: runs beyond ASCII that the encoding holds whole."""
        c, n = self.c, len(self.texts)
        beyond = c > 127
        starts = np.flatnonzero(beyond & ~np.append(False, beyond[:-1]))
        if not len(starts):
            return
        lengths = np.flatnonzero(beyond & ~np.append(beyond[1:], False)) - starts + 1
        where, within = np.flatnonzero(beyond), np.arange(beyond.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        run = np.repeat(np.arange(len(starts)), lengths)
        for read_as, written_in in DOUBLE_BYTE:
            b = _bytes(read_as)[c[where]]
            held = (np.minimum.reduceat(b, np.cumsum(lengths) - lengths) >= 0x80) & (lengths > 1)
            changed = np.zeros(n, bool)
            changed[self.owner[starts[held]]] = True
            if not changed.any():
                continue
            out, keep = c.copy(), np.ones(len(c), bool)
            lead = np.flatnonzero(held[run] & (within % 2 == 0))
            last = within[lead] + 1 == lengths[run[lead]]
            out[where[lead[last]]] = 0xFFFD
            lead = lead[~last]
            out[where[lead]] = _double_byte()[b[lead] - 128, b[lead + 1] - 128]
            keep[where[lead + 1]] = False
            at = keep & changed[self.owner]
            self._offer(np.append(out[at], np.uint16(10)), np.append(self.owner[at], self.owner[at][-1]), changed, ("runs", read_as, written_in))

    def _east(self) -> None:
        """UTF-8 read as a double-byte encoding."""
        east = np.bincount(self.owner, (self.c >= 0x3400) & (self.c < 0xA000), len(self.texts)) > 0
        chosen = np.flatnonzero(east)
        if not len(chosen):
            return
        chain = ("runs", "gb18030", "utf-8")
        c, begins = _codes([_restored(self.texts[i], chain) for i in chosen])
        owner = np.append(np.repeat(chosen, np.diff(begins)), chosen[-1])
        self._offer(c, owner, east, chain)

    def restored(self, i: int) -> tuple[str | None, str]:
        """(name of the chain, text) of the likeliest reading of a text."""
        chain, text = self.chain[i], self.texts[i]
        if chain is None or chain[0] != "single":
            return _name(chain), text if chain is None else _restored(text, chain)
        read_as, written_in = SINGLE_BYTE[chain[1]]
        low, high = self.begins[i], self.begins[i + 1]
        old = self.whole[low + 1 : high]
        new = _read_again(read_as, written_in)[old]
        if chain[2]:
            better = np.zeros(self.sentence[-1] + 1, bool)
            better[self.used[self.sentence_gains[chain[1]] > SENTENCE_GAIN]] = True
            new = np.where(better[self.sentence[low + 1 : high]], new, old)
        same = new == old
        return _name(chain), "".join(t if s else chr(x) for t, x, s in zip(text, new.tolist(), same.tolist()))


def _name(chain: tuple | None) -> str | None:
    if chain is None:
        return None
    if chain[0] == "utf-8":
        last, *again = chain[1]
        times = {0: "", 1: f"read as {again[0]}, then " if again else "", 2: f"read twice as {again[0]}, then " if again else ""}[len(again)]
        return f"utf-8 {times}{'as' if again else 'read as'} {last}"
    read_as, written_in = SINGLE_BYTE[chain[1]] if chain[0] == "single" else chain[1:]
    return f"{written_in} read as {read_as}"


def _restored(text: str, chain: tuple) -> str:
    """The text read by a chain of UTF-8 sequences or of runs."""
    if chain[0] == "utf-8":
        c = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for codec in chain[1]:
            new, keep = _from_utf8(np.minimum(c, POINTS - 1).astype(np.uint16), codec)
            c = np.where(c < POINTS, new, c)[keep]
        return c[1:-1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    read_as, written_in = chain[1:]
    if read_as == "gb18030":
        return text.encode(read_as, "replace").decode(written_in, "replace")
    back = _table(read_as)[1]

    def run(match: re.Match) -> str:
        if not all(c in back for c in match[0]):
            return match[0]
        return bytes(back[c] for c in match[0]).decode(written_in, "replace")

    return BEYOND.sub(run, text)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about AT_A_TIME characters."""
    rest = iter(texts)
    while True:
        part, size = [], 0
        for t in rest:
            part.append(t)
            size += len(t)
            if size >= AT_A_TIME:
                break
        if not part:
            return
        yield part


def _pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c, _ = _codes(texts)
    single = np.bincount(c, minlength=POINTS)
    known = np.flatnonzero(single)
    at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
    pairs, n = np.unique(((_collapsed(c[at]) + 1) << 16) | _collapsed(c[at + 1]), return_counts=True)
    return np.concatenate((known, pairs)), np.concatenate((single[known], n))


def count_pairs(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of characters and of pairs beyond ASCII over the clean texts of a task."""
    for b in texts:
        for part in _slices(list(b["text"])):
            marks = Readings(part, None)
            keys, n = _pairs_of([t for t, bad in zip(part, marks.lost | marks.utf8) if not bad])
            yield pd.DataFrame({"pair": keys, "n": n})


def _summed(texts: DataFrame, count) -> pd.Series:
    return texts.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").toPandas().set_index("pair")["n"]


def _beyond(records: DataFrame, text_col: str) -> DataFrame:
    return records.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))


def train(records: DataFrame, text_col: str) -> Model:
    """The model of all clean records.

    Records with UTF-8 sequences read in another encoding and lost characters are not counted at
    all; those that the first model finds misread otherwise are taken out of the counts again.
    Its size is bounded by pairs of characters in use, East Asian ones being one symbol in a
    pair; pairs seen once carry no information and are left to the smoothing.
    """
    texts = records.select(F.col(text_col).alias("text")).where("text is not null")
    counts = _summed(texts, count_pairs)
    first = Model(counts.index.to_numpy(np.int64), counts.to_numpy(np.int64))

    def misread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _slices(list(b["text"])):
                r = Readings(part, first)
                found = [t for t, out in zip(part, (r.gain >= LEAST_GAIN) & ~r.lost & ~r.utf8) if out]
                if found:
                    keys, n = _pairs_of(found)
                    yield pd.DataFrame({"pair": keys, "n": n})

    counts = counts.sub(_summed(_beyond(records, text_col), misread), fill_value=0)
    counts = counts[counts > 1]
    return Model(counts.index.to_numpy(np.int64), counts.to_numpy(np.int64))


def best_chain(text: str, model: Model) -> tuple[str | None, str, float]:
    """(chain, text, gain in log probability) of the likeliest reading; every chain is scored, one between single-byte codecs by sentences too."""
    r = Readings([text], model)
    return *r.restored(0), float(r.gain[0])


def _spoilt(text: str) -> str:
    """The text spoilt by a known chain that its own characters choose among those that change it."""
    chains = [("utf-8", c) for c in UTF8_READ_AS] + [(w, r) for r, w in SINGLE_BYTE + DOUBLE_BYTE]
    turn = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for k in range(len(chains)):
        written_in, read_as = chains[(turn + k) % len(chains)]
        try:
            new = codecs.charmap_decode(text.encode(written_in), "strict", _table(read_as)[0])[0]
        except UnicodeEncodeError:
            continue
        if new != text:
            return new
    return text


def scored(records: DataFrame, id_col: str, text_col: str, model: Model, spoil: bool = True) -> DataFrame:
    """(id, chain, restored, gain, lost, spoilt_gain) of the records beyond ASCII, in the shared folder.

    ``spoilt_gain`` is the gain of the same record spoilt by a known chain, for records that are
    clean: without lost characters, UTF-8 sequences and a gain of LEAST_GAIN.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = iter(b["id"])
            for part in _slices(list(b["text"])):
                r = Readings(part, model)
                clean = np.flatnonzero((r.gain < LEAST_GAIN) & ~r.lost & ~r.utf8) if spoil else ()
                true = np.full(len(part), None)
                if len(clean):
                    true[clean] = Readings([_spoilt(part[i]) for i in clean], model).gain
                found = [r.restored(i) if g >= LEAST_GAIN else (None, None) for i, g in enumerate(r.gain)]
                yield pd.DataFrame(
                    {
                        "id": list(islice(ids, len(part))), "chain": [f for f, _ in found], "restored": [t for _, t in found],
                        "gain": r.gain, "lost": r.lost, "spoilt_gain": true,
                    }
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, chain string, restored string, gain double, lost boolean, spoilt_gain double"
    return written(rows.mapInPandas(score, schema), "readings")


def _margin(readings: DataFrame) -> float:
    clean = readings.where("spoilt_gain is not null")
    ends = clean.agg(F.percentile_approx("gain", 0.999, 10_000), F.percentile_approx("spoilt_gain", 0.001, 10_000)).first()
    return LEAST_GAIN if ends[0] is None else max(LEAST_GAIN, (ends[0] + ends[1]) / 2)


def validated_margin(records: DataFrame, text_col: str, model: Model) -> float:
    """The gain that parts clean records from the same records spoilt by a known chain.

    From all records with characters beyond ASCII that are clean; half-way between the highest
    gain of a clean record (but for 1 in 1000) and the low end of the spoilt ones, LEAST_GAIN
    at least.
    """
    return _margin(scored(records.select(F.lit(0).alias("id"), text_col), "id", text_col, model))


def find_garbled(records: DataFrame, id_col: str, text_col: str, model: Model | None = None, margin: float | None = LEAST_GAIN) -> DataFrame:
    """(id, chain, restored, gain) of the records that hold wrongly decoded text.

    ``chain`` names the likeliest chain of encodings and ``restored`` the text it gives; where
    characters are lost and no chain helps both are null. Every chain is scored on every record
    with a character beyond ASCII, whole. With ``margin`` None the validated one is taken, from
    the same pass. Null and empty texts are no cases; repeated rows stay repeated.
    """
    model = model or train(records, text_col)
    readings = scored(records, id_col, text_col, model, spoil=margin is None)
    margin = _margin(readings) if margin is None else max(margin, LEAST_GAIN)
    misread = F.col("gain") >= margin
    return readings.where(misread | F.col("lost")).select(
        "id", F.when(misread, F.col("chain")).alias("chain"), F.when(misread, F.col("restored")).alias("restored"),
        F.when(misread, F.col("gain")).otherwise(0.0).alias("gain"),
    )
