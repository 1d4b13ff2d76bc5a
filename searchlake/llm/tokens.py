"""Token ids through the ``tokenizers`` library, with the ids of pieces that a worker has met kept.

The vocabulary of ``word_bpe_49k.json`` never joins characters across white space (its normaliser
turns white space into one blank and its splitter drops blanks), so a text's ids are those of its
blank-separated pieces in turn. A worker lets the library encode each distinct piece once. Pieces of up to ``KEY`` bytes are
found again by those bytes themselves, for a whole batch of texts at once; longer ones in a dictionary, also by their bytes.
No two different pieces are ever taken for each other. The tables of a worker are bounded, and so is what it encodes
at a time: long texts are cut at blanks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

VOCABULARY = "word_bpe_49k.json"
KEY = 16
STRETCH = 1 << 18


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER = np.array([chr(c).isalpha() for c in range(256)])
_BETWEEN = "\x1e"  # stands between texts
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))

_BLANKS = np.uint64(0x2020202020202020)
#: Bits of a piece of 0 to KEY bytes in its first and in its second eight bytes.
_INSIDE = tuple(np.array([(1 << 8 * min(max(n - first, 0), 8)) - 1 for n in range(KEY + 1)], dtype=np.uint64) for first in (0, 8))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut at blanks."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def simplified(text: str) -> np.ndarray:
    """The bytes of a Latin-1 text, with far fewer distinct pieces and the same ids.

    Letters become lower-case (the normaliser does that too, letter by letter), and whatever follows a letter and is no
    letter stands apart (the splitter ends a word there anyway; contractions start with their apostrophe).
    """
    raw = np.frombuffer(text.lower().encode("latin-1"), dtype=np.uint8)
    letter, blank = _LETTER[raw], (raw == 32) | (raw == 10)
    return np.insert(np.where(blank, np.uint8(32), raw), np.flatnonzero(letter[:-1] & ~letter[1:] & ~blank[1:]) + 1, 32)


def verbatim(text: str) -> np.ndarray:
    """The UTF-8 bytes of another text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.where(raw == 10, np.uint8(32), raw)


def is_plain(text: str) -> bool:
    if "<|" in text:  # may hold a special token
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceTable:
    """Ids of pieces by their bytes: an open-addressing table in arrays, and a dictionary for long pieces."""

    def __init__(self, learn, codec: str, most: int):
        self.learn, self.codec, self.most = learn, codec, most
        self.clear()

    def clear(self) -> None:
        self.bits = 13
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.low, self.high = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.uint64)
        self.ends = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)
        self.count = 0
        self.long: dict[bytes, int] = {}

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * _MIX[0]) ^ (high * _MIX[1])
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[2]
        mixed >>= np.uint64(64 - self.bits)
        return mixed.view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those that are not there."""
        place, mask = self._place(low, high), len(self.slots) - 1
        found = self.slots[place]
        left = np.flatnonzero(((self.low[found] != low) | (self.high[found] != high)) & (found >= 0))
        while len(left):  # another piece is there: on to the next place
            place[left] = (place[left] + 1) & mask
            now = self.slots[place[left]]
            found[left] = now
            left = left[((self.low[now] != low[left]) | (self.high[now] != high[left])) & (now >= 0)]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, each: list[np.ndarray], hidden: int = 0) -> None:
        """New pieces, all different; the last ``hidden`` ones are long and so not found by a key."""
        n, sizes = len(each), np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        start = int(self.ends[self.count - 1]) if self.count else 0
        total = start + int(sizes.sum())
        if self.count + n > len(self.ends):
            grow = max(self.count + n, 2 * len(self.ends))
            self.low, self.high, self.ends = (np.resize(x, grow) for x in (self.low, self.high, self.ends))
        if total > len(self.ids):
            self.ids = np.resize(self.ids, max(total, 2 * len(self.ids)))
        self.low[self.count : self.count + n - hidden], self.high[self.count : self.count + n - hidden] = low, high
        self.ends[self.count : self.count + n] = start + np.cumsum(sizes)
        if n:
            self.ids[start:total] = np.concatenate(each)
        first, self.count = self.count, self.count + n
        number = np.arange(first, self.count - hidden, dtype=np.int32)
        if 2 * self.count > len(self.slots):  # at most half full, or looking up would not end
            old = np.sort(self.slots[self.slots >= 0])
            number = np.concatenate([old, number])
            self.bits = max(self.bits, (2 * self.count).bit_length())
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        place, mask = self._place(self.low[number], self.high[number]), len(self.slots) - 1
        while len(number):
            free = self.slots[place] < 0
            self.slots[place[free]] = number[free]  # of several for one place the last stays
            stay = self.slots[place] != number
            place, number = (place[stay] + 1) & mask, number[stay]

    def encode(self, raw: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a batch made by :func:`simplified` or :func:`verbatim`."""
        if self.count > self.most:
            self.clear()  # memory stays bounded; what comes back is encoded again
        blanks = np.flatnonzero(raw == 32)
        begins, stops = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
        real = stops > begins
        begins, stops = begins[real], stops[real]
        size = stops - begins
        # the first bytes of every piece as two numbers; what lies beyond its end is blanked out
        wide = np.ndarray((len(raw) + KEY // 2,), dtype="<u8", buffer=np.concatenate([raw, np.zeros(KEY, dtype=np.uint8)]), strides=(1,))
        inside = np.minimum(size, KEY)
        low, high = wide[begins] & _INSIDE[0][inside], wide[np.minimum(begins + 8, len(raw))] & _INSIDE[1][inside]
        low |= _BLANKS & ~_INSIDE[0][inside]
        high |= _BLANKS & ~_INSIDE[1][inside]
        number = self.find(low, high)
        long = np.flatnonzero(size > KEY)
        words = {i: raw[a:b].tobytes() for i, a, b in zip(long.tolist(), begins[long].tolist(), stops[long].tolist())}
        for i, word in words.items():
            number[i] = self.long.get(word, -1)
        gaps = np.flatnonzero((number < 0) & (size <= KEY))
        fresh = list(dict.fromkeys(w for i, w in words.items() if number[i] < 0))
        if len(gaps) or fresh:
            order = gaps[np.lexsort((low[gaps], high[gaps]))]
            at = order[np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))[: len(order)]]
            known = [raw[a:b].tobytes() for a, b in zip(begins[at].tolist(), stops[at].tolist())]
            before = self.count + len(at)
            options = () if self.codec == "latin-1" else ("surrogatepass",)
            self.add(low[at], high[at], self.learn([w.decode(self.codec, *options) for w in known + fresh]), len(fresh))
            self.long.update((w, before + k) for k, w in enumerate(fresh))
            number[gaps] = self.find(low[gaps], high[gaps])
            for i, word in words.items():
                number[i] = self.long[word]
        stop = self.ends[number]
        start = np.where(number > 0, self.ends[number - 1], 0)
        border = (raw[begins] == 0x1E) & (size == 1)
        sizes = np.where(border, 0, stop - start)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.arange(total) + np.repeat(start - (ends - sizes), sizes)]
        return np.split(out, ends[border])


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes.

    ``most`` bounds the number of pieces kept, ``stretch`` the characters that are encoded together.
    """

    def __init__(self, path: str | None = None, most: int = 1_000_000, stretch: int = STRETCH):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.stretch = stretch
        self.plain = PieceTable(self._learn, "latin-1", most)
        self.other = PieceTable(self._learn, "utf-8", most // 2)

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        """The library's ids of each piece."""
        out: list = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        # a piece of letters is one word and so ends at its one end-of-word id
        groups = [letters[at : at + 50] for at in range(0, len(letters), 50)]
        for group, done in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.asarray(done.ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            parts = np.split(ids, cuts[:-1]) if len(cuts) == len(group) else [self._one(words[i]) for i in group]
            for i, part in zip(group, parts):
                out[i] = part
        for i, word in enumerate(words):
            if out[i] is None:
                out[i] = self._one(word)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[bytes]] = [[] for _ in texts]
        for table, change, wanted in ((self.plain, simplified, True), (self.other, verbatim, False)):
            held: list[tuple[int, str]] = []
            size = 0

            def flush():
                nonlocal size
                if held:
                    for (i, _), ids in zip(held, table.encode(change(f" {_BETWEEN} ".join([t for _, t in held])))):
                        parts[i].append(ids.astype("<u4", copy=False).tobytes())
                held.clear()
                size = 0

            for i, text in enumerate(texts):
                if not text or is_plain(text) is not wanted:
                    continue
                for part in stretches(text, self.stretch):
                    if _BETWEEN in part:  # nothing to stand between, so it goes alone
                        flush()
                        parts[i].append(np.concatenate(self._alone(part)).astype("<u4").tobytes())
                        continue
                    held.append((i, part))
                    size += len(part)
                    if size >= self.stretch:
                        flush()
            flush()
        return [b"".join(p) for p in parts]

    def _alone(self, text: str) -> list[np.ndarray]:
        return [np.zeros(0, dtype=np.uint32), *self._learn([w for w in text.replace("\n", " ").split(" ") if w])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; later tasks of the worker find it warm."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
