"""Token ids exactly as the public vocabularies' libraries give them, made at batch speed.

word_bpe: the text is normalised (NFC, white space to one space, lower case) and cut into pre-tokens
(contractions, runs of letters, single digits, runs of other signs). That cutting is done here on
arrays of code points; texts with signs outside the tabulated scripts, or with the strings of special
tokens, take the library's own way instead.

byte_bpe: the same vocabulary as ranks, by its own fast library; a text that this library refuses is
encoded by the other one.
"""

from __future__ import annotations

import base64
import json
import unicodedata

from dataclasses import dataclass, replace

import numpy as np

from .words import mix, power, unpower

#: Code points whose class and case are the same in every Unicode version in use: Latin, Greek, Cyrillic,
#: Armenian, general punctuation to mathematical signs, CJK signs, kana, ideographs, Hangul.
_KNOWN = ((0x00, 0x378), (0x400, 0x52F), (0x2000, 0x2070), (0x20A0, 0x20BF), (0x2190, 0x2300), (0x3000, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_WORD_END, _TEXT_END = ord("Z"), ord("Y")  #: never in lower-cased text


def _classes() -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    for low, high in _KNOWN:
        for c in range(low, high):
            kind = unicodedata.category(chr(c))
            if kind not in ("Cn", "Cs") and unicodedata.combining(chr(c)) == 0:
                table[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    table[[c for c in _WHITE if table[c] != UNKNOWN]] = SPACE
    table[0x130] = UNKNOWN  # its lower case has two signs
    return table


class WordBpe:
    """The tokenizer in word_bpe_49k.json."""

    def __init__(self, path: str):
        self._path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = _classes()
        self.chars = _byte_chars()
        self.end = spec["model"]["end_of_word_suffix"]
        self.byte_id = np.array([self.vocab[c] for c in self.chars], np.int64)
        self.last_id = np.array([self.vocab[c + self.end] for c in self.chars], np.int64)
        key = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(key)
        self.pair_key, self.pair_rank = key[self.order], self.order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self._fast = None

    @property
    def library(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    # -- pre-tokens -------------------------------------------------------------------------------

    def pretokens(self, texts: list[str]) -> Pretokens:
        """The pre-tokens of all texts. Texts that need the library's own way are listed as odd, and
        have none here."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)] if any("<|" in t for t in texts) else []
        texts = _without(texts, odd)
        big = "\n".join(texts)
        plain = big.isascii()
        if not plain and not unicodedata.is_normalized("NFC", big):
            texts = [unicodedata.normalize("NFC", t) for t in texts]
            big = "\n".join(texts)
        codes = _codes(big.lower() if plain else big.replace("Σ", "σ").lower())
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            more = [i for i, t in enumerate(texts) if (self.classes[_codes(t)] == UNKNOWN).any() or (self.classes[_codes(t.lower())] == UNKNOWN).any()]
            rest = self.pretokens(_without(texts, more))
            return replace(rest, odd=sorted({*odd, *more, *rest.odd}))
        n = len(codes)
        begin = np.zeros(n + 1, bool)
        if n:
            begin[0] = kind[0] != SPACE
            begin[1:n] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
        apostrophe = np.flatnonzero((codes == 39) & begin[:n])
        if len(apostrophe):
            pad = np.r_[codes, np.zeros(3, np.uint32)]
            a, b = pad[apostrophe + 1], pad[apostrophe + 2]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
            for hit, step in ((two, 2), (three, 3)):
                at = apostrophe[hit]
                begin[at + 1] = False
                after = at + step
                after = after[after < n]
                begin[after[kind[after] != SPACE]] = True
        start = np.flatnonzero(begin)
        last = kind != SPACE
        last[:-1] &= (kind[1:] == SPACE) | begin[1:n]
        end = np.flatnonzero(last) + 1
        at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]  # lower case keeps lengths in the tabulated scripts
        if at[-1] != n + 1:
            raise ValueError("text lengths changed")
        return Pretokens(codes, start, end, np.searchsorted(start, at), odd)

    def library_pretokens(self, text: str) -> list[bytes | int]:
        """The library's own pre-tokens, as bytes, and ids of special strings."""
        out: list[bytes | int] = []
        back = {c: b for b, c in enumerate(self.chars)}
        for piece in _split_special(text, self.special):
            if piece in self.special:
                out.append(self.library.token_to_id(piece))
            elif piece:
                normal = self.library.normalizer.normalize_str(piece)
                out += [bytes(back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    # -- ids --------------------------------------------------------------------------------------

    def encode(self, texts: list[str], close: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the id close; number of ids of each text with that one)."""
        if self._fast is None:
            self._fast = self._ranked()
            self._ids = Memo()
        found = self.pretokens(texts)
        flat, size = self._ids.get(found, lambda p, which: self._encode_words(p.marked(which)))
        total = np.r_[0, np.cumsum(size)]
        ends = total[found.first[1:]]
        ids = np.insert(flat, ends, close)
        counts = np.diff(np.r_[0, ends]) + 1
        if found.odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in found.odd:
                parts[i] = np.array([*self.library.encode(texts[i], add_special_tokens=False).ids, close], np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts

    def _encode_words(self, marked: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self._fast.encode_to_numpy(marked)
        stops = np.flatnonzero(ids == self.byte_id[_TEXT_END])
        return np.delete(ids, stops), np.diff(np.r_[-1, stops]) - 1

    def _ranked(self):
        """The vocabulary as ranks of byte strings, a word's end being the byte Z: its pairs with the last
        byte of a word come first, then the merges in order, and ids are ranks."""
        import tiktoken

        back = {c: bytes([b]) for b, c in enumerate(self.chars)}
        raw = lambda t: b"".join(back[c] for c in (t.removesuffix(self.end) if t.endswith(self.end) else t)) + (b"Z" if t.endswith(self.end) else b"")
        ranks = {raw(c): self.vocab[c] for c in self.chars} | {raw(c + self.end): self.vocab[c + self.end] for c in self.chars}
        ranks |= {raw(t): i for t, i in self.vocab.items() if t not in self.special}
        return tiktoken.Encoding("word", pat_str="[^YZ]+Z|Y", mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Pretokens:
    """Pre-tokens are codes[start:end]; those of text i are first[i] up to first[i + 1]."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    odd: list[int]

    def hash(self) -> np.ndarray:
        n = len(self.codes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.codes.astype(np.uint64) + np.uint64(977)) * power(n)[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * unpower(n)[self.start])

    def marked(self, which: np.ndarray) -> str:
        """Some pre-tokens as text, each followed by Z and Y."""
        size = self.end[which] - self.start[which] + 2
        total = np.r_[0, np.cumsum(size)]
        at = np.arange(total[-1]) + np.repeat(self.start[which] - total[:-1], size)
        out = self.codes[np.minimum(at, len(self.codes) - 1)]
        out[total[1:] - 2], out[total[1:] - 1] = _WORD_END, _TEXT_END
        return out.tobytes().decode("utf-32-le", "surrogatepass")

    def joined(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(UTF-8 bytes of some pre-tokens in a row, number of bytes of each)."""
        words = self.marked(which).split("ZY")[:-1]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return b"".join(raw), np.array([len(w) for w in raw], np.int64)


class Memo:
    """What was worked out for pre-tokens, by a 64-bit hash: an open-addressing table and a pool of the
    results' numbers. It is emptied when it holds limit pre-tokens, so its memory is bounded."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.slots = limit, 4 * limit
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            held = self.key[slot]
            hit = held == keys[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (held != 0)
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def _add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        entry = np.arange(len(self.size), len(self.size) + len(keys))
        begin = len(self.pool) + np.r_[0, np.cumsum(size)[:-1]]
        self.begin, self.size, self.pool = np.r_[self.begin, begin], np.r_[self.size, size], np.r_[self.pool, flat.astype(np.uint32)]
        left = np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = keys[left[free]]  # of two that meet in one slot the last stays
            won = free & (self.key[slot] == keys[left])
            self.entry[slot[won]] = entry[left[won]]
            left, slot = left[~won], slot[~won]
            slot = np.where(self.key[slot] == keys[left], slot, (slot + 1) & (self.slots - 1))

    def get(self, found: Pretokens, make) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pre-tokens in order, how many each has). make(found, which) gives both for
        some distinct pre-tokens."""
        keys = found.hash()
        keys[keys == 0] = 1
        at = self._find(keys)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, which = np.unique(keys[miss], return_index=True)
            if len(self.size) + len(new) > self.limit:
                self.clear()
                new, which = np.unique(keys, return_index=True)
                miss = np.arange(len(keys))
            if len(new) > self.limit:  # one slice with more distinct pre-tokens than the table may hold
                self.limit, self.slots = 1 << (len(new) - 1).bit_length(), 4 << (len(new) - 1).bit_length()
                self.clear()
            for i in range(0, len(new), 100_000):
                self._add(new[i : i + 100_000], *make(found, miss[which[i : i + 100_000]]))
            at = self._find(keys)
        size, begin = self.size[at], self.begin[at]
        total = np.r_[0, np.cumsum(size)]
        return self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)], size


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _without(texts: list[str], odd: list[int]) -> list[str]:
    if odd:
        texts = list(texts)
        for i in odd:
            texts[i] = ""
    return texts


def _split_special(text: str, special: list[str]) -> list[str]:
    import re

    return re.split("(" + "|".join(map(re.escape, special)) + ")", text)


def _byte_chars() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + n)
            n += 1
    return [chars[b] for b in range(256)]


class ByteBpe:
    """The tokenizer in byte_bpe_50k.json, whose special string stays special inside texts."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._path, self._library = json_path, None
        self.fast = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # its regex engine gives up on some very long runs, by a panic: then the library once
            if isinstance(e, (MemoryError, KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[tuple[str, ...], WordBpe | ByteBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    key = ("word", path)
    if key not in _loaded:
        _loaded[key] = WordBpe(path)
    return _loaded[key]


def byte_bpe(json_path: str, ranks_path: str) -> ByteBpe:
    key = ("byte", json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = ByteBpe(json_path, ranks_path)
    return _loaded[key]
