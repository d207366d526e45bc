"""Simple-8b: unsigned integers packed into 64-bit words, decoded by arrays.

The top four bits of a word select how many values it holds and how wide they are. A word of selector 0
is an escape: the next word is one value of up to 64 bits, verbatim. Sequences are cut into blocks of
BLOCK values (the last of a sequence may be shorter); the number of words of every block is kept beside
them, so blocks can be found and decoded independently. Places of a block's last word beyond its values
are zeros.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: (values in a word, bits of each) for selectors 1 to 15; selector 0 is the escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([1, *(c for c, _ in SELECTORS)])
_U = np.uint64


def block_sizes(sizes: np.ndarray) -> np.ndarray:
    """Values of each block of sequences that have so many values."""
    n = -(-sizes // BLOCK)
    out = np.full(int(n.sum()), BLOCK, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    out[last] = (sizes - (n - 1) * BLOCK)[n > 0]
    return out


def encode(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of the sequences that lie end to end in values."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = block_sizes(np.asarray(sizes, np.int64))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = np.cumsum(blocks)
    bits = np.zeros(n + 1, np.uint8)
    bits[:n] = _widths(values)
    heads, kinds, owner = [], [], []
    place, alive = end - blocks, np.arange(len(blocks))
    while len(alive):  # every block writes its next word at once
        pick = _pick(bits, place, end[alive])
        heads.append(place)
        kinds.append(pick)
        owner.append(alive)
        place = place + np.minimum(_COUNT[pick], end[alive] - place)
        go = place < end[alive]
        place, alive = place[go], alive[go]
    head, kind, owner = np.concatenate(heads), np.concatenate(kinds), np.concatenate(owner)
    order = np.argsort(head, kind="stable")
    head, kind, owner = head[order], kind[order], owner[order]
    length = np.where(kind == 0, 2, 1)
    first = np.r_[0, np.cumsum(length)[:-1]]
    words = np.zeros(int(length.sum()), np.uint64)
    took = np.minimum(_COUNT[kind], end[owner] - head)
    for s in np.unique(kind):
        w = np.flatnonzero(kind == s)
        if s == 0:
            words[first[w] + 1] = values[head[w]]
            continue
        count, bits = SELECTORS[s - 1]
        word = np.full(len(w), _U(int(s)) << _U(60))
        if bits:
            for j in range(count):
                inside = j < took[w]
                if not inside.any():
                    break
                word[inside] |= values[head[w[inside]] + j] << _U(j * bits)
        words[first[w]] = word
    return words, np.bincount(owner, weights=length, minlength=len(blocks)).astype(np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 64 for all that no selector holds."""
    out = np.zeros(len(values), np.uint8)
    for _, bits in SELECTORS:
        if not (over := values >= _U(1) << _U(bits)).any():
            break
        out[over] = bits + 1
    out[values >= _U(1) << _U(60)] = 64
    return out


def _pick(bits: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The densest selector for the values from each place on; those past the block's end fit any."""
    pick = np.zeros(len(place), np.int64)
    rows, most, done, last = np.arange(len(place)), np.zeros(len(place), np.uint8), 0, len(bits) - 1
    for s in range(len(SELECTORS), 0, -1):  # denser ones hold narrower values: who fails one fails the rest
        count, width = SELECTORS[s - 1]
        for j in range(done, count):
            at = place[rows] + j
            most = np.maximum(most, np.where(at < end[rows], bits[np.minimum(at, last)], 0))
        done, fits = count, most <= width
        rows, most = rows[fits], most[fits]
        if not len(rows):
            break
        pick[rows] = s
    return pick


def decode(words: np.ndarray, block_words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of the sequences, end to end."""
    blocks = block_sizes(np.asarray(sizes, np.int64))
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escape = np.flatnonzero(selector == 0)
    if len(escape):  # a verbatim word may itself look like an escape: walk from each block's first word
        for i in escape:
            if not raw[i]:
                raw[i + 1] = True
    owner = np.repeat(np.arange(len(blocks)), block_words)
    lead = ~raw
    count = np.where(lead, _COUNT[selector], 0)
    before = np.r_[0, np.cumsum(count)[:-1]]
    base = before[np.r_[0, np.cumsum(block_words)[:-1]]]
    inside = before - base[owner]
    start = np.r_[0, np.cumsum(blocks)[:-1]]
    out = np.zeros(int(blocks.sum()), np.uint64)
    place = start[owner] + inside
    took = np.minimum(count, blocks[owner] - inside)
    for s in np.unique(selector[lead]):
        w = np.flatnonzero(lead & (selector == s))
        if s == 0:
            out[place[w]] = words[w + 1]
            continue
        n, bits = SELECTORS[s - 1]
        if not bits:
            continue
        mask = (_U(1) << _U(bits)) - _U(1)
        for j in range(n):
            ok = j < took[w]
            if not ok.any():
                break
            out[place[w[ok]] + j] = (words[w[ok]] >> _U(j * bits)) & mask
    return out
