"""Exact byte-level BPE of many texts at once, through the tokenizers library.

Merges never leave a word of the pre-tokenizer, and words are found on the bytes with numpy where their bounds are
beyond doubt: at a single space between two characters that are no white space, and, inside a stretch between two such
spaces that holds nothing but printable ASCII without apostrophes, Latin letters and single line feeds, wherever the
kind of character changes.  Any other stretch stays whole and goes through the library as it is.  Units that a worker
has seen are looked up (units.py); new plain words are merged by the library's model.
"""

from __future__ import annotations

import re

import numpy as np

from .common import resident
from .units import UnitMemo, joined

#: Units that a worker remembers.
MEMO_UNITS = 1_000_000

_WORD = re.compile("(?: ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)|\n)")
ODD, LETTER, DIGIT, SIGN, SPACE, FEED = range(6)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
    kind[0x27], kind[0x20], kind[0x0A] = ODD, SPACE, FEED
    return kind


_KIND = _kinds()
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def units_of(data: np.ndarray, places: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """The places where units begin, ascending.  data: texts and 16 zeros; places: where non-empty texts begin, and the end."""
    n = int(places[-1])
    octets = data[:n]
    kind, blank = _KIND[octets], _BLANK[octets]
    if len(high := np.flatnonzero(octets >= 0xC0)):
        lead = octets[high]
        latin = high[lead == 0xC3]
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
        second, third = data[high + 1], data[high + 2]
        for i in high[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (lead == 0xE1) & (second == 0x9A) | (lead == 0xE2) & ((second == 0x80) | (second == 0x81)) | (lead == 0xE3) & (second == 0x80) & (third == 0x80)]:
            blank[i : i + 3] = True  # what may be white space beyond ASCII, and no harm if it isn't
    bounds = np.zeros(n + 1, bool)
    bounds[places] = True
    near = np.zeros(n, bool)  # a blank on either side, or a text's edge
    near[1:] = blank[:-1]
    near[:-1] |= blank[1:]
    edge = bounds[:n] | bounds[1:]
    space = kind == SPACE
    safe = space & ~near & ~edge
    odd = (kind == ODD) | (space & ~safe) | ((kind == FEED) & near)
    for s in specials:
        raw, at = octets.tobytes(), -1
        while (at := raw.find(s, at + 1)) >= 0:
            odd[at] = True
    change = np.zeros(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) & ~safe[:-1]
    stretch = bounds[:n] | safe
    if odd.any():
        first = np.flatnonzero(stretch)
        lengths = np.diff(np.append(first, n))
        change &= ~np.repeat(np.logical_or.reduceat(odd, first), lengths)
    return np.flatnonzero(stretch | change)


class ByteBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        alphabet = byte_alphabet()
        self.stand_in = dict(enumerate(alphabet))
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        back = {c: b for b, c in enumerate(alphabet)}
        tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.token_bytes = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in tokens]
        self.memo = UnitMemo(self._encode, MEMO_UNITS)

    def _encode(self, units: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(units)
        tokenize, stand_in, odd = self.model.tokenize, self.stand_in, []
        for i, u in enumerate(units):
            if _WORD.fullmatch(u.decode()):
                out[i] = [t.id for t in tokenize(u.decode("latin-1").translate(stand_in))]
            else:
                odd.append(i)
        if odd:
            for i, e in zip(odd, self.library.encode_batch_fast([units[i].decode() for i in odd], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8), one text after the other, and the n + 1 places where a text's ids begin and end."""
        data, places = joined(texts)
        n = int(places[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(places), np.int64)
        starts = units_of(data, np.append(places[:-1][np.diff(places) > 0], n), self.specials)
        ids, sizes = self.memo.values(self.memo.rows(data, starts, np.append(starts[1:], n)))
        total = np.append(0, np.cumsum(sizes))
        return ids, total[np.searchsorted(starts, places)]

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, at = self.encode(texts)
        return [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@resident
def byte_bpe(path: str) -> ByteBPE:
    """One encoder a worker process."""
    return ByteBPE(path)
