"""Token ids of whole texts under the lower-casing word vocabulary, vectorised.

Equal to encoding each text with its tokenizer file. Letters of ASCII and Latin-1, digits and
ASCII punctuation are split and folded in NumPy; distinct parts go through the merges once and
stay in a table of hashes. A stretch between white space that holds anything else (other
scripts, apostrophes, special tokens, control bytes) goes through the tokenizer as it is.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from .words import BASE, BYTES, INVERSE, SPACE, SPAN, U, buffers, mix, powers

VOCABULARY = "word_bpe_49k.json"
KEPT = 600_000  # parts that a Python worker keeps
SPACED, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, dtype=np.uint8)
KIND[SPACE] = SPACED
KIND[[i for i in range(33, 127)]] = MARK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[ord("'"), ord("<")]] = ODD
_coders: dict[str, Coder] = {}


class Coder:
    def __init__(self, vocabulary: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = str(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.tokenizer = Tokenizer.from_file(path)
        # The vocabulary marks a word's last symbol; here a byte that UTF-8 never has stands for the
        # mark. Ids are in the order of merges, so an id serves as the rank of its merge.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(shown[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in vocab.items() if all(c in shown for c in t)}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slots = np.full(1 << 16, -1, dtype=np.int32)

    def put(self, first: int) -> None:
        """Enters the keys from `first` on into the open-addressed slots, two slots a key at least."""
        if 2 * len(self.keys) > len(self.slots):
            self.slots, first = np.full(4 * len(self.slots) if 2 * len(self.keys) <= 4 * len(self.slots) else 1 << (4 * len(self.keys)).bit_length(), -1, dtype=np.int32), 0
        i = np.arange(first, len(self.keys), dtype=np.int32)
        slot = (self.keys[i] & U(len(self.slots) - 1)).astype(np.int64)
        while len(i):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = i[free]
            left = self.slots[slot] != i
            i, slot = i[left], (slot[left] + 1) & (len(self.slots) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place in the table, or -1."""
        slot = (h & U(len(self.slots) - 1)).astype(np.int64)
        out = self.slots[slot]
        if not len(self.keys):
            return out
        bad = np.flatnonzero((self.keys[out] != h) & (out >= 0))
        while len(bad):
            slot[bad] = (slot[bad] + 1) & (len(self.slots) - 1)
            out[bad] = self.slots[slot[bad]]
            bad = bad[(out[bad] >= 0) & (self.keys[out[bad]] != h[bad])]
        return out

    def look(self, h: np.ndarray, raw: np.ndarray, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Each part's place in the table, to which new parts are added."""
        if len(self.keys) > KEPT:
            self.forget()
        place = self.find(h)
        unknown = np.flatnonzero(place < 0)
        if not len(unknown):
            return place
        new, first = np.unique(h[unknown], return_index=True)
        first = unknown[first]
        whole, plain, merge = raw.tobytes(), folded.tobytes(), self.merge
        found = [
            self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids if o else merge(plain[a:b] + b"\xff")
            for a, b, o in zip(starts[first].tolist(), ends[first].tolist(), odd[first].tolist(), strict=True)
        ]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        known = len(self.keys)
        self.at = np.concatenate((self.at, np.cumsum(sizes) - sizes + len(self.flat)))
        self.keys, self.size, self.flat = np.concatenate((self.keys, new)), np.concatenate((self.size, sizes)), np.concatenate((self.flat, flat))
        self.put(known)
        place[unknown] = self.find(h[unknown])
        return place


def coder(vocabulary: str) -> Coder:
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def encode(column: pa.Array, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and each row's (plus one) first place in them."""
    table = coder(vocabulary)
    raw, off = buffers(column)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    kind = KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    low = raw[lead + 1]
    lead = lead[(low != 0x97) & (low != 0xB7)]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    folded = raw.copy()
    folded[(raw >= 65) & (raw <= 90)] += 32
    upper = lead[raw[lead + 1] < 0x9F] + 1
    folded[upper] += 32
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    # Stretches between white space; one with an odd byte is a part by itself.
    inside = np.append(kind != SPACED, False)
    before = np.concatenate(([False], inside[:-1]))
    starts, ends = np.flatnonzero(inside & (edge | ~before)), np.flatnonzero(before & (edge | ~inside))
    odd_before = np.concatenate(([0], np.cumsum(kind == ODD)))
    strange = odd_before[ends] > odd_before[starts]
    step = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(step, starts[strange], 1)
    np.add.at(step, ends[strange], -1)
    odd = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    kind[odd] = ODD
    folded[odd] = raw[odd]
    change = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)))
    s = np.flatnonzero((kind != SPACED) & (change | edge[:-1]))
    stop = np.concatenate((change[1:], [True])) | edge[1:]
    e = np.flatnonzero((kind != SPACED) & stop) + 1
    h = np.empty(len(s), dtype=U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SPAN, "right")))
        a, b = int(s[i]), int(e[j - 1])
        total = np.zeros(b - a + 1, dtype=U)
        np.cumsum(BYTES[folded[a:b]] * powers(BASE, b - a + 1)[: b - a], dtype=U, out=total[1:])
        h[i:j] = (total[e[i:j] - a] - total[s[i:j] - a]) * powers(INVERSE, b - a + 1)[s[i:j] - a]
        i = j
    strange = kind[s] == ODD
    h = mix(h + U(0x632BE59BD9B4E019) * (e - s).astype(U) + strange.astype(U) * U(0x5851F42D4C957F2D))
    place = table.look(h, raw, folded, s, e, strange)
    sizes = table.size[place]
    total = np.concatenate(([0], np.cumsum(sizes)))
    ids = table.flat[np.repeat(table.at[place] - total[:-1], sizes) + np.arange(total[-1])]
    return ids, total[np.searchsorted(s, off)]
