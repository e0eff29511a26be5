"""Byte-level BPE over whole columns, with a bounded memory of pieces.

Texts are cut at borders of the tokenizer's own pre-tokens, found on the bytes
of a whole block at once: between letters, digits and other characters, and
around white space.  Runs of letters beyond ASCII are cut further, where no
entry of the vocabulary has the two bytes at the border side by side, as no
merge can cross there.  Only borders that no context can move are cut, so the
ids of a text are those of its pieces, one after the other.  Each worker remembers
the ids of pieces in a table of fixed size, where a new piece takes the place
of the one that shares its slot.  Pieces that are not remembered are joined by
line ends, encoded by the tokenizer as one text, and told apart again by the
bytes that each id stands for.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from orefield.llm import common as c
from orefield.llm.common import U64, ragged

#: Places for remembered pieces, and the most ids of one that is remembered.
SLOT_BITS = 20
MOST_IDS = 8
#: Bytes of unknown pieces that are encoded as one text.
LEARN_BYTES = 1 << 16

UNSURE, LETTER, DIGIT, OTHER, SPACE = range(5)
_encoders: dict[str, Encoder] = {}


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point; unsure where it has changed since an early version of Unicode, or libraries differ on it."""
    major = {"L": LETTER, "N": DIGIT}
    old = unicodedata.ucd_3_2_0
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        x = chr(cp)
        now, then = unicodedata.category(x), old.category(x)
        if "Cn" in (now, then) or now[0] != then[0] or 0x1C <= cp <= 0x1F or cp == 0x85:
            continue
        out[cp] = SPACE if x.isspace() else major.get(now[0], OTHER)
    return out


@functools.cache
def _ascii() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[:128] = [SPACE if x in (*range(9, 14), 32) else UNSURE if 0x1C <= x <= 0x1F else LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else OTHER for x in range(128)]
    return out


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character that each byte belongs to, and the places of bytes that continue one."""
    out = _ascii()[data]
    wide = np.flatnonzero(data >= 0x80)
    if not len(wide):
        return out, wide
    starts = data[wide] >= 0xC0
    lead, more = wide[starts], wide[~starts]
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    cp = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        has = size > k
        cp[has] = cp[has] << 6 | data[lead[has] + k] & 0x3F
    kind = _classes()[np.minimum(cp, 0x10FFFF)]
    for k in range(4):
        has = size > k
        out[lead[has] + k] = kind[has]
    return out, more


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if visible, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def piece_starts(data: np.ndarray, offsets: np.ndarray, parted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each text begin, and the classes of all bytes; every text that has bytes begins a piece.

    parted tells of each two bytes whether no entry of the vocabulary has them side by side.
    """
    n = len(data)
    kind, inner = byte_classes(data)
    if not n:
        return np.zeros(0, np.int64), kind
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (before != after) & (before != UNSURE) & (after != UNSURE)
    edge = np.zeros(n, bool)  # the first byte of each text
    edge[offsets[:-1][offsets[:-1] < n]] = True
    wide = np.flatnonzero((data[:-1] >= 0x80) & (data[1:] >= 0xC0)) + 1
    wide = wide[(kind[wide] == LETTER) & (kind[wide - 1] == LETTER)]
    cut[wide] = parted[data[wide - 1], data[wide]]
    # an apostrophe may join the letters after it
    quote = np.flatnonzero(data[:-1] == 0x27) + 1
    cut[quote[(kind[quote] == LETTER)]] = False
    # the last white space before a visible character stands alone, or with that character if it is U+0020
    visible = np.flatnonzero((before == SPACE) & (after != SPACE) & (after != UNSURE) & ~edge[1:]) + 1
    blank = data[visible - 1] == 0x20
    cut[visible[blank]] = False
    cut[visible[blank] - 1] = True
    for at in visible[~blank]:
        k = at - 1
        while data[k] & 0xC0 == 0x80:
            k -= 1
        cut[k] = True
    cut[inner] = False
    cut[:n] |= edge
    return np.flatnonzero(cut[:n]), kind


class Encoder:
    """Ids of whole texts under a byte-level tokenizers file (its text)."""

    def __init__(self, definition: str, slot_bits: int = SLOT_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        split = parts.get("pre_tokenizer") or {}
        if parts.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        if any(not x.get("special") for x in parts.get("added_tokens") or []):
            raise ValueError("added tokens that aren't special may stand anywhere in a text")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        special = parts.get("added_tokens") or []
        #: Ids of the special tokens by their written names; none where the file has more to say on how they are found.
        self.specials = {x["content"].encode(): int(x["id"]) for x in special if not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))}
        self.plain_specials = len(self.specials) == len(special)
        self.special = re.compile(b"|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) or rb"(?!)")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.parted = np.ones((256, 256), bool)
        byte = {x: b for b, x in enumerate(byte_letters())}
        for x, k in vocabulary.items():
            self.bytes_of[k] = len(x)
            own = [byte[y] for y in x]
            self.parted[own[:-1], own[1:]] = False
        self.shift = U64(64 - slot_bits)
        self.hashes = np.zeros(1 << slot_bits, U64)
        self.counts = np.zeros(1 << slot_bits, np.uint8)
        self.kept = MOST_IDS << slot_bits
        #: Ids of remembered pieces, MOST_IDS for each; then, for the time of one block, those of its unknown pieces.
        self.pool = np.zeros(self.kept + (1 << 16), np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32)

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of the pieces of raw, in the order given."""
        first = kind[starts]
        first = np.where((first == SPACE) & (ends - starts > 1) & (np.frombuffer(raw, np.uint8)[starts] == 0x20), kind[np.minimum(starts + 1, len(kind) - 1)], first)
        plain = ~np.isin(first, (UNSURE, SPACE)) & ~np.isin(kind[ends - 1], (UNSURE, SPACE))
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        ids: list[np.ndarray] = []
        joined = np.flatnonzero(plain)
        groups = np.split(joined, np.flatnonzero(np.diff(np.cumsum(sizes[joined]) // LEARN_BYTES)) + 1) if len(joined) else []
        a, b = starts.tolist(), ends.tolist()
        texts = [b"\n".join([raw[a[k] : b[k]] for k in g.tolist()]).decode() for g in groups]
        for g, own in zip(groups, self._one_by_one(texts), strict=True):
            at = np.cumsum(self.bytes_of[own])
            stops = np.cumsum(sizes[g] + 1) - 1  # where each piece ends; a line end follows
            last = np.searchsorted(at, stops) + 1
            counts[g] = np.diff(np.concatenate([[0], last + 1]))[: len(g)] - 1
            keep = np.ones(len(own), bool)
            keep[last[:-1]] = False
            ids.append(own[keep])
        alone = np.flatnonzero(~plain)
        own = self._one_by_one([raw[a[k] : b[k]].decode() for k in alone.tolist()])
        counts[alone] = [len(x) for x in own]
        flat = np.concatenate([*ids, *own]) if ids or own else np.zeros(0, np.int64)
        order = np.concatenate([joined, alone])
        begins = np.empty(len(starts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(begins, counts)], counts

    def block(self, data: np.ndarray, offsets: np.ndarray, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of texts that lie end to end: where pieces begin, their numbers of ids, and all ids."""
        starts, kind = piece_starts(data, offsets, self.parted)
        if not len(starts):
            return starts, np.zeros(0, np.int64), np.zeros(0, self.pool.dtype)
        ends = np.append(starts[1:], len(data))
        h = c.word_hashes(data, starts, ends)
        slot = (h >> self.shift).astype(np.int64)
        counts = self.counts[slot].astype(np.int64)
        source = slot * MOST_IDS
        miss = np.flatnonzero((self.hashes[slot] != h) | (counts == 0))
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            ids, n = self._learn(data.tobytes(), starts[at], ends[at], kind)
            if self.kept + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.kept], np.zeros(2 * len(ids), self.pool.dtype)])
            self.pool[self.kept : self.kept + len(ids)] = ids
            begins = self.kept + np.cumsum(n) - n
            counts[miss], source[miss] = n[back], begins[back]
        out = self.pool[ragged(source, counts)] if with_ids else None
        if len(miss):  # only now, as the block may have used what these displace
            own = (new >> self.shift).astype(np.int64)
            _, one = np.unique(own, return_index=True)
            one = one[n[one] <= MOST_IDS]
            own, n = own[one], n[one]
            self.hashes[own], self.counts[own] = new[one], n
            to = ragged(own * MOST_IDS, n)
            self.pool[to] = self.pool[ragged(begins[one], n)]
        return starts, counts, out

    def pieces(self, column: pa.Array):
        """(rows, number of the first piece of each row and one more, characters of each piece, ids of each piece) of runs of rows."""
        for _, rows, data, offsets in c.text_blocks(column):
            starts, counts, _ = self.block(data, offsets, with_ids=False)
            chars = np.add.reduceat((data & 0xC0 != 0x80).astype(np.int64), starts) if len(starts) else starts
            yield rows, np.searchsorted(starts, offsets), chars, counts

    def encode(self, column: pa.Array, specials: bool = False):
        """(rows, all ids, number of ids of each row) of runs of rows; a null text is empty.

        With specials, the written name of a special token is that token and a
        border of the text on both sides; else it is text like any other.
        """
        if specials and not self.plain_specials:
            raise ValueError("special tokens that take more or less than their written names aren't found")
        for _, rows, data, offsets in c.text_blocks(column):
            if specials and self.special.search(data.tobytes()):
                yield rows, *self._with_specials(data, offsets)
                continue
            starts, counts, ids = self.block(data, offsets)
            sums = np.concatenate([[0], np.cumsum(counts)])
            yield rows, ids, np.diff(sums[np.searchsorted(starts, offsets)])

    def _with_specials(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text; what stands between special tokens is encoded as a text of its own."""
        raw = data.tobytes()
        found = [(d, m) for d in range(len(offsets) - 1) for m in self.special.finditer(raw, offsets[d], offsets[d + 1])]
        row = np.array([d for d, _ in found], np.int64)
        begin, size = (np.array([x(m) for _, m in found], np.int64) for x in (re.Match.start, lambda m: len(m[0])))
        gone = np.concatenate([[0], np.cumsum(size)])  # bytes of special tokens before each of them
        keep = np.ones(len(data), bool)
        keep[ragged(begin, size)] = False
        at = begin - gone[:-1]
        borders = offsets - gone[np.searchsorted(begin, offsets)]
        starts, counts, ids = self.block(data[keep], np.sort(np.concatenate([borders, at])))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ids = np.insert(ids.astype(np.uint32), sums[np.searchsorted(starts, at)], [self.specials[m[0]] for _, m in found])
        return ids, np.diff(sums[np.searchsorted(starts, borders)]) + np.bincount(row, minlength=len(offsets) - 1)


c.forgetters.append(_encoders.clear)


def encoder(definition: str) -> Encoder:
    """This process's encoder for a definition."""
    if definition not in _encoders:
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]
