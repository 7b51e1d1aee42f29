"""Byte-level BPE ids of whole columns of texts, by the tokenizers library, each distinct stretch of text once.

A byte-level pre-tokenizer with its usual pattern never lets a token run over these places: before white space that follows a
visible ASCII character, before a space that precedes one, around other single white space between two, and between ASCII
letters, digits and other signs but the apostrophe. Texts are cut there, the library encodes each stretch that is new to
this process, and the texts' ids are gathered from the known stretches' ids; equal stretches are told by their bytes. A stretch
that is plainly one pre-token goes to the library's model at once, any other to the whole tokenizer. Texts in which
a special token's string occurs are encoded whole, as a cut could split it, and so are all texts where the vocabulary's
file has another pre-tokenizer, a normalizer or a way to pick pieces at random.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import bytestext as bt
from .stretches import Stretches, Growing

CHUNK = 1 << 20
#: Stretches given to the whole tokenizer at once.
BATCH = 2000
#: Stretches a process remembers at most; beyond it it starts afresh.
MOST_KNOWN = 1_000_000

_VISIBLE = bt.byte_class((0x21, 0x7E))
_WHITE = ~bt.SOLID
#: 1 letter, 2 digit, 3 other visible signs; 0 all bytes that don't make a cut, the apostrophe among them.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 0
#: One pre-token for sure: letters up to U+00FF, digits, or signs but the apostrophe.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + n) for n, b in enumerate(unseen)}


_LETTERS = _byte_letters()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.cuts = bool(usual and parts["normalizer"] is None and parts["model"].get("type") == "BPE" and not parts["model"].get("dropout"))
        self.known = Stretches(MOST_KNOWN)
        self.forget()

    def forget(self) -> None:
        self.known.forget()
        self.starts, self.ids = Growing(np.int64), Growing(self.kind)
        self.starts.add(np.zeros(1, dtype=np.int64))

    def ids_of(self, stretches: list[bytes]) -> list[list[int]]:
        tokenize = self.model.tokenize
        plain = [self.cuts and _PLAIN.fullmatch(x) is not None for x in stretches]
        # the plain ones hold no line feed, so that one pass spells them all in the vocabulary's letters
        spelled = b"\n".join(itertools.compress(stretches, plain)).decode("latin-1").translate(_LETTERS).split(_LETTERS[10])
        names = iter(spelled)
        others = [x.decode() for x, p in zip(stretches, plain, strict=True) if not p]
        rest = (x.ids for i in range(0, len(others), BATCH) for x in self.tokenizer.encode_batch_fast(others[i : i + BATCH], add_special_tokens=False))
        return [[t.id for t in tokenize(next(names))] if p else next(rest) for p in plain]

    def learn(self, stretches: list[bytes]) -> None:
        found = self.ids_of(stretches)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.starts.add(self.ids.size + np.cumsum(sizes))
        self.ids.add(np.fromiter(itertools.chain.from_iterable(found), dtype=self.kind, count=int(sizes.sum())))

    def stretches(self, flat: np.ndarray, offsets: np.ndarray, data: bytes) -> np.ndarray:
        """Where the stretches of the rows start."""
        cut = np.zeros(len(flat), dtype=bool)
        if self.cuts:
            white, visible = _WHITE[flat], _VISIBLE[flat]
            cut[1:] = white[1:] & visible[:-1]
            space = flat == 0x20
            cut[:-1] |= space[:-1] & visible[1:]
            cut[2:] |= visible[:-2] & (white & ~space)[1:-1] & visible[2:]
            kind = _KIND[flat]
            cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            for at in (m.start() for x in self.special for m in re.finditer(re.escape(x), data)):
                row = np.searchsorted(offsets, at, side="right") - 1
                cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(flat)]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunk by chunk: the rows' ids one after another, and how many each row has."""
        for _, _, flat, offsets in bt.chunks(texts, CHUNK):
            if not len(flat):
                yield np.zeros(0, dtype=self.kind), np.zeros(len(offsets) - 1, dtype=np.int64)
                continue
            data = flat.tobytes()
            starts = self.stretches(flat, offsets, data)
            ends = np.append(starts[1:], len(flat))
            if self.known.full():
                self.forget()
            numbers, new = self.known.number(flat, starts, ends)
            if len(new):
                self.learn([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = self.starts()
            sizes = at[numbers + 1] - at[numbers]
            yield self.ids()[bt.ragged(at[numbers], sizes)], np.diff(bt.bounds(sizes)[np.searchsorted(starts, offsets)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
