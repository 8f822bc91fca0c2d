"""Byte-level BPE ids of whole texts by the tokenizers library, with a bounded memo of pre-tokens.

A byte-level BPE first splits a text by a fixed pattern and then merges inside each
pre-token alone, so the ids of a text are those of its pre-tokens in turn. Texts whose
characters are all of the common Latin ranges are split here, many at a time over their bytes,
and each new pre-token is given to the library once, as its bytes are spelled in the file; any
other text goes to the library as it is, and so does a text that holds an added token of the
file, which the library takes out first.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-token pattern of the byte-level BPE, for the characters below.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: What ``splits`` does, as a pattern.
PRETOKEN = re.compile(rf"'(?:[sdmt]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Characters whose class the pattern above may take otherwise than the library does.
UNCOMMON = r"[^\x01-\x1b\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]"
#: Pre-tokens in a call of the library; bytes of texts that are split at a time.
JOINED, SPLIT = 256, 2 << 20
#: Classes of bytes: white space, letters, digits and all else; continuation bytes take that of the character's first.
BLANK, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
CLASS[48:58] = DIGIT
#: How byte-level files spell each byte as a character.
SPELLED = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
SPELLED = {b: c or chr(256 + SPELLED[:b].count("")) for b, c in enumerate(SPELLED)}


def splits(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the bytes of texts that begin at ``starts``, and the end of the bytes."""
    n = len(data)
    kind = CLASS[data]
    two = np.flatnonzero((data == 0xC2) | (data == 0xC3))  # the ranges of common characters that hold letters and others
    after = data[np.minimum(two + 1, n - 1)]
    kind[two] = np.where(np.where(data[two] == 0xC2, np.isin(after, (0xAA, 0xB5, 0xBA)), ~np.isin(after, (0x97, 0xB7))), LETTER, OTHER)
    inner = np.flatnonzero(data & 0xC0 == 0x80)
    kind[inner] = kind[inner - 1]  # right for the second byte; third bytes belong to characters that are all of the class OTHER
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind == BLANK) & begins[1:] & ~first[1:])  # of white space before something else
    begins[last] = True
    begins[last[data[last] == 32] + 1] = False
    quotes = np.flatnonzero(data == 39)
    quotes = quotes[begins[quotes]]
    one, two = (data[np.minimum(quotes + k, n - 1)] for k in (1, 2))
    short = np.isin(one, list(b"sdmt")) & ~first[np.minimum(quotes + 1, n)]
    long = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & ~first[np.minimum(quotes + 1, n)] & ~first[np.minimum(quotes + 2, n)]
    begins[quotes[short | long] + 1] = False
    begins[quotes[short] + 2] = True
    begins[quotes[long] + 3] = True
    return np.flatnonzero(begins)


class Memo:
    """A bounded map in two generations: what has not been asked for during one is forgotten."""

    def __init__(self, entries: int):
        self.entries, self.now, self.older = entries, {}, {}

    def forget(self) -> None:
        self.now, self.older = {}, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are not known; the others are in ``now`` afterwards."""
        new = keys.difference(self.now)  # of a dict, not of its view, which would be gone through
        if len(self.now) + len(new) > self.entries:
            self.now, self.older, new = {}, self.now, keys
        known = set(filter(self.older.__contains__, new))
        self.now.update(zip(known, map(self.older.__getitem__, known)))
        return list(new - known)


class ByteBPE:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, entries: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([UNCOMMON, *added])
        self.merger = self.merging(path)
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.sizes[i] = len(piece)
        self.pretokens = Memo(entries)

    @staticmethod
    def merging(path: str):
        """The library with the file's merges alone: it takes pre-tokens already spelled, with blanks between them."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as data:
            file = json.load(data)
        return Tokenizer.from_str(json.dumps(file | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "post_processor": None}))

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def solve(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, each merged alone."""
        out = []
        spelled = [w.decode("latin-1").translate(SPELLED) for w in pretokens]
        for k in range(0, len(spelled), JOINED):
            words = spelled[k : k + JOINED]
            ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        return out

    def split(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts of common characters, by their pre-tokens."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        if not size:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(int(offsets[0]), size)
        offsets -= offsets[0]
        at = splits(np.frombuffer(data, np.uint8), offsets)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), data]).dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        new = self.pretokens.missing(set(words))
        self.pretokens.now.update(zip(new, self.solve(new)))
        found = list(map(self.pretokens.now.__getitem__, words))
        flat, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = lengths[codes]
        ends = np.cumsum(own)
        shift = (np.cumsum(lengths) - lengths)[codes] - (ends - own)
        ids = flat[np.repeat(shift, own) + np.arange(int(ends[-1]))].tobytes()
        cuts = (np.append(0, ends)[np.searchsorted(at, offsets)] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(texts, self.odd), False))
        out: list[bytes | None] = [None] * len(texts)
        at = np.flatnonzero(odd)
        for i, ids in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist())):
            out[i] = ids
        at = np.flatnonzero(~odd)
        ends = np.cumsum(np.asarray(pc.binary_length(texts))[at].astype(np.int64))
        collecting = gc.isenabled()
        gc.disable()  # many short strings and no cycles
        try:
            begin = 0
            while begin < len(at):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SPLIT, side="right")))
                some = at[begin:stop]
                for i, ids in zip(some.tolist(), self.split(texts.take(pa.array(some)))):
                    out[i] = ids
                begin = stop
        finally:
            if collecting:
                gc.enable()
        return out


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder for each Python worker, which Spark keeps; its memo goes on to the next task unless that task's user forgets it."""
    return ByteBPE(path)
