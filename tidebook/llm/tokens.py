"""Token ids of whole texts by a public byte-level BPE tokenizer, with a cache of pre-tokens."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = b"\0\0\0\0"

#: Bytes of text that are cut at once: one word met many times in them is looked up once.
PORTION = 1 << 22

# The classes of the public pre-token pattern of byte-level BPE, written out for the
# characters that PLAIN allows; texts with any other character go to the tokenizer whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = r"\t-\r \x85\xa0"
NOT_PLAIN = re.compile(r"[^\t-\r -~\xa0-ɏ]")
OTHER, LETTER, NUMBER, SPACE = range(4)
KIND = np.array([next((k for k, p in enumerate((LETTERS, NUMBERS, SPACES), 1) if re.match(f"[{p}]", chr(c))), OTHER) for c in range(0x250)], np.uint8)


def pre_tokens(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each pre-token starts in plain texts set end to end, and where the last ends.

    ``chars`` are code points, ``ends`` the place after each text. The pattern, in the classes above:
    '(s|t|m|d|re|ve|ll) or ␣?LETTERS or ␣?NUMBERS or ␣?OTHER or SPACES(?!not a space) or SPACES.
    """
    n, kind = len(chars), KIND[chars]
    first = np.zeros(n + 1, bool)  # of a text
    first[0] = first[ends] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1  # runs that follow white space
    start[after[chars[after - 1] == ord(" ")]] = False
    start[after - 1] = True  # its last character leads the run if it is a blank, else stands alone
    mark = np.flatnonzero((chars == ord("'")) & start[:n])
    mark = mark[~first[mark + 1]]
    one = mark[np.isin(chars[mark + 1], [*map(ord, "stmd")])]
    mark = mark[mark + 2 < n]
    mark = mark[~first[mark + 2]]
    pair = chars[mark + 1].astype("u4") << 16 | chars[mark + 2]
    two = mark[np.isin(pair, [ord(x) << 16 | ord(y) for x, y in ("re", "ve", "ll")])]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return np.flatnonzero(start)


def portions(batch: pa.RecordBatch, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """All rows in their order, so many at once as have ``most`` bytes of text together, or one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    """Where the public 50k byte-level BPE file is on this machine (asked on each executor)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Texts are cut into pre-tokens and the ids of each are kept, so the tokenizer's BPE model runs
    about once for each distinct pre-token, and one call asks the cache once for each. ``capacity``
    bounds the cache; when it is full it is emptied, which costs time and changes no result. Special
    tokens' strings in a text are ordinary text.
    """

    def __init__(self, vocabulary: str | None = None, capacity: int = 1_000_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or default_vocabulary())
        self.tokenizer.encode_special_tokens = True
        self.capacity, self.longest, self.kept = capacity, longest, {}
        self.letters = {k: v for k, v in byte_letters().items() if chr(k) != v}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object a text, ending with id 0; a null text counts as empty."""
        plain = [t is None or not NOT_PLAIN.search(t) for t in texts]
        found = self.plain([t or "" for t, p in zip(texts, plain) if p])
        return [(next(found) if p else self.direct(t)) + END_ID for t, p in zip(texts, plain)]

    def plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each of some plain texts."""
        data = "".join(texts).encode("utf-16-le")
        if not data:
            yield from [b""] * len(texts)
            return
        ends = np.cumsum([len(t) for t in texts])
        starts = pre_tokens(np.frombuffer(data, "<u2"), ends)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(2 * starts), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.words(words.dictionary), pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(starts, ends)].tolist()
        held = memoryview(ids.buffers()[2])
        for low, high in zip([0, *at], at):
            yield bytes(held[low:high])

    def words(self, distinct: pa.LargeBinaryArray) -> list[bytes]:
        """Ids of distinct pre-tokens, given in UTF-16."""
        kept, (_, ends, data) = self.kept, distinct.buffers()
        at, data = np.frombuffer(ends, np.int64, len(distinct) + 1).tolist(), bytes(data)
        words = [data[low:high] for low, high in zip(at, at[1:])]
        out = list(map(kept.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        if len(kept) + len(new) > self.capacity:
            kept.clear()
        model = self.tokenizer.model
        for k in new:
            out[k] = kept[words[k]] = self.word(words[k].decode("utf-16-le"), model)
        return out

    def word(self, word: str, model) -> bytes:
        if len(word) > self.longest:
            return self.direct(word)
        if word.isascii() and word.isprintable():
            seen = word.replace(" ", self.letters[32])
        else:
            seen = word.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in model.tokenize(seen)]
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The Python worker's own encoder, whose cache serves all its tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


@contextmanager
def encoding(vocabulary: str | None = None) -> Iterator[Callable[[list[str | None]], list[bytes]]]:
    """``encode`` of the worker's encoder for one task, after which its cache is emptied.

    A worker lives on and runs the tasks of other stages, where the pre-tokens would only take memory.
    """
    own = encoder(vocabulary)
    try:
        yield own.encode
    finally:
        own.kept.clear()
