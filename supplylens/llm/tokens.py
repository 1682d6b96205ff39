"""Byte-level BPE of whole texts by the tokenizers library, with repeated words encoded once.

A run of white space and the word after it are a chunk; a word is cut once more wherever an ASCII
sign follows an ASCII letter. No pre-token holds a character of a word and white space after it, or a
letter and a sign after it, and what becomes of a run depends on the chunk alone, so the chunks of a
text encode independently. The chunks of some texts are cut and told apart by their bytes, as arrays;
each worker keeps two generations of chunks and their ids, and the library encodes those that they
lack, many in one call. There a chunk starts with the first token that has white space in front, and
chunks without white space are set apart by line ends, so the ids part without offsets. Texts that hold
an added token or white space other than ASCII's go to the library whole, as do all texts under a
tokenizer that isn't plain byte-level BPE.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks in a generation, and the longest chunk worth keeping.
KEPT_WORDS, KEPT_CHARS = 200_000, 48
#: Characters of texts that are encoded together, and of new chunks in one text for the library.
AT_ONCE, IN_CALL = 1_000_000, 1_000
BLANK = "\t\n\x0b\x0c\r "
OTHER_BLANK = re.compile(rf"[^\S{BLANK}]")
#: What a byte of UTF-8 is: 1 for white space, 2 for a letter and 4 for a sign of ASCII.
KINDS = np.array([1 if chr(b) in BLANK else 2 if b < 128 and chr(b).isalpha() else 4 if 32 < b < 127 and not chr(b).isdigit() else 0 for b in range(256)], np.uint8)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        added = [x["content"] for x in spec["added_tokens"]]
        step = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and step.get("type") == "ByteLevel" and not step["add_prefix_space"] and step["use_regex"]
        self.chunked = plain and not any(re.search(r"\s", x) for x in added)
        self.added = added
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        vocab, blank = self.library.get_vocab(with_added_tokens=True), {byte_alphabet()[ord(c)] for c in BLANK}
        self.starts, self.blank = np.zeros((2, max(vocab.values()) + 1), bool)
        for token, k in vocab.items():
            self.starts[k], self.blank[k] = token[:1] in blank, blank.issuperset(token)
        self.line_end = vocab.get(byte_alphabet()[ord("\n")])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _apart(self, text: str) -> bool:
        """Whether the library has to see the text whole."""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else OTHER_BLANK.search(text)
        return bool(not self.chunked or odd or any(x in text for x in self.added))

    def _together(self, chunks: list[str]) -> None:
        """Learn chunks that start with white space and end in something else."""
        raw = self._whole("".join(chunks))
        ids = np.frombuffer(raw, np.uint32)
        first = self.starts[ids]
        first[1:] &= ~self.blank[ids[:-1]]
        at = (4 * np.flatnonzero(first)).tolist()
        self.words.update((c, raw[a:b]) for c, a, b in zip(chunks, at, [*at[1:], len(raw)], strict=True))

    def _by_lines(self, chunks: list[str]) -> None:
        """Learn chunks without white space."""
        raw = self._whole("\n".join(chunks))
        ends = (4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == self.line_end)).tolist()
        self.words.update((c, raw[a:b]) for c, a, b in zip(chunks, [0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True))

    def _learn(self, chunks: list[str]) -> None:
        bare, spaced = [], []
        for c in chunks:
            ids = self.older.get(c)
            if ids is not None:
                self.words[c] = ids
            elif c[0] not in BLANK:
                bare.append(c)
            elif c[-1] not in BLANK:
                spaced.append(c)
            else:  # the white space at a text's end
                self.words[c] = self._whole(c)
        for learn, some in ((self._by_lines, bare), (self._together, spaced)):
            held, size = [], 0
            for c in some:
                held.append(c)
                size += len(c)
                if size >= IN_CALL:
                    learn(held)
                    held, size = [], 0
            if held:
                learn(held)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        found = list(map(self.words.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            self._learn([chunks[k] for k in new])
            for k in new:
                found[k] = self.words[chunks[k]]
        return found

    def _chunked(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that aren't empty and part into chunks."""
        raws = [x.encode() for x in texts]
        data = b"".join(raws)
        kinds = KINDS[np.frombuffer(data, np.uint8)]
        # White space after anything else, and a sign after a letter.
        cut = np.zeros(len(data), bool)
        cut[1:] = (kinds[1:] == 1) & (kinds[:-1] != 1)
        cut[1:] |= (kinds[1:] == 4) & (kinds[:-1] == 2)
        ends = np.cumsum([len(x) for x in raws])
        cut[0] = cut[ends[:-1]] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(data))
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known, codes = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        flat, sizes = np.frombuffer(b"".join(known), np.uint32), np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = sizes[codes]
        before = np.cumsum(counts) - counts
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - before, counts)
        places += np.arange(len(places))
        raw, starts = flat[places].tobytes(), (4 * before[np.searchsorted(at, ends[:-1])]).tolist()
        if len(self.words) > KEPT_WORDS:
            self.words, self.older = {}, {c: x for c, x in self.words.items() if len(c) <= KEPT_CHARS}
        return [raw[a:b] for a, b in zip([0, *starts], [*starts, len(raw)], strict=True)]

    def _some(self, texts: list[str]) -> list[bytes]:
        whole = [not x or self._apart(x) for x in texts]
        rest = [x for x, w in zip(texts, whole, strict=True) if not w]
        found = iter(self._chunked(rest) if rest else ())
        return [self._whole(x) if w else next(found) for x, w in zip(texts, whole, strict=True)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def encode(self, text: str) -> bytes:
        return self._some([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
