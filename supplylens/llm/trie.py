"""BPE encoding and decoding by a prefix trie.

In BPE the encoding of a word is fixed by the last token of each of its prefixes: the encoding of
a prefix ends in token t exactly if t encodes to itself and the encoding of what precedes t ends in
a token that stays apart from t, that is, the two side by side encode to just the two. Distinct
words form a trie, held as their sorted list; a depth-first walk gives each node the last token of
its prefix, so a prefix that many words share is encoded once. Which tokens can end a prefix is told by
an automaton over the vocabulary. A word's last symbol carries the end-of-word mark, so its last token
is found at the word's end and the rest is read back along the path.

Cases: null and empty texts have no ids and decode to ""; one result per input row, whatever its
id; texts of any length are encoded whole; special tokens in a text are ids as in the library;
other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, read
from supplylens.llm.tokens import byte_alphabet, default_path

KEPT_PIECES, KEPT_WORDS, KEPT_PAIRS = 250_000, 200_000, 500_000
SEPARATOR = re.compile(r"[\x1c-\x1f]")


class TrieEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import regex

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.mark = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        if spec["decoder"] or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("made for a vocabulary without a decoder, whose special tokens stand in the text as they are")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.apart_from = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = byte_alphabet()
        self.names = {k: t for t, k in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.apart: dict[int, bool] = {}
        # Tokens that encode to themselves; others never end a prefix.
        self.whole = {t for t in self.vocab if self.merge(self.symbols(t)) == [t]}
        self.link()
        # What the worker knows: ids of pieces, their text with a space behind each token, ids of words; a new and an old generation.
        self.ids, self.old_ids = {}, {}
        self.shown, self.old_shown = {}, {}
        self.coded, self.old_coded = {}, {}

    def link(self) -> None:
        """An automaton over the vocabulary: for what has been read, the tokens that end it, the longest first."""
        self.next: list[dict[str, int]] = [{}]
        inside, ends = [None], [None]
        for token in self.whole:
            end = token.endswith(self.mark) and len(token) > len(self.mark)
            body, node = token[: -len(self.mark)] if end else token, 0
            for c in body:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    inside.append(None)
                    ends.append(None)
                node = self.next[node][c]
            (ends if end else inside)[node] = (self.vocab[token], len(body))
        # fail: the longest proper suffix that is a node; shorter nodes are ready when a longer one asks.
        self.fail = [0] * len(self.next)
        self.inside, self.ends = [()] * len(self.next), [()] * len(self.next)
        level = list(self.next[0].values())
        for node in level:
            for out, own in ((self.inside, inside), (self.ends, ends)):
                out[node] = (own[node],) if own[node] else ()
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    back = self.fail[node]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[child] = back = self.next[back].get(c, 0)
                    for out, own in ((self.inside, inside), (self.ends, ends)):
                        out[child] = ((own[child],) if own[child] else ()) + out[back]
                    below.append(child)
            level = below

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """BPE of a few symbols by its definition: the pair of lowest rank, the leftmost first."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to just the two."""
        if len(self.apart) >= KEPT_PAIRS:
            self.apart.clear()
        a, b = self.names[left], self.names[right]
        known = self.apart[left << 32 | right] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def _last(self, tokens: tuple[tuple[int, int], ...], at: int, state: list[int]) -> tuple[int, int]:
        """Of the tokens that end a prefix of `at` symbols the last one of its encoding; state: those of shorter prefixes."""
        apart = self.apart
        for token, size in tokens:
            if size == at:
                return token, size
            left = state[at - size]
            known = apart.get(left << 32 | token)
            if known or known is None and self.stay_apart(left, token):
                return token, size
        raise ValueError("no token ends a prefix")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words, which are in the vocabulary's alphabet.

        In sorted order the words are the trie's leaves as a depth-first walk meets them: `state` is
        the path to the current leaf, and each word goes back to where it leaves the one before.
        """
        found: dict[str, list[int]] = {}
        # By length of the prefix: its last token, that one's size, and the automaton's node.
        state, sizes, nodes = [-1], [0], [0]
        last, step, fail, inside, before = self._last, self.next, self.fail, self.inside, ""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(nodes) - 1, n - 1, len(before))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :], sizes[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for at in range(shared, n):
                c = word[at]
                while node and c not in step[node]:
                    node = fail[node]
                node = step[node].get(c, 0)
                if at < n - 1:
                    token, size = last(inside[node], at + 1, state)
                    state.append(token)
                    sizes.append(size)
                    nodes.append(node)
            token, size = last(self.ends[node], n, state)
            tokens, at = [token], n - size
            while at:
                tokens.append(state[at])
                at -= sizes[at]
            tokens.reverse()
            found[word] = tokens
            before = word
        return found

    def split(self, piece: str) -> list[str]:
        """The words of a text without white space, in the vocabulary's alphabet."""
        if piece.isascii():
            plain = piece.lower()
            if plain.isalpha():
                # Only a whole contraction could be more than one word; it would need an apostrophe.
                return [plain]
            if plain[:-1].isalpha() and plain[-1] in ",.;:!?":
                return [plain[:-1], plain[-1]]
            return ["".join(map(self.bytes.__getitem__, w.encode())) for w in self.words.findall(plain)]
        if max(piece) > "ɏ":
            plain = self.library.normalizer.normalize_str(piece)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        # Below combining marks every string is in normal form, and lower case goes by single characters.
        plain = piece.lower()
        if max(plain) > "ɏ":
            plain = self.library.normalizer.normalize_str(piece)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        if plain.isalpha():
            found = [plain]
        elif plain[:-1].isalpha() and plain[-1] in ",.;:!?":
            found = [plain[:-1], plain[-1]]
        else:
            found = self.words.findall(plain)
        return [w if w.isascii() and w.isprintable() else "".join(map(self.bytes.__getitem__, w.encode())) for w in found]

    def learn(self, pieces: set[str]) -> None:
        """Know the pieces; those that neither generation knows are encoded, their new words through one trie."""
        if len(self.ids) > KEPT_PIECES:
            self.old_ids, self.old_shown, self.ids, self.shown = self.ids, self.shown, {}, {}
        if len(self.coded) > KEPT_WORDS:
            self.old_coded, self.coded = self.coded, {}
        ids, shown, coded, new = self.ids, self.shown, self.coded, []
        for p in pieces:
            if p not in ids:
                if (known := self.old_ids.get(p)) is None:
                    new.append((p, self.split(p)))
                else:
                    ids[p], shown[p] = known, self.old_shown[p]
        words = set()
        for _, ws in new:
            for w in ws:
                if w not in coded:
                    if (known := self.old_coded.get(w)) is None:
                        words.add(w)
                    else:
                        coded[w] = known
        coded.update(self.encode_words(words))
        names = self.names
        for p, ws in new:
            found = coded[ws[0]] if len(ws) == 1 else [k for w in ws for k in coded[w]]
            ids[p] = array("I", found).tobytes()
            shown[p] = "".join([names[k] + " " for k in found])

    def cut(self, text: str) -> list[str]:
        """The runs between white space. Python also takes four separators for white space; the library doesn't."""
        if SEPARATOR.search(text):
            return [p for p in re.split(r"[^\S\x1c-\x1f]+", text) if p]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        cut = [self.parts(t or "") for t in texts]
        self.learn(set().union(*cut))
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        return [(b"".join(map(ids, ps)), "".join(map(shown, ps))[:-1]) for ps in cut]

    def parts(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces of their own and end the pieces beside them."""
        if not any(x in text for x in self.special):
            return self.cut(text)
        found = []
        for k, part in enumerate(self.apart_from.split(text)):
            if k % 2:
                self.ids[part], self.shown[part] = array("I", [self.special[part]]).tobytes(), part + " "
                found.append(part)
            else:
                found += self.cut(part)
        return found

    def decode(self, ids) -> str:
        """The tokens' names, with spaces between: what a vocabulary without a decoder gives."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _runner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(path)
        gc.disable()  # there are no cycles here, and walking the worker's tables in search of them takes a sixth of the time
        try:
            for batch in batches:
                out = enc.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["id", "ids", "decoded"]
                )
        finally:
            gc.enable()

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ids (binary, little-endian 32-bit) and the decoded text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_runner(tokenizer or default_path("word_bpe_49k.json")), f"id {kind}, ids binary, decoded string")
    return found.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_trie_bpe": query}
ORACLES: dict[str, str] = {}
