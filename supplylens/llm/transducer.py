"""Token counts by a deterministic finite-state transducer that is compiled from a BPE vocabulary.

The encoding of a text is fixed by the last token of each of its prefixes: the encoding of a prefix ends in
token t exactly if t encodes to itself and what precedes t ends in a token u (or in nothing) such that u
and t side by side encode to just the two. So reading a character needs only the ends from which a token
may still run on. A state holds these: for each node of the vocabulary's trie that a suffix of the text has
reached, the token before that suffix and the number of tokens up to there, less those up to here. A
transition carries the change of that number, so a text's count is the sum over its path. States and
transitions are compiled as texts ask for them (subset construction) into one hash table of numbers.

Where two characters stand side by side that no token has inside, the state after the second is known
without what came before. A batch of texts is cut into chunks at such places, and all chunks take their
steps together, one table look-up for all of them at once. Long stretches without such a place are cut
anywhere: their chunks have state maps, found for the states that come up (first of all for a guess from some
characters before), and a scan over the chunks composes the maps.

Cases: null and empty texts have no tokens; one result for each input row, whatever its id; special
strings are ordinary text; characters outside the vocabulary count as their bytes; texts of any length
are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, read
from supplylens.llm.tokens import default_path

LIMIT = 4096
#: Characters of a chunk, those before it that a guess reads, and those of texts that are counted together.
CHUNK, WARM, AT_ONCE = 192, 24, 1_000_000
#: States that are kept from one call to the next, and guesses that a chunk gets in a round.
KEPT_STATES, GUESSES = 300_000, 16
BLANK, NEVER = "▁", -np.inf
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


class Transitions:
    """A hash table from (state, symbol) to (next state, change of the count), read for many keys at once."""

    def __init__(self, bits: int = 17):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.gain = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.int64(20)) & np.int64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        at = np.flatnonzero(held != keys)
        while len(at):
            free = held[at] == -1
            slot[at[free]] = -1
            at = at[~free]
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            held[at] = self.keys[slot[at]]
            at = at[held[at] != keys[at]]
        return slot

    def add(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        """Put in distinct keys that aren't there."""
        while 3 * (self.used + len(keys)) > 2 << self.bits:
            old = np.flatnonzero(self.keys != -1)
            held = self.keys[old], self.to[old], self.gain[old]
            self.__init__(self.bits + 1)
            self.add(*held)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            # Of the keys that want a free slot one gets it; the others go on to the next.
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            left = left[self.keys[at] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.to[slot], self.gain[slot] = to, gain
        self.used += len(keys)


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        form, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not form.precompiled_charsmap and form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("made for BPE with byte fallback whose texts get a blank in front and are else taken as they are")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        chars = sorted({c for t in self.score for c in t})
        if lacking := [c for c in chars if c not in self.score]:
            raise ValueError(f"characters that are no tokens: {lacking[:5]}")
        # Symbols: the vocabulary's characters, then other characters by their number of bytes.
        self.symbols, n = {c: k for k, c in enumerate(chars)}, len(chars)
        self.chars, self.width = chars, n + 4
        points = np.arange(0x110000)
        self.symbol = (n + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
        self.symbol[[ord(c) for c in chars]] = np.arange(n)
        self.symbol[0x20] = self.symbols[BLANK]
        # Whether some token has two symbols side by side.
        self.inside = np.zeros((n + 4, n + 4), bool)
        # The trie: children by node and character, the token of a node.
        self.child: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in self.score:
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][c]
            self.token[node] = t
            for a, b in zip(t, t[1:], strict=False):
                self.inside[self.symbols[a], self.symbols[b]] = True
        self.whole: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table = Transitions()
        self.start = self._state(((0, None, 0),))
        if len(self.apart) > 4 * KEPT_STATES:
            self.apart.clear()

    def _state(self, state: tuple) -> int:
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def merge(self, text: str) -> list[str]:
        """BPE of a few characters by its definition: the pair that makes the token of the best score, the leftmost first."""
        parts, score = list(text), self.score.get
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > NEVER:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score(parts[k - 1] + parts[k], NEVER)
            if k < len(gains):
                gains[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def _fits(self, left: str | None, token: str) -> bool:
        """Whether the encoding of what ends in `left` goes on with `token`."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(token) == [token]
        if not known or left is None:
            return known
        if (known := self.apart.get((left, token))) is None:
            known = self.apart[left, token] = self.merge(left + token) == [left, token]
        return known

    def _next(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and how the number of tokens changes."""
        if symbol >= len(self.chars):
            return self.start, symbol - len(self.chars) + 1
        ends, c = self.states[state], self.chars[symbol]
        before = ends[-1][1]
        if before is not None and not self.inside[self.symbols[before[-1]], symbol]:
            ends = self.states[self.start]
        new, last, count = [], None, 0
        for node, left, at in ends:  # the longest suffix first
            if (down := self.child[node].get(c)) is not None:
                if last is None and (t := self.token[down]) is not None and self._fits(left, t):
                    last, count = t, at + 1
                if self.child[down]:
                    new.append((down, left, at))
        return self._state((*((node, left, at - count) for node, left, at in new), (0, last, 0))), count

    def _learn(self, keys: np.ndarray) -> None:
        new = np.unique(keys)
        made = np.array([self._next(*divmod(key, self.width)) for key in new.tolist()], np.int64)
        self.table.add(new, made[:, 0], made[:, 1])

    def run(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which chunks end that begin in the given ones, and the changes of their counts; all take their steps together."""
        order = np.argsort(-length, kind="stable")
        at, size, now = begin[order], length[order], state[order].astype(np.int64)
        gain = np.zeros(len(order), np.int64)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for step, n in enumerate(active.tolist()):
            keys = now[:n] * self.width + symbols[at[:n] + step]
            slot = self.table.find(keys)
            if slot.min() < 0:
                self._learn(keys[slot < 0])
                slot = self.table.find(keys)
            now[:n] = self.table.to[slot]
            gain[:n] += self.table.gain[slot]
        ends, gains = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ends[order], gains[order] = now, gain
        return ends, gains

    def _some(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not lengths.sum():
            return np.zeros(len(texts), np.int64)
        points = np.frombuffer("".join([BLANK + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        # Where the state is known: a text's first symbol, and wherever no token runs across.
        known = np.empty(len(symbols), bool)
        known[1:] = ~self.inside[symbols[:-1], symbols[1:]]
        firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
        known[firsts] = True
        places = np.append(np.flatnonzero(known), len(symbols))
        # The first such place from every multiple of CHUNK on, and the texts' ends.
        cut = np.unique(np.concatenate([firsts, places[np.searchsorted(places, np.arange(0, len(symbols), CHUNK))], [len(symbols)]]))
        begin, length = cut[:-1], np.diff(cut)
        exact = np.ones(len(begin), bool)
        if length.max() > 2 * CHUNK:  # stretches without such a place
            parts = -(-length // CHUNK)
            parts[length <= 2 * CHUNK] = 1
            which = np.repeat(np.arange(len(begin)), parts)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            ends = begin + length
            begin = begin[which] + inner * CHUNK
            exact = inner == 0
            last = np.append(exact[1:], True)
            length = np.where(last, ends[which] - begin, CHUNK)
        entry = np.full(len(begin), self.start, np.int64)
        loose = np.flatnonzero(~exact)
        if len(loose):
            entry[loose] = self.run(symbols, begin[loose] - WARM, np.full(len(loose), WARM), np.full(len(loose), self.start))[0]
        ends, gains = self.run(symbols, begin, length, entry)
        if len(loose):
            self._compose(symbols, begin, length, entry, ends, gains, loose)
        text = np.searchsorted(firsts, begin, side="right") - 1
        out = np.zeros(len(texts), np.int64)
        out[lengths > 0] = np.bincount(text, gains, len(firsts)).astype(np.int64)
        return out

    def _compose(self, symbols, begin, length, entry, ends, gains, loose) -> None:
        """Put right the ends and gains of chunks that began in a guessed state, by composing chunks' state maps."""
        maps: dict[int, dict[int, tuple[int, int]]] = {k: {int(entry[k]): (int(ends[k]), int(gains[k]))} for k in loose.tolist()}
        fresh = {k: {int(ends[k])} for k in loose.tolist()}
        while True:
            asked: list[tuple[int, int]] = []
            came, stuck = -1, False
            for k in loose.tolist():  # ascending: the scan
                if k - 1 not in maps:
                    came, stuck = int(ends[k - 1]), False
                if not stuck:
                    if came in maps[k]:
                        ends[k], gains[k] = maps[k][came]
                        came = int(ends[k])
                    else:
                        asked.append((k, came))
                        stuck = True
                elif fresh.get(k - 1):
                    asked += [(k, s) for s in sorted(fresh[k - 1])[:GUESSES] if s not in maps[k]]
            if not asked:
                return
            which, states = np.array([k for k, _ in asked]), np.array([s for _, s in asked])
            out, gain = self.run(symbols, begin[which], length[which], states)
            fresh = {}
            for (k, s), e, g in zip(asked, out.tolist(), gain.tolist(), strict=True):
                maps[k][s] = (e, g)
                fresh.setdefault(k, set()).add(e)

    def count(self, texts: list[str | None]) -> list[int]:
        out, held, size = [], [], 0
        for t in texts:
            if held and size + len(t or "") > AT_ONCE:
                out += self._some(held).tolist()
                held, size = [], 0
                self._trim()
            held.append(t or "")
            size += len(held[-1])
        out += self._some(held).tolist()
        self._trim()
        return out

    def _trim(self) -> None:
        if len(self.states) > KEPT_STATES:
            self.clear()


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _runner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(compiled.count(batch.column(2).to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row; no begin, end or other added tokens."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_runner(model or default_path("piece_bpe_32k.model")), f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


QUERIES = {"op12_token_transducer": query}
ORACLES: dict[str, str] = {}
