import hashlib
import random
import zlib

import numpy as np
from conftest import by_text
from tokenizers import Tokenizer

from supplylens.llm import packing, trie, wavelet
from supplylens.llm.tokens import default_path, encoder

BYTES, WORDS = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a  b", " lead", "trail ", "a\n\nb", "a \nb", "tab\tx", "x y", "it's 'tis DON'T", "x\x1cy  z", "1234 ½ Ⅷ", "你好 世界 🙂🙂",
       "<|endoftext|> a<|startoftext|>b", "İstanbul ẞ ﬁ Σς é", "a" * 3000, "abcd" * 500 + "1 2", "hi,there.you;all", "ab, AB. aB! ab"]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoders_match_the_library(texts):
    byte, words, all_texts = encoder(BYTES), trie.TrieEncoder(WORDS), [t for t in texts if t] + ODD
    lib_b, lib_w = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for text, (ids, decoded) in zip(all_texts, words.encode(all_texts), strict=True):
        assert byte.encode(text) == raw(lib_b.encode(text, add_special_tokens=False).ids), text[:40]
        want = lib_w.encode(text, add_special_tokens=False).ids
        assert ids == raw(want) and decoded == lib_w.decode(want, skip_special_tokens=False), text[:40]


def test_control_characters_beside_letters(spark):
    """Words of ASCII may hold characters that byte-level vocabularies show by others."""
    odd = ["café\x7f latte", "\x00ß", "\x1cı", "é\x01a \x1fb\x7f.", "a\x00b"]
    lib = Tokenizer.from_file(WORDS)
    rows = {r["t"]: (r["ids"], r["decoded"]) for r in trie.encode(spark.createDataFrame([(t, t) for t in odd], "t string, text string"), id_col="t").collect()}
    for text in odd:
        want = lib.encode(text, add_special_tokens=False).ids
        assert rows[text] == (raw(want), lib.decode(want, skip_special_tokens=False)), text


def test_random_texts_match_the_library():
    rng = random.Random(11)
    pools = [list(map(chr, range(0x80))), list(map(chr, [*range(1, 0x20), 0x7F, 0x85, 0xA0])), list(map(chr, range(0x80, 0x250))), list(map(chr, range(0x300, 0x370))), list(map(chr, range(0x370, 0x3000))), ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n", "İ", "ß", "K"]]
    lib_b, lib_w, byte, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), encoder(BYTES), trie.TrieEncoder(WORDS)
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    got = words.encode(texts)
    for text, (ids, decoded), b, w in zip(texts, got, lib_b.encode_batch(texts, add_special_tokens=False), lib_w.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == raw(w.ids) and decoded == lib_w.decode(w.ids, skip_special_tokens=False), ascii(text)
        assert byte.encode(text) == raw(b.ids), ascii(text)


def test_small_tables_give_the_same(monkeypatch, texts):
    """Clearing a worker's tables of words changes nothing."""
    monkeypatch.setattr("supplylens.llm.trie.KEPT_PIECES", 30)
    monkeypatch.setattr("supplylens.llm.trie.KEPT_WORDS", 20)
    monkeypatch.setattr("supplylens.llm.tokens.KEPT_WORDS", 10)
    small = trie.TrieEncoder(WORDS)
    some = [t for t in texts if t][:12]
    lib_b, lib_w, byte = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), encoder.__wrapped__(BYTES)
    for text in some:
        assert small.encode([text])[0][0] == raw(lib_w.encode(text, add_special_tokens=False).ids)
        assert byte.encode(text) == raw(lib_b.encode(text, add_special_tokens=False).ids)


def test_the_library_sees_a_word_once_whatever_sign_follows(monkeypatch):
    rng, byte, lib, seen = random.Random(4), encoder.__wrapped__(BYTES), Tokenizer.from_file(BYTES), []
    whole = byte._whole
    monkeypatch.setattr(byte, "_whole", lambda text: seen.append(len(text)) or whole(text))
    words = ["".join(rng.choice("aeilmnorst") for _ in range(9)) for _ in range(200)]
    texts = [" ".join(w + sign for w in words) for sign in ("", ",", ".", ";", ":", "!", "?", ")", "%%%", "###", "'", "'s", "'x,", ".com", '."', "--", "=1")]
    assert list(byte.encode_all(texts)) == [raw(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert sum(seen) < 2 * len(texts[0])


def test_letters_signs_and_line_ends_match_the_library():
    rng = random.Random(12)
    pool = [*"aZsétdm,.'\"-_;1½ \n\t", "'s", "'ll", "'re", " '", "  ", "\u0301", "ª", "×", "－", "🙂", "\n\n", ""]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    got, want = encoder.__wrapped__(BYTES).encode_all(texts), Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    for text, ids, x in zip(texts, got, want, strict=True):
        assert ids == raw(x.ids), ascii(text)


def test_trie_query(spark, sf, docs):
    got = [tuple(r) for r in trie.query(spark, sf).collect()]
    lib, want = Tokenizer.from_file(WORDS), []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_text(got) == by_text(want)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 16), (1, 16), (5000, 16), (4096, 9), (3000, 17)):
        ids = rng.integers(0, min(2**bits, 300), n).astype(np.uint32)
        m = wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids, bits).dump())
        assert m.decode().tolist() == ids.tolist()
        for i in rng.integers(0, n, 40) if n else []:
            assert m.access(int(i)) == ids[i]
            v = int(ids[i])
            places = np.flatnonzero(ids == v)
            assert m.count(v) == len(places) and m.rank(v, int(i)) == int((ids[:i] == v).sum())
            k = int(rng.integers(0, len(places)))
            assert m.select(v, k) == places[k]
        assert m.count(299) == int((ids == 299).sum())


def test_shards_query(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    rows = [r for r in docs.select("doc_id", "text").collect()]
    got = wavelet.query(spark, sf).collect()
    want = [(r["doc_id"], len(x := ids_of(BYTES, r["text"]) + [2]), zlib.crc32(raw(x))) for r in rows]
    assert by_text((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == by_text(want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k))


def test_one_access_opens_a_frame_of_each_plane():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 3 * wavelet.FRAME + 77).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids, 16)
    for i in (0, wavelet.FRAME - 1, wavelet.FRAME, len(ids) - 1):
        m.held.clear()
        assert m.access(i) == ids[i] and len(m.held) == 16
    places = rng.integers(0, len(ids), 1000)
    assert m.take(places).tolist() == ids[places].tolist()
    for v in (*ids[:5].tolist(), 50_001, 1 << 20, -1):
        want = np.flatnonzero(ids == v)
        assert m.find(v).tolist() == want.tolist() and m.count(v) == len(want)
        assert m.find(v, 1, 3).tolist() == want[1:3].tolist()


def test_folder_is_counted_and_searched(spark, docs, tmp_path):
    """Counts, occurrences and ids at places over many shards, against the plain list of ids."""
    path = f"file://{tmp_path}/s"
    wavelet.write_shards(docs, path, shard_tokens=400)
    found, starts = wavelet.read_shards(spark, path)
    rows = found.join(starts, ["part", "seq"]).collect()
    assert starts.count() > 3 and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    rows.sort(key=lambda r: r["shard_start"] + r["at"])
    texts = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
    whole = [x for ids in texts for x in ids]
    tokens = [2, whole[0], whole[0], whole[len(whole) // 2], 49_999, 1 << 30]
    assert {(r["token"], r["n"]) for r in wavelet.token_counts(spark, path, tokens).collect()} == {(t, whole.count(t)) for t in tokens}
    for token in (2, whole[0], 1 << 30):
        got = [(r["part"], r["seq"], r["doc_id"], r["at"], r["place"]) for r in wavelet.occurrences(spark, path, token).collect()]
        want = [(r["part"], r["seq"], r["doc_id"], r["at"], k) for r, ids in zip(rows, texts, strict=True) for k, x in enumerate(ids) if x == token]
        assert by_text(got) == by_text(want)
    asked = [0, 5, 5, len(whole) - 1, len(whole), -1, None, *range(3, len(whole), 97)]
    got = wavelet.tokens_at(spark, path, spark.createDataFrame([(k,) for k in asked], "place bigint")).collect()
    assert sorted((r["place"], r["token"]) for r in got) == sorted({(k, whole[k]) for k in asked if k is not None and 0 <= k < len(whole)})


def test_packing_query(spark, sf, docs):
    got = packing.query(spark, sf).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(BYTES, r["text"]) + [0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(raw(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert by_text((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == by_text(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 1


def fewest(items, capacity):
    """The least number of sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = {s: items.count(s) for s in items}
        fixed, rest = packing.reduce(counts, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + fewest(left, capacity) == fewest(items, capacity)
        kinds = packing.plan(counts, capacity)
        total = {}
        for n, held in kinds:
            assert sum(s * c for s, c in held) <= capacity
            for s, c in held:
                total[s] = total.get(s, 0) + n * c
        assert total == counts


def test_many_items_of_few_sizes_are_planned_at_once():
    kinds = packing.plan({1000: 10**7, 400: 10**7})
    assert len(kinds) < 10 and sum(n for n, _ in kinds) <= 10**7
    assert sum(n * c for n, held in kinds for s, c in held if s == 1000) == 10**7


def test_empty_tables(empty, tmp_path):
    assert trie.encode(empty).count() == 0
    assert packing.packed(empty).count() == 0
    wavelet.write_shards(empty, f"file://{tmp_path}/s")
    found, starts = wavelet.read_shards(empty.sparkSession, f"file://{tmp_path}/s")
    assert found.count() == 0 and starts.count() == 0
    spark = empty.sparkSession
    assert [tuple(r) for r in wavelet.token_counts(spark, f"file://{tmp_path}/s", [2]).collect()] == [(2, 0)]
    assert wavelet.occurrences(spark, f"file://{tmp_path}/s", 2).count() == 0
    assert wavelet.tokens_at(spark, f"file://{tmp_path}/s", spark.range(3).withColumnRenamed("id", "place")).count() == 0
