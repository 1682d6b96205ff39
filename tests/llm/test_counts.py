import random

import numpy as np
import pytest
import sentencepiece
from conftest import by_text

from supplylens.llm import transducer
from supplylens.llm.tokens import default_path

MODEL = default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def counts(library, texts):
    return [len(x) for x in library.encode([t or "" for t in texts], num_threads=1)]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pools = [list("abcdefgh et"), list(map(chr, range(128))), list(map(chr, range(0x80, 0x3000))), ["▁", " ", "  ", "\n", "<s>", "</s>", "<unk>", "<0x41>", "😀", "\x00", "the ", "ing", "1", "中"], list(map(chr, range(0x4E00, 0x9FFF, 7)))]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def long_texts():
    """Stretches without a place where the state is known, with and without a period."""
    rng = random.Random(2)
    runs = ["x" * 3001, "ab" * 1500, "a" * 20_007, "=-" * 2000, "the" * 1500, "." * 5003, " " * 3000, "1" * 900, "中" * 900]
    return [*runs, "".join(rng.choice("abcdef") for _ in range(20_000)), "word " + "y" * 2000 + " word", "".join(runs)]


def test_counts_match_the_library(texts, library):
    compiled = transducer.Transducer(MODEL)
    some = [*texts, *random_texts(4000), *long_texts()]
    assert compiled.count(some) == counts(library, some)


def test_small_tables_and_chunks_give_the_same(monkeypatch, library):
    """Clearing the compiled states, short chunks and guesses from a single character change nothing."""
    for name, value in {"CHUNK": 5, "WARM": 1, "AT_ONCE": 400, "KEPT_STATES": 50, "GUESSES": 1}.items():
        monkeypatch.setattr(transducer, name, value)
    some = [*random_texts(150, 3), "ab" * 90, "x" * 77, "the quick brown fox " * 9]
    assert transducer.Transducer(MODEL).count(some) == counts(library, some)


def test_maps_compose_when_all_guesses_fail(monkeypatch, library):
    monkeypatch.setattr(transducer, "CHUNK", 7)
    monkeypatch.setattr(transducer, "WARM", 3)
    rng = random.Random(9)
    some = ["".join(rng.choice("aeinst") for _ in range(700)), "e" * 501, "in" * 333]
    assert transducer.Transducer(MODEL).count(some) == counts(library, some)


def test_transitions_hold_what_is_put_in():
    table, want = transducer.Transitions(bits=3), {}
    rng = np.random.default_rng(1)
    for _ in range(30):
        keys = np.setdiff1d(rng.integers(0, 5000, 40), np.array(list(want), np.int64))
        table.add(keys, keys % 97, keys % 5)
        want |= {int(k): (int(k) % 97, int(k) % 5) for k in keys}
    asked = np.arange(5000)
    slots = table.find(asked)
    assert {int(k) for k in asked[slots >= 0]} == set(want)
    assert all((table.to[s], table.gain[s]) == want[int(k)] for k, s in zip(asked, slots, strict=True) if s >= 0)


def test_query(spark, sf, docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 4096) for r, n in zip(rows, counts(library, [r["text"] for r in rows]), strict=True)]
    df = transducer.query(spark, sf)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert by_text(tuple(r) for r in df.collect()) == by_text(want) and any(w[3] for w in want)


def test_clashing_names_and_empty_tables(spark, empty, library):
    df = spark.createDataFrame([("a b", 1, 2), (None, 3, 4)], "n_tokens string, n_bytes int, id int")
    got = transducer.count_tokens(df, id_col="n_bytes", text_col="n_tokens", limit=1).toPandas()
    assert sorted(got.iloc[:, 0]) == [1, 3] and sorted(got["over_limit"]) == [False, True]
    assert transducer.count_tokens(empty).count() == 0


def test_other_models_are_turned_down(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as spec

    model = spec.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="made for BPE"):
        transducer.Transducer(str(tmp_path / "m.model"))
