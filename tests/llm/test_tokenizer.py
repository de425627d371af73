"""p8: against the public library, round trips, and the defined results of odd texts."""

import random

import numpy as np

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ohmgrid.llm import tokenizer as tk

ODD = [
    "'s 'sfoo don't  'll\n's \n 's ''s we're x'vey", "  a   \n\n b \t c\r\nd  ", "½ ² Ⅷ ٣ abc١٢ é́ 日本語 　 x y z\x85 q\u200bw \x1c a", "", "   ",
    "<|endoftext|> x", "a'", " '", "'", "'s", " 's", "\u180e \ufeff x 🙂🙂 '🙂", "\n", "\u2028\u2029 'd", "A" * 5000, "ab " * 5000,
]


@pytest.fixture(scope="module")
def own():
    with open(tk.VOCABULARY, "rb") as f:
        return tk.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encode(own, texts):
    ids, counts = own.texts(pa.array(texts, pa.string()))
    ends = counts.cumsum().tolist()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts.tolist())]


def expect(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(own, library):
    assert encode(own, ODD) == expect(library, ODD)


def test_random_mixtures(own, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab'stdrevml  \n\t1٢é.,-🙂\u00a0") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert encode(own, texts) == expect(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=30), min_size=1, max_size=5))
def test_any_text_round_trips(own, texts):
    order = {v: k for k, v in own.ranks.items()}
    assert [b"".join(order[i] for i in ids).decode() for ids in encode(own, texts)] == texts


def plain_merges(own, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((own.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [own.ranks[p] for p in parts]


def test_pair_merging_is_the_plain_process(own):
    rng = random.Random(5)
    pieces = [b" the", b" threshold", "µΩ".encode(), b"aaaaaaaaa", b"\xff\xfe"] + [bytes(rng.choice(b"abcest ion012\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for piece in pieces:
        assert own.merge_pairs(piece) == plain_merges(own, piece)
    assert len(own.merge_pairs(b"ab" * 100_000)) > 1000  # in seconds, not in hours


def test_scan_equals_the_states_one_after_another():
    rng = np.random.default_rng(6)
    to, _ = tk.automaton()
    for n in (1, 255, 256, 257, 5000, 70_001):
        symbols = rng.integers(0, 2 * tk.FRESH, n).astype(np.uint8)
        state, want = tk.BEHIND, []
        for s in symbols.tolist():
            want.append(state)
            state = to[s, state]
        assert tk.states(symbols).tolist() == want


def test_long_text_is_whole(own, library, monkeypatch):
    monkeypatch.setattr(tk, "PART", 1000)
    text = " ".join(f"word{i} 12.{i}\n'll" for i in range(2000))
    assert encode(own, [text, "x", text]) == expect(library, [text, "x", text])


def test_cache_is_bounded(own, monkeypatch):
    monkeypatch.setattr(tk, "CACHE", 10)
    texts = [f"alpha{i} beta{i}" for i in range(200)]
    first = encode(own, texts)
    assert len(own.cache) <= 10 and first == encode(own, texts)


def test_spark_nulls_repeats_clash_and_empty(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "  ", 5), (4, "ok", 5), (4, "ok", 5), (None, "ok", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in tk.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, [220, 220]), (4, [482]), (4, [482]), (None, [482])], key=str)
    assert tk.encode(df.limit(0)).count() == 0
    assert {(r.doc_id, r.restored) for r in tk.round_trip(df).collect()} == {(1, True), (2, True), (3, True), (4, True), (None, True)}
    assert sorted(r.n_tokens for r in tk.count_tokens(df.select("doc_id", "text")).collect()) == [0, 0, 1, 1, 1, 2]


def test_offsets_cut_the_text_into_its_tokens(spark, own):
    texts = {1: "a µΩ 12.5'll  \n🙂", 2: "", 3: None, 4: "x"}
    got = {r.doc_id: r for r in tk.encode_with_offsets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    data, start, length = own.token_bytes()
    for k, t in texts.items():
        raw, begins = (t or "").encode(), [0, *got[k].ends[:-1]]
        assert [raw[i:j] for i, j in zip(begins, got[k].ends)] == [data[start[x] : start[x] + length[x]].tobytes() for x in got[k].ids]
        assert not raw or got[k].ends[-1] == len(raw)


def test_whole_smallest_table(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in tk.encode(df).collect()} == want
