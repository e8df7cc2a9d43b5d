import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from readloom.llm import bpe, token_counts, token_store
from readloom.llm.common import pack, unpack

MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def reference(path=bpe.VOCABULARY, pattern=bpe.PATTERN):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lists(v, texts):
    ids, counts = v.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@pytest.mark.parametrize("path", [bpe.VOCABULARY, MULTI])
def test_encode_equals_the_library(path):
    random.seed(3)
    letters = "ab's tmdrevl 'S  \n\t\r12é ß.,!?#'''x    \u0085\x1c中文ñÀ²½_—😀́\x00"
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(5000)]
    texts += ["", "'s", "it're've'll'd'm 't", " " * 9, "a" * 3000, "ab" * 1500, "''s", "\n's", "!" * 900, "word word", "x'"]
    want = reference(path)
    assert lists(bpe.vocabulary(path), texts) == [want.encode_ordinary(t) for t in texts]


def test_another_pattern_and_forgetting(monkeypatch):
    pattern = r"\p{L}+|[^\p{L}]"
    v = bpe.Vocabulary(open(bpe.VOCABULARY, "rb").read(), pattern)
    monkeypatch.setattr(bpe, "KEPT", 50)
    want = reference(pattern=pattern)
    for k in range(5):
        texts = [" ".join(f"blorft{chr(97 + i)}{chr(97 + (i * k) % 26)}x" for i in range(20)) for _ in range(2)]
        assert lists(v, texts) == [want.encode_ordinary(t) for t in texts]


def test_words_with_one_hash(monkeypatch):
    real = bpe.byte_hashes
    monkeypatch.setattr(bpe, "byte_hashes", lambda *a, **k: real(*a, **k) & np.uint64(255))
    v = bpe.Vocabulary(open(bpe.VOCABULARY, "rb").read())
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcdefghij", k=random.randint(1, 30))) for _ in range(9)) for _ in range(100)]
    want = [reference().encode_ordinary(t) for t in texts]
    assert lists(v, texts) == want and lists(v, texts[::-1]) == want[::-1]


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_words_made_to_collide(spark, length):
    one = "a"
    while len(one) < length:
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba")), one]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    assert [r.decoded for r in bpe.encode(df, decoded=True).orderBy("doc_id").collect()] == texts
    ids = [reference().encode_ordinary(t) for t in texts]
    assert [r.n_tokens for r in token_counts.token_counts(df).orderBy("doc_id").collect()] == [len(i) for i in ids]
    got = rebuilt(token_store.read_blocks(token_store.token_blocks(df)).collect())
    assert [list(got[k][0]) for k in range(3)] == ids


def test_long_words():
    random.seed(1)
    texts = ["".join(random.choices(letters, k=n)) for letters, n in (("etaoin", 20_000), ("ab", 9_000), ("é中", 4_000), ("-=", 5_000))]
    assert lists(bpe.vocabulary(), texts) == [reference().encode_ordinary(t) for t in texts]
    assert bpe.vocabulary().decode(*bpe.vocabulary().encode(pa.array(["".join(random.choices("etaoinshrdlu", k=300_000))])))[1].tolist() == [300_000]


def test_queries_over_documents(spark, docs):
    want = reference()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.query(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys() == counts.keys()
    for k, text in texts.items():
        ids = want.encode_ordinary(text)
        assert list(got[k].token_ids) == ids and got[k].decoded == text and counts[k] == len(ids)


def test_odd_rows(odd, none):
    texts = [r.text for r in odd.collect()]
    want = reference()
    for row, text in zip(bpe.encode(odd, decoded=True).collect(), texts):
        assert row.decoded == text and (row.token_ids is None if text is None else list(row.token_ids) == want.encode_ordinary(text))
    for row, text in zip(token_counts.token_counts(odd).collect(), texts):
        assert row.n_tokens == (None if text is None else len(want.encode_ordinary(text)))
    assert bpe.encode(none).columns == ["doc_id", "token_ids"]
    assert not bpe.encode(none).collect() and not token_counts.token_counts(none).collect()


def test_decode(spark, odd):
    back = bpe.decode(bpe.encode(odd)).collect()
    assert [r.text for r in back] == [r.text for r in odd.collect()]
    broken = spark.createDataFrame([(1, [1 << 20])], "doc_id bigint, token_ids array<int>")
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(broken).collect()


def test_pack():
    for top in (0, 200, 60000, 1 << 31, 1 << 40):
        values = np.array([0, 1, top])
        assert unpack(pack(values)).tolist() == values.tolist()


@pytest.mark.parametrize("sizes", [[0], [1], [31, 32, 33], [token_store.BLOCK, 5, 20000]])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(1)
    blocks = [np.minimum(rng.zipf(1.3, n) - 1, 70000) for n in sizes]
    counts = np.bincount(np.concatenate([*blocks, [0]]))
    freqs = token_store.scaled(counts)
    assert freqs.sum() == 1 << token_store.BITS and ((freqs > 0) == (counts > 0)).all()
    of = token_store.slots(freqs)
    for block, (payload, marks, sums, crc) in zip(blocks, token_store.encode_blocks(freqs, blocks)):
        assert token_store.decode_block(freqs, of, payload, marks, sums, len(block), crc).tolist() == block.tolist()
        if len(block) > 3 * token_store.STRIDE * token_store.LANES:  # from a checkpoint in the middle
            k, step = 2, token_store.STRIDE * token_store.LANES
            assert token_store.decode_stretches(freqs, of, payload, marks, sums, len(block), [k]).tolist() == block[k * step : (k + 1) * step].tolist()
            some = [len(sums) - 1, 0]
            assert token_store.decode_stretches(freqs, of, payload, marks, sums, len(block), some).tolist() == [*block[some[0] * step :].tolist(), *block[:step].tolist()]
            with pytest.raises(ValueError, match="checksum"):
                token_store.decode_block(freqs, of, b"\0" * 8 + payload[8:], marks, sums, len(block), crc)
            entropy = -(np.log2(counts[block] / counts.sum())).sum() / 8
            assert len(payload) < 1.02 * entropy + 1000


def rebuilt(pieces):
    out = {}
    for r in sorted(pieces, key=lambda r: r.start):
        out.setdefault(r.doc_id, []).append(r.token_ids)
    return out


def test_token_blocks_round_trip(spark, docs, odd, none):
    longer = docs.union(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), F.repeat("text", 30).alias("text"), "lang", "source", "n_chars"))
    want = {r.doc_id: list(r.token_ids) for r in bpe.encode(longer).collect()}
    got = rebuilt(token_store.read_blocks(token_store.token_blocks(longer)).collect())
    assert {k: sum(map(list, v), []) for k, v in got.items()} == want
    pieces = token_store.read_blocks(token_store.token_blocks(odd)).collect()
    assert sorted((str(r.doc_id), str(r.token_ids)) for r in pieces if r.doc_id not in (5, 6)) == sorted((str(r.doc_id), str(r.token_ids)) for r in bpe.encode(odd).collect() if r.doc_id not in (5, 6))
    assert [r.kind for r in token_store.token_blocks(none).collect()] == ["table"]


def test_token_blocks_query_against_the_library(spark, docs):
    want = reference()
    got = rebuilt(token_store.read_blocks(token_store.query(spark, "/root/testdata/sf0.001")).collect())
    assert {k: sum(map(list, v), []) for k, v in got.items()} == {r.doc_id: want.encode_ordinary(r.text) for r in docs.collect()}


def one_lane_at_a_time(freqs, payload, checkpoints, n):
    """The decoder as the textbook has it: a number at a time, from the first checkpoint."""
    total, starts = int(freqs.sum()), (np.cumsum(freqs) - freqs).tolist()
    states = [int.from_bytes(checkpoints[4 + 8 * k : 12 + 8 * k], "little") for k in range(token_store.LANES)]
    words, at, out = [int.from_bytes(payload[i : i + 4], "little") for i in range(0, len(payload), 4)], 0, []
    for i in range(n):
        k = i % token_store.LANES
        slot = states[k] % total
        symbol = max(j for j in range(len(freqs)) if freqs[j] and starts[j] <= slot)
        states[k] = int(freqs[symbol]) * (states[k] // total) + slot - starts[symbol]
        if states[k] < 1 << 31:
            states[k], at = states[k] << 32 | words[at], at + 1
        out.append(symbol)
    return out


def test_blocks_against_brute_force():
    rng = np.random.default_rng(8)
    block = np.minimum(rng.zipf(1.5, 1500) - 1, 40)
    freqs = token_store.scaled(np.bincount(block))
    payload, marks, _, _ = token_store.encode_blocks(freqs, [block])[0]
    assert one_lane_at_a_time(freqs, payload, marks, len(block)) == block.tolist()


def test_more_ids_than_slots():
    counts = np.ones((1 << token_store.BITS) + 5, np.int64)
    freqs = token_store.scaled(counts)
    assert freqs.min() >= 1 and freqs.sum() == 1 << (token_store.BITS + 1)
    block = np.array([0, len(counts) - 1, 7] * 50)
    payload, marks, sums, crc = token_store.encode_blocks(freqs, [block])[0]
    assert token_store.decode_block(freqs, token_store.slots(freqs), payload, marks, sums, len(block), crc).tolist() == block.tolist()


def test_string_ids_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "one two", 1, 2), (None, None, 3, 4), ("c", "", 5, 6)], "doc_id string, text string, ids int, doc_ids int")
    got = {r.doc_id: r.token_ids for r in token_store.read_blocks(token_store.token_blocks(df)).collect()}
    assert {k: None if v is None else list(v) for k, v in got.items()} == {"a": reference().encode_ordinary("one two"), None: None, "c": []}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {"a": 2, None: None, "c": 0}
    assert {r.doc_id for r in bpe.encode(df).collect()} == {"a", None, "c"}
