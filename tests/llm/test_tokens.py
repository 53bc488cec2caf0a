import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findery.llm import bpe, tokenfile

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [
    "'s", "'", "a", "aa", "THE", " the", "  ", "\n", " \n", "\n ", "é", "ß", "Σ", "İ", "1", "½", "!!", "...", "<|endoftext|>", "<|startoftext|>", "<|end", "\t", "\xa0", " ",
    "\x1c", "中文", "한국어", "😀", "é", "՘", "Ᲊ", "२", "_", "\x00", "​", "Å", "ſ", "thanedble",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=25))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path, parts):
    text = "".join(parts)
    library = Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    for speculate in (True, False):
        own = bpe.codec(path, 4, speculate)
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == ids
    if path == BYTE:
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "!" * 777, "ab" * 2000, "\n" * 50 + "x", "é" * 400])
def test_long_runs(text):
    for path in (BYTE, WORD):
        assert np.frombuffer(bpe.codec(path).encode_batch([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_a_full_cache_changes_nothing():
    r = random.Random(0)
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    assert bpe.Codec(BYTE, cache=50).encode_batch(texts) == bpe.codec(BYTE).encode_batch(texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_are_proposed_together_as_one_by_one(path, monkeypatch):
    r, table = random.Random(2), bpe.MergeTable(path)
    tokens, end = sorted(table._greedy), bpe.WORD_END if table.word_end else b""
    words = [b"".join(r.choice(tokens).replace(bpe.WORD_END, b"") for _ in range(r.randint(0, 5))) + end for _ in range(3000)]
    words += [bytes(r.randrange(256) for _ in range(r.randint(1, 20))) for _ in range(300)] + [b"a" * n for n in (1, 255, 256, 257, 400)] + [b""]
    monkeypatch.setattr(bpe, "TOGETHER", 3000)
    ids, sizes = table._propose(words)
    ends = np.cumsum(sizes)
    assert [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)] == [table._propose_long(w) or [] for w in words]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_with_white_space_are_not_kept(path):
    own, library = bpe.Codec(path), Tokenizer.from_file(path)
    texts = ["oder.\nDie oder", "oder.\nDie  a\tb", "a \tb oder\n c", "\x85oder\x85 oder\u2009die ", None, "oder.\nDie \n"]
    for _ in range(2):
        ids = own.encode_batch(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert not any(bpe.re.search(r"\s", c) for c in own._chunks)
    own.forget()
    assert not own._chunks and own.encode_batch(texts) == ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_word_is_merged_once_whatever_stands_around_it(path):
    own, merged = bpe.Codec(path, 2, False), []
    encode = own._encode_words
    own._encode_words = lambda words, dtype: merged.extend(words) or encode(words, dtype)
    texts = ["a thanedble oder, thanedble. oder!", "a (thanedble) oder;oder 12thanedble's", "", None, "a thanedble\x85oder \u4e2d\u6587 oder\u2009thanedble \x1foder"]
    ids = [x for t in texts[:4] for x in own.encode_batch([t])]
    plain = [w for w in merged if w.strip(b" \xff").isalpha() and (path == WORD or w[:1] == b" ")]  # a text's first word has no space before it
    assert plain and len(plain) == len(set(plain))
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u2").tolist() for x in [*ids, *own.encode_batch(texts[4:])]] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_compatible_pairs_are_those_that_merging_keeps():
    table, r = bpe.codec(BYTE).table, random.Random(1)
    tokens = [table.bytes_of[i] for i in range(256, 50_000) if table.bytes_of[i] in table._greedy]
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(3000)]
    ids = np.array([[table._greedy[a], table._greedy[b]] for a, b in pairs])
    apart = table.compatible(ids[:, 0], ids[:, 1])
    for (a, b), pair, ok in zip(pairs, ids.tolist(), apart.tolist(), strict=True):
        assert (table.merge_exactly(a + b) == pair) == ok


def test_round_trip_over_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTE)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())

    want = sorted((str(r.doc_id), *expected(r.text)) for r in odd.collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(odd, BYTE).collect()) == want
    assert bpe.round_trip(empty, BYTE).count() == 0
    tokens = bpe.encode(odd, BYTE)
    assert {(str(r.doc_id), r.text) for r in bpe.decode(tokens, BYTE).collect()} == {(str(r.doc_id), r.text or "") for r in odd.collect()}


@settings(deadline=None)
@given(st.integers(1, 32), st.integers(0, 200), st.integers(0, 2**31))
def test_packing(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64).astype("<u4")
    data = tokenfile.pack(ids, bits)
    assert len(data) == (n * bits + 7) // 8 and tokenfile.unpack(data, n, bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [11, 16])
def test_files_are_read_by_document(bits):
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    rng = np.random.default_rng(0)
    docs = [(k if k != 3 else None, rng.integers(0, 2**bits, n).astype("<u4")) for k, n in enumerate([5, 0, 70_000, 1, 200_000, 3])]
    writer = tokenfile.TokenFileWriter(out := Sink(), bits)
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    f = tokenfile.TokenFile(pa.BufferReader(out.kept))
    at = 0
    for k, ((key, ids), (got_key, start, got)) in enumerate(zip(docs, f.documents(), strict=True)):
        assert (key, at) == (got_key, start) and got.tolist() == ids.tolist() == f.document(k).tolist()
        at += len(ids)


def test_a_doc_id_with_most_rows_is_dealt_out_and_order_stays():
    keys = np.array([1, 2, 3] + [7] * 90 + [8, 9, 10])
    bounds = np.sort(keys)[np.linspace(0, len(keys) - 1, 9).astype(int)[1:-1]]
    parts = tokenfile._parts_of(keys, bounds, 5)
    assert max(np.bincount(parts)) < 30 and all(parts[a] <= parts[b] for a in range(len(keys)) for b in range(len(keys)) if keys[a] < keys[b])


def test_token_files_over_odd_rows(spark, odd, empty, tmp_path):
    tokenfile.write_tokens(odd, str(tmp_path / "t"), WORD)
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(WORD), 0
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    want = sorted((str(r.doc_id), tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    tokenfile.write_tokens(empty, str(tmp_path / "e"), WORD)
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).count() == 0
