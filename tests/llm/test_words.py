"""Texts made to break word hashes, memory bounds and parsers."""

import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threatlake.llm import pretokens, shingles, token_files
from threatlake.llm.bpe import Encoder, Merges
from threatlake.llm.html_tree import blocks, parse
from threatlake.llm.ngram_join import ngram_components
from threatlake.llm.pretokens import Splitter, Words
from threatlake.llm.shingles import Shingler
from threatlake.llm.token_files import LibraryEncoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
MERGES, LIBRARY, BYTE_LIBRARY = Merges(WORDS), Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
ENCODER = LibraryEncoder(BYTES, 0)
#: Two words that every polynomial hash modulo 2^64 takes for one.
THUE_MORSE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
MIRROR = THUE_MORSE.translate(str.maketrans("ab", "ba"))
TEXTS = st.text(alphabet=st.sampled_from(list("abst '’S1éÉ中😀\n\t\x1c　.!<")), max_size=60)


def _in_words(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def _in_bytes(text):
    return [*BYTE_LIBRARY.encode(text, add_special_tokens=False).ids, 0]


def test_hashes_of_thue_morse_words(spark):
    texts = [THUE_MORSE, MIRROR, f"x {MIRROR} {THUE_MORSE}"]
    assert Encoder(MERGES, None).encode(texts) == [_in_words(t) for t in texts]
    assert [x.tolist() for x in LibraryEncoder(BYTES, 0).encode(texts)] == [_in_bytes(t) for t in texts]
    df = spark.createDataFrame([(1, " ".join([THUE_MORSE] * 6)), (2, " ".join([MIRROR] * 6)), (3, " ".join([THUE_MORSE] * 7))], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_words_of_one_hash(monkeypatch):
    """With a hash that tells nothing, bytes do."""
    monkeypatch.setattr(pretokens, "mixed", lambda points, places: np.zeros(len(points), np.uint64))
    texts = ["one two  one\nthree", "two one", "", "three three' s's"]
    assert Encoder(MERGES, None).encode(texts) == [_in_words(t) for t in texts]
    encoder = LibraryEncoder(BYTES, 0)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [_in_bytes(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_bytes_as_the_library(text):
    assert [x.tolist() for x in ENCODER.encode([text, "\n\n x", text + "<|endoftext|>", text])] == [_in_bytes(t) for t in (text, "\n\n x", text + "<|endoftext|>", text)]


def test_forgetful_memory(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 6)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 2)
    encoder = LibraryEncoder(BYTES, 0)
    for k in range(12):
        texts = [f"the word{k} and word{k - 3}\n the\tlast", f" {k}"]
        assert [x.tolist() for x in encoder.encode(texts)] == [_in_bytes(t) for t in texts]
        assert len(encoder.memory.used) <= 6 + 12


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_long_texts_in_pieces(text):
    """Cut after a few characters, the words are the same."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pretokens, "BATCH_POINTS", 4)
        patch.setattr(shingles, "BATCH_BYTES", 5)
        patch.setattr(token_files, "ENCODE_POINTS", 4)
        assert "".join(pretokens.pieces(text)) == text
        assert Encoder(MERGES, None).encode([text, "", text]) == [_in_words(t) for t in (text, "", text)]
        assert [x.tolist() for x in ENCODER.encode([text, "", text])] == [_in_bytes(t) for t in (text, "", text)]
        cut = [x.tolist() for x in Shingler(3).sets([text, "a b c", text])]
    assert cut == [x.tolist() for x in Shingler(3).sets([text, "a b c", text])]


def test_pieces_are_bounded():
    text = "some words of a text, and more. " * 200_000
    assert max(map(len, pretokens.pieces(text))) < pretokens.BATCH_POINTS + 100
    rows = Shingler(5).sets([text])[0]
    assert len(rows) == 7 and rows.tolist() == Shingler(5).sets([text[:32 * 30]])[0].tolist()


def test_same_compares_bytes():
    words = Splitter(spaced=False).split(["abc abd abc ab abcd"])
    other = Words(words.hashes[2:3], words.first[2:3], words.last[2:3], words.text[2:3], words.data)
    assert words.same(np.arange(5), np.zeros(5, int), other).tolist() == [True, False, True, False, False]


@pytest.mark.parametrize("html", ["<p>x<![foo bar]> y</p>", "<p>x<![foo bar", "<p>x<![if IE]>y<![endif]></p>", "<p>x<![CDATA[z]]>y</p>", "<!x><!-- x --!><p>x</p><![", "<p>x</p></>< <a <b"])
def test_declarations(html):
    assert "x" in " ".join(b.text for b in blocks(parse(html)))


def test_unclosed_elements_cost_linear_time():
    def seconds(n):
        began = time.perf_counter()
        nodes = parse("<i>" * n + "<section>x" * n)
        assert len(nodes) == 2 * n + 1
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(2_000), 0.005)
