"""Byte-pair encoding against the public library."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threatlake.llm.bpe import Encoder, Lexicon, Merges, build_transducer, encode_documents
from threatlake.llm.pretokens import Splitter

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MERGES, LIBRARY = Merges(WORDS), Tokenizer.from_file(WORDS)
TEXTS = st.text(alphabet=st.sampled_from(list("abeshtrvlmd '’’SRE1٣½ⅧΣσßéÉ中😀́\n\t\x1c\x85　.!,<|>")), max_size=60)


def _library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_as_the_library(text):
    assert Encoder(MERGES, None).encode([text, text + "x"]) == [_library(text), _library(text + "x")]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_split_with_spaces(text):
    library = Tokenizer.from_file(BYTES)
    words = Splitter(spaced=True).split([text, "next"])
    own = [words.bytes_of(k).decode() for k in range(len(words.hashes)) if words.text[k] == 0]
    assert "".join(own) == text
    assert own == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=6), max_size=40))
def test_transducer_numbers_words_in_order(words):
    words = sorted(w.encode() for w in words)
    t = build_transducer(words)

    def number(word):
        state, total = int(t["root"][0]), 0
        for c in word:
            at = [k for k, key in enumerate(t["keys"].tolist()) if key == state << 8 | c]
            if not at:
                return None
            state, total = int(t["to"][at[0]]), total + int(t["out"][at[0]])
        return total if t["final"][state] else None

    assert [number(w) for w in words] == list(range(len(words)))
    assert number(b"abcabcabc") is None


def test_lexicon_changes_nothing(tmp_path):
    texts = ["the unseenword and the seen one", "!!! don't <|endoftext|> x" + "q" * 500]
    Lexicon.write(f"{tmp_path}/l.fst", [b"the", b"seen", b"don", b"and"], MERGES)
    assert Encoder(MERGES, Lexicon(f"{tmp_path}/l.fst")).encode(texts) == [_library(t) for t in texts]


def test_documents(odd_docs, odd_rows, no_docs):
    found = sorted(map(str, (tuple(r) for r in encode_documents(odd_docs, WORDS).collect())))
    assert found == sorted(str((i, *_library(t or ""))) for i, t, _ in odd_rows)
    assert encode_documents(no_docs, WORDS).count() == 0
