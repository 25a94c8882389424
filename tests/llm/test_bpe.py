from array import array
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curatrix.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def both():
    return bpe.WordBpe(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text(alphabet=st.sampled_from(list("aAbéÉé \n\t'sSdD019Σσİß漢。!?,.\"-\x1c\x85\xa0😀")), max_size=40) | st.text(max_size=30))
def test_any_text_as_the_library_does(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    own, lib = bpe.load(PATH), _lib()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert array("I", own.encode(text)).tolist() == ids
    assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False)


def _lib(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(PATH))
    return kept[0]


def test_scan_and_heap_agree(both):
    own, _ = both
    for word in ("a", "banana" * 15, "abcabcab" * 10, "zq" * 50):
        ids = [own.start[c] for c in word]
        assert own._by_scan([*ids]) == own._by_heap([*ids])


def test_special_tokens(both):
    own, lib = both
    for t in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext", "é<|endoftext|>́"):
        assert array("I", own.encode(t)).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_memo_overflow_does_not_change_ids(both, monkeypatch):
    _, lib = both
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.WordBpe(PATH)
    for t in ("one two three four, five six. seven eight nine ten", "one two three"):
        assert array("I", own.encode(t)).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_query_rows(docs, rows, no_docs, both):
    _, lib = both
    found = {}
    for r in bpe.encode_decode(docs, PATH).collect():
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    want = {}
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.setdefault(r[0], []).append((len(ids), sha256(array("I", ids).tobytes()).hexdigest(), sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.encode_decode(no_docs, PATH).count() == 0
