"""Words of ASCII letters are encoded by the model itself, all others by the library; ids are those of the plain call."""

import numpy as np

from songsieve.llm import rans
from songsieve.llm.queries import tokenizer_file

TEXTS = ["The River, of erst; a I\nlooking looking", "don't stop's  two  blanks é naïve 12ab ab12 Ünder\nx", "\nline\n\n lead", "", None, "word." * 3 + " Zz zZ\tq", "ſ K ﬁ xylophonically"]


def test_ids_equal_the_plain_call():
    tok = rans.Tokens(tokenizer_file("byte_bpe_50k.json"), "<u2", 0)
    for _ in range(2):  # learnt, then remembered
        got = [np.frombuffer(x, "<u2").tolist() for x in tok.batch(TEXTS)]
        assert got == [[*tok.lib.encode(x or "", add_special_tokens=False).ids, 0] for x in TEXTS]


def test_words_of_letters_pass_by_the_library():
    tok = rans.Tokens(tokenizer_file("byte_bpe_50k.json"), "<u2", 0)
    seen, lib = [], tok.lib

    class Spy:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return lib.encode_batch_fast(texts, **kw)

    tok.lib = Spy()
    tok.batch(["The River, of erst\nlooking 12ab"])
    assert not any(w in x for x in seen for w in ("River", "erst", "looking")) and any("12ab" in x for x in seen)


def test_letters_with_accents_pass_by_the_library_and_words_are_laid_side_by_side():
    tok = rans.Tokens(tokenizer_file("byte_bpe_50k.json"), "<u2", 0)
    seen, lib = [], tok.lib

    class Spy:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return lib.encode_batch_fast(texts, **kw)

    tok.lib = Spy()
    texts = ["Ação über, çà\nécole ação", None, "", "a\0b c", "über<|endoftext|> x"]
    got = tok.batch(texts)
    assert len(got) == len(texts)
    assert not any(w in x for x in seen for w in ("Ação", "école", "çà")) and "a\0b c" in seen
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*lib.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert len(tok.cells([])) == 0


def test_ids_of_random_texts_equal_the_plain_call(monkeypatch):
    rng = np.random.default_rng(4)
    parts = ["a", "É", "ß", "ſ", "ɐ", "ʰ", "中", "٣", "1", " ", " ", " ", "\n", "\n", "\t", "\r", " ", " ", "　", "\0", "'s", "'", ",", ".", "!", "$$", "é", "🎵", "ǅ", "ª", "-", "_", "don't", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)]
    monkeypatch.setattr(rans, "MEMO_WORDS", 500)  # forgets now and then
    for dtype in ("<u2", "<u4"):
        tok = rans.Tokens(tokenizer_file("byte_bpe_50k.json"), dtype, 0)
        wanted = [[*e.ids, 0] for e in tok.lib.encode_batch(texts, add_special_tokens=False)]
        for at in range(0, len(texts), 200):
            assert [np.frombuffer(x, dtype).tolist() for x in tok.batch(texts[at : at + 200])] == wanted[at : at + 200]
