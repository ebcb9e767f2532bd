import numpy as np
import public_tokenizers
import pyarrow as pa

from scoreline.llm import tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_words_of_the_same_pieces_are_encoded_once(monkeypatch):
    """Words that differ by case and marks alone bring no pieces of their own, and have the ids of encoding them whole."""
    monkeypatch.setattr(tokens, "_cache", {})
    words = [w.encode() for w in ("étude", "Étude.", "ÉTUDE,", "(étude)", "x'd", "X'd9", "!'s", "'sS", "ªx", "x²", "İs", "ét", "a<|endoftext|>b", "×÷", "ÿß")]
    known = tokens.word_ids(TOKENIZER)(words)
    for w in words:
        assert np.frombuffer(known[w], "<u4").tolist() == whole(w.decode()), w
    pieces = tokens._cache[(TOKENIZER,)][2]
    assert sum(p == "étude" for p in pieces) == 1 and not any("." in p and len(p) > 1 for p in pieces) and "ÉTUDE," not in pieces


def test_ids_of_texts_at_every_kind_of_white_space():
    rows = [" a\x0bB\x0cc\r\nd\t", None, "", "  ", "A\x1cC x y", "one"]
    piece = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["cut off", *rows]}).slice(1)
    found = tokens.ids_of(piece, tokens.word_ids(TOKENIZER))
    assert [x.tolist() for x in found] == [whole(t) for t in rows]
