import hashlib
import random

import numpy as np
import pytest
from odd_tables import ROWS, documents

from salmoura.llm import bpe
from salmoura.llm.entries import word_vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def mine():
    with open(word_vocabulary(), encoding="utf-8") as file:
        return bpe.Tokenizer(file.read())


def texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz'0123 éßñ🎉.,!-"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    return made + [
        "", "ΑΣΣ ΟΔΟΣ", "İstanbul ǅ", "é café <|endoftext|> x<|startoftext|>y", "a\x1cb\x1fc\x85d​e",
        "it's we've I'LL don't''''s", "½²Ⅷ٣ 123", "日本語 🎉👩‍👩‍👧", "a" * 3000, "ab" * 2000, "ẛ̣ Å ﬁ", "<|endoftext|", "\x00\x01",
    ]


def test_ids_and_text_equal_the_library(mine, library):
    for text in texts():
        expected = library.encode(text, add_special_tokens=False).ids
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert mine.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(mine, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    for text in texts()[:200]:
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, library):
    df = documents(spark)
    found = sorted(bpe.encoded(df, word_vocabulary()).collect(), key=str)
    assert len(found) == len(ROWS)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for doc_id, text, *_ in ROWS:
        if doc_id is None:
            continue
        expected = library.encode(text or "", add_special_tokens=False).ids
        row = by_id[doc_id]
        assert (row["ids"], row["n_tokens"]) == (expected, len(expected))
        assert row["ids_sha256"] == hashlib.sha256(np.asarray(expected, "<u4").tobytes()).hexdigest()
        decoded = library.decode(expected, skip_special_tokens=False) if expected else ""
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encoded(df.limit(0), word_vocabulary()).count() == 0
