import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
from gaugewell.llm.bpe import CUTS, Encoding, vocabulary  # noqa: E402
from gaugewell.llm.tokens import BYTE_BPE_50K, encode_texts  # noqa: E402

ODD = [
    "", " ", "\n\n  x", "it's I'll 'tis", "<|endoftext|> a", "x" * 5000, "=" * 700, " " * 300 + "a", "a b  c", "½ ² Ⅷ ٣٤ 五 ㊀x",
    "日本語のテキスト。", "é ‍👩‍👩‍👧 🇫🇷", "\r\n\r\n\tfoo  bar\x1b[31m", "aB3+/9xQ" * 200, "\x00\x1c \x1f.\x85 z", "_a_ __init__ a_b1", "don’t", "﻿#", "ſ's 'S 'RE",
]


@pytest.fixture(scope="module")
def exact():
    v = vocabulary(BYTE_BPE_50K)
    return tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary


def test_same_ids_as_the_library(exact):
    v = vocabulary(BYTE_BPE_50K)
    for text in ODD:
        assert v.encode(text).tolist() == exact(text), text
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(ODD)[:40] + rng.choice(" \n\tabcé9_'½") for _ in range(rng.randint(1, 9)))
        assert v.encode(text).tolist() == exact(text), text
        assert v.decode(v.encode(text)) == text.encode()


def test_every_prefix_is_stored(exact):
    v = vocabulary(BYTE_BPE_50K)
    word = "internationalisations" * 3
    last = v.ends(word.encode())
    for n in range(1, len(word) + 1):
        assert v.walk(last[:n]) == exact(word[:n])


def test_appends_and_edits_are_exact(exact):
    v, rng = vocabulary(BYTE_BPE_50K), random.Random(9)
    e = Encoding(v, "The quick brown fox, 12 foxes\n  and   more words here ")
    text = "".join(e.pieces)
    for _ in range(300):
        at, removed = rng.randint(0, len(text)), rng.choice([0, 0, 1, 3, 9])
        new = "".join(rng.choice("ab c\n'1é. ") for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.3:
            e.append(new)
            text += new
        else:
            e.edit(at, removed, new)
            text = text[:at] + new + text[at + removed :]
        assert "".join(e.pieces) == text
        assert e.ids() == exact(text), text


def test_an_edit_does_not_encode_the_rest_again():
    e = Encoding(vocabulary(BYTE_BPE_50K), "some words in a row " * 2000)
    done = e.work
    e.edit(20_000, 1, "X")
    assert e.work - done < 60


def test_rows(spark, exact):
    rows = [(1, None, 7), (2, "", 7), (None, "a b", 7), (4, "é" * 9000, 7), (4, "é" * 9000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")  # a column with the result's name
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_texts(df).collect()), key=str)
    assert got == sorted([(i, exact(t) if t else []) for i, t, _ in rows], key=str)
    assert encode_texts(df.limit(0)).collect() == []
