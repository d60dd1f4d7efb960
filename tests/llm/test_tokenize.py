import random

import pytest
from tokenizers import Tokenizer

from calorgrid.llm import tokenize as T


@pytest.fixture(scope="module")
def enc():
    return T.Encoder(T.default_path(), T.default_pattern())


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(T.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(4)
    parts = ["thermal", " pixel", "  ", "\n\n", "溫差約為", "ß", "émissivité", "123456789", "'ll", "<|endoftext|>", "​", "🙂", "aaaaaaaa", "\t", "x" * 30, "...", "—", " ", "DJI_2024", "مرجع"]
    out = ["", " ", "a", "<|endoftext|>", "a" * 3000, "ab" * 2000, "溫" * 2000, " " * 500, "\n" * 100 + "x", "".join(chr(c) for c in range(1, 0x250))]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(200)) for _ in range(30)]


def test_ids_equal_the_library(enc, truth):
    for t in texts():
        assert enc.encode(t) == truth(t), t[:50]


def test_last_tokens_are_those_of_every_prefix(enc, truth):
    data = "unbelievablythermalpixels"
    last = [0]
    enc.vocabulary.extend(data.encode(), last)
    for k in range(1, len(data) + 1):
        assert last[k] == truth(data[:k])[-1]
        assert enc.vocabulary.read(last[: k + 1]) == truth(data[:k])


def test_tables_grow_by_appending_bytes(enc, truth):
    data = ("hyperspectral" * 40).encode()
    last = [0]
    for k in range(0, len(data), 7):
        enc.vocabulary.extend(data[: k + 7], last)
    assert enc.vocabulary.read(last) == truth(data.decode())


def test_appends_and_edits_are_exact(enc, truth):
    rng = random.Random(8)
    pool = [t for t in texts() if t and len(t) < 400]
    for _ in range(25):
        table, text = T.PrefixTable(enc), ""
        for _ in range(12):
            new = rng.choice(pool)[: rng.randrange(1, 40)]
            if rng.random() < 0.5 or not text:
                table.append(new)
                text += new
            else:
                a = rng.randrange(len(text) + 1)
                b = min(len(text), a + rng.randrange(10))
                table.edit(a, b, new)
                text = text[:a] + new + text[b:]
            assert table.text == text and table.ids == truth(text)


def test_changes_touch_only_what_lies_near(enc, truth):
    long = T.PrefixTable(enc, "x" * 9000)
    before = long.touched
    long.append("y")
    assert long.touched == before + 1 and long.ids == truth("x" * 9000 + "y")
    text = " word" * 6000
    many = T.PrefixTable(enc, text)
    before = many.touched
    many.edit(10, 11, "q")
    many.edit(15_002, 15_003, "")
    assert many.touched - before < 60
    text = text[:10] + "q" + text[11:]
    assert many.ids == truth(text[:15_002] + text[15_003:])


def test_white_space_at_the_border_of_a_change(enc, truth):
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "1", "'s", "!", "ß", "溫"]) for _ in range(rng.randrange(1, 14)))
        table = T.PrefixTable(enc, text)
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(3))
        new = rng.choice(["", " ", "a", "  ", "\n", "s"])
        table.edit(a, b, new)
        assert table.ids == truth(text[:a] + new + text[b:])


def test_frame_with_nulls_repeats_and_clashing_names(spark, truth):
    rows = [(1, "a  b", "k", 1), (2, "", "k", 2), (3, None, "k", 3), (None, "x", "k", 4), (1, "a  b", "k", 1), (9, "long " * 50_000, "k", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in T.token_ids(df, "doc_id", "text").collect()), key=lambda x: x[0])
    assert got == sorted(((i or 0, truth(t or "")) for i, t, *_ in rows), key=lambda x: x[0])
    assert T.token_ids(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    counts = {r["doc_id"]: r["n"] for r in T.token_counts(df, "doc_id", "text").collect()}
    assert counts[2] == counts[3] == 0 and counts[9] == len(truth("long " * 50_000))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_ids(df, "doc_id", "text").count() == 0
