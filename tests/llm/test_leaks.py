import random
import unicodedata

import regex

from gaugewell.llm.leaks import find_leaks, normalised, word_offsets, words_of


def plain_words(text):
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").lower()
    return regex.findall(r"[\p{L}\p{N}]+", text)


POOL = "Alpha beta, γάμμα ΣΊΣΥΦΟΣ ﬁne İstanbul été 日本語 ½ ｆｕｌｌ x­y don’t 12 a_b 한 ﷺ हिन्दी Ǆ \U0001f469‍\U0001f4bb".split(" ")


def test_words_and_their_places():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(POOL) + rng.choice([" ", "\n", "-", "", "́", "​"]) for _ in range(20))
        assert words_of(text) == plain_words(text)
        at = word_offsets(text)
        assert len(at) == len(words_of(text))
        for (a, b), w in zip(at, words_of(text)):
            assert w in normalised(text[a:b]).replace("ς", "σ") or w.replace("ς", "σ") in normalised(text[a:b]).replace("ς", "σ")


def shares(a, b, n):
    grams = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
    return any(tuple(b[i : i + n]) in grams for i in range(len(b) - n + 1))


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)] + ["Γ", "½", "é"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 11, 12, 13, 40]))), None if i % 2 else " ".join(rng.choices(vocab, k=14)), "x") for i in range(40)]
    items += [(0, items[0][1], items[0][2], "x"), (77, None, None, "x"), (78, "", "", "x")]
    docs = [(None, None, 1), (1, "", 1)]
    for d in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        if d % 2:
            source = items[rng.randrange(40)][1].split()
            a = rng.randrange(len(source))
            words[5:5] = source[a : a + rng.randint(10, 20)]
        docs.append((d, "".join(w.upper() + rng.choice([" ", ", ", "\n--", "​ ", "_"]) for w in words), 1))
    docs.append(docs[-1])
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, prompt string, answer string, text string")
    for n, chars in ((12, 8_000_000), (12, 900), (3, 8_000_000)):
        want = {(d, i) for d, t, _ in docs for i, p, _, _ in items if t and p and shares(plain_words(p), plain_words(t), n)}
        got = find_leaks(df, it, fields=("prompt",), min_words=n, offsets=False, block_chars=chars).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want
    want = {(d, i, f) for d, t, _ in docs for i, p, a, _ in items for f, x in (("prompt", p), ("answer", a)) if t and x and shares(plain_words(x), plain_words(t), 12)}
    rows = find_leaks(df, it).collect()
    assert {(r.doc_id, r.item_id, r.field) for r in rows} == want
    texts = dict((d, t) for d, t, _ in docs)
    for r in rows:
        field = next(i for i in items if i[0] == r.item_id)[1 if r.field == "prompt" else 2]
        passage = plain_words(texts[r.doc_id][r.start_char : r.end_char])
        assert len(passage) == r.words >= 12 and shares(plain_words(field), passage, r.words)


def test_long_text_and_no_rows(spark):
    run = " ".join(f"q{i}" for i in range(12))
    df = spark.createDataFrame([(1, "z " * 300_000 + run + " z" * 300_000)], "doc_id bigint, text string")
    it = spark.createDataFrame([(5, run)], "item_id bigint, prompt string")
    assert [tuple(r) for r in find_leaks(df, it, fields=("prompt",), offsets=False).collect()] == [(1, 5)]
    same = find_leaks(df.withColumnRenamed("doc_id", "id"), it.withColumnRenamed("item_id", "id"), "id", "text", "id", ("prompt",), offsets=False)
    assert same.columns == ["id", "item_id"] and [tuple(r) for r in same.collect()] == [(1, 5)]
    (r,) = find_leaks(df, it, fields=("prompt",)).collect()
    assert (r.start_char, r.end_char) == (600_000, 600_000 + len(run))
    assert find_leaks(df, it.limit(0), fields=("prompt",)).collect() == []
    assert find_leaks(df.limit(0), it, fields=("prompt",), offsets=False).collect() == []


def test_short_answers_beside_their_prompt(spark, tmp_path):
    from gaugewell.llm.queries import p7_passages

    run = [" ".join(f"{c}{i}" for i in range(14)) for c in "pq"]
    texts = [f"Answer: FORTY-Two. {run[0]} is 7, forty​ two", f"{run[1]} 42, 7", "forty two 7", f"{run[0]} {run[1]} forty-two forty two 42"]
    items = [(1, run[0], "forty two"), (2, run[1], "42"), (3, "7 and more", "7"), (4, run[1], None), (2, run[1], " 42!")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    it = spark.createDataFrame(items, "item_id bigint, prompt string, answer string")
    it.write.parquet(f"{tmp_path}/eval_items.parquet")
    rows = p7_passages(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.item_id, r.words, texts[r.doc_id][r.start_char : r.end_char]) for r in rows if r.field == "answer")
    assert got == [(0, 1, 2, "FORTY-Two"), (0, 1, 2, "forty​ two"), (1, 2, 1, "42"), (3, 1, 2, "forty two"), (3, 1, 2, "forty-two"), (3, 2, 1, "42")]
    assert {(r.doc_id, r.item_id) for r in rows if r.field == "prompt"} == {(0, 1), (1, 2), (1, 4), (3, 1), (3, 2), (3, 4)}
    blocks = find_leaks(spark.read.parquet(f"{tmp_path}/documents.parquet"), it, block_chars=50, whole=("answer",)).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, rows))
