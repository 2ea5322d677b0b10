from __future__ import annotations

import random

import pytest

from ripplefold.llm import encode, repetition


def plain_bpe(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def ranks():
    return encode.read_ranks(encode.default_vocabulary())


def test_tree_merges_like_the_plain_loop(ranks):
    rng = random.Random(3)
    for _ in range(400):
        piece = bytes(rng.choice(b"aabcdeett  \xc3\xa9\xe6\x97\xa5") for _ in range(rng.randint(0, 40)))
        assert encode.merge_piece(piece, ranks) == plain_bpe(piece, ranks)
    assert encode.merge_piece(b"a" * 50_000, ranks)[:1] == encode.merge_piece(b"a" * 64, ranks)[:1]


def test_every_token_is_its_own_encoding_or_splits_as_the_loop_does(ranks):
    for token in list(ranks)[::97]:
        assert encode.merge_piece(token, ranks) == plain_bpe(token, ranks)


def test_ids_match_the_public_library(spark, ranks):
    import public_tokenizers
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "It's  a\ttest\r\n\r\n  x", "naïve café 日本語テキスト 😀👍🏽", "a\x1cb \x85   ​", "<|endoftext|>", "x" * 3000, "1²½五 ＡＢ", " 'll  'LL don't", "word " * 2000, "\n" * 500]
    df = spark.createDataFrame([(i, t, "k", "out") for i, t in enumerate(texts)], "doc_id long, text string, k string, out string")
    got = {r.doc_id: r.ids for r in encode.token_ids(df, "doc_id").collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}


def test_no_rows_no_ids(spark):
    assert encode.token_ids(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0


def covered_words(words, width=8):
    seen, hit = set(), set()
    for i in range(len(words) - width + 1):
        run = tuple(words[i : i + width])
        if run in seen:
            hit.update(range(i, i + width))
        seen.add(run)
    return len(hit)


def test_covered_words_match_a_set_of_runs():
    rng = random.Random(5)
    for _ in range(500):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        for width in (2, 3, 5, 8, 11):
            assert repetition.repeated_words(words, width)[0] == covered_words(words, width)
    assert repetition.repeated_words(["x"] * 10_000)[0] == 9_999


def test_repetitive_texts_are_found_and_odd_ones_defined(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(60)]
    spam = ["buy the best cheap thing here now today " * 20] * 8
    edge = [None, "", "  \n", "one two", "日本語" * 3]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(plain + spam + edge)], "doc_id long, text string, n_words int")
    measured = repetition.measures(df, "doc_id")
    assert {r.doc_id for r in repetition.repetitive(measured).collect()} == set(range(60, 68))
    odd = {r.doc_id: (r.n_words, r.covered, r.repeated) for r in measured.where("doc_id >= 68").collect()}
    assert odd[68] == odd[69] == odd[70] == (0, 0, 0.0) and odd[71] == (2, 0, 0.0) and odd[72] == (1, 0, 0.0)
    assert repetition.judged(measured.limit(0)).count() == 0 and repetition.fit([]) == {}


def test_posteriors_follow_agreeing_rules():
    table = repetition.fit([((1, 1, 1, 1, 1), 50), ((-1, -1, -1, -1, -1), 900), ((1, 0, 0, 1, 0), 10), ((-1, 0, -1, 0, -1), 40)])
    assert table[(1, 1, 1, 1, 1)] > 0.99 > 0.01 > table[(-1, -1, -1, -1, -1)] and table[(1, 0, 0, 1, 0)] > 0.5


def test_corpora_of_one_kind_keep_their_true_texts(spark):
    """One-line texts vote on runs and words only; alone or beside clean texts, all with a share of 0.3 come out."""
    halves = [" ".join(f"a{i}b{j}" for j in range(40)) for i in range(30)]
    spam = [f"{h} {h} tail{i}" for i, h in enumerate(halves)]
    clean = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(300)]
    for texts, n in ((spam, 30), (spam + clean, 30), (spam[:1] + clean, 1), (clean, 0), (spam[:1], 1)):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id for r in repetition.repetitive(repetition.measures(df, "doc_id")).collect()}
        assert got == set(range(n))


def test_no_true_text_is_voted_clean_by_runs_or_variety():
    rng = random.Random(11)
    for _ in range(3000):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(words)), rng.randint(4, 30)
            words[rng.randrange(len(words)) : 0] = words[at : at + n]
        covered, fours, _, variety = repetition.repeated_words(words)
        if covered >= 0.3 * len(words):
            assert fours >= 0.1875 and variety <= 0.7
