"""Repeated passages by definition: what goes are the words of repeated windows of 51 words, and nothing else."""

import random

import pytest

from lodestone.llm import cdc

WORDS = cdc.WORDS


def plain(rows):
    """doc_id to text without the words of every window of WORDS words but the first; words are single-spaced."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        words = text.split(" ")
        gone = [False] * len(words)
        for i in range(len(words) - WORDS + 1):
            window = tuple(words[i : i + WORDS])
            if first.setdefault(window, (doc_id, i)) != (doc_id, i):
                gone[i : i + WORDS] = [True] * WORDS
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        left, at, i = [], 0, 0
        while i < len(words):
            if gone[i]:
                j = i
                while j < len(words) and gone[j]:
                    j += 1
                left.append(text[at : starts[i]])
                at, i = starts[j] - 1, j
            else:
                i += 1
        out[doc_id] = "".join([*left, text[at:]])
    return out


def got(spark, rows, parts=5):
    return {r.doc_id: r.text for r in cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}


@pytest.mark.parametrize("length", [51, 60, 90, 120, 150])
def test_passages_made_of_stock_phrases_go_whole(spark, length):
    rng, rows = random.Random(length), []
    some = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(25):
        passage, base = some(length), 100 * k
        step = rng.choice([20, 30, 40, 50])
        for n, i in enumerate(range(0, length, step)):  # each piece stands before in another text
            rows.append((base + n, " ".join(some(20) + passage[i : i + step] + some(20))))
        for n in (50, 60):
            rows.append((base + n, " ".join(some(30) + passage + some(30))))
    found, expected = got(spark, rows), plain(rows)
    assert found == expected
    assert all(len(expected[100 * k + 60].split()) == 60 for k in range(25))


def test_text_that_is_no_repeated_window_stays(spark):
    rng, rows = random.Random(3), []
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases = [some(rng.randint(24, 50)) for _ in range(30)]
    for k, p in enumerate(phrases):
        rows.append((k, " ".join(some(40) + p + some(40))))
    for k in range(150):  # two or three phrases of others side by side, or with few words between
        chosen = rng.sample(phrases, rng.randint(2, 3))
        rows.append((100 + k, " ".join(some(rng.randint(0, 9)) + [w for p in chosen for w in p + some(rng.choice([0, 0, 1, 3]))] + some(9))))
    assert got(spark, rows) == plain(rows)


def test_edited_copies_periods_and_joined_passages(spark):
    rng, rows = random.Random(4), []
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = some(600)
    rows.append((0, " ".join(base)))
    for k in range(1, 40):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 2)] = some(rng.randint(0, 2))
        rows.append((k, " ".join(words)))
    rows.append((50, " ".join(some(20) + base[100:170] + base[300:380] + some(20))))
    rows.append((51, " ".join(some(20) + base[120:170] + base[300:350] + some(20))))
    period = some(17)
    rows += [(60, " ".join(period * 20)), (61, " ".join(some(5) + period * 9)), (62, " ".join((some(80) + ["x"]) * 3))]
    rows += [(70, "same " * 300 + "same"), (71, "same " * 120 + "same")]
    assert got(spark, rows) == plain(rows)


def test_common_words_and_many_tasks(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(40)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 70))) for _ in range(25)]
    rows = [(k, " ".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for k in range(120)]
    assert got(spark, rows, 9) == plain(rows)
