import random

import pytest

from deltaframe.llm import decontaminate as d


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        previous, row = row, [0]
        for i, x in enumerate(item):
            row.append(min(previous[i] + (x != c), previous[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def edit(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "é"]) + text[i + 1 :]
    return text


def words(rng, n):
    return " ".join(rng.choice("the of and to ing tion er ea nd th re on an is".split()) + rng.choice(["", "er", "st"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_against_dynamic_programming(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.randrange(6, 30))) for i in range(12)]
    texts = [words(rng, 40)] + [words(rng, 20) + " " + edit(rng, rng.choice(items)[1], rng.randrange(14)) + " " + words(rng, 20) for _ in range(40)]
    matcher = d.Matcher(items)
    for text in texts:
        low = d.reduce_text(text)
        want = {}
        for i, t in items:
            t = d.reduce_text(t)
            if len(t) >= d.LEAST_CHARS and (best := sellers(t, low)) <= int(0.1 * len(t)):
                want[i] = best
        got = matcher.find(text)
        assert {h[0]: h[1] for h in got} == want
        for i, edits, size, start, end in got:
            t = d.reduce_text(dict(items)[i])
            assert len(t) == size
            assert sellers(t, low[start:end]) == edits


def test_bit_parallel_distance():
    rng = random.Random(9)
    for _ in range(300):
        item = "".join(rng.choices("abc", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randrange(0, 120)))
        assert d.closest(d.letter_masks(item), len(item), text)[0] == sellers(item, text)


def test_query_cases(spark):
    long = "It was the best of times, it was the worst of times, it was the age of wisdom"
    rows = [(1, "Intro. " + long.upper() + "!! end", 5), (1, "Intro. " + long.upper() + "!! end", 5), (2, None, 5), (3, "", 5), (4, "yes", 5), (5, "oh yes", 5), (None, long, None), (6, "it was the best of times", 5), (7, "x " * 50_000 + long.replace("worst", "wurst"), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    items = spark.createDataFrame([(10, long), (10, long), (11, "Yes!"), (12, None), (13, " ? "), (None, long)], "item_id int, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.edits) for r in d.leaks(docs, items).collect())
    want = [("1", i, 0) for i in ("10", "None")] * 2 + [("4", "11", 0), ("5", "11", 0)] + [("None", i, 0) for i in ("10", "None")] + [("7", i, 1) for i in ("10", "None")]
    assert got == sorted(want)
    clean = d.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 6]
    nothing = items.limit(0)
    assert d.leaks(docs, nothing).collect() == []
    assert d.keep_clean(docs, nothing).count() == len(rows)
    assert d.leaks(docs.limit(0), items).collect() == []


def test_blocks_cover_all_items(spark):
    rng = random.Random(4)
    items = [(i, words(rng, 12)) for i in range(50)] + [(3, words(rng, 12)), (60, "so it was")]
    rows = [(k, words(rng, 10) + " " + edit(rng, t, rng.randrange(4)) + " " + words(rng, 10), "c") for k, (_, t) in enumerate(items)] + [(99, None, "c"), (100, "was it so", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(d.item_blocks(table, block_bytes=500).paths) > 4
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    one = as_rows(d.leaks(docs, table))
    assert len({r[0] for r in one}) >= 50
    assert as_rows(d.leaks(docs, table, block_bytes=500)) == one
    assert as_rows(d.keep_clean(docs, table, block_bytes=500)) == as_rows(d.keep_clean(docs, table))


def test_short_items_lie_between_word_bounds():
    matcher = d.Matcher([(1, "Was 2?"), (2, "hm"), (3, "x" * 30)])
    assert [h[0] for h in matcher.find("So, what was 2 then")] == [1]
    assert matcher.find("so, what was 22 then") == []
    assert matcher.find("Hm!") == [(2, 0, 2, 0, 2)]
    assert matcher.find("it hm") == [(2, 0, 2, 3, 5)]
    assert matcher.holds("a was 2") and not matcher.holds("ahm") and not matcher.holds(None)


def test_starts_of_long_items():
    """The start of a match of 20,000 letters is found as fast as its end."""
    rng = random.Random(2)
    item = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000))
    low = edit(rng, item, 300)
    (hit,) = d.Matcher([(1, item)]).find("before it " + low + " after it")
    assert hit[1] <= 300 and abs(hit[3] - 10) <= 10


def test_shortest_start():
    rng = random.Random(7)
    for _ in range(200):
        item = "".join(rng.choices("ab", k=rng.randrange(1, 40)))
        text = "".join(rng.choices("ab", k=rng.randrange(0, 60)))
        row, ends = list(range(len(item) + 1)), [len(item)]
        for j, c in enumerate(text, 1):
            previous, row = row, [j]
            for i, x in enumerate(item):
                row.append(min(previous[i] + (x != c), previous[i + 1] + 1, row[i] + 1))
            ends.append(row[-1])
        least = min(ends)
        assert d.shortest(d.letter_masks(item), len(item), text, least) == ends.index(least)
