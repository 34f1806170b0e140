import random

import pytest

from veilspark.llm.decontaminate import COVERAGE, RUN, WINDOW, contaminated, windows

ITEM = "A train leaves Boston at 9 am with 120 people and travels 60 km before it stops for lunch near the old mill."
OTHER = "Name the largest river that crosses the northern plains and explain why its delta keeps moving south each year."


def frames(spark, docs):
    rows = list(enumerate(docs))
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, ""), (4, None), (5, "tiny item")], "item_id long, text string")
    return spark.createDataFrame(rows, "doc_id long, text string"), bench


def found(spark, docs):
    return {(r.doc_id, r.item_id): r for r in contaminated(*frames(spark, docs)).collect()}


def test_passages(spark):
    changed = ITEM.replace("Boston", "Chicago").replace("120", "75").replace("60 km", "40 miles").replace("9", "7")
    edited = ITEM.replace("lunch", "dinner")
    got = found(spark, [
        f"Some words before. {ITEM} And some after.",
        f"lower case start {ITEM} end",
        changed,
        edited,
        "A train leaves the station at noon and travels far before it stops for the night somewhere else entirely.",
        f"{OTHER} {OTHER}",
        "a tiny item here",
        "nothing of the kind",
    ])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (5, 2), (6, 5)}
    assert got[0, 1].coverage == 1.0 and not got[0, 1].changed and got[0, 1].first_token == 3
    assert got[2, 1].changed and got[2, 1].coverage >= 0.8
    assert not got[3, 1].changed


def test_slots_must_be_consistent(spark):
    item = "if x is 5 then take 5 from 5 and add 5 to the 5 you had before 5 came along"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, mixed = item.replace("5", "8"), item
    for value in "12345678":
        mixed = mixed.replace("5", value, 1)
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert got[1].changed and got[1].conflicts == 0
    assert 2 not in got


def test_numbers_alone_are_no_template():
    w = windows(["1 2 3 4 5 6", "9 8 7 6 5 4", "a 1 b 2 c 3", "a 4 b 5 c 6"], 5)
    by = {i: set(w.hashes[w.owner == i].tolist()) for i in range(4)}
    assert not by[0] & by[1] and by[2] == by[3]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f"), (None, "x y z"), (2, None)], "item_id long, text string")
    got = contaminated(odd_docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1)]
    assert contaminated(no_docs, bench).count() == 0
    assert contaminated(odd_docs, bench.limit(0)).count() == 0


def test_runs_are_one_slot(spark):
    """A name or number of more words than the item's, in the middle of a short item, shifts nothing."""
    name = "the old keeper of the quiet lighthouse walked slowly toward Boston while rain fell across every empty field he passed"
    number = "the old baker of the quiet village sold nearly exactly 25 loaves while rain fell across every empty field around"
    bench = spark.createDataFrame([(1, name), (2, number)], "item_id long, text string")
    docs = [
        name.replace("Boston", "New York"),
        name.replace("Boston", "St. Louis"),
        name.replace("Boston", "New\nYork"),
        number.replace("25", "twenty five"),
        name.replace("Boston", "somewhere else"),
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2)}
    assert all(r.coverage == 1.0 and r.changed and r.conflicts == 0 for r in got.values())


def test_capitalised_starts_are_read_both_ways(spark):
    item = "Zoltan has 12 red apples in a basket. Zoltan gives 3 of them away. Zoltan buys 4 more. How many are left now?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [
        item.replace("Zoltan", "Farid").replace("12", "20"),
        "We were asked by Mary\n" + item.replace("Zoltan", "Farid Khan"),
        "it is said that " + item[0].lower() + item[1:],
        item.replace(". ", ".\n"),
        "The shop has many red apples. The clerk gives some of them away. People buy more. How many are left now?",
    ]
    got = {r.doc_id: r for r in contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].changed and got[0].coverage == 1.0 and not got[3].changed


def brute_match(item, doc):
    """Share of the item's windows that the document holds, and its longest run of tokens; plain words only."""
    item, doc = item.split(), doc.split()
    grams = {tuple(doc[j : j + WINDOW]) for j in range(len(doc) - WINDOW + 1)}
    held = [tuple(item[i : i + WINDOW]) in grams for i in range(len(item) - WINDOW + 1)]
    run = longest = 0
    for h in held:
        run = run + 1 if h else 0
        longest = max(longest, run)
    return sum(held) / len(held), longest + WINDOW - 1 if longest else 0


def test_edited_passages_against_brute_force(spark):
    """Items of words of their own, some of them changed or left out, somewhere among other words."""
    pick = random.Random(8)
    items = [" ".join(f"item{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(pick.randint(10, 60))) for k in range(25)]
    docs = []
    for n in range(300):
        k = pick.randrange(len(items))
        words = items[k].split()
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            at = pick.randrange(len(words))
            words[at : at + 1] = pick.choice([["changed"], [], ["two", "more"]])
        filler = lambda: [f"f{chr(97 + pick.randrange(26))}z" for _ in range(pick.randint(0, 30))]
        docs.append((n, " ".join([*filler(), *words, *filler()])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    matches = {(n, k): brute_match(item, doc) for n, doc in docs for k, item in enumerate(items)}
    want = {key: m for key, m in matches.items() if m[0] >= COVERAGE or m[1] >= RUN}
    assert set(got) == set(want) and 100 < len(want) < 300
    for key, (coverage, run) in want.items():
        assert got[key].coverage == pytest.approx(coverage, abs=0.21)  # the best place may leave out what an edit moved
        assert got[key].run <= run + 1


def test_changed_slots_against_their_source(spark):
    """Every number and name of an item filled anew, the same way throughout: all are found, none as a copy."""
    pick = random.Random(3)
    people, others = ["Anna", "Peter", "Julia", "Robert"], ["Farid", "Zoltan", "Mireille", "Kwame"]
    items, docs = [], []
    for k in range(20):
        words = [f"w{chr(97 + k)}{chr(97 + j)}" for j in range(24)]
        for at in range(2, 24, 5):
            words[at] = pick.choice([pick.choice(people), str(pick.randint(2, 99))])
        items.append((k, " ".join(words)))
        new = {p: o for p, o in zip(people, others, strict=True)} | {str(i): str(i + 200) for i in range(100)}
        docs.append((k, "so it is said that " + " ".join(new.get(w, w) for w in words) + " and so on"))
    frames_ = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r for r in contaminated(*frames_).collect()}
    assert set(got) == {(k, k) for k in range(20)} and all(r.changed for r in got.values())


def test_large_id_beside_a_null_id(spark):
    large = (1 << 53) + 1
    docs = spark.createDataFrame([(large, ITEM), (None, OTHER)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, frames(spark, [])[1]).collect()} == {(large, 1), (None, 2)}
