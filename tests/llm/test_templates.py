import random

import pytest
from dispatchlake.llm import templates

ITEMS = [
    (1, "A train leaves Boston at 60 miles per hour and another leaves Chicago at 45 miles per hour, so when will the two trains finally meet?"),
    (2, "The quick orange fox quietly jumped over seven sleeping dogs while nobody in the village was watching them."),
    (3, "7 + 8"),
    (4, "short plain question here"),
    (5, None),
]
FILL = "Nothing that stands in this part of the text has to do with any question that was ever asked of anyone."


def doc_rows():
    same = f"{FILL} {ITEMS[0][1]} {FILL}"
    other = f"{FILL} A train leaves Denver at 80 miles per hour and another leaves New Orleans at 35 miles per hour, so when will the two trains finally meet? {FILL}"
    mixed = f"{FILL} A train leaves Denver at 80 miles per hour and another leaves Denver at 80 miles per hour, so when will the two trains finally meet?"
    shouted = f"{FILL} {ITEMS[1][1].upper()}"
    small = "And then: Short plain question here!"
    return [(10, same), (11, other), (12, FILL), (13, None), (14, ""), (15, shouted), (16, small), (17, (FILL + " ") * 2000 + ITEMS[1][1]), (10, same), (None, same), (18, mixed), (19, "The quick orange fox quietly jumped over a fence.")]


@pytest.mark.parametrize("inline", [1000, 0])
def test_finds_exact_and_changed_items(spark, make_docs, inline):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = templates.decontaminate(make_docs(doc_rows()), benchmark, inline=inline).collect()
    assert len(got) == len(doc_rows())
    found = {r.doc_id: [(i.item_id, i.exact) for i in r["items"]] for r in got}
    assert found == {10: [(1, True)], None: [(1, True)], 11: [(1, False)], 12: [], 13: [], 14: [], 15: [(2, True)], 16: [(4, True)], 17: [(2, True)], 18: found[18], 19: []}
    assert sum(r.contaminated for r in got) == sum(bool(f) for f in found.values()) + 1


def test_slots_must_agree():
    assert templates.consistent([(["80"], ["60"]), (["80", "x"], ["60", "y"]), (["81"], ["60"]), (["80"], ["61"])]) == [True, True, False, False]


def test_places_between_others_are_found():
    hit = lambda pos, at: {"pos": pos, "at": at, "n": 8, "vals": [], "theirs": []}
    chance = [hit(1, 10 * k) for k in range(20)]
    assert templates.cover([hit(0, 0), *chance, hit(8, 8)], 200) == (16, True)


def test_windows_match_brute_force(spark, make_docs):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "abcd" for b in "xyzuvw"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 30)))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=30) + rng.choice(items)[1].split()[: rng.randrange(3, 30)] + rng.choices(words, k=9))) for i in range(80)]
    want = set()
    for d, t in docs:
        w = t.split()
        for i, s in items:
            x = s.split()
            n = min(8, len(x))
            if n >= 4 and {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} & {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}:
                want.add((d, i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = templates.matches(make_docs(docs), benchmark).collect()
    assert {(r.did, r.item_id) for r in got} == want and all(r.exact for r in got)


@pytest.mark.parametrize("inline", [1000, 0])
def test_short_items_word_for_word(spark, make_docs, inline):
    items = [(1, "7 + 8"), (2, "What is 12 times 7?"), (3, "What is the capital city of France today"), (4, "?"), (5, "Paris"), (6, "17 23 40 by 51 60 72 or 88 90 91 in 92"), (7, "+")]
    docs = [
        (1, "Add up 7 + 8, then stop."),
        (2, "Then we asked (What is 12 times 7?) and waited"),
        (3, "At last we asked What is the capital city of France today and nobody knew"),
        (4, "At last we asked What is the capital city of Spain today and nobody knew"),
        (5, "Add up 7 - 8, 7 + 9 and 7 8"),
        (6, "What is 13 times 7?"),
        (7, "Then to Paris."),
        (8, "say 17 23 40 by 51 60 72 or 88 90 91 in 92 again"),
        (9, "say 17 23 40 by 51 60 72 or 88 90 91 in"),
        (10, "What is 12 times"),
        (11, "7? Where now?"),
    ]
    got = templates.decontaminate(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), inline=inline).collect()
    found = {r.doc_id: [(i.item_id, i.exact) for i in r["items"]] for r in got}
    plus = [(7, True)]
    assert found == {1: [(1, True), *plus], 2: [(2, True)], 3: [(3, True)], 4: [(3, False)], 5: plus, 6: [], 7: [(5, True)], 8: [(6, True)], 9: [], 10: [], 11: []}
    assert all(0 < i.covered <= i.tokens for r in got for i in r["items"])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert templates.decontaminate(make_docs([]), some).count() == 0
    assert [r.contaminated for r in templates.decontaminate(make_docs([(1, FILL)]), none).collect()] == [False]
