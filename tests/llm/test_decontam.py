import pyarrow as pa
from brute import WORDS

from lumiform.llm import decontam as D


def kinds(text):
    t = D.canonical(pa.array([text]))
    return "".join("wnuN"[k] for k in t.kind)


def test_templates():
    assert kinds("He ran 3.5 km and 1,000 miles") == "wwnuwnu"
    assert kinds("Today Mary Jones met John. Then they left") == "NwNwww"
    assert kinds("The man saw Ann. Bob has 4 red apples. Bob Ann") == "wwwNNwnwwN"
    assert kinds("It took twenty minutes in a day") == "wwnuwww"
    assert kinds("WE SHOUT AT NASA") == "wwww"
    assert kinds("") == ""
    a, b = D.canonical(pa.array(["if Ann has 3 kg", "If Bob Lee has 40 miles"]))[:1], None
    assert a[0][:5].tolist() == a[0][5:].tolist() and b is None


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id or -1, r.item_id, r.same_slots) for r in D.matches(d, spark.createDataFrame(items, "item_id long, text string")).collect())


QUESTION = "If {0} buys {1} apples for {2} dollars each, how much does {0} pay in total for all of the apples that were bought there?"


def test_other_parameters_must_be_consistent(spark):
    items = [(1, QUESTION.format("John Smith", 12, 3.5)), (2, "What is 2 plus 2?"), (3, "no"), (4, None), (1, QUESTION.format("John Smith", 12, 3.5))]
    docs = [
        (1, "Hello. " + QUESTION.format("John Smith", 12, 3.5) + " Bye."),
        (2, "Well then. " + QUESTION.format("Mary Ann Lee", 7, "1,200")),
        (3, "So. " + QUESTION.format("Mary", 7, 9).replace("does Mary", "does Peter")),
        (4, "what is 5 plus 5"), (5, "what is 5 plus 6"), (6, None), (None, QUESTION.format("Eve", 1, 2)), (7, ""), (7, QUESTION.format("John Smith", 12, 3.5)),
        (8, "the apples that were bought there are green and nothing else of the kind is in here"),
    ]
    assert pairs(spark, docs, items) == [(-1, 1, False), (1, 1, True), (2, 1, False), (4, 2, False), (7, 1, True)]


EDGES = "{0} Jones has {1} red apples and Jones gives {2} to Bob before lunch with Bob"


def test_text_around_a_passage_may_run_into_its_edges(spark):
    items = [(1, EDGES.format("Mary", 3, 2))]
    docs = [
        (1, "For example, " + EDGES.format("Mary", 3, 2) + "."), (2, "we read that dear Doctor " + EDGES.format("Mary", 3, 2) + " Lee said"),
        (3, "For example, " + EDGES.format("Mary", 7, 5).replace("Jones", "Smith")),
        (4, "For example, " + EDGES.format("Mary", 3, 2).replace("and Jones", "and Smith")), (5, "Mary Jones has some " + EDGES.format("Mary", 3, 2)[11:].replace("Bob before", "Ann Bob before")),
    ]
    assert pairs(spark, docs, items) == [(1, 1, True), (2, 1, True), (3, 1, False)]


def test_short_items_and_names_that_open_sentences(spark):
    items = [(1, "Alice has 3 red apples."), (2, "Who sings?"), (3, "Sir"), (4, "..."), (5, "")]
    docs = [(1, "It rains. Bob has 4 red apples. Then it stops."), (2, "bob has red apples"), (3, "They ask who sings? Nobody."), (4, "who never sings"), (5, "")]
    assert pairs(spark, docs, items) == [(1, 1, False), (3, 2, True)]


def test_placeholders_alone_match_nothing(spark):
    """Items of a name, a number, an answer and a row of numbers are found by their own values only."""
    row = " ".join(str(n * n + 3) for n in range(24))
    items = [(1, "Paris"), (2, "42"), (3, "Yes"), (4, "Barack Obama"), (5, row), (6, "3 km"), (7, "Paris 7 Rome 9 London the 5 10")]
    docs = [
        (1, "die Katze sitzt auf dem Tisch"), (2, "we met Barack Obama, then 42 others"), (3, "Susan saw 17 birds and Peter 41"), (4, "so Yes. In Paris it rains"),
        (5, " ".join(str(n * n + 4) for n in range(24))), (6, "table: " + row + " end"), (7, "5 km or 3 miles"), (8, "just 3 km more"),
        (9, "Berlin 7 Oslo 8 Madrid the 6 11"), (10, "Paris 7 Rome 9 Oslo the 5 10"),
    ]
    assert pairs(spark, docs, items) == [(2, 2, True), (2, 4, True), (4, 1, True), (4, 3, True), (6, 5, True), (8, 6, True), (10, 1, True), (10, 7, False)]


def test_an_item_of_hundreds_of_numbers(spark):
    row = "the " + " ".join(f"{n} plus {n + 1} is" for n in range(400))
    other = "the " + " ".join(f"{n + 5000} plus {n + 5001} is" for n in range(400))
    assert pairs(spark, [(1, row), (2, other)], [(9, row)]) == [(1, 9, True), (2, 9, False)]


TWO = "When {0} went to the old market on the hill {1} apples were sold there for a good price and then {2} came back home over the long bridge with {3} pears"


def test_alignments_share_one_slot_map(spark):
    items = [(1, TWO.format("Alice", 3, "Alice", 7))]
    split = "for a quite good price"
    docs = [
        (1, "Yes. " + TWO.format("Bob", 5, "Bob", 9)), (2, "Yes. " + TWO.format("Bob", 5, "Bob", 9).replace("for a good price", split)),
        (3, "Yes. " + TWO.format("Bob", 5, "Carl", 9)), (4, "Yes. " + TWO.format("Bob", 5, "Carl", 9).replace("for a good price", split)),
        (5, TWO.format("Eve", 1, "Eve", 2) + ". " + TWO.format("Dan", 4, "Dan", 8)),
    ]
    assert pairs(spark, docs, items) == [(1, 1, False), (2, 1, False), (5, 1, False)]


def test_planted_items_with_other_parameters(spark, sf):
    """Each benchmark item gets parameters, and documents hold it with others: all are found, and none of the documents without."""
    import random

    draw = random.Random(2)
    items, docs, want = [], [], set()
    texts = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    fill = lambda words, values: " ".join(values.get(i, w) for i, w in enumerate(words))
    for k, text in enumerate(texts):
        words = text.split()
        names, numbers = draw.sample(range(1, len(words)), 2), draw.sample(range(1, len(words)), 2)
        if len({*names, *numbers, *(n + 1 for n in names), *(n - 1 for n in names)}) < 8:
            continue
        values = lambda a, n: {names[0]: a, names[1]: a} | {i: str(n) for i in numbers}
        items.append((k, fill(words, values("Robert", 11))))
        docs += [(10 * k, "we read that " + fill(words, values("Susan", 23)) + " and so on"), (10 * k + 1, "we read that " + fill(words, values("Susan", 23) | {names[1]: "Peter"}) + " and so on"), (10 * k + 2, text)]
        want.add((10 * k, k, False))
    got = pairs(spark, docs, items)
    assert len(want) >= 10 and {g for g in got if g[0] % 10 == 0} == {(d or -1, i, s) for d, i, s in want} and not [g for g in got if g[0] % 10 == 1]


def test_very_long_text_and_clashing_names(spark):
    item = QUESTION.format("John Smith", 12, 3.5)
    long = "some words of no weight stand here. " * 40000
    d = spark.createDataFrame([(1, long + item + " " + long, 1, "x", 2), (2, long, 1, "x", 2)], "doc_id long, text string, key_ int, hash string, n_ int")
    b = spark.createDataFrame([(1, item, "x", 3)], "item_id long, text string, slots string, place int")
    assert [(r.doc_id, r.item_id, r.coverage, r.same_slots) for r in D.matches(d, b).collect()] == [(1, 1, 1.0, True)]


def test_repeats_hot_windows_and_empty(spark):
    item = [(1, QUESTION.format("John", 12, 3))]
    docs = [(i % 200, "Read this: " + item[0][1] + f" number {i % 200} of a list") for i in range(400)]
    assert len(pairs(spark, docs, item)) == 200
    assert pairs(spark, [], item) == [] and pairs(spark, docs, []) == []


def test_query_against_plain_windows(spark, sf):
    docs = [(r.doc_id, WORDS.findall((r.text or "").lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORDS.findall(r.text.lower())
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for d, x in docs:
            there = {tuple(x[i : i + 8]) for i in range(len(x) - 7)}
            if own and 2 * len(own & there) >= len(own):
                want.add((d, r.item_id))
    assert {(r.doc_id, r.item_id) for r in D.op4_decontamination(spark, sf).collect()} == want and want
