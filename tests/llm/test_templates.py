import random
import re

from pressroom.llm import templates

ITEM = ("A farmer named Alice sells 12 apples for 3 dollars each at the market in Berlin on Monday. After 5 hours Alice has sold every apple she brought along. "
        "How much money does Alice take home to her family in the evening")
OTHER = "The committee will publish the final report of the investigation before the end of the summer session"
SHORT = "what is the boiling point"


def other_numbers(text):
    return text.replace("12", "40").replace("3 dollars", "7 euros").replace("Alice", "Nadia").replace("Berlin", "Cairo").replace("5 hours", "9 minutes")


def test_leaks(spark, docs):
    filler = "Rain fell on the hills for many weeks and the small streams were full of brown water. "
    half = " ".join(ITEM.split()[:26])
    texts = {200: filler + ITEM, 201: filler + ITEM.upper() + " " + filler, 202: ITEM.lower(), 203: filler * 3 + other_numbers(ITEM) + filler, 204: filler, 205: filler + " ".join(ITEM.split()[:9]) + filler,
             206: "So: what is the boiling point? " + filler, 207: filler + OTHER.replace(" ", "\n"), 208: filler + half + ". " + filler, 209: None, 210: "", 211: "1 2 3 4 5 6 7 8 9 10 11 12 13 14"}
    rows = [(i, t, "x", "y") for i, t in texts.items()] + [(200, filler, "x", "y"), (None, ITEM, "x", "y")]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, mark string, pos string").repartition(3)
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, SHORT), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(mixed, bench).collect()}
    assert set(got) == {(200, 1), (201, 1), (202, 1), (203, 1), (206, 3), (207, 2), (208, 1), (211, 6), (None, 1)}
    assert got[211, 6].verbatim and got[203, 1].slot_consistency >= 0.75 and not got[203, 1].verbatim and got[200, 1].verbatim and got[200, 1].coverage == 1
    left = templates.decontaminate(mixed, bench)
    assert left.columns == mixed.columns and {r.doc_id for r in left.collect()} == {204, 205, 209, 210, None}
    assert templates.leaks(docs, bench).collect() == []
    assert templates.leaks(mixed.limit(0), bench).collect() == [] and templates.leaks(mixed, bench.limit(0)).collect() == []


def test_inconsistent_slots_do_not_count(spark):
    """The item's one name stands for many in the document: the template matches, the slots do not."""
    item = " ".join(f"then Bob met the old {w} again" for w in "baker miller tailor smith cooper".split())
    names = iter(["Ann", "Eve", "Joe", "Tim", "Kim"])
    other = " ".join(x if x != "Bob" else next(names) for x in item.split())
    docs = spark.createDataFrame([(1, item), (2, other)], "doc_id long, text string")
    got = templates.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_copies_with_other_values_in_one_document(spark):
    """An earlier passage with the item's template does not hide a later copy."""
    names = iter(["Ann", "Eve", "Joe", "Tim", "Kim"])
    bob = " ".join(f"then Bob met the old {w} again" for w in "baker miller tailor smith cooper".split())
    mixed = " ".join(x if x != "Bob" else next(names) for x in bob.split())
    filler = "Rain fell on the hills for many weeks and the small streams were full of brown water. "
    docs = spark.createDataFrame([(1, other_numbers(ITEM) + " " + filler + ITEM), (2, other_numbers(ITEM) + " " + ITEM + " " + other_numbers(ITEM)), (3, mixed + " " + filler + bob), (4, mixed)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(docs, spark.createDataFrame([(1, ITEM), (2, bob)], "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert all(r.slot_consistency == 1 and r.coverage == 1 and r.verbatim for r in got.values())


SUMS, TERMS = "What is 12 + 30 - 7 + 9 * 4 / 2?", "Solve 3 x 2 + 5 x 7 = 0"
FILLER = "Rain fell on the hills for many weeks. "


def test_short_arithmetic_with_other_numbers(spark):
    """Signs of operation stand in for words: other numbers match, other signs do not, nor do lists and dates."""
    texts = {1: FILLER + SUMS + " " + FILLER, 2: FILLER + TERMS, 3: FILLER + SUMS.replace("30", "31"), 4: FILLER, 5: "What is 81 + 15 - 6 + 11 * 3 / 8?", 6: FILLER + "Solve 9 x 4 + 8 x 6 = 1",
             7: "What is 12 - 30 + 7 - 9 / 4 * 2?", 8: "On 2024-01-05, 2024-01-06 and 2024-02-07 it rained 3 - 4 - 5 - 6 - 7 - 8 times", 9: "12 30 7 9 4 2"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = templates.leaks(docs, spark.createDataFrame([(1, SUMS), (2, TERMS)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in got} == {(1, 1, True), (2, 2, True), (3, 1, False), (5, 1, False), (6, 2, False)}


def test_numbers_alone_match_verbatim(spark):
    item = "3 14 15 92 65 35 89 79 32 38"
    docs = spark.createDataFrame([(1, FILLER + item + " end"), (2, "3 14 15 92 65 35 88 79 32 38"), (3, "1 2 3 4 5 6 7 8 9 10 11 12")], "doc_id long, text string")
    got = templates.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.verbatim) for r in got] == [(1, True)]


def test_names_of_all_scripts(spark):
    docs = spark.createDataFrame([(i, FILLER + ITEM.replace("Alice", name).replace("12", "17")) for i, name in enumerate(["Lukas", "Łukasz", "Şule", "Жанна", "Ωmega", "Ḥasan"])], "doc_id long, text string")
    got = templates.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 5] and all(r.slot_consistency == 1 for r in got)


def words_of(text):
    """Tokens of the first stream: (kind, lower text, capital)."""
    out = []
    for m in re.finditer(r"[0-9](?:[0-9]|(?<=[0-9])[.,](?=[0-9]))*|[^\W\d_]+", text):
        t = m.group()
        out.append((t, t.lower() if t.isascii() else t, t[0].isupper() and not (len(t) > 1 and t[1].isupper())))
    return out


def brute_pairs(docs, items):
    """Pairs that share a window of eight tokens in one of the three forms, by plain strings."""
    def forms(text):
        tokens, out = words_of(text), set()
        for i in range(len(tokens) - 7):
            some = tokens[i:i + 8]
            units = [k > 0 and some[k][1] in templates.UNITS and some[k - 1][0][0].isdigit() if k else i > 0 and some[0][1] in templates.UNITS and tokens[i - 1][0][0].isdigit() for k in range(8)]
            plain = ["#" if t[0][0].isdigit() else "%" if u else t[1] for t, u in zip(some, units)]
            named = ["@" if t[2] and not u and not t[0][0].isdigit() else p for t, u, p in zip(some, units, plain)]
            for kind, codes in (("named", named), ("plain", plain)):
                if sum(c not in "#%@" for c in codes) >= templates.LEAST_WORDS:
                    out.add(tuple(codes))
        return out
    held = {i: forms(t) for i, t in items}
    return {(d, i) for d, t in docs for i, f in held.items() if f & forms(t)}


def test_windows_against_brute_force(spark):
    """Every pair that shares a window is found, and no other, before slots and numbers of windows are looked at."""
    rng = random.Random(8)
    vocabulary = ["the", "old", "Mill", "stands", "near", "12", "3.5", "km", "river", "Anna", "sold", "7", "apples", "for", "20", "euros", "Berlin", "GREEN"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.randint(8, 14))) for i in range(25)]
    docs = [(i, phrase(10) + " " + " ".join(items[i % 25][1].split()[:rng.randint(6, 12)]).replace("12", "44").replace("Anna", "Olga") + " " + phrase(10)) for i in range(60)]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "doc_id as row", "text")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "item_id as row", "text")
    schema = "{} long, row long, mark long, pos int, home int, exact boolean, slots array<long>, n long"
    found = [x.mapInArrow(lambda rows, k=k: templates._emit(rows, k, [8], None, False, False), schema.format(k)).where("not exact").select(k, "mark") for x, k in ((a, "doc_id"), (b, "item_id"))]
    got = {tuple(r) for r in found[0].join(found[1], "mark").select("doc_id", "item_id").distinct().collect()}
    assert got == brute_pairs(docs, items) and len(got) > 20
