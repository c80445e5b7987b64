"""Template matching against a plain version that compares every window of every pair."""

import random
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from eventmill.llm import decontaminate as D


def _surface(text):
    text = regex.sub(r"(?<=\p{N})[.,:/](?=\p{N})", "\ue003", text)
    return [w for w in regex.split("[^\\p{L}\\p{M}\\p{N}\ue000-\ue003]+", text.lower()) if w]


def _template(text):
    text = regex.sub(r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{M}]*", "\ue000", text).lower()
    text = regex.sub(r"\p{N}+(?:[.,:/]\p{N}+)*", "\ue001", text)
    text = regex.sub(rf"(?<=\ue001 ?)(?:{'|'.join(D.UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}])", "\ue002", text)
    return [w for w in regex.split("[^\\p{L}\\p{M}\\p{N}\ue000-\ue003]+", text) if w]


def _slot(token):
    return token[0] in "\ue000\ue001\ue002"


def _match(doc, item):
    """Whether a document matches an item, by all pairs of windows."""
    (dt, dv), (it, iv) = ((_template(t), _surface(t)) for t in (doc, item))
    n = min(D.WINDOW, len(it))
    if not n:
        return False
    keys = [i for i in range(len(it) - n + 1) if n >= D.LITERALS and sum(not _slot(w) for w in it[i : i + n]) >= D.LITERALS]
    spans = defaultdict(list)
    for i in keys:
        for j in range(len(dt) - n + 1):
            if dt[j : j + n] == it[i : i + n]:
                if not any(map(_slot, it[i : i + n])):
                    return True
                spans[j - i].append(i)
    if len({k for i in keys for k in range(i, i + n)}) < len(it):
        for i in set(range(len(iv) - n + 1)) - set(keys):
            if any(dv[j : j + n] == iv[i : i + n] for j in range(len(dv) - n + 1)):
                return True
    for shift, starts in spans.items():
        at = {k for i in starts for k in range(i, i + n) if _slot(it[k])}
        names = {(iv[k], dv[k + shift]) for k in at if it[k][0] == "\ue000"}
        if len(names) == len({a for a, _ in names}) == len({b for _, b in names}):
            return True
        if any(all(iv[k] == dv[k + shift] for k in range(i, i + n) if _slot(it[k])) for i in starts):
            return True
    return False


def test_against_all_pairs_of_windows(spark):
    r = random.Random(41)
    plain = ["the", "train", "goes", "from", "and", "then", "meets", "with", "some", "red", "house", "far"]

    def sentence(n):
        w = []
        while len(w) < n:
            x = r.random()
            w += [r.choice(["Anna", "Bob", "Carl"])] if x < 0.1 else [str(r.randrange(3, 9)), r.choice(["km", "hours"])] if x < 0.2 else [r.choice(plain)]
        return w

    items = [sentence(r.choice([3, 6, 9, 14, 20])) for _ in range(40)]
    items += [items[k] for k in (1, 5)] + [items[4][:-1] + ["Anna"]]
    texts = []
    for k in range(150):
        base = list(r.choice(items))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            i = r.randrange(len(base))
            base[i] = r.choice(["Anna", "Dora", "7", "11", r.choice(plain)])
        texts.append(" ".join([*sentence(r.randrange(6)), *base, *sentence(r.randrange(6))]))
    item_texts, texts = [" ".join(x) for x in items], [*texts, "word " * 300, ""]
    item_texts.append("word " * 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(item_texts)), "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(item_texts) if _match(t, x)}
    assert {r["doc_id"] for r in got} == {d for d, _ in want} and 30 < len({d for d, _ in want}) < len(texts)
    assert {(r["doc_id"], r["item_id"]) for r in got} <= want
    # what every item of a class shares is told once, under its least id
    assert not {r["item_id"] for r in got} & {40, 41}


def test_a_phrase_of_many_items_is_one_row(spark):
    phrase = "choose the one right answer from those that follow here"
    items = spark.range(500).select(F.col("id").alias("item_id"), F.concat(F.lit(phrase + " "), F.md5(F.col("id").cast("string"))).alias("text"))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("please "), F.lit(phrase)).alias("text"))
    got = D.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 0) for i in range(50)]


def test_variants_of_one_question_are_one_class(spark):
    """Items that differ in their numbers or names only give a document one row, and the classes have the rest."""
    said = lambda name, a, b: f"on a cold day {name} walks {a} km and then {b} km more to the old mill, how far in all"
    items = spark.createDataFrame([(i, said(["Anna", "Bob", "Carl"][i % 3], i + 3, 2 * i + 7)) for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"somebody told that {said('Zoe', 90_000 + i, 80_000 + i)} and went away") for i in range(200)], "doc_id long, text string")
    got = D.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 0) for i in range(200)]
    assert D.item_classes(items).groupBy("class").count().collect()[0].asDict() == {"class": 0, "count": 3000}


def test_patterns_of_names_part_classes(spark):
    items = [(1, "so then Anna gave the red ball to Bob and later on Bob gave it back to Anna again"), (2, "so then Anna gave the red ball to Bob and later on Carl gave it back to Dora again")]
    docs = [(1, "so then Eva gave the red ball to Finn and later on Finn gave it back to Eva again"), (2, "so then Eva gave the red ball to Finn and later on Gus gave it back to Hal again")]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # windows without a name are shared by both items and count for the lesser one
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(*frames).where("slots > 0").collect()} == {(1, 1), (2, 2)}
    assert D.item_classes(frames[1]).count() == 2
