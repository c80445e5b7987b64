"""Each operator over small tables, against brute force, round trips or held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from eventmill.llm import byte_bpe, decontaminate, kd_shard, lang_id, near_dedup, quality_mil, quality_rules, suffix_dedup, url_rules, warc
from eventmill.llm.scratch import Scratch

from . import samples


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(samples.rows(samples.corpus()), samples.SCHEMA).cache()


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets = {i: _shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_runs_are_tasks_and_pieces_are_long(spark):
    """One sorted run for each task, whatever the size of Arrow batches, and places that ascend in it."""
    entries = spark.range(4000).repartition(3).select(*(F.concat(F.lit("k"), (F.col("id") * 7919 % 4000).cast("string")).alias(n) if n == "url_key" else (F.col("id") if n in ("page_id", "offset") else F.lit(None) if n != "captured" else F.lit("2024")).cast(t).alias(n) for n, t in (x.split() for x in warc._ENTRY.split(", "))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = warc.sorted_runs(entries).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = defaultdict(list)
    for r in rows:
        runs[r["run"]].append((r["nth"], r["url_key"]))
    assert len(runs) == 3 and len(rows) == 4000
    for own in runs.values():
        assert [k for _, k in sorted(own)] == sorted(k for _, k in own) and sorted(n for n, _ in own) == list(range(len(own)))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 1_000_000 if block > 3 else 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == _components(samples.corpus())
    assert len({c for _, c in got.values()}) < 36


def test_blocks_end_by_bytes(docs, spark, monkeypatch):
    """Long texts fill blocks by their sets' bytes: the same links, and no pair of blocks over two bounds and a set."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 6000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == _components(samples.corpus())
    placed = spark.range(400).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.col("id").alias("comp"), F.lit(100).alias("size"))
    by_pair = near_dedup._block_pairs(placed, Scratch(spark, "test")).groupBy("key", "part").agg(F.count("*").alias("n"))
    assert by_pair.agg(F.max("n")).first()[0] <= 2 * (6000 // 800 + 1)


def test_large_groups_of_near_copies_stay_in_blocks(spark, monkeypatch):
    """Linked variants beside an outlier: no task gets more than two blocks, and one pair of blocks of one component isn't compared."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    verifier = near_dedup._verifier

    def bounded(percent):
        links = verifier(percent)

        def checked(group):
            assert group.num_rows <= 64  # blocks of the first pass are dealt by hash, and so vary
            return links(group)

        return checked

    monkeypatch.setattr(near_dedup, "_verifier", bounded)
    base = samples.words(random.Random(5), 60)
    texts = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(200)] + [(200 + k, " ".join(f"x{k}" if i % 15 == 7 else w for i, w in enumerate(base))) for k in range(3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _components(texts) and {got[i][1] for i in range(200)} == {0} and got[200][1] == 200


def test_block_pairs(spark, monkeypatch):
    """Every two members of different components meet in a pair of blocks, and none of one component that fills both."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    comp = {r: 0 if r < 20 else r // 3 * 3 for r in range(40)}
    placed = spark.createDataFrame([(7, r, c) for r, c in comp.items()], "key long, rep long, comp long")
    rows = near_dedup._block_pairs(placed, Scratch(spark, "test")).collect()
    sides = defaultdict(lambda: ([], []))
    for r in rows:
        sides[r["part"]][r["half"]].append(r["rep"])
    met = {frozenset((x, y)) for a, b in sides.values() for x in a for y in (b or a) if comp[x] != comp[y]}
    assert met == {frozenset((x, y)) for x in comp for y in comp if comp[x] != comp[y]}
    assert all(max(len(a), len(b)) <= 4 and {comp[r] for r in a + b} != {0} for a, b in sides.values())


def _repeats(texts, length):
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i] = (sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("contexts", [2000, 2])
def test_remove_repeats(docs, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 500_000 if contexts > 2 else 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_PLACES", 100_000 if contexts > 2 else 0)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    want = _repeats([(i, t.encode()) for i, t in samples.corpus()], 400)
    assert got == want
    assert sum(n for n, _, _ in want.values()) > 5000


def test_remove_repeats_as_text_cuts_whole_characters(spark):
    text = "é" * 400
    df = spark.createDataFrame([(1, "x" + text), (2, text)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df, as_text=True).collect()}
    assert kept == {1: "x", 2: ""}


def test_byte_bpe_against_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    texts = [t for _, t in samples.corpus()] + [t for _, t in samples.EDGES] + ["<|endoftext|>", "a" * 3000, "".join(chr(r.randrange(32, 0x3000)) for _ in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path).collect():
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == known.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_cache_starts_afresh_when_full(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = byte_bpe.Vocabulary(f.read())
    for k in range(5):
        v.learn({f"word{k}{i}" for i in range(8)})
        assert len(v.cache) <= 10


def test_shards(spark, docs):
    rows = kd_shard.assign_shards(docs, 7).collect()
    texts = dict(samples.corpus())
    assert len(rows) == len(texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(load.values()) / 7, max(r["size"] for r in rows)
    assert set(load) <= set(range(7)) and all(abs(load[k] - mean) <= 3 * largest for k in range(7))


def test_shards_cut_through_a_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(kd_shard, "SLOT_ROWS", 50)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = kd_shard.assign_shards(df, 24).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n"), F.count_distinct("slot").alias("d")).collect()
    assert len(got) == 24 and all(r["m"] == r["n"] - 1 and r["d"] == r["n"] for r in got)
    assert max(r["b"] for r in got) - min(r["b"] for r in got) <= 50


ITEM = "A train leaves Paris at 30 km per hour and meets Alice after 3 hours; how far did Alice go by then?"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contaminated(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    texts = [
        (1, "Before it. A train leaves Rome at 45 km per hour and meets Bob after 7 hours; how far did Bob go by then? After."),
        (2, "A train leaves Rome at 45 km per hour and meets Bob after 7 hours; how far did Carol go by then?"),  # Alice can't be two people
        (3, ITEM.lower().replace(" alice", " Alice").replace("paris", "Paris")), (4, None), (5, ""), (6, "nothing of the kind, but a text of many common words for all that"),
        (7, "... five short words here now! and more"), (8, "a train leaves Paris"),
    ]
    items = [(1, ITEM), (2, "Five short words here now"), (3, None), (4, "too short")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (3, 1), (7, 2)}


def test_contaminated_without_items(spark, docs):
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_quality_rule_counts(spark):
    r = random.Random(8)
    texts = [t for _, t in samples.corpus()] + [t for _, t in samples.EDGES if t is None or len(t) < 40000]
    texts += ["\n".join(r.choice(["a b c", "a b c d", " ", "#*$", "x"]) for _ in range(r.randrange(60))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.quality_rules(df, df.select("doc_id").where("doc_id < 10")).collect():
        t = texts[row["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and row["kept"] in (False, not row["base_failed"])


def test_log_ratio_parts_trusted_from_other_texts(spark):
    r = random.Random(9)
    texts = [(i, " ".join(r.choice("alpha beta gamma delta eps".split() if i % 3 else "### *** $$$ alpha".split()) + str(r.randrange(9)) for _ in range(80))) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {row["doc_id"]: row["llr"] for row in quality_rules.quality_rules(df, df.where("doc_id % 3 > 0 and doc_id < 60").select("doc_id")).collect()}
    assert min(v for k, v in got.items() if k % 3) > max(v for k, v in got.items() if not k % 3)


def test_languages(spark):
    r = random.Random(10)
    stems = {"en": "the and with of ing tion er", "de": "der und mit sch ung keit ein", "fr": "le les et aux ment eau que", "es": "el los ción mente que ado ez"}
    make = lambda g: " ".join("".join(r.choice(stems[g].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))
    rows = [(i, make(g), g) for i, g in enumerate(list(stems) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df.where("doc_id % 3 > 0"), row_key=F.col("doc_id"))
    got = lang_id.identify(df.where("doc_id % 3 = 0").drop("lang"), model).collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_scores(spark):
    r = random.Random(11)
    good = lambda: " ".join(samples.words(r, r.randint(20, 200)))
    bad = lambda: " ".join(x.upper() + "!!" for x in samples.words(r, r.randint(20, 200)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"))
    got = quality_mil.score(df, quality_mil.train(df, labels.where("doc_id % 5 > 0"))).where("doc_id % 5 = 0").collect()
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in got]
    assert sum(right) >= 0.95 * len(right)


def test_gradient_of_the_attention_model():
    import numpy as np

    r = np.random.default_rng(3)
    model = quality_mil.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, at = r.random((7, quality_mil.DIMENSIONS)), np.array([0, 3, 7])
    y, w = np.array([0.0, 1.0]), np.array([0.4, 0.6])

    def loss():
        p = model.forward(x, at)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grad = model.gradient(x, at, y, w)
    for name, g in grad.items():
        flat, at_most = model.p[name].reshape(-1), np.abs(g).argmax()
        before = flat[at_most]
        flat[at_most] = before + 1e-5
        up = loss()
        flat[at_most] = before - 1e-5
        down = loss()
        flat[at_most] = before
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at_most]) < 1e-4 * max(1, abs(g).max())


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_listed_urls(spark):
    urls = {
        "https://A.Example.org/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "x://COM/de/?q=://org/": ("com", "/de/", "com/de/", "block"),
        "http://x.com": ("x.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://org": ("org", "", None, "allow"), "http://x.org?a/b": ("x.org", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double, lookup string")
    for r in url_rules.filter_urls(df, none, RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]]


def test_mined_rules_block_what_they_were_mined_from(spark):
    r = random.Random(12)
    rows = []
    for i in range(600):
        spam = i % 5 == 0
        host = "cheap-pills.example.net" if spam else r.choice(["news", "shop"]) + ".example.net"
        rows.append((i, f"https://{host}/{'buy' if spam else r.choice(['buy', 'read'])}/{i}", spam))
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    rules = url_rules.mine_rules(df)
    assert rules.count() > 0
    got = {x["page_id"]: x["verdict"] for x in url_rules.filter_urls(df, rules, RULES).collect()}
    assert all((got[i] == "block") == spam for i, _, spam in rows)


def test_no_rules_from_few_urls(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", True)], "page_id long, url string, block boolean")
    assert url_rules.mine_rules(df).count() == 0


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "SAMPLES", 2)
    r = random.Random(13)
    htmls = ["<p>a</p>", "", None, "é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nx", "x" * 100_000]
    rows = [(i, r.choice(["http://b.example.org/x?y=1", "https://a.example.org/", None, "http://a.example.org/\nq"]), r.choice([*htmls, f"page {i}"])) for i in range(120)]
    rows += [(5, "http://dup.example.org/", rows[5][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.archive_round_trip(df).orderBy("place").collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows) and len({x["part"] for x in got}) > 1
    payload = {(i): (h or "") for i, _, h in rows}
    for x in got:
        raw = payload[x["page_id"]].encode()
        assert x["payload_bytes"] == len(raw) and x["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        origin = first[payload[x["page_id"]]]
        assert (x["record_type"], x["refers_to"]) == (("response", None) if x["page_id"] == origin else ("revisit", origin))
    assert [x["place"] for x in got] == list(range(len(rows)))
    keys = [(x["url_key"], x["captured"]) for x in got]
    assert keys == sorted(keys)


def test_near_stage_drops_a_pair_at_0_82(spark):
    w = samples.words(random.Random(9), 105)
    texts = [(1, " ".join(w)), (2, " ".join("changed" if i in (30, 70) else x for i, x in enumerate(w)))]
    a, b = (_shingles(t) for _, t in texts)
    assert 0.815 < len(a & b) / len(a | b) < 0.825
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(samples.rows(texts), samples.SCHEMA), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def _leaks(spark, texts, items):
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_contaminated_with_inconsistent_slots(spark):
    """A changed name doesn't hide the other windows, and numbers may fall together or apart."""
    words = samples.words(random.Random(2), 40)
    item = " ".join([*words[:5], "Marie", *words[5:35], "Marie", *words[35:]])
    named = "we saw that Marie and Paul sold old chairs to Marie and then Paul left"
    sums = "a farmer has 3 red apples and then buys 5 more of them while 3 fall down"
    texts = [(1, "x ".join(item.rsplit("Marie", 1)).replace("x ", "Julie", 1)), (2, named[: named.rindex("Paul")] + "Carol left"), (3, sums.replace("3", "4").replace("5", "4")), (4, sums.replace("3", "7", 1).replace("5", "8"))]
    assert _leaks(spark, texts, [(1, item), (2, named), (3, sums)]) == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_contaminated_by_items_without_templates(spark):
    items = [(1, "What is 12 + 37 + 45?"), (2, "7 times 8 is?"), (3, "Convert 5 km 300 m to feet"), (4, "the kings Anna, Bert, Carl, Dora, Emil, Fritz, Gustav, Hans, Ida, Karl"), (5, "Really?")]
    texts = [(i, f"Here it comes: {t} And more of it.") for i, t in items] + [(9, "What is 13 + 37 + 45? 7 times 9 is. Convert 6 km 300 m to feet, kings Anna, Bert, Carl")]
    assert _leaks(spark, texts, items) == {(i, i) for i in range(1, 6)}


def _repeated_words(texts, n):
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = Counter(tuple(m.group() for m in w[i : i + n]) for w in found for i in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, found):
        runs = []
        for i in range(len(w) - n + 1):
            if seen[tuple(m.group() for m in w[i : i + n])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + n
                else:
                    runs.append([i, i + n])
        gone = [(w[a].start(), w[b - 1].end()) for a, b in runs]
        kept, at = b"", 0
        for a, b in gone:
            kept, at = kept + t[at:a], b
        out.append((sum(b - a for a, b in gone), len(gone), kept + t[at:]))
    return out


@pytest.mark.parametrize("contexts", [2000, 2])
def test_repeated_passages_of_words(spark, docs, contexts, monkeypatch):
    """Passages of 50 words, counted beside removed bytes or cut out, against brute force; spaces between words may differ."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_SPANS", 500_000 if contexts > 2 else 0)
    rows = samples.corpus()
    want = dict(zip((i for i, _ in rows), _repeated_words([t.encode() for _, t in rows], 50)))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, length=50, unit="word").collect()}
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 15
    both = suffix_dedup.remove_repeats(docs, passage_words=50).collect()
    bytewise = _repeats([(i, t.encode()) for i, t in rows], 400)
    assert {r["doc_id"]: (r["passage_bytes"], r["n_passages"]) for r in both} == {i: x[:2] for i, x in want.items()}
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in both} == bytewise
    spaced = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "\n".join(map(str, range(5, 57))))], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(spaced, length=50, unit="word", as_text=True).collect()} == {1: "0 1 2 3 4  57 58 59", 2: ""}


def test_shards_keep_equal_texts_together(spark):
    """Only a group over the slack is parted, whatever its rows' languages and sources are."""
    r = random.Random(20)
    rows = [(i, " ".join(samples.words(r, r.randint(5, 60))), r.choice(["en", "fr", None]), f"s{r.randrange(9)}") for i in range(600)]
    rows += [(1000 + i, rows[i % 150][1], r.choice(["en", "fr"]), f"s{r.randrange(9)}") for i in range(400)]
    rows += [(None if i % 2 else 2000 + i, "a heavy group of one text", "en", "s1") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    scratch = Scratch(spark, "test")
    table = kd_shard.points(df, scratch, 12)
    tree = kd_shard.build_tree(table, 12)
    got = table.withColumn("shard", tree.place()).collect()
    parted, weight, members = defaultdict(set), Counter(), Counter()
    load = Counter()
    for x in got:
        parted[x["t1"], x["t2"]].add(x["shard"])
        weight[x["t1"], x["t2"]] += x["size"]
        members[x["t1"], x["t2"]] += 1
        load[x["shard"]] += x["size"]
    largest = max(x["size"] for x in got)
    slack = max(kd_shard.SLACK * sum(load.values()) / 12, largest)
    assert all(weight[k] > slack for k, s in parted.items() if len(s) > 1) and len(parted[weight.most_common(1)[0][0]]) > 1
    assert sum(n > 1 and weight[k] <= slack for k, n in members.items()) > 20
    assert set(load) == set(range(12)) and max(load.values()) - min(load.values()) <= 4 * largest
    _check_cuts(tree, [x.asDict() for x in got], {d: max(x[d] for x in got) - min(x[d] for x in got) for d in kd_shard.DIMENSIONS})


def _check_cuts(node, rows, wide):
    """Each cut, against brute force: on the widest dimension, with no point nearer to the weighted median."""
    if node.left is None or not rows:
        return
    width = {d: (max(x[d] for x in rows) - min(x[d] for x in rows)) / max(1, wide[d]) for d in wide}
    assert width[node.dim] == max(width.values())
    left = [x for x in rows if (x[node.dim], x["tie"]) < (node.value, node.tie)]
    right = [x for x in rows if (x[node.dim], x["tie"]) >= (node.value, node.tie)]
    total = sum(x["size"] for x in rows)
    miss = abs(sum(x["size"] for x in left) - total * (node.leaves // 2) / node.leaves)
    weights = Counter()
    for x in rows:
        weights[x[node.dim], x["tie"]] += x["size"]
    assert miss <= max(weights.values()) / 2 + total * 1e-2
    _check_cuts(node.left, left, wide)
    _check_cuts(node.right, right, wide)


def test_archives_are_gzip_members_that_can_be_sought(spark, tmp_path, monkeypatch):
    """Each offset of the index leads to its record, and a plain gzip reader reads whole archives; a repeated id keeps its payload."""
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://example.org/{i % 3}", "ü" * (i % 4) + "\r\n\r\n") for i in range(60)] + [(7, "http://example.org/7", "another payload"), (8, "http://example.org/8", "ü" * 3 + "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"{tmp_path}/archives"
    warc.write_archives(df, folder, Scratch(spark, "test"))
    files = {p.name: p.read_bytes() for p in tmp_path.glob("archives/part-*")}
    assert len(files) > 4 and max(map(len, files.values())) < 4000
    assert sum(gzip.decompress(b).count(b"WARC/1.0\r\n") for b in files.values()) == len(rows)
    entries = warc.read_archives(spark, folder).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in entries) == sorted((i, len(h.encode())) for i, _, h in rows)
    for r in entries:
        headers, block = warc.parse_record(next(iter(warc._members(files[r["archive"]][r["offset"] :])))[1])
        assert headers["warc-type"] == r["record_type"] and ("warc-refers-to" in headers) == (r["record_type"] == "revisit")
        payload = block.partition(b"\r\n\r\n")[2]
        assert payload == b"" if r["record_type"] == "revisit" else len(payload) == r["payload_bytes"]
    assert {(r["record_type"], r["refers_to"]) for r in entries if r["page_id"] == 7} == {("revisit", 3), ("response", None)}


def test_a_family_below_the_threshold_doesn_t_meet_in_full(spark, monkeypatch):
    """A large group alike in its common words only: sets are compared by rare shingles, not block by block, and links across blocks are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    seen = spark.sparkContext.accumulator(0)
    verifier = near_dedup._verifier

    def counted(percent):
        links = verifier(percent)

        def run(group):
            seen.add(group.num_rows)
            return links(group)

        return run

    monkeypatch.setattr(near_dedup, "_verifier", counted)
    r = random.Random(15)
    base = samples.words(r, 80)
    texts = [(i, " ".join([*base, *samples.words(r, 22)])) for i in range(150)]
    texts += [(200 + i, texts[7 * i][1] + " end") for i in range(20)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _components(texts) and len({c for _, c in got.values()}) == 150
    assert seen.value < 12_000
