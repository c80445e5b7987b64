"""Scores, votes, log ratios and mined rules, each against a plain computation."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from eventmill.llm import byte_bpe, lang_id, quality_mil, quality_rules, url_rules
from eventmill.llm import buffers as B

from . import samples


def test_attention_scores_against_loops():
    r = random.Random(2)
    texts = [" ".join(samples.words(r, n)).encode() for n in (1, 63, 64, 65, 200, 500)]
    model = quality_mil.Model(3)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    got = model.score(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for text, score in zip(texts, got):
        w = text.split(b" ")
        codes, energy = [], []
        for k in range(0, len(w), 64):
            piece = b" ".join(w[k : k + 64])
            # n-grams run on behind a passage, into the text that follows
            x = quality_mil.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0][k // 64]
            assert x.sum() == len(piece)
            x = np.sqrt((x + 20 / 512) / (len(piece) + 20))
            h = [max(0.0, sum(x[i] * p["encode"][i, j] for i in range(512)) + p["encode_0"][j]) for j in range(32)]
            unit = lambda name, j: sum(h[i] * p[name][i, j] for i in range(32))  # noqa: B023, E731
            energy.append(sum(math.tanh(unit("tanh", j)) / (1 + math.exp(-unit("gate", j))) * p["weigh"][j] for j in range(16)))
            codes.append(h)
        weight = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        z = sum(a * sum(h[j] * p["out"][j] for j in range(32)) for a, h in zip(weight, codes))
        assert abs(score - 1 / (1 + math.exp(-z - p["out_0"][0]))) < 1e-4


def test_a_long_text_scores_the_same_in_pieces(monkeypatch):
    r = random.Random(3)
    data = np.frombuffer(" ".join(samples.words(r, 5000)).encode(), np.uint8)
    model = quality_mil.Model(4)
    at = np.array([0, len(data)])
    whole = model.score(data, at)[0]
    assert abs(model.score_long(data, 640) - whole) < 1e-3
    monkeypatch.setattr(B, "SLICE_BYTES", 1000)
    assert abs(model.score(data, at)[0] - whole) < 1e-3


def test_a_long_text_encodes_the_same_in_pieces(spark, monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        known = byte_bpe.Vocabulary(f.read())
    pieces = [f" word{k % 700}" for k in range(5000)]
    a, b = known.encode_long(iter(pieces), 13), known.encode_long(iter(pieces))
    assert (a == b).all() and known.decode(a) == "".join(pieces).encode()


def test_votes_of_machines_against_loops():
    r = random.Random(4)
    langs = ["en", "de", "nl", "fr", "es", "xx"]
    texts = [(g, " ".join(samples.words(random.Random(f"{g}{k}"), 30)) + f" {g}" * r.randrange(1, 9)) for g in langs for k in range(12)]
    raw = [t.encode() for _, t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    model = lang_id.fit(lang_id.features(data, at), [g for g, _ in texts])
    lang, score = lang_id.predict(model, data, at)
    x = lang_id.features(data, at)
    x /= x.sum(axis=1, keepdims=True)
    families = {f: sorted(g for g in langs if lang_id.family(g) == f) for f in sorted({lang_id.family(g) for g in langs})}

    def contest(name, members, row):
        votes, sure = Counter({m: 0.0 for m in members}), {m: 1.0 for m in members}
        for a, b in itertools.combinations(members, 2):
            w = model.machines[name, a, b].astype(np.float64)
            p = 1 / (1 + math.exp(-3 * (float(row @ w[:-1]) + w[-1])))
            votes[a] += (p >= 0.5) + 1e-3 * p
            votes[b] += (p < 0.5) + 1e-3 * (1 - p)
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(members, key=lambda m: votes[m])
        return best, sure[best]

    for row, g, s in zip(x.astype(np.float64), lang, score):
        f, one = contest("", list(families), row)
        best, two = contest(f, families[f], row)
        assert g == best and abs(s - min(one, two)) < 1e-3


def test_log_ratios_against_counts(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["Alpha", "beta", "é", "x"]) + str(r.randrange(30)) for _ in range(r.randrange(90))) for _ in range(60)]
    df = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string")

    def buckets(text):
        w = [x.encode() for x in text.lower().split()]
        h = lambda *xs: xxhash.xxh64(xs[-1], seed=42 if len(xs) == 1 else h(*xs[:-1])).intdigest()
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        grams = [(x,) for x in w] + list(zip(w, w[1:]))
        return [signed(h(*g)) % quality_rules.BUCKETS for g in grams]

    target, raw = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        target.update(buckets(t) if i % 3 == 0 else [])
    n, m = sum(target.values()) + quality_rules.BUCKETS, sum(raw.values()) + quality_rules.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / n) - math.log((raw[b] + 1) / m)
    for row in quality_rules.quality_rules(df, df.where("doc_id % 3 = 0").select("doc_id")).collect():
        g = buckets(texts[row["doc_id"]])
        want = sum(map(weight, g)) / len(g) if g else 0.0
        assert abs(row["llr"] - want) < 1e-9
        assert row["kept"] == (not row["base_failed"] and want >= quality_rules.THRESHOLD) or abs(want - quality_rules.THRESHOLD) < 1e-9


def _plain_rules(baskets, lift=url_rules.MIN_LIFT):
    """All rules by counting every set of tokens."""
    n, blocked = len(baskets), sum(b for _, b in baskets)
    base, least = blocked / n, max(url_rules.MIN_SUPPORT, url_rules.MIN_URLS / n) * n
    seen, hit = Counter(), Counter()
    for tokens, block in baskets:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                seen[s] += 1
                hit[s] += block

    def strong(s):
        p, m, z = hit[s] / seen[s], seen[s], url_rules.DEVIATIONS
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        return hit[s] >= least - 1e-9 and p >= lift * base and low > base

    rules = {s: hit[s] / seen[s] for s in seen if strong(s)}
    rules = {s: c for s, c in rules.items() if not any(rules.get(t, -1) >= c for t in itertools.combinations(s, len(s) - 1))}
    own, own_hit = Counter(), Counter()
    for tokens, block in baskets:
        held = [s for s in rules if set(s) <= tokens]
        if held:
            best = max(held, key=lambda s: (rules[s], hit[s], s))
            own[best] += 1
            own_hit[best] += block
    return {s for s in rules if own[s] and own_hit[s] >= lift * base * own[s]}


def test_mined_rules_against_counting_all_sets(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        host = r.choice(["a", "b", "c", "d"])
        word = r.choice(["buy", "read", "win"])
        rows.append((i, f"http://{host}.org/{word}", r.random() < (0.8 if (host, word) in (("a", "buy"), ("c", "win")) else 0.5 if host == "d" else 0.1)))
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    baskets = [(set(x["t"]), x["block"]) for x in df.select("block", url_rules.tokens(F.col("url")).alias("t")).collect()]
    want = _plain_rules(baskets)
    rules = url_rules.mine_rules(df)
    assert {tuple(x["antecedent"]) for x in rules.collect()} == want and len(want) >= 2
    got = {x["page_id"]: x["verdict"] for x in url_rules.filter_urls(df, rules, []).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for (i, _, _), (t, _) in zip(rows, baskets) if any(set(s) <= t for s in want)}


def test_only_planted_rules_survive_noise(spark):
    """Hundreds of tokens that say nothing, and one that does: corrected and held out, only that one blocks."""
    r = random.Random(8)
    rows = []
    for i in range(6000):
        bad = r.random() < 0.2
        word = "casino" if bad and r.random() < 0.5 or r.random() < 0.01 else r.choice("abcdefgh")
        rows.append((i, f"https://h{r.randrange(40)}.example{r.randrange(9)}.org/{word}/p{r.choice('klmnop')}/{r.choice('uvwxyz')}x", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    kept = {tuple(x["antecedent"]) for x in url_rules.mine_rules(df, false_rate=0.05, held_out=True).collect()}
    assert ("path:casino",) in kept and all("path:casino" in x for x in kept)
    noise = spark.createDataFrame([(i, u, r.random() < 0.2) for i, u, _ in rows], "page_id long, url string, block boolean")
    assert url_rules.mine_rules(noise).count() > 0 and url_rules.mine_rules(noise, false_rate=0.05, held_out=True).count() == 0


def test_training_is_bounded_in_bytes_and_languages(spark, monkeypatch):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["good", "fine", "well"] if i % 2 else ["spam", "buy", "now"]) for _ in range(40 if i else 40_000))) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality_mil, "SAMPLE_BYTES", 5000)
    seen = []
    fit = quality_mil.fit
    monkeypatch.setattr(quality_mil, "fit", lambda bags, y: seen.append(sum(len(b) for b in bags)) or fit(bags, y))
    quality_mil.score(docs, quality_mil.train(docs, labels)).count()
    assert 0 < seen[0] <= 40  # texts of about 190 bytes; the long one isn't drawn
    many = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.when(F.col("id") < 200, F.col("id") % 2).otherwise(F.col("id")).cast("string")).alias("lang"), F.concat(F.when(F.col("id") % 2 == 0, "alpha beta ").otherwise("gamma delta "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(lang_id, "LANGUAGES", 2)
    model = lang_id.train(many)
    assert {str(x) for own in model.contests.values() for x in own if x} == {"l0", "l1"}
    got = lang_id.identify(many.where("doc_id < 200"), model).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in got) > 190
