"""The whole pipeline over a small corpus, against a plain version of every stage."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline

from . import samples
from .test_operators import _repeated_words, _shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    r = random.Random(31)
    text = lambda n: " ".join(samples.words(r, n))
    passage, item = text(60), text(30)
    out = [(i, text(r.randint(20, 120))) for i in range(40)]
    out += [(100 + i, out[i][1]) for i in range(5)]  # exact copies
    out += [(110 + i, out[20 + i][1] + " tail") for i in range(3)]  # near copies
    out += [(120 + i, f"{text(40)} {passage}\n{text(30)}") for i in range(4)]
    out += [(130 + i, f"{text(25)} {item}. {text(25)}") for i in range(3)]
    out += [(140, "12 34 !!"), (141, ""), (142, None), (None, text(50)), (None, out[7][1]), (143, text(60)), (143, text(60))]
    return out, item


def _plain(corpus, item):
    docs = [(i, t) for i, t in corpus if any(c.isalpha() for c in t or "")]
    sets = [_shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(root(k), []).append(k)
    return docs, [docs[k][1] for k in sorted(groups)], groups


def test_run_against_a_plain_version(spark, tmp_path):
    corpus, item = _corpus()
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in corpus]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, kept, groups = _plain(corpus, item)
    assert len(kept) == len(docs) - 9 and all(len(g) <= 2 for g in groups.values())
    cut = [rest.decode() for _, _, rest in _repeated_words([t.encode() for t in kept], 50)]
    assert sum(a != b for a, b in zip(cut, kept)) == 4
    bag = lambda t: re.findall(r"\w+", t.lower())
    inside = lambda t: any(bag(t)[k : k + 8] == bag(item)[j : j + 8] for k in range(len(bag(t)) - 7) for j in range(len(bag(item)) - 7))
    clean = [t for t in cut if not inside(t)]
    assert len(clean) == len(cut) - 3
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [known.encode_ordinary(t) for t in clean]
    want = sorted((len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for x, t in zip(ids, clean))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[143]) == 2 and len(by_id[None]) in (1, 2)
    assert all(r["lang"] == "en" for r in got)
