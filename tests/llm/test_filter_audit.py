"""The filter audit's stream against a plain recount, whatever the order and cut of the files."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventmill.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, key string, part string, n long"
LABELS = "doc_id long, quality int, toxic int"


def _mask(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t))
    return sum(f << k for k, f in enumerate(fails))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab AZ\té #\n\x0b日"), max_size=60), st.integers(1, 30))
def test_masks(text, times):
    assert A.own_mask((text * times).encode()) == _mask(text * times)


def _plain(rows, labels):
    least, marks = {}, defaultdict(lambda: (False, False))
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        marks[i] = marks[i][0] or q == 1, marks[i][1] or x == 1
    out = Counter()
    for i, t, part in rows:
        copy = i is not None and i > least[t or ""]
        out[part or "", _mask(t) | 16 * copy, *marks[i]] += 1
    return out


def _corpus(seed):
    r = random.Random(seed)
    texts = ["", None, "Short text", "one # mark", "ABC DEF", "long " * 300, " ".join(str(i) for i in range(250)), "é" * 3, *(f"text {i}" for i in range(12))]
    rows = [(r.choice([None, *range(60)]) if r.random() < 0.1 else i, r.choice(texts), r.choice(["a", "a", "b", None])) for i in range(200)]
    return [*rows, *rows[:15]], [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in (*range(0, 200, 2), *range(0, 40, 4), None)]


def _files(spark, rows, path, parts, first):
    step = -(-len(rows) // parts)
    for k in range(parts):
        own = [(*x, "clash", "clash", 1) for x in rows[k * step : (k + 1) * step]]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{first}")


@pytest.mark.parametrize("descending", [True, False])
def test_later_files_take_back_what_smaller_ids_make_wrong(spark, tmp_path, descending):
    rows, labels = _corpus(3)
    table = spark.createDataFrame(labels, LABELS)
    if descending:  # most smaller ids come later
        rows.sort(key=lambda r: -(r[0] if r[0] is not None else -1))
    folders = f"{tmp_path}/checkpoint", f"{tmp_path}/counters"
    for k, own in enumerate([rows[:120], rows[120:]]):  # the second call takes up the state of the first
        _files(spark, own, f"{tmp_path}/docs", 2, k)
        docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/docs")
        counts = A.count_masks(docs, table, *folders)
        got = {tuple(r)[:4]: r["n"] for r in counts.collect()}
        assert got == {**_plain(rows[:120] if k == 0 else rows, labels)}
    if descending:
        negative = spark.read.parquet(folders[1]).where("n < 0").count()
        assert negative > 0  # masks were retracted
        _orders(counts, rows, labels)


def _orders(counts, rows, labels):
    got = {(r["part"], r["filter_order"], r["step"]): r for r in A.interactions(counts).collect()}
    own = _plain(rows, labels)
    parts = {p for p, *_ in own}
    assert len(got) == len(parts) * 600
    total = defaultdict(int)
    for (part, _, step), r in got.items():
        order = r["filter_order"]
        before, bit = {A.BIT[f] for f in order[: step - 1]}, A.BIT[order[step - 1]]
        count = lambda keep: sum(n for (p, m, g, t), n in own.items() if p == part and keep(m, g, t))  # noqa: B023, E731
        hit = lambda m: any(m & b for b in before)  # noqa: B023, E731
        want = count(lambda m, g, t: not hit(m) and not m & bit), count(lambda m, g, t: not hit(m) and m & bit), count(lambda m, g, t: hit(m) and m & bit), count(lambda m, g, t: m == bit)  # noqa: B023
        lost = count(lambda m, g, t: g and not hit(m) and m & bit), count(lambda m, g, t: t and not hit(m) and m & bit)  # noqa: B023
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == (*want, *lost)
        total[part, order[step - 1]] += want[1]
    assert all(r["shapley"] == total[p, o[s - 1]] for (p, o, s), r in got.items())
    assert {o for _, o, _ in got} == {"".join(p) for p in permutations("ABCDE")}


def test_folding_keeps_least_rows_and_sums(spark):
    rows = pd.DataFrame([(b"x" * 16, 5, "a", 1, False, False)] * 2 + [(b"x" * 16, 9, "b", 1, True, False)] * 3 + [(b"x" * 16, None, "a", 1, False, False), (b"y" * 16, None, "a", 2, False, True)], columns=["key", "doc_id", "part", "mask", "good", "toxic"])
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    got = {(len(r.key), None if pd.isna(r.doc_id) else int(r.doc_id), r.part, r.mask, r.good, r.toxic): r.n for r in A.folded(rows).itertuples()}
    assert got == {(16, 5, "a", 1, False, False): 2, (2, None, "b", 17, True, False): 3, (2, None, "a", 1, False, False): 1, (2, None, "a", 2, False, True): 1}


def test_a_folder_or_one_file_and_no_rows(spark, tmp_path):
    labels = spark.createDataFrame([], LABELS)
    for rows, want in (([(1, "x", "s", "", "", 1)], 600), ([], 0)):
        path = f"{tmp_path}/docs-{want}.parquet"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        assert A.audit(spark, path, labels).count() == want
