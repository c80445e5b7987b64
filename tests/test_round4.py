"""Faults that a review of round 4 found."""

import datetime as dt
import difflib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventmill.llm import collocations
from eventmill.operators import calendar, extract, search_index, similar, venues

from .test_round3 import _links_of, _odd_places


def test_events_of_headings_without_letters(spark, tmp_path):
    heads = ["<h1>20.118.157.107 +1 (726) 555-7857</h1>", "<h1>Jazz 1</h1>", "<h1></h1>", "<p>none</p>"]
    rows = [(k, f"http://x.org/{k}", f'<html lang="fr">{heads[k // 4]}') for k in range(16)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = ["url", "name", "start", "image", "location", "performers"]
    ours = sorted(tuple(r) for r in entry.queries()["json_ld_to_event"](spark, str(tmp_path)).select(*columns).collect())
    assert ours == sorted(con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['json_ld_to_event']})").fetchall())
    assert len(ours) == 12 and [r[1] for r in ours].count("") == 9


def test_values_without_a_name_are_events_only_if_asked_for(spark):
    html = [(str(k), f'<script type="application/ld+json">{{"@type":"Event"{x}}}</script>') for k, x in enumerate([',"name":"A","startDate":"2026-01-26"', ',"name":"","startDate":"2026-01-26"', ',"startDate":"2026-01-26"', ',"name":"A"'])]
    picked = extract.pick_event_json_ld(extract.extract_json_ld(spark.createDataFrame(html, "url string, html string")), ["Event"])
    assert [r["url"] for r in extract.json_ld_to_event(picked).collect()] == ["0"]
    assert sorted((r["url"], r["name"]) for r in extract.json_ld_to_event(picked, unnamed=True).collect()) == [("0", "A"), ("1", ""), ("2", "")]


def test_links_of_venues_hold_every_pair(spark, monkeypatch):
    """The pairs that difflib gives, each with its match and score, follow from the links of classes and their members."""
    rows, df = _odd_places(spark)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a or "", b or "").ratio()
    want = {}
    for k, x in enumerate(rows):
        for y in rows[k + 1 :]:
            kinds = _links_of(x, y)
            if any(kinds):
                kind = kinds.index(True)
                want[x[1], y[1]] = (("name", "address", "website")[kind], ratio(x[2 + kind], y[2 + kind]) if kind < 2 else 1.0)
    for small in (similar.SMALL, 9):
        monkeypatch.setattr(similar, "SMALL", small)
        got = venues.link_duplicate_venues(df).collect()
        members, pairs = {}, {}
        for r in got:
            members.setdefault(r["class_id"], []).append(r["slug"])
        at = lambda slug: int(slug[1:])
        for r in got:
            assert (r["linked"] is None) == (r["slug"] != r["class_id"])
            for link in r["linked"] or []:
                pairs |= {(a, b): (link["match"], link["score"]) for a in members[r["class_id"]] for b in members[link["class_id"]] if at(a) < at(b)}
        inside = {(a, b) for own in members.values() for a in own for b in own if at(a) < at(b)}
        assert not inside & set(pairs) and {k: x for k, x in want.items() if k not in inside} == pairs
    assert len(pairs) > 100 and {m for m, _ in pairs.values()} == {"name", "address", "website"}


def test_the_query_of_duplicate_venues_has_the_pairs(spark, tmp_path):
    spark.range(300).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["find_duplicate_venues"](spark, str(tmp_path)).collect()
    assert sum(r["links"] for r in got) == 2 * sum(len(r["linked"]) for r in got) > 0


def test_index_posts_a_text_once(spark, tmp_path):
    """Events of one text share its postings, and two texts of one hash (nulls don't count in it) are both found."""
    at = dt.datetime(2026, 1, 26, 20)
    texts = [("Nuit jazz", "un", "Salle")] * 50 + [(None, "opéra", "Salle"), ("Opéra", None, "Salle"), ("opéra", None, "Salle"), (None, None, "jazz"), ("jazz", None, None), (None, None, None)]
    rows = [(k, *t, at, False, False) for k, t in enumerate(texts)]
    events = spark.createDataFrame(rows, "event_id long, name string, description string, location string, start_ts timestamp_ntz, expired boolean, draft boolean")
    search_index.build(events, f"{tmp_path}/index", 4, 8)
    runs = "nui uit it_ t_j _ja jaz azz zz_ z_u _un un_ n_s _sa sal all lle".split()
    found = search_index.candidates(spark, f"{tmp_path}/index", "nuit").collect()
    assert len(found) == 1 and spark.read.parquet(f"{tmp_path}/index/postings").where(F.col("__text") == found[0]["__text"]).count() == len(runs)
    now = F.lit(at).cast("timestamp_ntz")
    for query, n in (("jazz", 52), ("opera", 3), ("nuit jazz un salle", 50), ("zz", 52), ("zzz", 0)):
        same = lambda df: sorted(r["event_id"] for r in df.collect())
        got = search_index.search(spark, f"{tmp_path}/index", query, now)
        assert same(got) == same(calendar.search_events(events, query, now)) and got.count() == n and got.columns == events.columns


def test_tables_of_counters_grow_with_the_corpus(spark, monkeypatch):
    """Rare pairs don't pass because a table has filled up."""
    r = random.Random(1)
    rows = [(" ".join(f"w{r.randrange(300)}" for _ in range(1000)) + ". a b" * 5, "en") for _ in range(50)]
    seen, before = [], collocations._marks

    def marks(counted, levels, least, kind, buckets):
        out = before(counted, levels, least, kind, buckets)
        seen.append((buckets, {k: int(np.unpackbits(v).sum()) for k, v in out.items()}))
        return out

    monkeypatch.setattr(collocations, "_marks", marks)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 5, 2, buckets=1 << 14).collect()
    assert [b for b, _ in seen] == [1 << 14, 1 << 15] and ("a b", 250) in {(r["phrase"], r["a"]) for r in got}
    few, many = np.zeros(1 << 14, np.uint8), np.arange(1 << 14).astype(np.uint8)
    few[[3, 16_383]] = 100, 7
    for counts, size in ((few, 6), (many, 1 << 14)):
        assert len(data := collocations._packed(counts)) == size
        own = np.ones(1 << 14, np.int64)
        collocations._add(own, data, np.dtype(np.uint8))
        assert (own == counts.astype(np.int64) + 1).all()
