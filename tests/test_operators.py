"""Operators on small frames: the cases that the given tables don't have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventmill.functions import text as T
from eventmill.operators import calendar as C
from eventmill.operators import classify, duplicates, extract, html_rows, lifecycle, publish, rules, select, venues

NOW = dt.datetime(2026, 1, 20, 12)
EVENT = "source_id string, name string, event_url string, start_ts timestamp_ntz, description string, location string, category string"


def as_of():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def day(n, hour=20):
    return dt.datetime(2026, 1, 20, hour) + dt.timedelta(days=n)


RULES = rules.SelectionRules(
    include_types=("concert", "danse"), exclude_types=("loto",), positive=("jazz",), negative=("annulé",), exclude_locations=("Paris",), local_keywords=("la friche", "vieux-port"),
    category_mapping=(("concert", "musique"), ("danse", "danse")), max_days_ahead=30,
)


@pytest.mark.parametrize("name,start,location,text,criterion", [
    ("Concert de jazz", day(3), "La Friche", "", "positive_keywords"), ("Concert", day(3), "", "", "all_criteria"), ("", day(3), "", "", "required_fields"), ("Concert", None, "", "", "required_fields"),
    ("Concert annulé", day(3), "", "", "negative_keyword"), ("Concert", day(3), "", "spectacle ANNULÉ", "negative_keyword"), ("Grand loto concert", day(3), "", "", "excluded_type"),
    ("Concert à Paris", day(3), "Ailleurs", "", "excluded_location"), ("Concert à Paris", day(3), "la-friche", "", "all_criteria"), ("Concert", day(-1), "", "", "past_date"),
    ("Concert", day(31), "", "", "max_days"), ("Concert", day(30, 0), "", "", "all_criteria"), ("Exposition", day(3), "", "", "no_included_type"),
])
def test_select_events(spark, name, start, location, text, criterion):
    df = spark.createDataFrame([("s", name, "u", start, text, location, "")], EVENT)
    got = select.select_events(df, RULES, as_of()).first()
    assert got["criterion"] == criterion and got["accepted"] == (criterion in ("positive_keywords", "all_criteria"))


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("negative", 2, "b", None), ("negative", 1, "a", None), ("category_mapping", 1, "x", "art")], "rule_set string, ord int, key string, target string")
    got = rules.selection_rules(table, max_days_ahead=5)
    assert got.negative == ("a", "b") and got.category_mapping == (("x", "art"),) and got.max_days_ahead == 5


CLASSES = rules.ClassifierRules(source=(("ballet", "danse"),), venue=(("friche", None), ("opéra", "musique")), words={"danse": ("tango", "classique"), "musique": ("concert", "jazz", "classique"), "theatre": ("pièce",)})


@pytest.mark.parametrize("name,text,location,source,category,confidence", [
    ("Tango", "", "", "Ballet russe", "danse", 0.95), ("Concert de jazz", "", "", "", "musique", 0.95), ("Soirée", "", "", "", "communaute", 0.3),
    ("Classique", "", "", "", "danse", 0.5), ("Soirée", "une pièce", "Opéra", "", "musique", 0.75), ("Soirée", "", "La Friche, opéra", "", "communaute", 0.3), ("Concert jazz", "tango", "Opéra", "", "musique", 0.95),
])
def test_classify_events(spark, name, text, location, source, category, confidence):
    df = spark.createDataFrame([(name, text, location, source)], "name string, description string, location string, source_category string")
    got = classify.classify_events(df, CLASSES).first()
    assert (got["category"], got["confidence"]) == (category, confidence)


def test_extended_rules_leave_the_old_ones_alone():
    more = CLASSES.extended(words={"danse": ("valse",), "art": ("expo",)}, source=(("ballet", "art"),))
    assert more.words["danse"][-1] == "valse" and "art" in more.words and "valse" not in CLASSES.words["danse"] and dict(more.source)["ballet"] == "art"


VENUE = "ord int, slug string, title string, description string, address string, website string, aliases array<string>, search_names array<string>"


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([
        (1, "la-criee", "Théâtre La Criée", "", "30 quai de Rive Neuve", "https://www.criee.example/", ["/locations/criée/"], ["criee theatre national"]),
        (2, "le-cepac-silo", "Le Cepac Silo", "d", "35 quai du Lazaret", "https://silo.example", [], ["silo"]),
        (3, "cepac-silo", "Cepac Silo", "d", "", "http://silo.example/x", [], []), (4, "", "Sans nom", "", "", "", None, None),
    ], VENUE)


def test_resolve_venue(spark, places):
    lookup = venues.build_venue_lookup(places)
    names = ["la criee", "THÉÂTRE LA CRIÉE", "criée", "Au Silo ce soir", "Cepac Silo", "le cepac silo", "Ailleurs", "", None, "grand théâtre la criée, salle 2"]
    got = {r["raw"]: r["venue"] for r in venues.resolve_venue(spark.createDataFrame([(n,) for n in names], "raw string"), "raw", lookup).collect()}
    assert [got[n] for n in names] == ["la-criee", "la-criee", "la-criee", "le-cepac-silo", "le-cepac-silo", "le-cepac-silo", "Ailleurs", "", None, "la-criee"]


def test_duplicate_venues(places):
    got = {(r["a"], r["b"]): r["match"] for r in venues.find_duplicate_venues(places.where("slug <> ''")).collect()}
    assert got == {("le-cepac-silo", "cepac-silo"): "name"}


PUBLISHED = "path string, name string, event_url string, start_ts timestamp_ntz, location string, description string, image string, source_id string, alternate_sources array<string>, source_ids array<string>, last_crawled timestamp_ntz"


def test_detect_and_merge(spark):
    old = spark.createDataFrame([
        ("a.md", "Spectacle de Danse Contemporaine", "https://www.x.org/1", day(5), "klap", "", "", "x:1", [], [], None),
        ("b.md", "Jazz à l'opéra", "https://y.org/2/", day(6), "opera", "texte", "i.jpg", "y:2", [], [], None),
    ], PUBLISHED)
    new = spark.createDataFrame([
        ("z:1", "Autre", "http://x.org/1/", day(9), "", "", ""), ("z:2", "Spectacle de danse contemporaine !", "http://z.org/2", day(5), "d", "Klap", ""),
        ("z:3", "Rien de commun", "http://z.org/3", day(5), "", "klap", ""), ("z:4", "Jazz à l'opéra", "http://z.org/4", day(6, 18), "", "ailleurs", ""), ("z:5", "Jazz à l'opéra", "http://z.org/5", day(7), "", "opera", ""),
    ], EVENT)
    got = {r["source_id"]: (r["path"], r["confidence"], r["should_merge"]) for r in duplicates.detect_duplicates(new, old).collect()}
    assert got == {"z:1": ("a.md", 0.95, True), "z:2": ("a.md", 0.85, True), "z:3": (None, 0.0, False), "z:4": ("b.md", 0.75, False), "z:5": (None, 0.0, False)}
    found = spark.createDataFrame([("a.md", 1, "premier", "", "http://x.org/1/", "z:1"), ("a.md", 2, "second", "j.jpg", "http://z.org/2", "z:2"), ("b.md", 3, "non", "", "https://y.org/2/", "y:2")], "path string, ord int, description string, image string, event_url string, source_id string")
    merged = {r["path"]: r for r in duplicates.merge_duplicates(old, found, as_of()).collect()}
    a, b = merged["a.md"], merged["b.md"]
    assert (a["description"], a["image"], a["alternate_sources"], a["source_ids"]) == ("premier", "j.jpg", ["http://x.org/1/", "http://z.org/2"], ["x:1", "z:1", "z:2"]) and a["last_crawled"] == NOW
    assert b["changes"] == [] and b["last_crawled"] is None and b["source_ids"] == []
    again = {r["path"]: r["changes"] for r in duplicates.merge_duplicates(duplicates.merge_duplicates(old, found, as_of()).drop("changes"), found, as_of()).collect()}
    assert again == {"a.md": [], "b.md": []}


def test_multi_day(spark):
    base = spark.createDataFrame([(1, "Fête", "s:1", day(0, 18))], "event_id long, name string, source_id string, start_ts timestamp_ntz")
    days = spark.createDataFrame([(1, 0, day(20)), (1, 1, day(2))], "event_id long, ord int, day timestamp_ntz")
    got = C.number_multi_day(base, days).orderBy("start_ts").collect()
    assert [(r["day_of"], r["source_id"], r["start_ts"].hour, r["event_group_id"]) for r in got] == [("Jour 1 sur 2", "s:1:day1", 18, "fete-202602"), ("Jour 2 sur 2", "s:1:day2", 18, "fete-202602")]


def test_week_view_has_empty_days(spark):
    df = spark.createDataFrame([(1, day(0)), (2, day(0, 10)), (3, day(6)), (4, day(7)), (5, None)], "event_id long, start_ts timestamp_ntz")
    got = C.week_view(df, as_of()).orderBy("day").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0, 0, 0, 1] and got[0]["label"] == "Aujourd'hui" and got[1]["label"] == "Mer"


def test_expiry_leaves_rows_without_a_date(spark):
    df = spark.createDataFrame([(1, day(-1), False, "i"), (2, day(0), None, ""), (3, None, None, None)], "event_id long, start_ts timestamp_ntz, expired boolean, image string")
    assert {r["event_id"]: r["expired"] for r in lifecycle.mark_expired(df, as_of()).collect()} == {1: True, 2: False, 3: False}
    kept, images = lifecycle.delete_expired(df, as_of())
    assert {r["event_id"] for r in kept.collect()} == {2, 3} and [r["image"] for r in images.collect()] == ["i"]


def test_every_event_has_one_action(spark):
    new = spark.createDataFrame([(i, f"s:{i}", ["A", "A", "", "B"][i % 4], day(i % 2)) for i in range(16)], "ord int, source_id string, name string, start_ts timestamp_ntz")
    dup = new.select("source_id", F.lit(False).alias("is_duplicate"), F.lit(False).alias("should_merge"))
    got = publish.publish_actions(new, dup, spark.createDataFrame([("2026/01/21/b.fr.md",)], "path string"))
    assert got.count() == 16 and {r["action"]: r["n"] for r in publish.publish_stats(got).collect()} == {"created": 2, "skipped_exists": 10, "failed": 4}


CARDS = """<div class="events-container">
<div class="event-card"><h3 class="t"><a href="/e/1">Concert A</a></h3><img src="/a.jpg"><span class="date">26 janvier 2026</span><span class="time">20h30</span><i class="tag">Jazz</i><i class="tag">Live</i></div>
<div class="event-card"><h3 class="t"><a href="/e/2">B &amp; C</a></h3><img data-src="/b.jpg" src="data:x"><span class="date">27/01/2026</span></div>
<div class="event-card"><h3 class="t">sans lien</h3></div></div>"""
SELECTORS = {"container": ".events-container", "item": ".event-card", "name": "h3.t", "link": "h3 a", "date": ".date", "time": ".time", "image": "img", "tags": ".tag"}


def test_extract_by_selectors(spark):
    pages = spark.createDataFrame([("u", CARDS), ("v", "<p>unclosed <b>"), ("w", None)], "url string, html string")
    got = html_rows.extract_by_selectors(pages, SELECTORS).orderBy("link").collect()
    assert [(r["name"], r["link"], r["image"], r["raw_date"], r["tags"]) for r in got] == [("Concert A", "/e/1", "/a.jpg", "26 janvier 2026", ["jazz", "live"]), ("B & C", "/e/2", "/b.jpg", "27/01/2026", [])]
    assert html_rows.extract_by_selectors(pages, SELECTORS | {"container": "", "item": ".none"}).count() == 2


def test_verse_blocks_and_their_events(spark):
    html = '<pre class="wp-block-verse">Du 3 au 5 février<br><strong>Nom</strong><br><strong>Théâtre du Port</strong></pre><pre>Roman, 12 euros, 3 mars</pre><pre>sans date</pre><pre>2 et 3 mars <a href="http://v.org">Le Silo</a></pre>'
    blocks = html_rows.extract_verse_blocks(spark.createDataFrame([("7", html)], "url string, html string"), ["théâtre"], ["euros"])
    rows = {r["block"]: (r["date_text"], r["venue"], r["link"]) for r in blocks.collect()}
    assert rows[0] == ("Du 3 au 5 février", "Théâtre du Port", None) and rows[1][1:] == ("Le Silo", "http://v.org") and len(rows) == 2
    articles = spark.createDataFrame([(7, "A &amp; B", "l", NOW)], "id long, title string, link string, published timestamp_ntz")
    got = extract.articles_to_events(articles, blocks.select(F.col("url").cast("long").alias("id"), "block", "date_text", "venue"), as_of()).collect()
    assert sorted(r["event_id"] for r in got) == ["7-0-20260203", "7-0-20260204", "7-0-20260205", "7-1-20260302", "7-1-20260303"] and got[0]["name"] == "A & B"


def test_json_ld_second_script_and_bad_ones(spark):
    html = """<script type="application/ld+json">{"@type":"Brand"}</script><script type="application/ld+json">{bad</script><script type='application/ld+json'>
    {"@type":"MusicEvent","name":"Nuit","startDate":"2026-01-26T19:00:00Z","image":["i.jpg"],"organizer":{"name":"Org","url":"o"},"location":{"name":"Salle, Ville"},"performer":[{"name":"Un"},{"name":"Deux"}]}</script>"""
    items = extract.extract_json_ld(spark.createDataFrame([("u", html)], "url string, html string"))
    picked = extract.pick_event_json_ld(items, ["MusicEvent"])
    got = extract.json_ld_to_event(picked).first()
    assert (got["name"], got["image"], got["performers"], got["start_ts"]) == ("Nuit", "i.jpg", ["un", "deux"], dt.datetime(2026, 1, 26, 20))
    assert extract.json_ld_to_venue(picked).first()["name"] == "Org"


def test_unknown_extractor():
    with pytest.raises(ValueError, match="unknown extractor"):
        html_rows.extractor("none")
    assert html_rows.extractor("microdata") is html_rows.extract_microdata


def test_duplicate_venues_against_all_pairs(spark):
    """Short names share no run of three letters; every pair is compared by brute force."""
    import difflib
    import random

    r = random.Random(4)
    names = ["klap", "kl ap", "zef", "z ef", "abcdef", "ab cd ef", "klap", "salle verte", "la salle verte", "x", "x"]
    for _ in range(60):
        w = "".join(r.choice("abcd") for _ in range(r.randint(2, 9)))
        names += [w, "".join(c + r.choice(["", "", "", " ", "e"]) for c in w).strip()]
    places = spark.createDataFrame([(i, f"v{i}", n) for i, n in enumerate(names)], "ord long, slug string, title string").selectExpr("*", "'' as address", "'' as website")
    norm = [r["n"] for r in places.orderBy("ord").select(T.normalize_name(T.normalize_venue_text("title")).alias("n")).collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    expected = {(f"v{i}", f"v{j}") for j in range(len(norm)) for i in range(j) if ratio(norm[i], norm[j]) >= 0.85}
    got = venues.find_duplicate_venues(places)
    assert {(r["a"], r["b"]) for r in got.collect()} == expected and {("v0", "v1"), ("v2", "v3"), ("v4", "v5")} <= expected


def test_publish_actions_of_duplicates_and_failures(spark):
    """Only rows that come to make a file count towards its path; a merge without a change is a skip."""
    rows = [(1, "s:1", "A", day(0)), (2, "s:2", "A", day(0)), (3, "s:3", "A", day(0)), (4, "s:4", None, day(1)), (5, "s:5", "B", None), (6, "s:6", "C", day(1)), (7, "s:7", "D", day(1)), (8, "s:8", "D", day(1)), (9, "s:9", "E", day(2))]
    new = spark.createDataFrame(rows, "ord int, source_id string, name string, start_ts timestamp_ntz")
    dup = spark.createDataFrame([("s:1", "old.md", "url", True, True), ("s:1", "older.md", "name_date", True, False), ("s:6", "c.md", "name_date", True, False), ("s:7", "d.md", "url", True, True), ("s:4", "x.md", "url", True, True)], "source_id string, path string, reasons string, is_duplicate boolean, should_merge boolean")
    existing = spark.createDataFrame([("2026/01/22/e.fr.md",)], "path string")
    got = {r["source_id"]: (r["action"], r["file_path"], r["reason"]) for r in publish.publish_actions(new, dup, existing, spark.createDataFrame([("s:1",)], "source_id string")).collect()}
    assert got == {
        "s:1": ("updated", "old.md", "Merged: url"), "s:2": ("created", "2026/01/20/a.fr.md", ""), "s:3": ("skipped_exists", "2026/01/20/a.fr.md", "File already exists"),
        "s:4": ("failed", None, "No name or date"), "s:5": ("failed", None, "No name or date"), "s:6": ("skipped_duplicate", "c.md", "Duplicate: name_date"),
        "s:7": ("skipped_duplicate", "d.md", "Duplicate: url"), "s:8": ("created", "2026/01/21/d.fr.md", ""), "s:9": ("skipped_exists", "2026/01/22/e.fr.md", "File already exists"),
    }


def test_merge_steps(spark):
    old = spark.createDataFrame([("a.md", "Nom", "https://x.org/1", day(5), "klap", "", "", "x:1", [], [], None)], PUBLISHED)
    found = spark.createDataFrame([("a.md", 1, "", "", "https://x.org/1", "x:1"), ("a.md", 2, "texte", "", "https://x.org/1", "x:1"), ("a.md", 3, "autre", "", "https://x.org/1", "x:1"), ("a.md", 4, "", "", "https://y.org", "x:1"), ("a.md", 5, "", "", "https://y.org", None), ("a.md", 6, "", "", "", "y:1")], "path string, ord int, description string, image string, event_url string, source_id string")
    assert {r["ord"]: r["changed"] for r in duplicates.merge_steps(old, found).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_deep_pages_and_implied_ends(spark):
    deep = "<div>" * 100_000 + '<p class="event">x<a href="/e">E</a>' + "</div>" * 100_000
    lists = "<ul><li class=event><a href=/1>Un</a><p>un<p>deux<li class=event><a href=/2>Deux</a></ul><table><tr><td>a<td>b<tr><td>c</table>"
    got = html_rows.extract_by_selectors(spark.createDataFrame([("u", deep), ("v", lists)], "url string, html string"), {"item": ".event", "name": "a", "link": "a"})
    assert sorted((r["url"], r["name"]) for r in got.collect()) == [("u", "E"), ("v", "Deux"), ("v", "Un")]
    root = html_rows.parse(lists)
    assert [x.text() for x in html_rows.find(root, "p")] == ["un", "deux"] and [x.text() for x in html_rows.find(root, "table tr")] == ["a b", "c"] and len(html_rows.find(root, "tr td")) == 3
    assert len(html_rows.find(html_rows.parse(deep), "div div p")) == 1


@pytest.mark.parametrize("item", ["event-card", "event-item", "event", "agenda-item", "my-event-x", "agendas"])
def test_fallback_selectors_in_their_order(item):
    root = html_rows.parse(f'<section class="{item}"><a href="/x">X</a></section>')
    hit = next(s for s in html_rows.ITEM_SELECTORS if html_rows.find(root, s))
    assert hit == {"my-event-x": "[class*='event']", "agendas": "[class*='agenda']"}.get(item, f".{item}")


def test_reason_of_a_class(spark):
    df = spark.createDataFrame([("Concert jazz", "tango", "Opéra", ""), ("Tango", "", "", "Ballet russe"), ("Soirée", "", "", "")], "name string, description string, location string, source_category string")
    got = {r["name"]: (r["reason"], r["is_confident"], r["is_uncertain"]) for r in classify.classify_events(df, CLASSES).collect()}
    assert got == {
        "Concert jazz": ("Matched venue 'opéra', 4 keyword(s) for 'musique'", True, False), "Tango": ("Source category mapped: 'Ballet russe' → danse", True, False),
        "Soirée": ("No category keywords matched, using default", False, True),
    }


def test_letters_never_rule_out_similar_names(spark):
    import difflib
    import random

    r = random.Random(3)
    names = ["".join(r.choice("abé z9") for _ in range(r.randrange(9))) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for x in df.select("a", "b", T.most_similarity(T.letter_counts(F.col("a")), T.letter_counts(F.col("b"))).alias("most"), T.normalized_similarity(F.col("a"), F.col("b")).alias("ratio")).collect():
        assert x["most"] >= x["ratio"] - 1e-9 and abs(x["ratio"] - difflib.SequenceMatcher(None, x["a"], x["b"]).ratio()) < 1e-9


def test_duplicate_venues_by_first_of_each(spark):
    """Without expansion every link between different texts is there, and each further venue hangs on the first of its text."""
    names = ["klap", "kl ap", "klap", "klap", "salle verte", "salle vertes", "autre lieu", "salle verte"]
    places = spark.createDataFrame([(i, f"v{i}", n, "http://x.org" if i in (3, 4, 6) else "") for i, n in enumerate(names)], "ord long, slug string, title string, website string").withColumn("address", F.lit(""))
    got = {(r["a"], r["b"], r["match"]) for r in venues.find_duplicate_venues(places, expand=False).collect()}
    assert got == {("v0", "v1", "name"), ("v0", "v2", "name"), ("v0", "v3", "name"), ("v4", "v5", "name"), ("v4", "v7", "name"), ("v3", "v4", "website"), ("v3", "v6", "website")}
