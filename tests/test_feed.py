"""Behaviour of whole feeds on short Russian books, and of the smaller operators that feed them."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import terms, vectors
from lectern.plans import candidates, feed
from lectern.plans import search as ps
from lectern.sources import files
from tests.test_search_classics import BOOKS as CLASSICS

MOODS = [
    ("book_1", "Тайна старого дома", "Мрачная усадьба, тайна исчезновения семьи, тревожная атмосфера, расследование и секреты.", "Анна Сумрак", ["детектив", "готика"]),
    ("book_2", "Светлая дорога", "Путешествие, дружба, надежда, теплая атмосфера и преодоление трудностей.", "Илья Рассвет", ["приключение"]),
    ("book_3", "Доктор Живаго", "История любви, тяжелого выбора, философских размышлений и исторических потрясений.", "Борис Пастернак", ["исторический роман"]),
    ("book_4", "Замок тумана", "Таинственный замок, мрачный тон, тревога, скрытый конфликт и расследование древнего секрета.", "Марта Нокс", ["детектив", "готика"]),
]
BOOK = "book_id string, title string, content string, author string, genres array<string>"
REQUEST = ("req_id string, user_id string, mode string, session_id string, recommendation_context string, search_context string, query string, limit int, cursor string, "
           "offset int, seed_book_id string, exclude_book_ids array<string>")


def fed(spark, books, requests, taste=(), lists=(), preferred=None):
    """Cards by request, in order."""
    catalog = spark.createDataFrame(books, BOOK)
    index = ps.build_index(catalog, terms.chunk_table(catalog), dim=64)
    cards = feed.book_cards(index.books, catalog)
    stores = spark.createDataFrame(list(taste), "user_id string, positive array<double>, negative array<double>, recent_positive array<double>, recent_negative array<double>")
    none = spark.createDataFrame([], "user_id string, session_id string, session array<double>")
    affinity = spark.createDataFrame([], "user_id string, store string, key string, value double")
    seen = spark.createDataFrame(list(lists), "user_id string, list string, book_id string")
    named = spark.createDataFrame(preferred, "user_id string, kind string, key string") if preferred else None
    req = feed.with_contexts(spark.createDataFrame(requests, REQUEST))
    ranked = candidates.full_feed(req, catalog, index, cards, stores, none, affinity, seen, named)
    rows = candidates.pages(ranked.cache(), catalog).orderBy("req_id", "place").collect()
    resolved = {r.req_id: r.resolved_query for r in ranked.select("req_id", "resolved_query").distinct().collect()}
    out = {}
    for r in rows:
        out.setdefault(r.req_id, []).append(r.card)
    return out, resolved


def asking(req, query, context="query", **more):
    values = {"mode": "similar", "seed_book_id": None, "exclude_book_ids": []} | more
    return (req, "user-" + req, values["mode"], None, context, None, query, 3, None, 0, values["seed_book_id"], values["exclude_book_ids"])


@pytest.fixture(scope="module")
def moods(spark):
    from lectern.lexicon import RUSSIAN

    keys = RUSSIAN.feature_keys()
    bright = [1.0 if k in ("mood.светлое", "mood.радостное") else 0.0 for k in keys]
    zero = [0.0] * len(keys)
    return fed(spark, MOODS + CLASSICS, [
        asking("asks", "Хочу мрачную книгу с тайной и без романтики"), asking("starts", None, "profile", seed_book_id="book_2"),
        asking("named", None, "profile"), asking("without", None, "profile", exclude_book_ids=["book_3"]), asking("titled", "Доктор Живаго"), asking("tales", "фантастический триллер о ревизских сказках"),
    ], taste=[("user-named", bright, zero, bright, zero)], lists=[("user-without", "seen", "book_1")], preferred=[("user-named", "genre", "готика"), ("user-named", "author", "марта нокс")])


def test_a_query_rules_its_feed(moods):
    cards, resolved = moods
    first = cards["asks"][0]
    assert first.book_id in ("book_1", "book_4") and first.recommendation_context == "query" and first.explanation_mode == "query_explanation"
    assert first.match_reason_context == "query" and first.preview_excerpt and first.why_for_you.startswith("Книга")
    assert resolved["asks"].startswith("Хочу мрачную книгу")


def test_a_title_is_answered_by_the_search_pipeline(moods):
    cards, resolved = moods
    assert cards["titled"][0].book_id == "book_3" and resolved["titled"] == "Доктор Живаго"


def test_profile_feeds(moods):
    cards, resolved = moods
    assert resolved["starts"].startswith("Светлая дорога") and "book_2" in [c.book_id for c in cards["starts"]]
    assert {"готика", "марта нокс"} <= {w for w in ("готика", "марта нокс") if w in resolved["named"]}
    gothic = next(c for c in cards["named"] if c.book_id == "book_4")
    assert "Марта Нокс" in gothic.why_for_you and "готика" in gothic.why_for_you and gothic.score_breakdown.author_boost > 0.8
    assert len(cards["without"]) == 3 and not {"book_1", "book_3"} & {c.book_id for c in cards["without"]}  # one excluded, one seen


def test_a_scene_keeps_its_book_first_and_its_words(moods):
    cards, resolved = moods
    assert cards["tales"][0].book_id == "dead_souls" and resolved["tales"] == "фантастический триллер о ревизских сказках"


def test_admission_in_order(spark):
    rows = [(1, 1, 60), (2, 1, 50), (3, 2, 30), (4, 2, None), (5, 3, 11), (6, 3, 10)]
    uploads = spark.createDataFrame(rows, "id long, uploaded_at int, size_bytes long").repartition(3)
    none = spark.createDataFrame([], "size_bytes long")
    got = {r.id: (r.library_bytes, r.admitted) for r in files.library_admission(uploads, none, 100).collect()}
    assert got == {1: (0, True), 2: (60, False), 3: (60, True), 4: (90, True), 5: (90, False), 6: (90, True)}
    assert files.library_admission(uploads.where("false"), none, 100).collect() == []


def test_admission_walks_few_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 40), rng.randint(1, 100)) for i in range(3000)]
    walked = []
    walk = files._walked
    monkeypatch.setattr(files, "_walked", lambda *a: (walked.append(1), walk(*a))[1])
    uploads = spark.createDataFrame(rows, "id long, uploaded_at int, size_bytes long")
    stored = spark.createDataFrame([(500,), (None,)], "size_bytes long")
    found = {r.id: (r.library_bytes, r.admitted) for r in files.library_admission(uploads, stored, 80_000, block_rows=100).collect()}
    held, want = 500, {}
    for i, _, size in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = (held, held + size <= 80_000)
        held += size if held + size <= 80_000 else 0
    assert found == want and len(walked) <= 6


def test_gate_makes_up_for_what_it_removes(spark):
    rng = random.Random(1)
    books = [(i, [rng.gauss(0, 1) for _ in range(5)], "even" if i % 2 == 0 else "odd") for i in range(300)] + [(300, None, "odd")]
    asked = [(q, books[q][1], kind, 2, barred) for q, kind, barred in ((0, "theme", ["even"]), (1, "title", []), (2, None, None), (3, "mixed", []))]
    nearest = lambda q: sorted((b for b in books if b[1]), key=lambda b: (-round(sum(x * y for x, y in zip(books[q][1], b[1])), 9), b[0]))
    gone = {(3, b[0]) for b in nearest(3)[:20]}  # all of the first k and more
    q = spark.createDataFrame(asked, "query_id int, vector array<double>, qtype string, k int, barred array<string>")
    b = spark.createDataFrame(books, "book_id int, vector array<double>, kind string")
    x = spark.createDataFrame(list(gone), "query_id int, book_id int")
    got = {}
    for r in vectors.gated_nearest(q, b, x).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.book_id)
    want = {0: [b[0] for b in nearest(0) if b[2] == "odd"][:6], 2: [b[0] for b in nearest(2)][:6], 3: [b[0] for b in nearest(3)][20:26]}
    assert got == want


def test_character_references(spark):
    cases = {"&#1234; &#x41;&#X42 &mdash;&nbsp;x": "Ӓ AB —\xa0x", "&amp;lt; &lt;b&gt; &#0; &#xD800; &#150;": "&lt; <b> � � –", "a & b &nosuch; &": "a & b &nosuch; &", "&#128512;": "\U0001F600", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.unescaped(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == cases
