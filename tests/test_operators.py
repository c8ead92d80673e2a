"""Operators against small independent models, each with inputs that would expose a wrong rule."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.lexicon import LATIN, RUSSIAN
from lectern.operators import features, profiles, titles, vectors

WORDS = "раскольникова игнорировать книгами девушки желание читается домов ёлка старость утопил собаку Мёртвые души".split()


def test_stems_and_tokens(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS + ["Это был он, и книга про дом!"]], "t string")
    for r in rows.select("t", tx.tokens(F.col("t")).alias("k")).collect():
        assert r.k == RUSSIAN.tokens(r.t), r.t


def brute_titles(query, keys, floor=0.62):
    out = {}
    for book, key in keys:
        if query == key:
            s = 1.0
        elif query in key or key in query:
            s = 0.84 + 0.16 * min(len(query), len(key)) / max(len(query), len(key))
        else:
            q = set(query.split())
            s = max(0.78 * len(q & set(key.split())) / len(q), 0.86 * SequenceMatcher(None, query.replace(" ", ""), key.replace(" ", "")).ratio())
        if s >= floor:
            out[book] = max(out.get(book, 0), s)
    return sorted(((round(s + 1e-12, 4), b) for b, s in out.items()), key=lambda x: (-x[0], x[1]))[:5]


def test_fuzzy_titles_equal_brute_force(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    keys = [(f"b{i:03d}", " ".join(word(rnd.randint(1, 6)) for _ in range(rnd.randint(1, 4)))) for i in range(150)]
    asked = []
    for i in range(60):
        base = list(rnd.choice(keys)[1])
        for _ in range(rnd.randint(0, 3)):
            base[rnd.randrange(len(base))] = rnd.choice("abcde ")
        asked.append((i, " ".join("".join(base).split()) or "a"))
    got = {}
    k = spark.createDataFrame([(b, 0, key) for b, key in keys], "book_id string, ord int, key string")
    for r in titles.title_matches(spark.createDataFrame(asked, "query_id long, query string"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.book_id))
    for i, text in asked:
        assert [b for _, b in got.get(i, [])] == [b for _, b in brute_titles(text, keys)], text


def test_hash_vector_and_centroid(spark):
    import hashlib

    toks = LATIN.tokens("that with from this that with")
    vec = [0.0] * 64
    for t in toks + [f"{a}__{b}" for a, b in zip(toks, toks[1:])]:
        d = hashlib.sha1(t.encode()).digest()
        sign = -1.0 if d[8] % 2 else 1.0
        vec[int.from_bytes(d[:4], "big") % 64] += sign
        vec[int.from_bytes(d[4:8], "big") % 64] += sign * 0.5
    n = math.sqrt(sum(x * x for x in vec))
    got = spark.createDataFrame([("that with from this that with",), ("",)], "t string").select(vx.hash_embedding(tx.tokens(F.col("t"), LATIN), 64).alias("v")).collect()
    assert got[0].v == pytest.approx([x / n for x in vec]) and got[1].v == [0.0] * 64


@pytest.mark.parametrize("block", [1024, 3])
def test_nearest_in_one_block_or_many(spark, monkeypatch, block):
    rnd = random.Random(3)
    books = [(f"b{i}", [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    asked = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(8)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "BOOK_BLOCK", 7 if block == 3 else 8192)
    got = vectors.nearest(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(books, "book_id string, vector array<double>"), 5)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.book_id)
    for i, q in asked:
        best = sorted(books, key=lambda b: (-round(sum(x * y for x, y in zip(q, b[1])), 9), b[0]))[:5]
        assert found[i] == [b for b, _ in best]


def test_decayed_fold_equals_the_loop(spark):
    rnd = random.Random(11)
    books = {f"b{i}": [rnd.random() for _ in range(3)] for i in range(5)}
    events, state = [], {}
    for i in range(300):
        user, action, book = rnd.choice("uv"), rnd.choice(["save", "swipe_left", "skip", "like"]), rnd.choice(list(books))
        events.append((i, user, book, action, f"s{i // 50}", 1_700_000_000 + i * 7000))
        for a, store, strength, decay in profiles.EFFECTS:
            if a == action and store != "session":
                old = state.get((user, store), [0.0] * 3)
                state[(user, store)] = [o * decay + f * strength for o, f in zip(old, books[book])]
    ev = spark.createDataFrame(events, "id long, user_id string, book_id string, action string, session_id string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    got = profiles.feature_stores(ev, spark.createDataFrame(list(books.items()), "book_id string, scores array<double>"), 3)
    rows = {(r.user_id, r.store): r.scores for r in got.where("store <> 'session'").collect()}
    assert set(rows) == set(state)
    for key, want in state.items():
        assert rows[key] == pytest.approx(want, abs=1e-9)


def test_onboarding_state(spark):
    books = spark.createDataFrame([("m", "Муму", "Тургенев", ["повесть"], [0.5] + [0.0] * 27)], "book_id string, title string, author string, genres array<string>, scores array<double>")
    cols = "user_id string, favorite_moods array<string>, favorite_atmosphere array<string>, favorite_tone array<string>, favorite_style array<string>, favorite_plot array<string>, favorite_books array<string>, favorite_genres array<string>, favorite_authors array<string>, avoid_tags array<string>"
    on = spark.createDataFrame([("u", ["тревожное"], [], [], [], ["тайна"], ["Муму"], ["драма"], ["Гоголь"], ["мрачная"])], cols)
    stores, aff = profiles.from_onboarding(on, titles.title_keys(books), books)
    keys = RUSSIAN.feature_keys()
    s = {r.store: dict(zip(keys, r.scores)) for r in stores.collect()}
    assert s["positive"]["mood.тревожное"] == pytest.approx(0.3) and s["positive"]["plot.тайна"] == pytest.approx(0.3)
    assert s["positive"][keys[0]] == pytest.approx(0.5 * 0.42 * 0.5) and s["negative"]["atmosphere.мрачная"] == pytest.approx(0.27)
    a = {(r.store, r.key): r.value for r in aff.collect()}
    assert a[("author_positive", "гоголь")] == pytest.approx(0.85) and a[("author_positive", "тургенев")] == pytest.approx(0.62)


def test_feature_shares(spark):
    r = spark.createDataFrame([("грустный и мрачный дом, тайна",)], "t string").select(features.lexical_scores(tx.tokens(F.col("t"))).alias("s")).first()
    s = dict(zip(RUSSIAN.feature_keys(), r.s))
    assert s["mood.негативное"] == 1.0 and s["atmosphere.мрачная"] == pytest.approx(2 / 3)  # its label is a stem too and s["plot.тайна"] == 1.0
