"""Behaviour of search, passports and understanding on four short Russian books."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import terms, understanding
from lectern.plans import search as ps

BOOKS = [
    ("crime_punishment", "Преступление и наказание",
     "Раскольников, бедный студент, убил старуху-процентщицу и ее сестру. После преступления его мучают вина, совесть, страх и раскаяние. "
     "Роман исследует пороки человечества, нравственное падение, бедность и искупление.", "Федор Достоевский", ["роман", "психологический роман"]),
    ("dead_souls", "Мертвые души",
     "Чичиков ездит по помещикам и скупает мертвые души по ревизским сказкам. Это афера о чиновниках, помещиках, бюрократии и социальной сатире.",
     "Николай Гоголь", ["поэма", "сатира"]),
    ("mumu", "Муму",
     "Герасим любит собаку Муму, но по приказу барыни вынужден утопить собаку в реке. Повесть показывает жестокость, сострадание, бесправие и унижение.",
     "Иван Тургенев", ["повесть", "классика"]),
    ("decoy_book", "Зимний берег",
     "Мрачная семейная история о тяжелом выборе, ссорах и одиночестве. В книге нет Раскольникова, ревизских сказок и истории с собакой.",
     "Елена Север", ["драма"]),
]


@pytest.fixture(scope="module")
def index(spark):
    catalog = spark.createDataFrame(BOOKS, "book_id string, title string, content string, author string, genres array<string>")
    return ps.build_index(catalog, terms.chunk_table(catalog), dim=384)


def test_a_part_of_a_name_finds_its_book(spark, index):
    asked = spark.createDataFrame([(1, "раскольник"), (2, "ничего такого")], "query_id int, query string")
    found = ps.fast_entities(asked, index, 3).collect()
    assert [(r.query_id, r.book_id) for r in found if r.rank == 1] == [(1, "crime_punishment")]
    assert found[0].entity >= 0.88


QUERIES = [
    (1, "Раскольников", {"entity"}, "crime_punishment", 1),
    (2, "человек убил процентщицу", {"scene", "specific", "mixed"}, "crime_punishment", 1),
    (3, "ревизские сказки", None, "dead_souls", 1),
    (4, "утопил собаку", None, "mumu", 1),
    (5, "мужчина утопил собаку", None, "mumu", 1),
    (6, "хочу книгу про пороки человечества", {"theme", "recommendation", "mixed"}, "crime_punishment", 3),
]


def test_entities_scenes_and_themes(spark, index):
    asked = spark.createDataFrame([(i, q) for i, q, *_ in QUERIES], "query_id long, query string")
    analysed = ps.analyzed_queries(asked, index)
    types = {r.query_id: r.qtype for r in analysed.select("query_id", "qtype").collect()}
    rows = ps.search(analysed, index, k=3).select("query_id", "rank", "book_id", "snippets").collect()
    for i, query, kinds, book, within in QUERIES:
        if kinds:
            assert types[i] in kinds, query
        top = [r.book_id for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)]
        assert book in top[:within], (query, types[i], top)


def test_passport_of_mumu(index):
    p = index.books.where("book_id = 'mumu'").first()
    assert "утопление" in p.scene_hints and "убийство" not in p.scene_hints
    assert "афера с ревизскими душами" not in p.scene_hints
    themes = set(p.synthetic_queries)
    assert any("жестокость и сострадание" in t for t in themes)
    assert not any("бюрократия и афера" in t or "социальная сатира" in t for t in themes)


def test_negated_names_are_not_entities(index):
    p = index.books.where("book_id = 'decoy_book'").first()
    assert not any("Раскольников" in e for e in p.entities)


def test_avoid_is_understood(spark):
    q = spark.createDataFrame([(1, "Хочу мрачную книгу с тайной и без романтики")], "query_id long, query string")
    u = understanding.understand(q).first()
    assert "романтика" in u.avoid and u.confidence == 0.72 and u.language == "ru"
