"""Text column functions: cleaning, tokens, keys, chunks, snippets, ids."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon as lx
from lectern.functions import patterns as pt
from lectern.functions.binding import indexes, let
from lectern.lexicon import Lexicon, RUSSIAN

BLANKS = " \n\t\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def fold(c: Column) -> Column:
    """Lower case with ё folded to е."""
    return F.translate(F.lower(c), "ё", "е")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(fold(strip(F.coalesce(c, F.lit("")))), r"\s+", " ")


def clean_text(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one space, at most one empty line, stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def raw_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pt.WORD}+)"), F.lit(1))


def stem_text(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Every word of the text reduced to its stem, in one pass."""
    pattern = pt.suffix_pattern(lex.suffixes)
    return F.regexp_replace(fold(c), pattern, "") if pattern else fold(c)


def normalize_word(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    return stem_text(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_]+", ""), lex)


def tokens(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Stemmed tokens without stop words."""
    pattern = pt.token_pattern(lex.stop_words)
    return F.regexp_extract_all(stem_text(F.coalesce(c, F.lit("")), lex), F.lit(f"({pattern})"), F.lit(1))


def match_text(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    return F.array_join(tokens(c, lex), " ")


def keywords(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Plain words longer than two letters that are not query filler."""
    words = F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({pt.token_pattern(lex.keyword_stop_words)})"), F.lit(1)
    )
    return F.filter(words, lambda w: F.length(w) > 2)


def unique_by(values: Column, key, limit: int | None = None) -> Column:
    """Keep the first value of every key, in order; blank values and blank keys go."""
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: strip(F.coalesce(v, F.lit(""))))
    pairs = F.transform(cleaned, lambda v: F.struct(v.alias("v"), key(v).alias("k")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & (p["k"] != ""))

    def firsts(ps):
        keys = F.transform(ps, lambda q: q["k"])
        kept = let(keys, lambda ks: F.filter(ps, lambda p, i: F.array_position(ks, p["k"]) == i + 1))
        return F.transform(kept, lambda p: p["v"])

    out = let(pairs, firsts)
    return F.slice(out, 1, limit) if limit is not None else out


def dedupe_texts(values: Column, lex: Lexicon = RUSSIAN, limit: int | None = None) -> Column:
    return unique_by(values, lambda v: match_text(v, lex), limit)


def unique_labels(values: Column, limit: int | None = None) -> Column:
    return unique_by(values, normalize_label, limit)


def split_list(c: Column) -> Column:
    """A list written as text, split on , ; | or / and deduplicated by label."""
    return unique_labels(F.split(F.coalesce(c, F.lit("")), r"[,;|/]+"))


def source_lines(c: Column) -> Column:
    """Non-empty distinct lines in order."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip)
    return F.array_distinct(F.filter(lines, lambda v: v != ""))


# ---- keys of titles -------------------------------------------------------
def romanize(c: Column) -> Column:
    c = F.lower(c)
    singles = {k: v for k, v in lx.CYRILLIC_TO_LATIN.items() if len(v) == 1}
    for letter, latin in lx.CYRILLIC_TO_LATIN.items():
        if len(latin) > 1:
            c = F.replace(c, F.lit(letter), F.lit(latin))
    drop = "".join(k for k, v in lx.CYRILLIC_TO_LATIN.items() if not v)
    c = F.translate(c, "".join(singles) + drop, "".join(singles.values()))
    return F.btrim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def lookup_key(c: Column) -> Column:
    c = F.regexp_replace(romanize(F.coalesce(c, F.lit(""))), r"\b(txt|fb2|pdf|epub|dataset)\b", " ")
    return F.btrim(F.regexp_replace(c, r" +", " "))


def file_stem(c: Column) -> Column:
    """Base name without its last extension."""
    base = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def title_variants(*candidates: Column) -> Column:
    """Lookup keys of every spelling of a title, plus the part after the first underscore."""
    raw = F.transform(F.filter(F.array(*candidates), lambda v: v.isNotNull() & (v != "")), file_stem)
    tails = F.transform(F.filter(raw, lambda v: v.contains("_")), lambda v: F.regexp_replace(v, r"^[^_]*_", ""))
    keys = F.transform(F.concat(raw, tails), lookup_key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


# ---- chunks ---------------------------------------------------------------
def chunk_texts(c: Column, separator: str = r"\n\s*\n", target: int = 1200, overlap: int = 180) -> Column:
    """Pack paragraphs into chunks of about `target` characters that share an overlap."""
    paragraphs = F.filter(F.transform(F.split(c, separator), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"))

    def step(acc, p):
        flush = (acc["cur"] != "") & (acc["size"] + F.length(p) + 2 > target)
        tail = strip(F.right(acc["cur"], F.lit(overlap)))
        packed = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        restart = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush, restart).otherwise(packed).alias("cur"),
            F.when(flush, F.length(restart)).otherwise(acc["size"] + F.length(p) + 2).alias("size"),
        )

    def finish(acc):
        chunks = F.concat(acc["done"], F.filter(F.array(acc["cur"]), lambda x: x != ""))
        return F.when(F.size(chunks) > 0, chunks).otherwise(F.filter(F.array(strip(c)), lambda x: x != ""))

    return F.aggregate(paragraphs, empty, step, finish)


# ---- excerpts -------------------------------------------------------------
def excerpt(compact: Column, start: Column, end: Column) -> Column:
    """Cut [start, end) of a text widened to whole words, with ellipses where text is left out."""
    size = F.length(compact)
    back = F.instr(F.reverse(F.substring(compact, F.lit(1), start)), " ")
    left = F.when((start > 0) & (back > 0), start - back + 1).otherwise(start)
    ahead = F.instr(F.substring(compact, end + 1, size), " ")
    right = F.when((end < size) & (ahead > 0), end + ahead - 1).otherwise(end)
    body = F.btrim(F.substring(compact, left + 1, right - left))
    text = F.concat(F.when(left > 0, "...").otherwise(""), body, F.when(right < size, "...").otherwise(""))
    return F.regexp_replace(text, r"^\.\.\.(\S)", r"... $1")


def head_excerpt(compact: Column, length: int) -> Column:
    return F.concat(
        F.rtrim(F.left(compact, F.lit(length))), F.when(F.length(compact) > length, "...").otherwise("")
    )


def _first_hit(lowered: Column, terms: Column) -> Column:
    """The first of the terms that occurs in the text, or null; the text is not searched beyond it."""
    none = F.lit(None).cast("string")
    look = lambda low: F.aggregate(terms, none, lambda hit, t: F.when(hit.isNotNull(), hit).when(F.contains(low, t), t))
    return let(lowered, look)


def snippet(text: Column, query: Column, max_len: int = 280) -> Column:
    """The neighbourhood of the first query word found, else the beginning of the text."""
    return compact_snippet(squeeze(F.coalesce(text, F.lit(""))), snippet_terms(query), max_len)


def snippet_terms(query: Column) -> Column:
    return F.filter(raw_words(fold(query)), lambda t: F.length(t) > 1)


def compact_snippet(compact: Column, terms: Column, max_len: int = 280) -> Column:
    """`snippet` of a squeezed text and the words of a query, both taken before they were paired."""
    third = max_len // 3

    def cut(compact, lowered, hit):
        pos = F.instr(lowered, hit) - 1
        start = F.greatest(F.lit(0), pos - third)
        end = F.least(F.length(compact), pos + F.length(hit) + (max_len - third))
        return F.when(hit.isNull(), head_excerpt(compact, max_len)).otherwise(excerpt(compact, start, end))

    return let(compact, lambda c: let(fold(c), lambda low: let(_first_hit(low, terms), lambda hit: cut(c, low, hit))))


def preview(text: Column, query: Column | None = None, lex: Lexicon = RUSSIAN) -> Column:
    """340 leading characters, or the neighbourhood of the first query token found."""
    compact = squeeze(F.coalesce(text, F.lit("")))
    if query is None:
        return head_excerpt(compact, 340)

    def cut(c, lowered):
        pos = F.instr(lowered, _first_hit(lowered, tokens(query, lex))) - 1
        start = F.greatest(F.lit(0), pos - 120)
        end = F.least(F.length(c), pos + 220)
        return F.when(pos.isNull(), head_excerpt(c, 340)).otherwise(excerpt(c, start, end))

    return let(compact, lambda c: let(fold(c), lambda low: cut(c, low)))


# ---- overlap of a text with a query ---------------------------------------
def run_lengths(values: Column) -> Column:
    """Distinct values of an array with their counts, computed inside the row: array<struct<term,tf>>."""

    def runs(ordered):
        at = F.filter(indexes(F.size(ordered)), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def counted(starts):
            return F.transform(
                starts,
                lambda p, i: F.struct(
                    F.get(ordered, p).alias("term"),
                    (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - p).alias("tf"),
                ),
            )

        return let(at, counted)

    return let(F.sort_array(values), runs)


def token_coverage(text_tokens: Column, query_tokens: Column) -> Column:
    """struct<coverage, occurrences, density> of a token list against a query."""

    def measure(text, query, common):
        hits = F.size(F.filter(text, lambda t: F.array_contains(common, t)))  # the common words are few, the query's may be many
        return coverage_of(F.size(common), F.size(F.array_distinct(query)), F.when(F.size(common) > 0, hits).otherwise(0), F.size(text))

    return let(text_tokens, lambda text: let(query_tokens, lambda query: let(
        F.array_intersect(query, text), lambda common: measure(text, query, common))))


def coverage_of(found: Column, wanted: Column, occurrences: Column, size: Column) -> Column:
    """struct<coverage, occurrences, density> of a text of `size` tokens that has `found` of the `wanted` distinct words."""
    some = (wanted > 0) & (size > 0)
    return F.struct(
        F.when(some, found / wanted).otherwise(0.0).alias("coverage"),
        F.when(some, occurrences).otherwise(0).alias("occurrences"),
        F.when(some, occurrences / size).otherwise(0.0).alias("density"),
    )


def overlap_score(text_tokens: Column, query_tokens: Column) -> Column:
    return let(token_coverage(text_tokens, query_tokens), overlap_of)


def overlap_of(coverage: Column) -> Column:
    """Score of a `token_coverage`."""
    return coverage["coverage"] + F.least(F.lit(0.25), coverage["density"] * 3.5)


def plain(c: Column) -> Column:
    """Folded text with single blanks."""
    return squeeze(fold(F.coalesce(c, F.lit(""))))


def phrase_bonus(text: Column, text_key: Column, query: Column, query_key: Column) -> Column:
    """1.0 when the normalised query occurs in the normalised text, 0.8 when only the raw one does."""
    return plain_phrase_bonus(plain(text), text_key, squeeze(fold(query)), query_key)


def plain_phrase_bonus(plain_text: Column, text_key: Column, plain_query: Column, query_key: Column) -> Column:
    """`phrase_bonus` of texts that went through `plain` before they were paired."""
    return (
        F.when(query_key == "", 0.0)
        .when(F.contains(text_key, query_key), 1.0)
        .when((plain_query != "") & F.contains(plain_text, plain_query), 0.8)
        .otherwise(0.0)
    )


def sanitize_query(c: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Remove one generic opening and the filler phrases; an emptied query stays as it was."""
    whole = strip(F.coalesce(c, F.lit("")))
    cut = whole
    for prefix in reversed(lex.generic_prefixes):
        rest = F.btrim(F.substring(whole, len(prefix) + 1, 1 << 30), F.lit(" :,.-"))
        cut = F.when(F.startswith(fold(whole), F.lit(prefix)), rest).otherwise(cut)
    for words in lex.filler_patterns:
        cut = F.regexp_replace(cut, rf"(?iu)(?<!{pt.WORD})(?:{words})(?!{pt.WORD})", " ")
    cut = F.btrim(F.regexp_replace(cut, r"\s+", " "), F.lit(" ,.-"))
    return F.when(cut == "", whole).otherwise(cut)


#: What the code points 128 to 159 stand for in web pages.
LATIN_1_CONTROLS = "".join(bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(128, 160))


def code_point(n: Column) -> Column:
    """The character of a code point; the replacement character for one that is none."""
    sound = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return (F.when(n.between(128, 159), F.substring(F.lit(LATIN_1_CONTROLS), (n - 127).cast("int"), F.lit(1)))
            .when(sound, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd"))


def unescaped(c: Column) -> Column:
    """Character references decoded, each once: decimal, hexadecimal, and the names of HTML 4. What is no reference stays.

    A reference starts at an ampersand, so the text is cut there and each piece starts with at most one.
    """
    named = F.from_json(F.lit(json.dumps(name2codepoint)), "map<string,int>")

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^#([0-9]{1,9});?", 1)
        hexed = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,8});?", 1)
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        n = F.when(number != "", number.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(name != "", F.try_element_at(named, name).cast("long"))
        rest = F.regexp_replace(piece, r"^(#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;)", "")
        return F.when(n.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(code_point(n), rest))

    pieces = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def html_text(c: Column) -> Column:
    """Text of an HTML page: no scripts, styles, comments or tags; character references decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<!?/?[A-Za-z][^>]*>", " ")
    return squeeze(unescaped(c))


# ---- ids ------------------------------------------------------------------
def stable_book_id(source_key: Column) -> Column:
    return F.concat(F.lit("dataset_"), F.left(F.sha1(source_key), F.lit(16)))


def text_book_id(title: Column, content: Column) -> Column:
    return F.concat(F.lit("book_"), F.left(F.sha1(F.concat(title, F.lit("\n"), content)), F.lit(16)))


def point_id(raw: Column) -> Column:
    """The id itself when it is a UUID, else UUIDv5 of it in the URL namespace."""
    uuid_like = F.regexp_replace(F.lower(F.btrim(raw)), r"^(?:urn:)?(?:uuid:)?\{?|\}$|-", "")
    ns = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(ns, F.encode(F.btrim(raw), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    v5 = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    digits = F.when(uuid_like.rlike("^[0-9a-f]{32}$"), uuid_like).otherwise(v5)
    return F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def source_key(path: Column, root: str) -> Column:
    """Path below `root` in POSIX form, or the base name when the file lies elsewhere."""
    posix = F.replace(F.regexp_replace(path, r"^file:/+", "/"), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(posix, F.lit(base)), F.substring(posix, len(base) + 1, 1 << 30)).otherwise(
        F.element_at(F.split(posix, "/"), -1)
    )


def member_path(name: Column) -> Column:
    """Archive member path without empty and dot parts; null when it is absolute, climbs up or is empty."""
    raw = F.replace(strip(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    return F.when(
        ~F.startswith(raw, F.lit("/")) & (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/")
    )


def storage_name(name: Column, max_length: int = 180) -> Column:
    """A flat, safe file name from the last three path parts."""
    raw = F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", ".", ".."))
    flat = F.array_join(F.when(F.size(parts) > 3, F.slice(parts, -3, 3)).otherwise(parts), "__")
    safe = F.btrim(F.regexp_replace(flat, r"[^\p{L}\p{N}_.\- ()]+", "_"), F.lit(" ._"))
    safe = F.when(safe == "", "book").otherwise(safe)
    ext = F.regexp_extract(safe, r".(\.[^.]*)$", 1)
    base = F.substring(safe, F.lit(1), F.length(safe) - F.length(ext))
    keep = F.lit(max_length) - F.length(ext)
    base = F.when(
        F.length(base) > keep, F.regexp_replace(F.substring(base, F.lit(1), keep), r"[ ._]+$", "")
    ).otherwise(base)
    return F.concat(F.when(base == "", "book").otherwise(base), ext)


# ---- slugs ----------------------------------------------------------------
def title_case(c: Column) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def slug_text(c: Column) -> Column:
    """A Latin slug written back in Cyrillic, title-cased."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    c = F.lower(F.btrim(F.regexp_replace(F.regexp_replace(c, "[_-]+", " "), r"\s+", " ")))
    for latin, letter in lx.SLUG_PAIRS:
        c = F.replace(c, F.lit(latin), F.lit(letter))
    for latin, letters in lx.SLUG_ENDINGS:
        c = F.regexp_replace(c, rf"{latin}(?![A-Za-z0-9_])", letters)
    singles = {k: v for k, v in lx.SLUG_LETTERS.items() if len(v) == 1}
    for latin, letters in lx.SLUG_LETTERS.items():
        if len(letters) > 1:
            c = F.replace(c, F.lit(latin), F.lit(letters))
    c = F.translate(c, "".join(singles), "".join(singles.values()))
    # The endings below are tied to an ASCII word boundary, which never follows a Cyrillic
    # letter unless an ASCII word character does; so only the two inner fixes apply.
    c = F.replace(F.replace(c, F.lit("йа"), F.lit("я")), F.lit("йу"), F.lit("ю"))
    return title_case(c)


def slug_author_title(title: Column, author: Column) -> Column:
    """struct<title, author>: an `Author_Title_words` slug without an author is split and rewritten."""
    author = F.coalesce(author, F.lit(""))
    is_slug = (author == "") & title.rlike("^[A-Za-z0-9_-]+$") & F.contains(title, F.lit("_"))
    parts = F.filter(F.split(title, "_"), lambda p: p != "")
    known = F.create_map(*[F.lit(x) for kv in lx.SLUG_AUTHORS.items() for x in kv])
    slug = F.get(parts, F.lit(0))
    rest = slug_text(F.array_join(F.slice(parts, 2, 1 << 20), " "))
    named = F.coalesce(F.try_element_at(known, slug), slug_text(slug))
    return F.struct(
        F.when(strip(F.coalesce(title, F.lit(""))) == "", "Рекомендация без названия")
        .when(~is_slug, title)
        .when(F.size(parts) < 2, slug_text(title))
        .otherwise(F.coalesce(F.nullif(rest, F.lit("")), title))
        .alias("title"),
        F.when(is_slug & (F.size(parts) >= 2), named).otherwise(author).alias("author"),
    )
