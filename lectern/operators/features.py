"""Lexicon features of texts and books: counts, distributions, profiles, dominant labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as pt
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.functions.binding import let
from lectern.lexicon import Lexicon, RUSSIAN, Rule


def unit_hits(tokens: Column, units: list[str]) -> Column:
    """The longest listed stem at the start of each token, for the tokens that have one."""
    singles = sorted({u for u in units if " " not in u})
    if not singles:
        return F.array().cast("array<string>")
    pattern = f"({pt.prefix_pattern(singles)})"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(pattern), F.lit(1))


def _phrase_count(text: Column, phrase: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def unit_counts(tokens: Column, units: list[tuple[str, str]], labels: list[str]) -> Column:
    """array<double> per label: how often its stems start a token and its phrases occur.

    One regex pass finds the longest stem of every token; a token counts for each
    listed stem that the found one starts with.
    """
    singles = sorted({u for _, u in units if " " not in u})

    def total(hits, text, label):
        mine = [u for lab, u in units if lab == label]
        weights = {v: sum(v.startswith(u) for u in mine if " " not in u) for v in singles}
        by_weight: dict[int, list[str]] = {}
        for v, n in weights.items():
            if n:
                by_weight.setdefault(n, []).append(v)
        parts = [F.size(F.filter(hits, lambda h: h.isin(*vs))) * n for n, vs in by_weight.items()]
        parts += [_phrase_count(text, u) for u in mine if " " in u]
        return sum(parts, F.lit(0)).cast("double")

    return let(
        F.array_join(tokens, " "),
        lambda text: let(
            F.regexp_extract_all(text, F.lit(f"({pt.prefix_pattern(singles)})"), F.lit(1)),
            lambda hits: F.array(*[total(hits, text, lab) for lab in labels]),
        ),
    )


def matched_units(tokens: Column, units: list[tuple[str, str]], label: str) -> Column:
    """Distinct stems and phrases of a label found in the tokens."""
    mine = list(dict.fromkeys(u for lab, u in units if lab == label))
    text = F.concat(F.lit(" "), F.array_join(tokens, " "))
    found = F.array(*[F.when(F.contains(text, F.lit(f" {u}" if " " not in u else u)), F.lit(u)) for u in mine])
    return F.array_compact(found)


def category_slices(lex: Lexicon) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for category, feats in lex.features.items():
        out.append((category, at, len(feats)))
        at += len(feats)
    return out


def shares(values: Column, lex: Lexicon) -> Column:
    """Each value as a share of the positive total of its category; zero where the total is zero."""

    def divide(v):
        out = []
        for _, start, size in category_slices(lex):
            positive = [F.greatest(F.get(v, F.lit(start + i)), F.lit(0.0)) for i in range(size)]
            total = sum(positive[1:], positive[0])
            out += [F.when(total > 0, p / total).otherwise(0.0) for p in positive]
        return F.array(*out)

    return let(values, divide)


def lexical_scores(tokens: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Category distributions of a text as an array in `lex.feature_keys()` order."""
    return shares(unit_counts(tokens, lex.feature_stems(), lex.feature_keys()), lex)


def prototype_vectors(spark, lex: Lexicon = RUSSIAN, dim: int = 384) -> list[list[float]]:
    """Hash vectors of the fixed feature descriptions (one per feature of the lexicon)."""
    texts = [(i, f"{c} {f} " + " ".join(ws)) for i, (c, f, ws) in enumerate((c, f, ws) for c, fs in lex.features.items() for f, ws in fs.items())]
    df = spark.createDataFrame(texts, "i int, content string")
    return [r.v for r in df.select("i", vx.hash_embedding(tx.tokens(F.col("content"), lex), dim).alias("v")).orderBy("i").collect()]


def combined_scores(tokens: Column, prototypes: list[list[float]], lex: Lexicon = RUSSIAN, dim: int = 384, threshold: float = 0.16) -> Column:
    """0.7 lexical plus 0.3 cosine to the feature prototypes, as distributions again."""
    protos = F.from_json(F.lit(json.dumps(prototypes)), "array<array<double>>")
    cosines = let(vx.hash_embedding(tokens, dim), lambda e: F.transform(protos, lambda p: vx.dot(e, p)))
    semantic = shares(F.transform(cosines, lambda c: F.when(c >= threshold, c).otherwise(0.0)), lex)
    mixed = F.zip_with(lexical_scores(tokens, lex), semantic, lambda a, b: a * 0.7 + b * 0.3)
    return shares(mixed, lex)


def book_profiles(chunks: DataFrame, lex: Lexicon = RUSSIAN, first: int | None = None) -> DataFrame:
    """(book_id, scores): mean distribution of all non-empty chunks of a book, or of its `first` ones."""
    tokens = F.col("tokens") if "tokens" in chunks.columns else tx.tokens(F.col("content"), lex)
    used = chunks.where(F.length("content") > 0)
    used = used if first is None else used.where(F.col("position") < first)
    scored = used.select("book_id", lexical_scores(tokens, lex).alias("s"))
    means = [F.round(F.avg(F.get("s", F.lit(i))), 9) for i in range(len(lex.feature_keys()))]
    return scored.groupBy("book_id").agg(F.array(*means).alias("scores"))


def as_map(scores: Column, lex: Lexicon = RUSSIAN) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in lex.feature_keys()]), scores)


def from_map(features: Column, lex: Lexicon = RUSSIAN) -> Column:
    """A feature map in fixed key order, missing keys zero."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0.0)) for k in lex.feature_keys()])


def long_form(df: DataFrame, key: str, lex: Lexicon = RUSSIAN, col: str = "scores") -> DataFrame:
    """(key, ord, category, feature, score) rows of a score array."""
    keys = F.array(*[F.lit(k) for k in lex.feature_keys()])
    out = df.select(key, F.posexplode(col).alias("ord", "score")).withColumn("k", F.get(keys, F.col("ord")))
    return out.select(
        key, "ord", F.substring_index("k", ".", 1).alias("category"), F.regexp_replace("k", r"^[^.]*\.", "").alias("feature"), "score"
    )


def dominant(scores: Column, lex: Lexicon = RUSSIAN, threshold: float = 0.12, per_category: int = 2) -> Column:
    """array<struct<category, feature, score>>: the strongest features of each category at or over the threshold."""

    def pick(v):
        parts = []
        for category, start, size in category_slices(lex):
            feats = list(lex.features[category])
            rows = F.array(*[
                F.struct((-F.get(v, F.lit(start + i))).alias("neg"), F.lit(i).alias("ord"), F.lit(category).alias("category"),
                         F.lit(feats[i]).alias("feature")) for i in range(size)
            ])
            parts.append(F.slice(F.sort_array(F.filter(rows, lambda r: -r["neg"] >= threshold)), 1, per_category))
        return F.flatten(F.array(*parts))

    return F.transform(
        let(scores, pick), lambda r: F.struct(r["category"].alias("category"), r["feature"].alias("feature"), (-r["neg"]).alias("score"))
    )


def names_of(dominants: Column, *categories: str) -> Column:
    """Feature names of the categories, in the order the categories are given."""
    picks = [F.transform(F.filter(dominants, lambda d: d["category"] == c), lambda d: d["feature"]) for c in categories]
    return F.concat(*picks)


def richness(scores: Column) -> Column:
    return F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))), 6)


def boost(scores: Column, priorities: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Sum of book score times query weight over the query's priorities (struct category, feature, score)."""
    def total(m):
        weigh = lambda acc, p: acc + F.coalesce(F.try_element_at(m, F.concat_ws(".", p["category"], p["feature"])), F.lit(0.0)) * p["score"]
        return F.aggregate(priorities, F.lit(0.0), weigh)

    return let(as_map(scores, lex), total)


def passes(rules: dict[str, tuple[Rule, ...]], label: str, matched: Column, score: Column) -> Column:
    """Whether a theme or scene label holds: any of its rules, or score >= 1 for a label without rules."""
    if label not in rules:
        return score >= 1.0
    options = []
    for rule in rules[label]:
        cond = score > 0
        for wanted, least in rule.groups:
            cond &= F.size(F.array_intersect(matched, F.array(*[F.lit(w) for w in wanted]))) >= least
        if rule.min_matched:
            cond &= F.size(matched) >= rule.min_matched
        if rule.min_score:
            cond &= score >= rule.min_score
        options.append(cond)
    out = options[0]
    for cond in options[1:]:
        out |= cond
    return out


def ranked_labels(tokens: Column, table: dict[str, tuple[str, ...]], units: list[tuple[str, str]], rules, limit: int) -> Column:
    """array<struct<label, score>> of the labels whose rule holds, best score first, then listing order."""
    labels = list(table)

    def pick(t):
        def with_scores(scores):
            rows = []
            for i, label in enumerate(labels):
                score = F.get(scores, F.lit(i))
                ok = passes(rules, label, matched_units(t, units, label), score)
                rows.append(F.when(ok, F.struct((-score).alias("neg"), F.lit(i).alias("ord"), F.lit(label).alias("label"))))
            return F.slice(F.sort_array(F.array_compact(F.array(*rows))), 1, limit)

        return let(unit_counts(t, units, labels), with_scores)

    return F.transform(let(tokens, pick), lambda r: F.struct(r["label"].alias("label"), (-r["neg"]).alias("score")))


def themes(tokens: Column, lex: Lexicon = RUSSIAN, limit: int = 6) -> Column:
    return ranked_labels(tokens, lex.themes, lex.theme_units(), lex.theme_rules, limit)


def scenes(tokens: Column, lex: Lexicon = RUSSIAN, limit: int = 4) -> Column:
    return ranked_labels(tokens, lex.scenes, lex.scene_units(), lex.scene_rules, limit)


def feature_key(raw: Column, lex: Lexicon = RUSSIAN) -> Column:
    """The first feature whose name equals, contains or is contained in a free-text label; else null."""
    probe = F.lower(tx.strip(raw))
    out = F.lit(None).cast("string")
    for category, feats in reversed(lex.features.items()):
        for label in reversed(feats):
            name = label.lower()
            hit = (probe == f"{category}.{name}") | F.contains(F.lit(name), probe) | F.contains(probe, F.lit(name))
            out = F.when(hit, F.lit(f"{category}.{label}")).otherwise(out)
    return F.when(probe != "", out)
