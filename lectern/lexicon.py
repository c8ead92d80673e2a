"""Word lists, rules and markers the operators are parametrised with.

Every list is data: an operator takes a `Lexicon` and compiles it into column
expressions or into a small DataFrame. `RUSSIAN` is the default vocabulary of
the product; `LATIN` covers the four languages of the test tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """One way for a label to pass: every condition that is set must hold."""

    groups: tuple[tuple[tuple[str, ...], int], ...] = ()  # (words, how many of them matched)
    min_matched: int = 0
    min_score: float = 0.0


@dataclass(frozen=True)
class Lexicon:
    name: str
    suffixes: tuple[str, ...]
    stop_words: tuple[str, ...]
    features: dict[str, dict[str, tuple[str, ...]]]
    themes: dict[str, tuple[str, ...]]
    scenes: dict[str, tuple[str, ...]]
    theme_rules: dict[str, tuple[Rule, ...]]
    scene_rules: dict[str, tuple[Rule, ...]]
    generic_prefixes: tuple[str, ...]
    filler_patterns: tuple[str, ...]
    keyword_stop_words: tuple[str, ...]
    entity_stop_words: tuple[str, ...]
    negations: tuple[str, ...]
    recommendation_markers: tuple[str, ...]
    scene_markers: tuple[str, ...]
    theme_markers: tuple[str, ...]
    specific_phrases: tuple[str, ...]
    concept_expansions: dict[str, tuple[str, ...]]
    scene_expansions: dict[str, tuple[str, ...]]
    genre_probes: dict[str, tuple[str, ...]]
    theme_probes: dict[str, tuple[str, ...]]
    constraint_probes: dict[str, str]
    avoid_probes: dict[str, str]
    without_word: str
    comparable_openers: tuple[str, ...]
    asks: tuple[str, ...]
    compares: tuple[str, ...]
    joint_probes: tuple[tuple[tuple[tuple[str, ...], ...], tuple[str, ...], tuple[str, ...]], ...] = ()
    scene_bonuses: tuple[dict, ...] = ()
    extra: dict = field(default_factory=dict)

    # ---- small driver-side helpers: they only ever see the lists above ----
    def stem(self, word: str) -> str:
        word = re.sub(r"[^\w]+", "", word.lower().replace("ё", "е"))
        if len(word) <= 3:
            return word
        for suffix in self.suffixes:
            if word.endswith(suffix) and len(word) - len(suffix) >= 3:
                return word[: -len(suffix)]
        return word

    def tokens(self, text: str) -> list[str]:
        stems = (self.stem(w) for w in re.findall(r"\w+", text.lower().replace("ё", "е")))
        return [s for s in stems if s and s not in self.stop_words]

    def feature_keys(self) -> list[str]:
        return [f"{c}.{f}" for c, feats in self.features.items() for f in feats]

    def feature_stems(self) -> list[tuple[str, str]]:
        """(feature key, stem or phrase); the label itself counts as a stem, and repeats count."""
        rows = []
        for category, feats in self.features.items():
            for label, words in feats.items():
                stems = [self.stem(label)] + [" ".join(self.tokens(w)) for w in words]
                rows += [(f"{category}.{label}", s) for s in stems if s]
        return rows

    @staticmethod
    def _units(lex: "Lexicon", table: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
        rows = [(label, " ".join(lex.tokens(w))) for label, words in table.items() for w in words]
        return [(label, unit) for label, unit in rows if unit]

    def theme_units(self) -> list[tuple[str, str]]:
        return self._units(self, self.themes)

    def scene_units(self) -> list[tuple[str, str]]:
        return self._units(self, self.scenes)


# --------------------------------------------------------------------------
# The Russian vocabulary of the product.
# --------------------------------------------------------------------------
RUSSIAN = Lexicon(
    name="russian",
    suffixes=(
        "иями", "ями", "ами", "ого", "ему", "ими", "ыми", "иях", "ях", "ах", "ость", "ости",
        "ение", "ения", "овать", "ировать", "ание", "ания", "ется", "утся", "ится", "ются",
        "ешь", "ете", "ить", "ать", "ять", "ому", "ий", "ый", "ой", "ая", "яя", "ое", "ее",
        "ые", "ие", "ам", "ям", "ом", "ем", "ую", "юю", "ою", "ею",
        "а", "я", "ы", "и", "о", "е", "у", "ю",
    ),
    stop_words=(
        "про", "книга", "книгу", "книги", "книге", "автор", "сюжет", "прочитать", "найти",
        "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то",
        "все", "она", "так", "из", "за", "вы", "же", "бы", "по", "только", "ее",
        "мне", "было", "вот", "от", "меня", "еще", "о", "об", "ему", "теперь", "когда",
        "быть", "был", "была", "это", "для", "кто", "дом", "год", "купить", "читать",
        "хочу", "посоветуй", "подбери", "нужна", "нужен", "нужно", "почитать", "чтото", "что-то",
        "какой", "какая", "какие", "которой", "который", "есть", "где", "роман", "повесть", "рассказ",
    ),
    features={
        "mood": {
            "позитивное": ("радост", "счаст", "весел", "светл", "добр", "хорош", "юмор", "смешн"),
            "негативное": ("груст", "печал", "мрачн", "темн", "зл", "ужасн", "кошмарн", "безысход"),
            "нейтральное": ("спокойн", "ровн", "обычн", "сдержан"),
            "тревожное": ("тревож", "страшн", "жутк", "пугающ", "опаса", "беспоко", "напряж"),
            "романтичное": ("любов", "нежн", "романтик", "чувств", "сердц", "страст"),
        },
        "style": {
            "диалоговый": ("сказал", "спросил", "ответил", "промолвил", "воскликнул", "диалог"),
            "описательный": ("стоял", "виднел", "казался", "описание", "пейзаж", "портрет"),
            "динамичный": ("вдруг", "внезапно", "быстро", "резко", "мгновенно", "стремительно"),
            "медленный": ("медленно", "долго", "постепенно", "неторопливо", "плавно", "размеренно"),
        },
        "plot": {
            "преодоление": ("преодол", "справил", "победил", "выдержал", "переборол", "одолел"),
            "борьба": ("борьб", "сражен", "битв", "противосто", "сопротивл", "воевал", "конфликт"),
            "путешествие": ("путешеств", "поход", "дорог", "путь", "странств", "поездк"),
            "отношения": ("отношен", "дружб", "любов", "ссор", "примир", "семья", "поколен"),
            "тайна": ("тайн", "загад", "мистик", "секрет", "неизвестн", "расследован"),
            "приключение": ("приключ", "авантюр", "риск", "опасн", "экспедиц"),
        },
        "characters": {
            "герой": ("герой", "спаситель", "защитник", "рыцарь", "избранн"),
            "антигерой": ("антигерой", "циничн", "сломленн", "двусмысленн"),
            "злодей": ("злодей", "враг", "противник", "антагонист", "негодяй"),
            "жертва": ("жертв", "пострадав", "бедняг", "несчастн"),
        },
        "atmosphere": {
            "таинственная": ("тайн", "загад", "мистик", "потусторон", "необъясним"),
            "напряженная": ("напряж", "нервн", "тревож", "взволнованн"),
            "уютная": ("уют", "тепл", "домашн", "комфортн", "приютн"),
            "мрачная": ("мрач", "темн", "гнетущ", "сумрачн", "угрюм"),
            "легкая": ("легк", "воздушн", "непринужд", "свободн"),
        },
        "tone": {
            "ироничный": ("ирони", "насмешк", "сарказм", "язвительн"),
            "серьезный": ("серьезн", "важн", "существенн", "значим"),
            "философский": ("философ", "мудр", "размышл", "смысл"),
            "эмоциональный": ("эмоциональн", "чувствен", "душевн", "переживан"),
        },
    },
    themes={
        "пороки человечества": ("порок", "грех", "гордын", "жадн", "алчн", "лицемер", "завист", "тщеслав", "корыст", "жесток"),
        "вина и раскаяние": ("вина", "совест", "раская", "искуп", "грех", "наказан", "преступл"),
        "бедность и унижение": ("бедност", "нищет", "унижен", "оскорб", "голод", "жалк", "нужд"),
        "социальная сатира": ("сатира", "ирони", "насмеш", "чиновник", "помещик", "общество", "лицемер"),
        "бюрократия и афера": ("ревизск", "душ", "чиновник", "бумаг", "сделк", "афера", "покупк", "помещик"),
        "жестокость и сострадание": ("жесток", "жалост", "милосерд", "сострадан", "мучен", "слез", "слёз"),
        "любовь и ревность": ("любов", "ревност", "чувств", "страст", "сердц"),
        "тайна и расследование": ("тайн", "загад", "следств", "расследован", "секрет"),
        "семья и отношения": ("семья", "брак", "отношен", "муж", "жена", "отец", "мать", "дети"),
        "смерть и трагедия": ("смерт", "похорон", "трагед", "гибел", "кладбищ"),
        "власть и унижение": ("власт", "господин", "барын", "приказ", "подчин", "унижен"),
    },
    scenes={
        "убийство": ("убил", "убий", "зарез", "застрел", "задуш", "топор", "кров"),
        "утопление": ("утоп", "река", "вода", "пруд"),
        "афера с ревизскими душами": ("ревизск", "душ", "помещик", "купил", "мертв"),
        "допрос и признание": ("допрос", "признан", "следовател", "суд", "улика"),
        "унижение бедного человека": ("бедност", "нищет", "унижен", "жалован", "копеек"),
    },
    # Some of the words below never equal a stemmed keyword ("афера", "общество", "вина",
    # "семья", "жена", "дети", "слёз"); they are kept because results depend on it.
    theme_rules={
        "пороки человечества": (
            Rule(groups=((("порок", "грех", "гордын", "жадн", "алчн", "лицемер", "завист", "тщеслав", "корыст"), 1),)),
            Rule(min_matched=2),
        ),
        "бюрократия и афера": (
            Rule(groups=((("ревизск",), 1),)),
            Rule(groups=((("ревизск", "афера", "сделк", "покупк", "чиновник"), 1), (("помещик", "бумаг", "мертв"), 1))),
            Rule(groups=((("ревизск", "афера", "сделк", "покупк", "чиновник"), 2),)),
        ),
        "социальная сатира": (
            Rule(groups=((("сатир", "ирон"), 1),)),
            Rule(groups=((("чиновник", "помещик", "общество", "лицемер"), 3),)),
        ),
        "вина и раскаяние": (
            Rule(groups=((("вина", "совест", "раская", "искуп", "грех"), 1),)),
            Rule(min_matched=3),
        ),
        "семья и отношения": (
            Rule(groups=((("семья", "брак", "отношен", "муж", "жена", "отец", "мать", "дети"), 3),)),
            Rule(min_score=4.0),
        ),
        "любовь и ревность": (
            Rule(groups=((("любов", "ревност", "страст", "сердц"), 1),), min_score=2.0),
            Rule(groups=((("любов", "ревност", "страст", "сердц"), 1),), min_matched=2),
        ),
        "жестокость и сострадание": (
            Rule(groups=((("жесток", "жалост", "милосерд", "сострадан", "мучен"), 1),)),
            Rule(groups=((("слез", "слёз"), 1),), min_matched=2),
        ),
    },
    scene_rules={
        "убийство": (Rule(groups=((("убил", "убий", "зарез", "застрел", "задуш"), 1),)),),
        "утопление": (Rule(groups=((("утоп",), 1),)),),
        "афера с ревизскими душами": (
            Rule(groups=((("ревизск",), 1),)),
            Rule(groups=((("мертв", "душ"), 2),)),
        ),
        "допрос и признание": (Rule(min_matched=2),),
        "унижение бедного человека": (
            Rule(groups=((("бедност", "нищет"), 1), (("унижен", "жалован", "копеек"), 1))),
        ),
    },
    generic_prefixes=(
        "хочу книгу", "хочу почитать", "хочу прочитать", "посоветуй книгу", "подбери книгу",
        "что почитать", "найди книгу", "интересуют книги", "хочу", "мне нужна книга", "мне нужен роман",
    ),
    filler_patterns=(
        "в какой книге|в каком произведении|где есть|найди книгу где|найди произведение где",
        "кто такой|кто такая|как зовут|есть ли книга про",
        "про|о|об|для|мне|пожалуйста",
    ),
    keyword_stop_words=(
        "про", "книгу", "книге", "найди", "хочу", "посоветуй", "что", "где", "как", "кто", "в", "на",
        "с", "о", "или", "и", "мне", "что-то", "то", "книга", "роман", "повесть", "рассказ",
    ),
    entity_stop_words=(
        "он", "она", "они", "его", "ее", "их", "это", "этот", "эта", "эти", "там", "тут", "вот",
        "после", "потом", "если", "когда", "который", "которая", "которые", "однажды", "один", "одна",
        "утром", "вечером", "ночью", "днем", "понедельник", "вторник", "среда", "четверг",
        "пятница", "суббота", "воскресенье", "январь", "февраль", "март", "апрель", "май", "июнь",
        "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь", "бог", "господь", "господи",
        "роман", "повесть", "поэма",
    ),
    negations=("нет", "без", "не было", "не был"),
    recommendation_markers=(
        "хочу", "посоветуй", "подбери", "что почитать", "интересуют", "что-то", "что то",
        "мрач", "тревож", "атмосфер", "настроен", "сюжет", "похож", "напомина",
    ),
    scene_markers=(
        "убил", "убийство", "утопил", "утопила", "процентщиц", "ревизск", "собак", "барын",
        "души", "застрелил", "задушил", "обманул",
    ),
    theme_markers=(
        "порок", "грех", "вина", "раская", "человечеств", "морал", "нравствен", "смысл",
        "обществен", "лицемер", "жесток", "жадн",
    ),
    specific_phrases=(
        "в какой книге", "в каком произведении", "где есть", "кто такой", "кто такая",
        "как зовут", "найди книгу где",
    ),
    concept_expansions={
        "пороки человечества": ("грех", "вина", "раскаяние", "жадность", "лицемерие", "зависть", "жестокость", "нравственное падение", "совесть"),
        "моральное падение": ("вина", "грех", "совесть", "раскаяние", "искупление", "преступление"),
        "вина и раскаяние": ("совесть", "искупление", "преступление", "грех", "наказание"),
        "социальная сатира": ("чиновники", "помещики", "афера", "лицемерие", "общество"),
        "жестокость": ("унижение", "сострадание", "милосердие", "бесправие"),
    },
    scene_expansions={
        "утопил собаку": ("утопление", "муму", "герасим", "барыня"),
        "мужчина утопил собаку": ("утопление", "муму", "герасим", "барыня"),
        "утопила собаку": ("утопление", "муму", "герасим", "барыня"),
        "ревизские сказки": ("мертвые души", "чичиков", "ревизские души"),
    },
    genre_probes={
        "детектив": ("детектив",),
        "триллер": ("триллер",),
        "фэнтези": ("фэнтези", "fantasy"),
        "фантаст": ("фантастика", "sci-fi"),
        "роман": ("роман", "отношения"),
        "драма": ("драма",),
        "хоррор": ("хоррор", "ужас"),
        "готик": ("готика",),
        "историч": ("исторический роман",),
    },
    theme_probes={
        "пороки человечества": ("пороки человечества", "вина и раскаяние", "бедность и унижение"),
        "моральное падение": ("вина и раскаяние", "пороки человечества"),
        "вина": ("вина и раскаяние",),
        "раскаяние": ("вина и раскаяние",),
        "ревизские сказки": ("бюрократия и афера", "социальная сатира"),
        "утопил собаку": ("жестокость и сострадание",),
        "процентщицу": ("вина и раскаяние", "пороки человечества"),
    },
    constraint_probes={
        "коротк": "короткая", "быстр": "динамичная", "легк": "легкая",
        "сильн": "сильный сюжет", "атмосфер": "атмосферная",
    },
    avoid_probes={
        "романтик": "романтика", "детектив": "детектив", "маг": "магия", "мистик": "мистика",
        "насили": "насилие", "жест": "жестокость", "политик": "политика",
    },
    without_word="без",
    comparable_openers=("как", "в духе", "похоже на"),
    asks=("что почитать", "посоветуй", "подбери", "хочу"),
    compares=("похоже на", "как у", "в духе"),
    joint_probes=(
        ((("ревизск",), ("сказ", "душ")), ("бюрократия и афера", "социальная сатира"), ()),
        ((("утоп",), ("собак",)), ("жестокость и сострадание",), ("утопление",)),
    ),
    scene_bonuses=(
        {"bonus": 0.9, "expanded": ("утоп",), "text": ("утоп",)},
        {"bonus": 2.2, "expanded": ("утоп",), "scene": ("утоп",)},
        {"bonus": 0.8, "query": ("собак",), "text": ("муму",)},
        {"bonus": 0.35, "query": ("собак",), "text": ("собак",)},
        {"bonus": 1.1, "query_any": ("утоп", "собак"), "text": ("герасим", "муму")},
        {"bonus": 3.6, "query": ("утоп", "собак"), "scene": ("утоп",)},
        {"bonus": 2.4, "query": ("утоп", "собак"), "text": ("муму",)},
        {"bonus": 1.2, "query": ("утоп", "собак"), "text": ("герасим",)},
    ),
)

# --------------------------------------------------------------------------
# Our own vocabulary for the Latin-script test tables: frequent stems, so that
# every rule and every score of the operators is exercised.
# --------------------------------------------------------------------------
LATIN = Lexicon(
    name="latin",
    suffixes=("keit", "heit", "ment", "tion", "lich", "ción", "ing", "ung", "ly", "ed", "es", "en", "er"),
    stop_words=("the", "of", "and", "to", "a", "in", "is", "it", "on", "la", "de", "le", "les", "et",
                "der", "die", "und", "el", "y", "que", "est", "zu", "un", "en"),
    features={
        "mood": {"that": ("thatin", "that"), "with": ("with", "avec"), "from": ("from", "pour", "para")},
        "style": {"this": ("this", "elle"), "sich": ("sich", "eine"), "than": ("than", "thre")},
        "plot": {"orre": ("orre", "rewh"), "ther": ("ther", "thon"), "aich": ("aich", "éque")},
        "characters": {"hehe": ("hehe", "thor"), "ench": ("ench", "erte"), "ciónue": ("ciónue", "asas")},
        "atmosphere": {"inor": ("inoran", "inor"), "thes": ("thes", "thea"), "enau": ("enau", "ente"), "oran": ("oran",)},
        "tone": {"onon": ("ononst", "onon"), "erin": ("erin", "eron"), "anea": ("anea", "ered")},
    },
    themes={
        "that with": ("that", "with", "from"),
        "pour dans": ("pour", "dans", "avec", "éque"),
        "nicht sich": ("nicht", "sich", "eine"),
        "para ción": ("para", "ciónue", "asas", "mente"),
        "thth": ("thth", "than", "thon"),
        "rare pair": ("rewh", "hehely", "oran"),
        "from with": ("from with", "with that", "ononst"),
    },
    scenes={
        "orre": ("orre", "rewh", "inoran"),
        "erte": ("erte", "ench", "enau"),
        "aich": ("aich", "éeau", "ouai"),
        "thin": ("thin", "thor", "thed"),
        "asas": ("asas", "osos", "cira"),
    },
    theme_rules={
        "that with": (Rule(groups=((("that", "with"), 2),), min_score=6.0),),
        "pour dans": (Rule(groups=((("pour", "avec"), 1),), min_score=2.0), Rule(min_matched=3)),
        "nicht sich": (Rule(groups=((("nicht",), 1), (("sich", "eine"), 1))),),
        "thth": (Rule(min_matched=3), Rule(min_score=4.0)),
    },
    scene_rules={
        "orre": (Rule(groups=((("orre", "rewh"), 2),)),),
        "erte": (Rule(min_matched=2),),
        "thin": (Rule(groups=((("thin",), 1), (("thor", "thed"), 1))),),
    },
    generic_prefixes=("that", "with the", "with", "pour"),
    filler_patterns=("of the|and the|de la", "in the|on the", "of|to|de|la"),
    keyword_stop_words=("the", "and", "that", "with", "les", "des", "der", "die", "und", "que", "est"),
    entity_stop_words=("the", "and", "les", "des", "der", "die", "das", "los", "las", "for", "was"),
    negations=("not", "nicht", "pas", "no"),
    recommendation_markers=("with", "pour", "sich", "para"),
    scene_markers=("orre", "rewh", "aich", "erte", "asas"),
    theme_markers=("thth", "than", "nicht", "dans"),
    specific_phrases=("of the", "dans la", "in der"),
    concept_expansions={
        "that with": ("from", "this", "thth"),
        "than": ("then", "thon rewh", "than"),
        "pour": ("avec", "dans", "éque"),
        "nicht": ("sich", "eine"),
    },
    scene_expansions={"orre": ("hehely", "ononst"), "aich": ("éeau", "ouai")},
    genre_probes={"that": ("en", "prose"), "pour": ("fr",), "nicht": ("de",), "para": ("es",), "with": ("en", "essay")},
    theme_probes={"than": ("that with", "thth"), "dans": ("pour dans",), "sich": ("nicht sich",), "with": ("that with",)},
    constraint_probes={"rewh": "rewh", "orre": "orre", "thon": "thon", "aich": "aich"},
    avoid_probes={"inor": "inoran", "ench": "ench", "éque": "éque", "thea": "thea", "than": "than"},
    without_word="not",
    comparable_openers=("with", "avec", "wie"),
    asks=("from", "dans"),
    compares=("with", "avec"),
    joint_probes=(((("than",), ("with", "from")), ("thth",), ()), ((("pour",), ("dans",)), ("pour dans",), ("aich",))),
    scene_bonuses=(
        {"bonus": 0.9, "expanded": ("ononst",), "text": ("ononst",)},
        {"bonus": 0.8, "query": ("rewh",), "text": ("orre",)},
        {"bonus": 1.2, "query": ("orre", "rewh"), "scene": ("orre",)},
    ),
)

# Strengths, decays and limits of the taste profile.
ACTIONS = ("dislike", "like", "save", "skip", "swipe_left", "swipe_right")
ACTION_STRENGTH = {"like": 1.0, "save": 1.25, "swipe_right": 0.9, "dislike": 1.0, "swipe_left": 0.8, "skip": 0.12}

# Cyrillic letters to Latin, lossy on purpose.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sh",
    "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "u", "я": "a",
}

# Latin slugs back to Cyrillic, applied in this order.
SLUG_PAIRS = (
    ("shch", "щ"), ("sch", "щ"), ("yo", "ё"), ("yu", "ю"), ("ya", "я"), ("zh", "ж"), ("kh", "х"),
    ("ts", "ц"), ("ch", "ч"), ("sh", "ш"),
)
SLUG_ENDINGS = (
    ("iy", "ий"), ("yi", "ый"), ("yy", "ый"), ("ii", "ий"), ("oi", "ой"), ("ei", "ей"), ("ai", "ай"),
)
SLUG_LETTERS = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и",
    "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р",
    "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}
SLUG_AUTHORS = {
    "Belyaev": "Беляев", "Bulgakov": "Булгаков", "Bulichev": "Булычев", "CharlotteBronte": "Шарлотта Бронте",
    "Dostoevskiyi": "Достоевский", "Dreiser": "Драйзер", "Gogol": "Гоголь", "Gorkiyi": "Горький",
    "Gugo": "Гюго", "Kuprin": "Куприн", "Lermontov": "Лермонтов", "MaminSibiryak": "Мамин-Сибиряк",
    "Pasternak": "Пастернак", "Sholohov": "Шолохов", "Tolstoy": "Толстой", "Turgenev": "Тургенев",
}
