"""Text functions as Column expressions; nothing here leaves the JVM.

"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spoken fillers, and words that carry meaning in code.
FILLERS = ("uh", "um", "yeah", "okay", "ok", "actually", "basically", "really", "like", "gonna", "wanna")
CODE_WORDS = ("for", "by", "where")
#: Interface noise in screen text, the plain list.
NOISE_V1 = (
    r"\bwindows\s+10\s+x64\b",
    r"\btype here to search\b",
    r"\bdesktop[-\w]*\b",
    r"\bmicrosoft\s+(?:sql|sol)\s+server\s+management\s+studio\b",
    r"\bobject\s+explorer\b",
    r"\bsolution\s*\d*\b",
    r"\bconnected\b",
    r"\blocalhost\\?\w*\b",
    r"\bfile\s+edit\s+view\s+project\s+tools?\s+window\s+help\b",
    r"\bfile\s+edit\s+source\s+refactor\s+navigate\s+search\s+project\s+run\s+window\s+help\b",
    r"\bpython:\s*current\s+file\s*\(integrated\s+terminal\)\b",
    r"\binstalling\s+packages\b",
    r"\bln\s*\d+\s*,?\s*col\s*\d+\b",
    r"\bspaces\s*:\s*\d+\b",
    r"\butf[- ]?8\b",
    r"\bexternal\s+libraries\b",
    r"\bscratches\s+and\s+consoles\b",
    r"\bversion\s+control\b",
    r"\bcurrent\s+file\b",
    r"\bnesoacademy\.org\b",
    r"\bcodewithmosh\.com\b",
    r"\bmosh\s+hamedani\b",
    r"\bsomething\s+went\s+wrong\b",
    r"\brefresh\s+or\s+try\s+again\s+later\b",
    r"\blearn\s+more\b",
    r"\bvideo\s+unavailable\b",
    r"\bplayback\s+error\b",
)
#: Interface phrases of high confidence, the audited list.
NOISE_V2 = (
    r"\bwindows\s+\d+(?:\.\d+)?\s+x64\b",
    r"\btype\s+here\s+to\s+search\b",
    r"\bquick\s+launch\b",
    r"\bmicrosoft\s+sql\s+server\s+management\s+studio\b",
    r"\bmicrosoft\s+sol\s+server\s+management\s+studio\b",
    r"\bobject\s+explor\w*\b",
    r"\bobj?ect\s+splor\w*\b",
    r"\blocalhost\\?\w*\b",
    r"\bexternal\s+libraries\b",
    r"\bexternat\s+libraries\b",
    r"\bscratches?\s+and\s+consoles\b",
    r"\bscratch\w*\s+and\s+consol\w*\b",
    r"\bversion\s+control\b",
    r"\bcurrent\s+file\b",
    r"\bcurrentfie\w*\b",
    r"\bproject\s+structure\b",
    r"\binvalidate\s+caches\b",
    r"\bpower\s+save\s+mode\b",
    r"\bpython:\s*current\s+file\s*\(integrated\s+terminal\)\b",
    r"\bln\s*\d+\s*,?\s*col\s*\d+\b",
    r"\bspaces\s*:\s*\d+\b",
    r"\b\d+\s*spaces\s+(?:of|for)\b",
    r"\bcrlf\b",
    r"\butf[- ]?8\b",
    r"\bsomething\s+went\s+wrong\b",
    r"\brefresh\s+or\s+try\s+again\s+later\b",
    r"\bvideo\s+unavailable\b",
    r"\bplayback\s+error\b",
    r"\blearn\s+more\b",
    r"\bnesoacademy\s*\.\s*org\b",
    r"\bcodewithmosh\s*\.\s*com\b",
    r"\bmosh\s+hamedani\b",
)
#: Corrections of frequent misreadings.
CORRECTIONS = (
    (r"\bgroup\s+5v\b", "group by"),
    (r"\bgroup\s+sv\b", "group by"),
    (r"\bgroup\s+5y\b", "group by"),
    (r"\bcqunt\b", "count"),
    (r"\bcqunt\s*\(\s*id\s*\)", "count(id)"),
    (r"\bseiect\b", "select"),
    (r"\bwbere\b", "where"),
    (r"\bhavlng\b", "having"),
)
#: Menu words, the words that anchor a menu, and terms that protect their surroundings.
UI_TOKENS = (
    "file", "edit", "view", "project", "tools", "tool", "window", "windows", "help", "run", "search", "source", "refactor", "navigate",
    "query", "debug", "terminal", "go", "format", "build", "new", "open", "close", "save", "find", "replace", "connect",
)
UI_ANCHORS = ("file", "edit", "view", "project", "window", "help")
PROTECTED_TERMS = (
    "select", "from", "where", "group", "by", "group by", "having", "join", "left join", "right join", "inner join", "outer join", "count",
    "sum", "avg", "min", "max", "order", "order by", "insert", "update", "delete", "create", "alter", "drop", "table", "database", "query",
    "constraint", "primary", "foreign", "key", "def", "return", "import", "for", "while", "range", "list", "dict", "tuple", "set", "class",
    "public", "private", "protected", "static", "void", "interface", "extends", "implements", "override", "method", "pointer", "reference",
    "template", "constructor", "destructor", "object", "inheritance", "variable", "int", "float", "double", "char", "bool", "struct",
    "virtual", "namespace", "include", "new",
)
#: The patterns of the cleaning rules.
URL = r"https?://\S+"
WWW = r"www\.\S+"
DOMAIN = r"\b[\w.-]+\.(?:com|org|net|io)\b"
CODE_CHARSET = r"""[^a-z0-9_+\-*/=<>(){}\[\].,:;'" ]+"""
LONG_NUMBER = r"\b\d{5,}\b"
REPEATED = r"([=_\-*])\1{2,}"
LONE_SYMBOL = r"(?<!\w)[^\w\s](?!\w)"


def text_or_empty(c: Column) -> Column:
    """PRJ1."""
    return F.coalesce(c.cast("string"), F.lit(""))


def blank(c: Column) -> Column:
    """FLT5, negated."""
    return F.trim(text_or_empty(c)) == ""


def squeeze(c: Column) -> Column:
    """TX9: any white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """TX1: lower case, links out, letters and digits only, single spaces."""
    bare = F.regexp_replace(F.lower(text_or_empty(c)), r"http\S+|www\S+", " ")
    return squeeze(F.regexp_replace(bare, r"[^a-z0-9\s]", " "))


def tokens(c: Column) -> Column:
    """Space-separated tokens; none for blank text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def content_tokens(c: Column, stop_words: Iterable[str]) -> Column:
    """TX2: drop stop words and single characters."""
    stop = sorted(set(stop_words))
    return F.filter(tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(stop))


def preprocess(c: Column, stop_words: Iterable[str]) -> Column:
    """TX3: cleaned text without stop words; applying it twice changes nothing."""
    return F.array_join(content_tokens(clean_text(c), stop_words), " ")


def stop_words(base: Iterable[str]) -> list[str]:
    """Base list without the code words, with the fillers."""
    return sorted((set(base) - set(CODE_WORDS)) | set(FILLERS))


def word_count(c: Column) -> Column:
    """PRJ3: words between white space; 0 for blank text."""
    return F.when(blank(c), 0).otherwise(F.size(F.split(F.trim(squeeze(text_or_empty(c))), " ")))


def reduction_pct(raw: Column, clean: Column) -> Column:
    """PRJ4: share of words removed in per cent, 2 decimals; an empty text counts as one word."""
    return F.round((1 - clean / F.greatest(raw, F.lit(1))) * 100, 2)


def video_key(url: Column) -> Column:
    """TX4: the id after ``watch?v=`` or ``youtu.be/``, else empty."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit("")), F.regexp_extract(url, r"youtu\.be/([^?&#/]+)", 1))


def hhmmss(seconds: Column) -> Column:
    """TX5."""
    whole = F.floor(seconds).cast("int")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(whole / 3600)), part(F.floor(whole % 3600 / 60)), part(whole % 60))


def key_text(c: Column) -> Column:
    """TX6: trimmed, lower case."""
    return F.lower(F.trim(text_or_empty(c)))


def subject_key(c: Column) -> Column:
    """TX7: canonical subject."""
    plain = key_text(c)
    return F.when(plain.isin("cpp", "cxx", "c plus plus"), "c++").otherwise(plain)


def video_number(c: Column) -> Column:
    """TX8, TX24, ST2: the number in ``v007``; null without digits."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("int")


def video_id(c: Column) -> Column:
    """TX8: ``v007`` becomes ``v7``; ids of another form are only trimmed and lowered."""
    plain = key_text(c)
    return F.when(plain.rlike(r"^v[0-9]+$"), F.concat(F.lit("v"), video_number(plain).cast("string"))).otherwise(plain)


def strip_links(c: Column) -> Column:
    for pattern in (URL, WWW, DOMAIN):
        c = F.regexp_replace(c, pattern, " ")
    return c


def finish(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, REPEATED, " "), LONE_SYMBOL, " "))


def clean_screen_v1(c: Column) -> Column:
    """TX10: links, known noise, characters foreign to code, long numbers and symbol runs out."""
    c = strip_links(F.lower(text_or_empty(c)))
    for pattern in NOISE_V1:
        c = F.regexp_replace(c, pattern, " ")
    return finish(F.regexp_replace(F.regexp_replace(c, CODE_CHARSET, " "), LONG_NUMBER, " "))


def replace_counting(df: DataFrame, column: str, counter: str, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """TX11-TX13: apply the rules to a column in order; ``counter`` counts the replacements.

    One projection a rule keeps the expressions small: each step reads the last
    one's text twice, and nesting them would double the plan with every rule.
    """
    df = df.withColumn(counter, F.lit(0))
    for pattern, to in rules:
        df = df.select(*[c for c in df.columns if c not in (column, counter)], (F.col(counter) + F.regexp_count(column, F.lit(pattern))).alias(counter), F.when(F.regexp_count(column, F.lit(pattern)) > 0, F.regexp_replace(column, pattern, to)).otherwise(F.col(column)).alias(column))
    return df


def correct(df: DataFrame, column: str, counter: str) -> DataFrame:
    """TX12."""
    return replace_counting(df, column, counter, CORRECTIONS)


def drop_phrases(df: DataFrame, column: str, counter: str) -> DataFrame:
    """TX13."""
    return replace_counting(df, column, counter, [(p, " ") for p in NOISE_V2])


def menu_cluster(words: Column, is_menu_word: Column, window: int = 8, least: int = 4) -> Column:
    """TX15: positions (0-based) of the menu words to remove.

    ``is_menu_word``: a flag for each word. A window of eight words is a menu if it
    has four menu words, an anchor and no protected term; its menu words go.
    """
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^a-z0-9_]+", ""))
    anchors, guarded = (F.array(*[F.lit(x) for x in xs]) for xs in (UI_ANCHORS, PROTECTED_TERMS))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))

    def is_menu(start: Column) -> Column:
        some, flags = F.slice(plain, start + 1, window), F.slice(is_menu_word, start + 1, window)
        return (F.size(F.filter(flags, lambda f: f)) >= least) & F.arrays_overlap(some, anchors) & ~F.arrays_overlap(some, guarded)

    # one flag for each start, so that every window is judged once
    starts = F.transform(places, is_menu)
    return F.filter(places, lambda p: F.element_at(is_menu_word, p + 1) & F.exists(F.slice(starts, F.greatest(p - window + 2, F.lit(1)), F.least(p + 1, F.lit(window))), lambda s: s))


def without_places(words: Column, places: Column) -> Column:
    return F.filter(words, lambda w, i: ~F.array_contains(places, i))


def text_class(c: Column) -> Column:
    """TX16: ``empty``, ``noise`` (no word of two letters or digits) or ``useful``."""
    useful = F.exists(F.split(c, r"\s+"), lambda w: F.length(F.regexp_replace(w, r"[^a-z0-9]", "")) >= 2)
    return F.when(blank(c), "empty").when(useful, "useful").otherwise("noise")


def has_term(text: Column, term: Column) -> Column:
    """TX17: the term stands free of word characters; any white space matches its spaces."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![a-z0-9_])"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"(?![a-z0-9_])")))


def has_alias(text: Column, alias: str) -> Column:
    """TX19: phrase match in any case, white space flexible."""
    escaped = "".join(f"\\{ch}" if ch in r"\.[]{}()*+?^$|" else ch for ch in alias.strip())
    return text.rlike(r"(?i)(?<!\w)" + r"\s+".join(escaped.split()) + r"(?!\w)")


def token_set(c: Column) -> Column:
    """TX23: distinct lower-case tokens of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z0-9_]+)"), F.lit(1)))


def ngrams(words: Column, least: int = 2) -> Column:
    """TX26: words of at least two characters and their neighbouring pairs."""
    kept = F.filter(words, lambda w: F.length(w) >= least)
    rest = lambda k: F.greatest(F.size(k) - 1, F.lit(0))
    both = lambda k: F.concat(k, F.zip_with(F.slice(k, F.lit(1), rest(k)), F.slice(k, F.lit(2), rest(k)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.transform(F.array(kept), both)[0]  # bound to a name, so that the words are made once


def contexts(text: Column, patterns: dict[str, list[str]], least: int = 2) -> Column:
    """TX21: struct(context, hits, confidence): the context with most matching patterns, if it is alone and has enough."""
    flags = F.array(*[F.struct(sum((text.rlike(p).cast("int") for p in ps), F.lit(0)).alias("hits"), F.lit(k).alias("context")) for k, ps in sorted(patterns.items())])
    ranked = F.array_sort(flags, lambda a, b: F.when(a["hits"] != b["hits"], b["hits"] - a["hits"]).when(a["context"] < b["context"], -1).otherwise(1))
    best, second = ranked[0], F.coalesce(F.get(ranked, F.lit(1))["hits"], F.lit(0))
    sure = (best["hits"] >= least) & (best["hits"] > second)
    return F.struct(F.when(best["hits"] > 0, best["context"]).otherwise("unknown").alias("context"), best["hits"].alias("hits"), F.when(sure, "high").when(best["hits"] > 0, "low").otherwise("none").alias("confidence"))
