"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the tokenizer leaves out (fixed values).
STOPWORDS = (
    *("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个"),
    *("上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好"),
    *("自己", "这", "那", "啊", "吧", "吗", "呢", "哦", "嗯", "啦"),
    *("the", "a", "an", "is", "are", "was", "were", "be", "been", "being"),
    *("have", "has", "had", "do", "does", "did", "will", "would", "could", "should"),
    *("may", "might", "must", "can", "this", "that", "these", "those"),
    *("i", "you", "he", "she", "it", "we", "they", "what", "which", "who"),
    *("when", "where", "why", "how", "all", "each", "every", "both", "few"),
    *("more", "most", "other", "some", "such", "no", "nor", "not", "only"),
    *("own", "same", "so", "than", "too", "very", "just", "and", "but", "or"),
    *("as", "if", "then", "else", "for", "of", "at", "by", "from", "to", "in"),
    *("on", "with", "about", "against", "between", "into", "through", "during"),
    *("before", "after", "above", "below", "up", "down", "out", "off", "over"),
)
#: Words that are no phrases (fixed values).
NO_PHRASES = ("的", "了", "是", "在", "和", "有", "这", "那", "the", "a", "is", "are", "to", "and", "of", "in")
#: First and last CJK ideograph of the basic block (fixed values).
CJK = "\\u4e00-\\u9fff"


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two letters or more, then each CJK run of two or more followed by its bigrams; without stopwords."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), bigrams(r))))
    return F.concat(words, F.filter(parts, lambda w: ~w.isin(*STOPWORDS)))


def bigrams(text: Column) -> Column:
    """Character pairs; a text of one character gives none."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))


def noun_phrases(text: Column) -> Column:
    """CJK runs cut into pieces of two to four characters, and Latin words of three letters or more, without ``NO_PHRASES``; case and repeats kept."""
    pieces = F.concat(F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fa5]{2,4}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0)))
    return F.filter(pieces, lambda p: ~F.lower(p).isin(*NO_PHRASES))


def search_terms(text: Column, limit: int = 10) -> Column:
    """Distinct Latin words of three to eight letters in order, at most ``limit``."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w).between(3, 8)))), 1, limit)


def keywords(text: Column) -> Column:
    """Distinct lower-cased Latin words of 3 to 50 letters without stopwords, in first-occurrence order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,50}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS)))


def entities(text: Column) -> Column:
    """Distinct capitalised Latin words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{2,}"), F.lit(0)))


def normalized_key(name: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(name), "[\\s_\\-]", "")


def normalized_text(text: Column) -> Column:
    """Lower case, letters, digits and underscores only, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s]", ""), "\\s+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct k-character pieces of the trimmed lower-cased text; a shorter text is one piece."""
    low = F.lower(F.trim(text))
    # characters once, so a long text isn't searched from its start for each piece
    pieces = F.transform(F.array(F.split(low, "")), lambda cs: F.transform(F.slice(cs, F.lit(1), F.size(cs) - (k - 1)), lambda c, i: F.concat(c, *[F.get(cs, i + j) for j in range(1, k)])))
    return F.when(F.length(low) < k, F.array(low)).otherwise(F.array_distinct(F.get(pieces, F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! ? or a line feed, trimmed, without empty ones."""
    marked = F.regexp_replace(text, "([.!?\\n])\\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def estimated_tokens(text: Column) -> Column:
    """Half the characters if at least 30 % are CJK, else the number of words."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    plain = F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))
    return F.when(cjk >= 0.3 * F.length(text), F.floor(F.length(text) / 2)).otherwise(plain).cast("bigint")


def mixed_tokens(text: Column) -> Column:
    """Half a token for a CJK character, a quarter for any other."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return F.floor(cjk / 2 + (F.length(text) - cjk) / 4).cast("bigint")


def highlighted(text: Column, term: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Every occurrence of a word, in any case, between marks."""
    return F.regexp_replace(text, f"(?i)\\b({term})\\b", f"{before}$1{after}")


def edit_at_most_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


#: Marks of times and their kinds; case doesn't matter (fixed values).
TIME_MARKS = (
    (r"(\d{4})年(\d{1,2})月(\d{1,2})日?", "POINT"),
    (r"(\d{4})年(\d{1,2})月", "POINT"),
    (r"(\d{4})年", "POINT"),
    (r"(从|自)(.{2,20})(开始|起)", "START"),
    (r"(到|至|直到)(.{2,20})(结束|为止)?", "END"),
    (r"(.{2,10})(期间|之间)", "DURATION"),
    (r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}", "POINT"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "POINT"),
    (r"\d{4}-\d{2}-\d{2}", "POINT"),
    (r"(since|from)\s+(.{2,20})", "START"),
    (r"(until|to|till)\s+(.{2,20})", "END"),
    (r"(during|between)\s+(.{2,20})", "DURATION"),
)
#: Words of time (fixed values).
TIME_WORDS = (
    *("从", "自从", "开始", "结束", "直到", "之前", "之后", "期间", "年", "月", "日", "今天", "昨天", "明天", "现在", "以前", "以后", "一直", "已经", "曾经", "将要", "正在"),
    *("from", "since", "until", "before", "after", "during", "when", "started", "ended", "began", "finished", "now", "currently"),
    *("previously", "formerly", "recently", "already", "still"),
)


def time_marks(text: Column) -> Column:
    """Distinct marks of time (text, type): matches of ``TIME_MARKS``, then each of ``TIME_WORDS`` at its first place, with up to ten
    characters before and twenty behind, as KEYWORD. Null for a null text."""

    def mark(kind: str):
        return lambda m: F.struct(m.alias("text"), F.lit(kind).alias("type"))

    def around(word: Column) -> Column:
        at = F.position(word, F.lower(text))
        first = F.greatest(at - 10, F.lit(1))
        return F.substring(text, first, at + F.length(word) + 20 - first)

    matched = [F.transform(F.regexp_extract_all(text, F.lit("(?id)" + pattern), F.lit(0)), mark(kind)) for pattern, kind in TIME_MARKS]
    held = F.filter(F.array(*map(F.lit, TIME_WORDS)), lambda w: F.contains(F.lower(text), w))
    return F.array_distinct(F.concat(*matched, F.transform(F.transform(held, around), mark("KEYWORD"))))


def complexity(text: Column, names: Column, confidence: Column, marked: Column) -> Column:
    """0 to 1: how much a text asks of a reader, from its length, the number of names in it and their mean confidence (null: no names),
    whether it holds marks of time, and its sentences. Null for a null text."""
    parts = [
        (F.length(text) > 500, 0.15),
        (F.length(text) > 1000, 0.15),
        (names / F.greatest(F.length(text) / 100, F.lit(1)) > 0.5, 0.2),
        (names > 3, 0.15),
        (names > 5, 0.1),
        (marked, 0.15),
        ((names > 0) & (confidence < 0.6), 0.2),
        (F.size(F.split(text, "[.!?。！？]")) > 5, 0.1),
    ]
    total = F.lit(0.0)
    for holds, weight in parts:
        total = total + F.when(holds, weight).otherwise(0.0)
    return F.when(text.isNotNull(), F.round(F.least(total, F.lit(1.0)), 6))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda p: p != "")


def spoken_turns(text: Column) -> Column:
    """Pieces that start at a line with a speaker's label, stripped, without empty ones; the text itself if there is none."""
    pieces = F.filter(F.transform(F.split(text, r"(?i)(?=(?:^|\n)\s*(?:User|AI|Assistant|Human|System|Bot)\s*[:：])"), stripped), lambda p: p != "")
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(text))


def injected(scenario: Column, sections: dict[str, list[Column]], rules: Column) -> Column:
    """The sections of the scenario and then the rules, which hold in every scenario, with blank lines between; empty ones are left out."""

    def joined(parts: list[Column]) -> Column:
        return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])

    return joined([*[F.when(scenario == k, joined(parts)) for k, parts in sections.items()], rules])
