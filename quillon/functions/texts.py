"""Text expressions: cleaning, masking, detection, tokens."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of company names, longest first.
COMPANY_SUFFIXES = ["股份有限公司", "有限责任公司", "incorporated", "corporation", "有限公司", "limited", "company", "集团", "公司", "corp", "gmbh", "inc", "ltd", "llc", "co"]

# Patterns of personal data, with their level.
PERSONAL = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", 2),
    "id18": ("\\b[0-9]{17}[0-9Xx]\\b", 4),
    "card": ("\\b[0-9]{16,19}\\b", 4),
    "mobile": ("\\b1[3-9][0-9]{9}\\b", 3),
    "ip": ("\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", 1),
}


def clean_field(name: Column) -> Column:
    """Trimmed, lower case, punctuation to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^0-9a-z\\u4e00-\\u9fff]+", " "), " +", " "))


def company_stem(name: Column) -> Column:
    """The cleaned name without its longest legal suffix."""
    return F.trim(F.regexp_replace(clean_field(name), " ?(" + "|".join(COMPANY_SUFFIXES) + ")$", ""))


def mask(value: Column, head: int = 2, tail: int = 2, char: str = "*") -> Column:
    """Head and tail kept, the middle masked; short values masked whole."""
    n = F.char_length(value)
    return F.when(n <= head + tail, F.repeat(F.lit(char), n)).otherwise(F.concat(F.left(value, F.lit(head)), F.repeat(F.lit(char), n - head - tail), F.right(value, F.lit(tail))))


def mask_email(value: Column) -> Column:
    at = F.instr(value, "@")
    return F.when(at > 0, F.concat(F.left(value, F.lit(1)), F.lit("***"), F.substring(value, at, F.char_length(value)))).otherwise(mask(value))


def token(value: Column, salt: str) -> Column:
    """A stable pseudonym of a value."""
    return F.concat(F.lit("TK-"), F.upper(F.left(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(16))))


def decade(age: Column) -> Column:
    low = (F.floor(age / 10) * 10).cast("int")
    return F.concat_ws("-", low.cast("string"), (low + 9).cast("string"))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_word(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?i)\\b{word}\\b"))


def strip_html(html: Column) -> Column:
    """Text without tags, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "\\s+", " "))


def clauses(text: Column, least: int = 5) -> Column:
    """Clauses between sentence marks that are longer than ``least``."""
    return F.filter(F.transform(F.split(text, "[.;!?。；！？\\n]"), lambda x: F.trim(x)), lambda c: F.char_length(c) > least)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def personal_counts(text: Column) -> dict[str, Column]:
    """Matches of each kind of personal data."""
    return {kind: F.regexp_count(text, F.lit(pattern)) for kind, (pattern, _) in PERSONAL.items()}


def lexicon_sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """(p - n) / (p + n) over whole words; 0 where there is neither."""
    hits = lambda some: F.regexp_count(text, F.lit("(?i)\\b(" + "|".join(some) + ")\\b"))
    return F.coalesce(F.try_divide((hits(good) - hits(bad)).cast("double"), (hits(good) + hits(bad)).cast("double")), F.lit(0.0))


def readability(text: Column) -> tuple[Column, Column]:
    """Mean sentence length in characters and the share of sentences over 60."""
    parts = clauses(text, 0)
    total = F.aggregate(parts, F.lit(0), lambda s, c: s + F.char_length(c))
    long_ = F.size(F.filter(parts, lambda c: F.char_length(c) > 60))
    return F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0)), F.coalesce(F.try_divide(long_, F.size(parts)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def trigrams(text: Column) -> Column:
    return F.when(F.char_length(text) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array(text))


def bump(version: Column, change: Column) -> Column:
    """The next semantic version: major, minor or patch."""
    part = F.transform(F.split(version, "\\."), lambda x: x.try_cast("int"))
    return F.when(change == "major", F.concat((part[0] + 1).cast("string"), F.lit(".0.0"))).when(change == "minor", F.concat_ws(".", part[0].cast("string"), (part[1] + 1).cast("string"), F.lit("0"))).otherwise(F.concat_ws(".", part[0].cast("string"), part[1].cast("string"), (part[2] + 1).cast("string")))


def ngram_similarity(a: Column, b: Column) -> Column:
    """Trigrams that both have, counted as often as both have them, over the larger number."""
    x, y = trigrams(a), trigrams(b)
    count = lambda some, g: F.size(F.filter(some, lambda h: h == g))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.coalesce(F.try_divide(both, F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def glossary(text: Column, terms: dict[str, str]) -> Column:
    """Terms replaced, longest first, whatever their case."""
    out = text
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        quoted = "".join("\\" + c if c in "\\.[]{}()*+-?^$|" else c for c in term)
        out = F.regexp_replace(out, f"(?i)\\b{quoted}\\b", terms[term].replace("\\", "\\\\").replace("$", "\\$"))
    return out


def norm_name(name: Column) -> Column:
    """A name to compare by: lower case, full-width blanks, punctuation and blanks gone."""
    return F.lower(F.regexp_replace(name, "[\\s\\u3000·.,，。()（）'\"-]+", ""))


def norm_code(code: Column) -> Column:
    """A registration code or card number: capitals and digits alone."""
    return F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")


def norm_phone(phone: Column) -> Column:
    """The last eleven digits of a number, without a country's prefix."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.char_length(digits) > 11, F.right(digits, F.lit(11))).otherwise(digits)


def perturbed(value: Column, share: float = 0.01, seed: int = 42) -> Column:
    """Noise of at most ``share``, the same factor for every value, as the seed is."""
    return F.round(value * (1 + random.Random(seed).uniform(-share, share)), 2)


# Marks of clauses, penalties, entities and languages.
CLAUSE_KINDS = [("definition", "means|refers to|defined as|是指"), ("obligation", "must|shall|required to|不得|应当"), ("right", "may|entitled to|有权|可以")]
PENALTY = "(?:fine|penalty|罚款)[^.;。；]{0,20}?[0-9]+(?:,[0-9]{3})*"
SECTION = "(?:^|\\n)(?:第[0-9一二三四五六七八九十]+[章节条]|[0-9]+(?:\\.[0-9]+)*[.、])[ \\t]*"
ENTITIES = {"person": "(?:Mr|Ms|Dr)\\. [A-Z][a-z]+", "company": "[A-Z][A-Za-z]+ (?:Ltd|Inc|Corp)", "amount": "[$€¥][0-9][0-9,]*", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "account": "ACC[0-9]{4,}"}
KEY_INFO = {"amounts": "[0-9][0-9,]*(?:\\.[0-9]+)? ?(?:USD|万元|亿元|元)", "dates": "[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", "ratios": "[0-9]+(?:\\.[0-9]+)?%"}
STOP_WORDS = {"en": ["the", "of", "and"], "fr": ["le", "la", "de"], "de": ["der", "die", "und"], "es": ["el", "los", "que"]}
CODE_MARKS = [("python", "def |import |self\\."), ("java", "public class |System\\.out|void "), ("sql", "SELECT |INSERT |CREATE "), ("javascript", "function |const |=>")]


def clause_kind(text: Column) -> Column:
    """Definition before obligation before right, else other."""
    out = F.lit("other")
    for kind, marks in reversed(CLAUSE_KINDS):
        out = F.when(text.rlike(marks), kind).otherwise(out)
    return out


def penalties(text: Column, most: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(PENALTY), F.lit(0)), 1, most)


def sections(text: Column, least: int = 20) -> Column:
    """What stands between numbered headings, if longer than ``least``."""
    return F.filter(F.transform(F.split(text, SECTION), lambda x: F.trim(x)), lambda s: F.char_length(s) > least)


def found(text: Column, patterns: dict[str, str], most: int = 10) -> dict[str, Column]:
    """The distinct matches of each pattern, in order of first occurrence."""
    return {k: F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))), 1, most) for k, p in patterns.items()}


def tokens_zh(text: Column) -> Column:
    """Han bigrams (of a run of one, the character) and lower-cased Latin words."""
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(pairs, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def tokens_run(text: Column) -> Column:
    """Han runs of two characters or more; where there is none, the characters that are not blank."""
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    return F.when(F.size(runs) > 0, runs).otherwise(F.filter(F.split(F.regexp_replace(text, "\\s", ""), ""), lambda c: c != ""))


def language_scores(text: Column) -> dict[str, Column]:
    """Share of Han and kana letters, and of each language's stop words among the words."""
    parts = words(text)
    letters = F.greatest(F.char_length(F.regexp_replace(text, "\\s", "")), F.lit(1))
    out = {"zh": F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")) / letters, "ja": F.regexp_count(text, F.lit("[\\u3040-\\u30ff]")) / letters}
    among = lambda stop: lambda w: w.isin(*stop)
    for code, stop in STOP_WORDS.items():
        out[code] = F.size(F.filter(parts, among(stop))) / F.greatest(F.size(parts), F.lit(1))
    return out


def code_switch(text: Column) -> Column:
    """Whether both Han and Latin letters occur."""
    return text.rlike("[\\u4e00-\\u9fff]") & text.rlike("[A-Za-z]")


def code_language(source: Column) -> Column:
    out = F.lit("unknown")
    for name, marks in reversed(CODE_MARKS):
        out = F.when(source.rlike(marks), name).otherwise(out)
    return out


def dictionary(text: Column, terms: dict[str, str]) -> Column:
    """Terms replaced one after another, longest first, wherever they stand."""
    out = text
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(term), F.lit(terms[term]))
    return out
