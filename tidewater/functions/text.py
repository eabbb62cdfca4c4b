"""Text scalars: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
PUNCTUATION = "[\\s，。、；：？！,.;:?!\"'“”‘’()（）\\[\\]【】—…·-]+"
CJK = r"[一-鿿]"


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased runs of letters and digits, as an array. Null text: an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def n_tokens(text: Column, pattern: str = TOKEN) -> Column:
    """How many tokens tokenize() would give, without making them."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)), F.lit(0))


def tokenize_cjk(text: Column) -> Column:
    """As tokenize(), but a run of CJK gives its characters and its pairs of neighbours."""
    single = F.regexp_extract_all(F.lower(text), F.lit(rf"({CJK}|[\p{{L}}\p{{N}}&&[^一-鿿]]+)"), F.lit(1))
    pairs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?=({CJK}{CJK}))"), F.lit(1))
    return F.coalesce(F.concat(single, pairs), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Tokenizer:
    """How an index cuts texts and queries; an index keeps the name, so that both are cut alike."""

    name: str
    tokens: Callable[[Column], Column]


LETTERS, CJK_PAIRS = Tokenizer("letters and digits", tokenize), Tokenizer("cjk", tokenize_cjk)
_tokenizers = {t.name: t for t in (LETTERS, CJK_PAIRS)}


def register(t: Tokenizer) -> Tokenizer:
    _tokenizers[t.name] = t
    return t


def tokenizer(name: str) -> Tokenizer:
    """The tokenizer of this name; one that needs a dictionary is known once it has been made in this session."""
    if name not in _tokenizers:
        raise ValueError(f"no tokenizer {name!r}; known: {', '.join(sorted(_tokenizers))}")
    return _tokenizers[name]


def segment(text: Column, tokens: Tokenizer = LETTERS) -> Column:
    """The tokens joined by spaces: what an index stores beside the text."""
    return F.array_join(tokens.tokens(text), " ")


def query_terms_or(query: Column) -> Column:
    """Distinct tokens of a query in order of appearance; a document matches if it has any of them."""
    return F.array_distinct(tokenize(query))


def norm_key(text: Column) -> Column:
    """Identity that ignores punctuation and white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, "")


def event_key(text: Column) -> Column:
    """First 60 characters without anything but letters and digits."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""), 1, 60)


def clean(text: Column) -> Column:
    """Markdown marks become spaces, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[*#`|>]", " "), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(text, r"^\p{IsWhite_Space}+", ""), r"\p{IsWhite_Space}+$", "")


def long_enough(text: Column, least: int = 40) -> Column:
    return F.length(strip(text)) >= least


def sentences(text: Column) -> Column:
    """Cut after a sentence mark unless a closing quote or bracket follows; blank pieces are dropped."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;])(?![”’）」』】])"), lambda s: F.length(F.trim(s)) > 0)


def is_complete(text: Column) -> Column:
    """Whether the last character ends a sentence."""
    return F.coalesce(F.right(F.trim(text), F.lit(1)).isin("。", "！", "？", "!", "?", "…"), F.lit(False))


def contains_ci(text: Column, part: Column) -> Column:
    """Literal containment that ignores case."""
    return F.contains(F.lower(text), F.lower(part))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part, 0 for an empty one."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(F.lit(0)).cast("bigint")


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters, with a union of 1 at least."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.lit(1), F.size(F.array_union(chars(a), chars(b))))


def seam_overlap(a: Column, b: Column, least: int = 2) -> Column:
    """Length of the longest end of a that b begins with, from `least` characters up; else 0."""
    top = F.least(F.length(a), F.length(b))
    sizes = F.when(top >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda k: F.endswith(a, F.substr(b, F.lit(1), k)))), F.lit(0))


def join_text(a: Column, b: Column) -> Column:
    """Weld b to a: a's last mark goes, and what both share at the seam is kept once."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    bare = F.regexp_replace(a, "[。！？!?…，、；：,;:]$", "")
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(bare, F.substr(b, seam_overlap(bare, b) + 1)))


def cer(reference: Column, heard: Column) -> Column:
    """Character error rate: edit distance over the reference's length, which counts as 1 at least."""
    return F.levenshtein(reference, heard) / F.greatest(F.lit(1), F.length(reference))


def scrub_model_output(text: Column) -> Column:
    """Drop reasoning blocks and stray tags of them; at most one blank line in a row."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"</?think>", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def explicit_replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace wrong by right, longest wrong first, without looking at replaced text again.

    Each wrong form first becomes a private character, so that later pairs don't see its replacement."""
    order = sorted(pairs, key=lambda p: (-len(p[0]), p[0]))
    private = [*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]
    if len(order) > len(private):
        raise ValueError(f"{len(order)} pairs; {len(private)} at most")
    for (wrong, _), mark in zip(order, private, strict=False):
        text = F.replace(text, F.lit(wrong), F.lit(chr(mark)))
    for (_, right), mark in zip(order, private, strict=False):
        text = F.replace(text, F.lit(chr(mark)), F.lit(right))
    return text


def tidy_spaces(text: Column) -> Column:
    """No space between a Latin letter and a digit, nor next to CJK; half-width marks next to CJK become full-width unless a
    digit follows."""
    out = F.regexp_replace(text, r"(?<=[A-Za-z])\s+(?=\d)", "")
    out = F.regexp_replace(out, rf"(?<={CJK})\s+|\s+(?={CJK})", "")
    for half, full in MARKS.items():
        out = F.regexp_replace(out, rf"(?<={CJK})\{half}(?!\d)|\{half}(?={CJK})", full)
    return out


# Full-width marks, spoken digits, and units before which 十 is 10.
MARKS = {",": "，", ".": "。", "?": "？", "!": "！", ";": "；", ":": "："}
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
TEN_UNITS = "核|号|分|倍|条|款|台|个|人|年|月|日"


def spoken_number(said: Column) -> Column:
    """A spoken number as digits: tens with 十, else digit by digit."""
    of = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    tens = F.coalesce(F.try_element_at(of, F.substring_index(said, "十", 1)), F.lit(1)) * 10 + F.coalesce(F.try_element_at(of, F.substr(said, F.instr(said, "十") + 1)), F.lit(0))
    read = F.translate(said, "".join(DIGITS)[:-1], "".join(str(v) for v in DIGITS.values())[:-2]).cast("bigint")
    return F.when(F.contains(said, F.lit("十")), tens.cast("bigint")).otherwise(read).cast("string")


def digits(text: Column) -> Column:
    """Spoken numbers as digits: decimals (X点Y), after and before Latin letters, and 十 before a unit."""
    number, plain = f"[{''.join(DIGITS)}]+", f"[{''.join(k for k in DIGITS if k not in '两十')}]+"

    def rewritten(text: Column, pattern: str, new) -> Column:
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), lambda a, b: F.length(b) - F.length(a))
        return F.aggregate(found, text, lambda acc, s: F.replace(acc, s, F.coalesce(new(s), s)))

    first = lambda s, p: F.regexp_extract(s, p, 1)
    text = rewritten(text, f"{number}点{plain}", lambda s: F.concat(spoken_number(F.substring_index(s, "点", 1)), F.lit("."), spoken_number(F.substring_index(s, "点", -1))))
    text = rewritten(text, f"[A-Za-z]+{number}", lambda s: F.concat(first(s, "^([A-Za-z]+)"), spoken_number(F.regexp_replace(s, "^[A-Za-z]+", ""))))
    text = rewritten(text, f"{number}[A-Za-z]", lambda s: F.concat(spoken_number(F.regexp_replace(s, "[A-Za-z]$", "")), first(s, "([A-Za-z])$")))
    return F.regexp_replace(text, f"十(?=(?:{TEN_UNITS}))", "10")


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches has found; else an empty string."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns], F.lit(""))


def parse_model_array(reply: Column, schema: str) -> Column:
    """A model's JSON array: fenced, bracketed, or as what objects can be saved one by one."""
    text = scrub_model_output(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = lambda c: F.from_json(F.regexp_replace(F.when(c != "", c), r",\s*([\]}])", "$1"), f"array<{schema}>")
    objects = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    saved = F.filter(F.transform(objects, lambda o: F.from_json(o, schema)), lambda o: o.isNotNull())
    return F.coalesce(parsed(fenced), parsed(bare), saved)
