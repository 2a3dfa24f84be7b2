"""Text column functions. All run inside the JVM, except the two Arrow UDFs imported here."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.python_udfs import fold_udf, unescape_udf

# the characters Python calls whitespace; Spark's trim and Java's \s cover fewer
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
_WS_CHARS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WS = f"[{_WS_CHARS}]"
_LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
TOKEN_PATTERN = "[\\p{L}\\p{Nl}\\p{No}]+"


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Trim every Unicode whitespace character, not only the space."""
    return F.btrim(_column(col), F.lit(WHITESPACE))


def collapse(col: Column | str) -> Column:
    """Each whitespace run becomes one space."""
    return F.regexp_replace(_column(col), _WS + "+", " ")


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(strip(col), F.lit(""))


def norm_text(col: Column | str, max_chars: int | None = None) -> Column:
    """Duplicate key of a text: trimmed, lower case, single spaces."""
    key = collapse(F.lower(strip(col)))
    return key if max_chars is None else F.substring(key, 1, max_chars)


def coalesce_text(*texts: str, title: str | None = None, body: str | None = None) -> Column:
    """First non-blank of ``texts``, else title and body on two lines, else the one present."""
    choices = [blank_to_null(c) for c in texts]
    if title and body:
        both = F.concat_ws("\n", blank_to_null(title), blank_to_null(body))
        choices.append(F.nullif(both, F.lit("")))
    return F.coalesce(*choices)


def question_text(title: str = "title", body: str = "body", text: str | None = None) -> Column:
    """Title and body first, a ready text last."""
    both = F.nullif(F.concat_ws("\n", blank_to_null(title), blank_to_null(body)), F.lit(""))
    return F.coalesce(both, blank_to_null(text)) if text else both


def strip_leaked_labels(col: Column | str) -> Column:
    """Remove label listings that leaked into a text (head, tail, tag tail, label lines)."""
    keys = fixed.LABEL_KEYS_PATTERN
    label = f"{keys}{_WS}*[:=]{_WS}*"
    prefix = (
        f"(?i)^{_WS}*(?:etiquetas:{_WS}*)?{label}[^|\\n,]+"
        f"(?:{_WS}*[|,]{_WS}*{label}[^|\\n,]+)*{_WS}*\\n+"
    )
    tag_tail = f"(?i)tags:{_WS}*{keys}{_WS}*[:=][\\s\\S]*\\z"
    tail = (
        f"(?i)(?:etiquetas:{_WS}*)?{label}[^,\\n]+(?:[,{_WS_CHARS}]+{label}[^,\\n]+)*{_WS}*\\z"
    )
    whole = strip(F.coalesce(_column(col), F.lit("")))
    text = strip(F.regexp_replace(whole, prefix, ""))
    text = strip(F.regexp_replace(text, tag_tail, ""))

    def keep(line: Column) -> Column:
        low = F.lower(line)
        hits = sum((low.contains(k).cast("int") for k in fixed.HEADS), F.lit(0))
        listing = (hits >= 2) & (line.contains(":") | line.contains("="))
        return ~(listing | strip(low).startswith("etiquetas:"))

    lines = F.filter(F.split(text, _LINE_END), keep)
    cleaned = strip(F.regexp_replace(strip(F.array_join(lines, "\n")), tail, ""))
    # most texts name no label: one search decides, and only line ends are unified
    suspect = whole.rlike(f"(?i){keys}|etiquetas:")
    return F.when(suspect, cleaned).otherwise(F.regexp_replace(whole, _LINE_END, "\n"))


def unescape(col: Column | str) -> Column:
    """HTML entities to characters; only texts with an ampersand are sent to Python."""
    text = _column(col)
    return F.coalesce(unescape_udf(F.when(text.contains("&"), text)), text)


def html_to_text(col: Column | str) -> Column:
    """Markup to spaces, entities to characters, single spaces; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(_column(col), F.lit("")), "<[^>]+>", " ")
    return strip(collapse(unescape(bare)))


def fold(col: Column | str) -> Column:
    """Lower case without accents; only non-ASCII texts are sent to Python."""
    text = F.coalesce(_column(col), F.lit(""))
    return F.coalesce(fold_udf(F.when(text.rlike("[^\\x00-\\x7f]"), text)), F.lower(text))


def tokens(col: Column | str) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(_column(col)), F.lit(TOKEN_PATTERN), F.lit(0))


def term_hits(col: Column | str, terms: Sequence[str]) -> Column:
    """How many of ``terms`` occur as substrings."""
    text = _column(col)
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def any_term(col: Column | str, terms: Sequence[str]) -> Column:
    text = _column(col)
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def urgency_score(col: Column | str, terms: Sequence[str] = fixed.URGENCY_TERMS) -> Column:
    return term_hits(F.lower(_column(col)), terms)


def _lower_all(tags: Column | str) -> Column:
    return F.transform(_column(tags), F.lower)


def _overlaps(tags: Column, wanted: Sequence[str]) -> Column:
    hit = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))
    return F.coalesce(hit, F.lit(False))


def advanced_score(
    text: Column | str,
    tags: Column | str,
    terms: Sequence[str] = fixed.ADVANCED_TERMS,
    hint_tags: Sequence[str] = fixed.ADVANCED_TAGS,
) -> Column:
    return term_hits(F.lower(_column(text)), terms) + _overlaps(_lower_all(tags), hint_tags).cast("int")


def urgency_flag(
    folded: Column | str,
    strong: Sequence[str] = fixed.URGENCY_STRONG,
    weak: Sequence[str] = fixed.URGENCY_WEAK,
) -> Column:
    """On a folded text: one strong term or two weak ones."""
    return any_term(folded, strong) | (term_hits(folded, weak) >= 2)


def advanced_flag(
    folded: Column | str,
    tags: Column | str,
    strong: Sequence[str] = fixed.ADVANCED_STRONG,
    weak: Sequence[str] = fixed.ADVANCED_WEAK,
    hint_tags: Sequence[str] = fixed.ADVANCED_HINT_TAGS,
) -> Column:
    """On a folded text: one strong term, two weak ones, or a hint tag."""
    return (
        any_term(folded, strong)
        | (term_hits(folded, weak) >= 2)
        | _overlaps(_lower_all(tags), hint_tags)
    )


def low_urgency_flag(
    folded: Column | str,
    terms: Sequence[str] = fixed.LOW_URGENCY_TERMS,
    strong: Sequence[str] = fixed.URGENCY_STRONG,
    weak: Sequence[str] = fixed.URGENCY_WEAK,
) -> Column:
    """On a folded text: an exploratory term and no urgency."""
    return any_term(folded, terms) & ~urgency_flag(folded, strong, weak)


def infer_emotion(
    col: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = fixed.EMOTION_RULES
) -> Column:
    """First rule group with a term in the text, else neutral."""
    text = F.lower(_column(col))
    (label, terms), *rest = rules
    choice = F.when(any_term(text, terms), label)
    for label, terms in rest:
        choice = choice.when(any_term(text, terms), label)
    return choice.otherwise("neutral")


def snippet(col: Column | str, head: int = 320, tail: int = 240, cap: int = 1400) -> Column:
    """Short texts whole; long ones as head and tail, cut at spaces, around a marker."""
    text = strip(F.coalesce(_column(col), F.lit("")))
    first = F.left(text, F.lit(head))
    last_word = F.substring_index(first, " ", -1)
    cut_head = F.when(
        first.contains(" "), F.left(first, F.length(first) - F.length(last_word) - 1)
    ).otherwise(first)
    end = F.right(text, F.lit(tail))
    cut_tail = F.when(
        end.contains(" "), F.right(end, F.length(end) - F.instr(end, " "))
    ).otherwise(end)
    joined = F.concat(cut_head, F.lit(fixed.SNIPPET_MARK), cut_tail)
    whole = F.length(text) <= head + tail + 24
    return F.substring(F.when(whole, text).otherwise(joined), 1, cap)


def json_object_text(col: Column | str) -> Column:
    """The text from the first ``{`` to the last ``}`` of a reply, without an opening code fence."""
    unfenced = F.regexp_replace(strip(_column(col)), "\\A```(?:[^\\n]*\\n)?", "")
    return F.nullif(F.regexp_extract(unfenced, "(?s)\\{.*\\}", 0), F.lit(""))


def extract_json(col: Column | str, schema: str) -> Column:
    """Tolerant reply parser: the object as ``schema``, or null when it is not valid JSON."""
    text = json_object_text(col)
    # '[..]' around the text makes anything after the object a syntax error
    valid = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(valid, "$[1]", "variant").isNull()
    return F.when(valid.isNotNull() & single, F.from_json(text, schema))


def parse_int_list(col: Column | str) -> Column:
    """``"[15, 17]"`` to an array of int; an empty list stays empty."""
    inner = F.btrim(_column(col), F.lit("[]"))
    numbers = F.transform(F.split(inner, ","), lambda x: strip(x).cast("int"))
    empty = F.array().cast("array<int>")
    return F.when(F.col(col).isNull() if isinstance(col, str) else col.isNull(), None).otherwise(
        F.when(inner == "", empty).otherwise(numbers)
    )


def strategy_prefix(col: Column | str) -> Column:
    return F.substring_index(F.coalesce(_column(col), F.lit("")), ":", 1)


def render(template: str, values: Mapping[str, Column | str]) -> Column:
    """Fill a format template with columns (or constants), as one concatenation."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)
