"""Text functions as Catalyst expressions. White space is spelled out: dialects differ in ``\\s``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\x0B\f]"
NOT_WS = r"[^ \t\n\r\x0B\f]"

# Word lists and patterns that decide results.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH_LINE = rf"^(?:{MONTHS})(?: \d{{1,2}})?$|^\d{{1,2}} (?:{MONTHS})$"
TIMELINE_EVENT = rf"^(?:{MONTHS}) \d{{1,2}}|^\d{{1,2}} (?:{MONTHS})"
LIST_ITEM = r"(?i)^(?:[-*•]|(?:\(?\d+\)?|\(?[A-Za-z]\)|[A-Za-z]\.|\d+[.)]|[ivxlcdm]+[.)]))[ \t]+"
LEADING_FRAGMENT = r"(?i)^(?:and|or|but|of|the|a|an|to|in|on|for|from|with|by|into|after|before)\b"
CONTINUATION_WORDS = ["and", "or", "but", "because", "therefore", "however", "which", "that", "this", "these", "those", "it", "they", "he", "she"]
STOP_WORDS = ["what", "is", "the", "a", "an", "of", "in", "on", "to", "and", "or", "how", "why", "does", "do", "explain", "define", "uses", "use", "advantages", "benefits", "basics"]
IGNORED_SECTIONS = ["references", "external links", "other websites", "related pages", "see also", "notes", "bibliography", "gallery"]
MINOR_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
MIN_TEXT_CHARS, MAX_TOKENS, OVERLAP, MIN_CHUNK_TOKENS, MIN_CHUNK_CHARS = 500, 256, 24, 40, 180


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize(c: Column) -> Column:
    """Line ends as LF, runs of blanks as one, at most one empty line in a row, stripped."""
    x = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def folded(c: Column) -> Column:
    """Lower-cased with white space runs as one blank; null as the empty text."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{WS}+", " "))


def tokens(c: Column) -> Column:
    """Lossless tokens: each with the white space before it, so their concatenation is the text but for its end."""
    return F.regexp_extract_all(c, F.lit(f"{WS}*{NOT_WS}+"), F.lit(0))


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"{NOT_WS}+")), F.lit(0))


def word_list(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def share_of(c: Column, keep: str) -> Column:
    """Characters of the class ``keep`` among those that are not white space, 0 if there are none."""
    solid = F.length(F.regexp_replace(c, WS, ""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, f"[^{keep}]", "")), solid), F.lit(0.0))


def alpha_ratio(c: Column) -> Column:
    return share_of(c, r"\p{L}")


def numeric_ratio(c: Column) -> Column:
    return share_of(c, r"\p{Nd}")


def starts_lower(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^\p{Ll}"), F.lit(False))


def starts_punctuated(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^[^\p{L}\p{N}_ \t\n\r]"), F.lit(False))


def ends_mid_sentence(c: Column) -> Column:
    """Not blank and not ending in . ? ! a quote or a closing bracket."""
    x = strip(c)
    return F.coalesce((x != "") & ~x.rlike(r"[.?!\"')\]]$"), F.lit(False))


def starts_like_fragment(c: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(F.lower(strip(c)), f"^{NOT_WS}+", 0), r"^[,.;:]+|[,.;:]+$", "")
    return starts_lower(c) | starts_punctuated(c) | F.coalesce(first.isin(CONTINUATION_WORDS), F.lit(False))


def short_label(c: Column) -> Column:
    """Up to 8 tokens, or up to 15 without an end of sentence; blank is none."""
    x, n = strip(c), token_count(c)
    return F.coalesce((x != "") & ((n <= 8) | ((n <= 15) & ~x.rlike(r"[.?!]$"))), F.lit(False))


def preview(c: Column, size: int = 500) -> Column:
    """Newlines as blanks, stripped, cut at ``size`` with three dots."""
    x = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " "))
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("..."))).otherwise(x)


def keywords(c: Column) -> Column:
    """Lower-cased words of a query without ? , . and stop words; a slash separates."""
    clean = F.translate(F.translate(F.lower(F.coalesce(c, F.lit(""))), "?,.", ""), "/", " ")
    return F.filter(F.split(clean, f"{WS}+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def stable_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def file_safe(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def fill(template: str, **values: Column) -> Column:
    """``$name`` placeholders of a template replaced by columns; null as the empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"${name}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def rerank_text(title: Column, section: Column, content: Column) -> Column:
    """The text that a reranker sees; missing parts leave no line."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Title", title), line("Section", section), line("Content", content))


def embedding_text(title: Column, section: Column, content: Column, before: Column) -> Column:
    """The text that is embedded: title, section, the context before (if any) and the content, parted by empty lines."""
    context = F.when(before != "", F.concat(F.lit("Previous context: "), before))
    return strip(F.concat_ws("\n\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Section: "), section), context, content))


def iso_now() -> Column:
    """The time of the query in UTC as an ISO text with microseconds and offset."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def hybrid_rerank_text(title: Column, section: Column, metadata: Column, content: Column) -> Column:
    """The same for hybrid candidates: a missing title or section comes from metadata; the content always stands."""
    found = lambda c, *names: F.coalesce(F.nullif(c, F.lit("")), *[F.get_json_object(metadata, f"$.{n}") for n in names], F.lit(""))
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n\n", line("Title", found(title, "article_title", "title")), line("Section", found(section, "section_path", "section_title")), F.concat(F.lit("Content:\n"), F.coalesce(content, F.lit(""))))


def scored_passage(rank: Column, title: Column, content: Column, score: Column) -> Column:
    """A numbered passage; the score with four decimals, without its line where it is missing."""
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")))
    return F.concat_ws("\n", head, F.when(score.isNotNull(), F.concat(F.lit("Score: "), F.format_string("%.4f", score))), F.coalesce(content, F.lit("")))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """An array of {role, content}; without the assistant's turn for inference."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))
