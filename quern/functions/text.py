"""Text functions as native columns: cleaning, tokens, sentences, prompts and what a reader of results sees."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.stopwords import ENGLISH

#: White space that Java's \\s doesn't know.
RARE_SPACE = "[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Words that the word tokenizer parts in two.
CONTRACTIONS = {"cannot": ("can", "not"), "gonna": ("gon", "na"), "gotta": ("got", "ta"), "gimme": ("gim", "me"), "lemme": ("lem", "me"), "wanna": ("wan", "na")}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced(text: Column | str) -> Column:
    """Rare white space as blanks; what follows needs to know the plain kind only."""
    return F.regexp_replace(_col(text), RARE_SPACE, " ")


def squash(text: Column | str) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(spaced(text), r"\s+", " "))


def tokens(text: Column | str) -> Column:
    """The words between white space; none for null, empty or blank text."""
    return _split(spaced(text))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def letters_only(text: Column | str) -> Column:
    """Lower case with everything but a-z and white space left out, not replaced: a-b becomes ab."""
    return F.regexp_replace(F.lower(spaced(text)), r"[^a-z\s]+", "")


def letter_words(text: Column | str) -> Column:
    return _split(letters_only(text))


def words(text: Column | str) -> Column:
    """Tokens of the letters, contractions parted."""
    parts = F.create_map(*(x for k, v in CONTRACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = letter_words(text)
    some = F.exists(found, lambda t: t.isin(*CONTRACTIONS))
    return F.when(some, F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(parts, t), F.array(t))))).otherwise(found)


def content_words(text: Column | str) -> Column:
    """words() without English stop words, unstemmed."""
    return F.filter(words(text), lambda t: ~t.isin(*ENGLISH))


def sentences(text: Column | str) -> Column:
    """Cut behind . ! or ? and the white space there."""
    return F.split(_col(text), rf"(?<=[.!?])(?:\s|{RARE_SPACE})+")


def paragraphs(text: Column | str) -> Column:
    return F.split(_col(text), "\n\n")


def slices(words: Column, size: int) -> Column:
    """An array cut into arrays of `size`; none for an empty one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / size)).cast("int"))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def without_edit(text: Column | str) -> Column:
    """Headings without the link text "(edit)" at their end."""
    return F.regexp_replace(_col(text), r"(?U)\s*\(\s*edit\s*\)\s*$", "")


@F.pandas_udf(T.StringType())
def _decoded(markup: pd.Series) -> pd.Series:
    return markup.map(html.unescape, na_action="ignore")


def decoded(markup: Column | str) -> Column:
    """Character references of HTML decoded.  Only texts with others than &amp;, &lt;, &gt;, &quot; and &#39; go to Python."""
    c = _col(markup)
    rare = F.regexp_like(c, F.lit("&(?!(?:amp|lt|gt|quot|#39);)[#a-zA-Z]"))
    native = c
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        native = F.replace(native, F.lit(f"&{name};"), F.lit(value))
    return F.coalesce(_decoded(F.when(rare, c)), native)


def strip_html(markup: Column | str) -> Column:
    """Tags to blanks, character references decoded, white space squashed."""
    return squash(decoded(F.regexp_replace(_col(markup), "<[^>]+>", " ")))


def html_title(markup: Column | str) -> Column:
    """The text of the first h1, or nothing."""
    return strip_html(F.regexp_extract(_col(markup), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))


def heading_path(path: Column) -> Column:
    """Titles joined with " > ", a title that repeats the one before it left out."""
    kept = F.filter(F.transform(path, lambda t, i: F.when((i == 0) | (t != F.get(path, i - 1)), t)), lambda t: t.isNotNull())
    return F.array_join(kept, " > ")


def keyword_overlap(query: Column | str, text: Column | str) -> Column:
    """The share of the query's distinct lower-cased words that stand anywhere in the text, inside words too."""
    wanted = F.array_distinct(tokens(F.lower(_col(query))))
    low = F.lower(_col(text))
    return F.size(F.filter(wanted, lambda t: F.contains(low, t))) / F.greatest(F.lit(1), F.size(wanted))


def hybrid_score(vector_score: Column | str, query: Column | str, text: Column | str, weight: float = 0.7) -> Column:
    """Vector score and keyword overlap mixed; the vector score alone where there is no text."""
    v = _col(vector_score)
    return F.when(_col(text).isNull(), v).otherwise(v * weight + keyword_overlap(query, text) * round(1 - weight, 9))


#: Fixed value: what the answering model is told.
SYSTEM_PROMPT = (
    "You are a Question Answering Assistant."
    "Based on the context provided, generate a very short and direct answer with no additional explanation."
    "e.g. Question: 'where is the most gold stored in the world?' Answer: 'United States'"
)


def prompt(question: Column | str, contexts: Column | str) -> Column:
    """The contexts, each introduced, and the question."""
    return F.concat(F.array_join(F.transform(_col(contexts), lambda c: F.concat(F.lit("Context: "), c)), "\n\n"), F.lit("\n\nQuestion:"), _col(question))


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))


def short_title(title: Column | str, most: int = 100) -> Column:
    """Up to `most` characters as they are; long paths as first > ... > last; others cut."""
    t = _col(title)
    parts = F.split(t, ">")
    ends = F.concat(F.trim(parts[0]), F.lit(" > ... > "), F.trim(F.element_at(parts, -1)))
    return F.when(F.length(t) <= most, t).when(F.size(parts) > 2, ends).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def preview(content: Column | str, most: int = 150) -> Column:
    c = _col(content)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def shown_score(score: Column | str) -> Column:
    return F.format_string("%.2f", _col(score).cast("double"))


def shown_title(title: Column | str, chunk_title: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(title), F.lit("")), _col(chunk_title), F.lit(""))


def composite_id(value: Column | str) -> Column:
    """struct(doc_id string, chunk_id int) of "doc_12|chunk_3", "12|3" or a plain id.

    Of more than two parts the first two count.  A chunk that isn't a number is chunk 0; a value whose
    document isn't one stays whole, as chunk 0.
    """
    v = _col(value).cast("string")
    parts = F.split(v, "\\|")
    number = lambda c, prefix: F.regexp_replace(F.trim(c), f"^{prefix}", "").try_cast("bigint")
    doc, chunk = number(parts[0], "doc_"), number(F.get(parts, F.lit(1)), "chunk_")
    pair = (F.size(parts) >= 2) & doc.isNotNull()
    return F.struct(F.when(pair, doc.cast("string")).otherwise(v).alias("doc_id"), F.when(pair, F.coalesce(chunk, F.lit(0))).otherwise(0).cast("int").alias("chunk_id"))
