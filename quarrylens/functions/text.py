"""Text expressions: identifiers, trigrams, stems, query kinds."""

from __future__ import annotations

from pyspark.sql import functions as F


def split_identifier(c: F.Column) -> F.Column:
    """The identifier, then its camel-case and snake-case words in lower case."""
    words = F.split(F.regexp_replace(c, r"(?<=[^_])(?=\p{Lu})", "_"), "_")
    words = F.filter(F.transform(words, F.lower), lambda w: w != "")
    return F.concat_ws(" ", c, F.concat_ws(" ", words))


def trigrams(c: F.Column) -> F.Column:
    """Distinct runs of three characters of the lower-cased text; none below three."""
    low = F.lower(c)
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


# What the kinds of question begin with.
STRUCTURAL = ["where is", "find ", "what calls", "references to", "who uses", "show me", "locate"]
CONCEPTUAL = ["how ", "how does", "explain", "what does", "why ", "why is", "why does", "describe", "what is the purpose", "summarize"]


def query_kind(c: F.Column) -> F.Column:
    q = F.lower(F.trim(c))
    begins = lambda ps: F.greatest(*[q.startswith(p) for p in ps])
    return F.when(begins(STRUCTURAL), "Structural").when(begins(CONCEPTUAL), "Conceptual").otherwise("Hybrid")


# Words that say nothing about a symbol, and endings in the order they are tried.
STOP_WORDS = (
    "where what which how why when who the a an this that these those its in of for with about to from by on at and or "
    "is are was were does do did has have had can could will would should calls find explain describe show locate uses used "
    "function method struct class module type enum me it all any some not be tool code codebase project file support work programming"
).split()
ENDINGS = ["ies", "ing", "tion", "sion", "ment", "ness", "ed", "ly", "s"]


def stem(w: F.Column) -> F.Column:
    """The word without the first ending that leaves three bytes or more; -ies becomes -y."""
    out = w
    for e in reversed(ENDINGS):
        rest = F.substring(w, F.lit(1), F.length(w) - len(e))
        out = F.when(w.endswith(e) & (F.octet_length(rest) >= 3), F.concat(rest, F.lit("y")) if e == "ies" else rest).otherwise(out)
    return out


def regex_escape(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1")


def search_pattern(c: F.Column) -> F.Column:
    """A regular expression for a question's telling words, stemmed; the whole question if none is left."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(STOP_WORDS))
    found = F.transform(words, lambda w: regex_escape(stem(w)))
    return F.when(F.size(found) == 0, regex_escape(c)).otherwise(F.concat_ws("|", found))


def epoch_text(seconds: F.Column) -> F.Column:
    """Seconds since 1970 as `YYYY-MM-DD HH:MM:SS UTC`, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(F.pmod(rest, F.lit(3600)) / 60), two(F.pmod(rest, F.lit(60))))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    return F.concat(F.regexp_replace(date, "^[+]", ""), F.lit(" "), clock, F.lit(" UTC"))  # years over 9999 come with a sign
