"""Note-text expressions. Word characters are Unicode letters, numbers and the underscore."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# neither a letter, a number nor an underscore; the underscore is blanked as well in cleaned text
SEPARATOR = r"[^\p{L}\p{N}]"
DIGITS = r"\p{Nd}+"
# The characters that end a line of text.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _words_only(text: Column) -> Column:
    """Every separator as one blank, so positions stay the same."""
    return F.regexp_replace(text, SEPARATOR, " ")


def clean_text(text: Column) -> Column:
    """Lower-case words separated by single blanks."""
    return F.lower(F.regexp_replace(text, SEPARATOR + "+", " "))


def clean_tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Distinct words in order of appearance, without digits, single letters and stop words."""
    words = F.split(F.regexp_replace(F.lower(_words_only(text)), DIGITS, ""), " +")
    stop = list(stop_words)

    def wanted(word: Column) -> Column:
        keep = (word != "") & ~word.rlike("^[a-zA-Z]$")
        return keep & ~word.isin(stop) if stop else keep

    return F.filter(F.array_distinct(words), wanted)


def _without_last_break(text: Column) -> Column:
    """A line break at the very end closes the last line and starts no new one."""
    size = F.length(text)
    return (
        F.when(F.endswith(text, F.lit("\r\n")), F.substring(text, F.lit(1), size - 2))
        .when(F.right(text, F.lit(1)).isin(list(BREAKS)), F.substring(text, F.lit(1), size - 1))
        .otherwise(text)
    )


def tokenizer_text(text: Column) -> Column:
    """One line of text for a tokenizer: lines joined by ``. ``, symbols dropped, dots tidied."""
    one_line = F.regexp_replace(_without_last_break(text), LINE_BREAK, ". ")
    plain = F.regexp_replace(one_line, r"[\[\]*_#:?! ]+", " ")
    # dots that touch or stand one blank apart become one
    return F.regexp_replace(plain, r"(?: ?\.)+", ".")


def section_after_first(text: Column, term: str) -> Column:
    """What follows the first ``term`` in the cleaned text, or ``none``."""
    cleaned = F.lower(_words_only(text))
    at = F.instr(cleaned, term.lower())
    return F.when(at > 0, F.substring(cleaned, at + len(term), F.length(cleaned))).otherwise("none")


def section_after_last(text: Column, term: str) -> Column:
    """What follows the last ``term`` in the lower-cased text, or all of it."""
    return F.substring_index(F.lower(text), term.lower(), -1)


def regex_tokens(text: Column, pattern: str = r"\w+") -> Column:
    """Lower-cased matches of ``pattern``."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def regex_retokenised(text: Column, pattern: str = r"\w+") -> Column:
    """The matches joined by blanks again."""
    return F.concat_ws(" ", regex_tokens(text, pattern))


def has_keyword(text: Column, word: str) -> Column:
    return F.contains(F.lower(text), F.lit(word.lower()))
