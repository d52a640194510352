"""Text functions as Columns: identifiers, search terms, lines, paths and ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUERY_TERMS = 64
EMBEDDING_CHARS = 2000

#: Words of letters, digits and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"
#: Borders inside an identifier: underscores, lower to upper, letter to digit and back, and the
#: last capital of a run that a small letter follows.
BORDER = r"_+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Nd})(?=[^\p{Nd}_])|(?<=[^\p{Nd}_])(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"

#: Spanish and English function words that are dropped from queries (never from
#: the index), compared without accents.
QUERY_STOP_WORDS = frozenset(
    """
    a al algo algun alguna algunas alguno algunos ante antes aqui asi bajo cada como con
    contra cual cuales cuando de del desde donde dos el ella ellas ello ellos en entre era
    eres es esa esas ese eso esos esta estan estas este esto estos fue fueron ha han hay
    hace hacer hacen la las le les lo los mas me mi mis mucho muy nada ni no nos o otra
    otro para pero poco por porque puede pueden que quien se segun ser si sin sobre son
    su sus tambien tan te tiene tienen todo todos tu tus un una unas uno unos usa usar y ya
    about above after an and any are as at be been being but by can could did do does
    doing during each for from had has have having he her here how i if in into is it its
    me more most my no not of off on once only or other our out over own same she should
    so some such than that the their them then there these they this those through to
    too under until up very was we were what when where which while who whom why will with
    would you your
    """.split()
)


def split_identifier(token: Column) -> Column:
    """The words of an identifier, in order: ``getUserById`` gives get, User, By, Id."""
    return F.array_remove(F.split(token, BORDER), "")


def expand(text: Column) -> Column:
    """Every word of a text, each followed by its parts if it has more than one."""

    def with_parts(word: Column) -> Column:
        parts = split_identifier(word)
        return F.when(F.size(parts) > 1, F.concat(F.array(word), parts)).otherwise(F.array(word))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), with_parts))


def search_text(*fields: Column) -> Column:
    """What the text index holds for a row: the expanded words of its fields."""
    return F.array_join(F.flatten(F.array(*(expand(F.coalesce(f, F.lit(""))) for f in fields))), " ")


def words(text: Column) -> Column:
    """Lower-case words of a text, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.lower)


def _without_marks(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.category(c).startswith("M"))


def _folding(plain) -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters."""
    pairs = [(c, _without_marks(c)) for c in map(chr, range(0x80, 0x2000)) if c.isalpha()]
    pairs = [(c, p) for c, p in pairs if len(p) == 1 and p != c and plain(p)]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


_ACCENTED, _PLAIN = _folding(lambda p: True)
#: Latin letters that don't decompose, as the text index spells them.
_STROKED, _UNSTROKED = "ØøĐđĦħŁłŦŧŊŋÐðı", "OoDdHhLlTtNnDdi"
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
_LATIN, _ASCII = (own + more for own, more in zip(_folding(str.isascii), (_STROKED, _UNSTROKED)))


def fold(term: Column) -> Column:
    """Lower case without accents, in any script."""
    return F.regexp_replace(F.lower(F.translate(term, _ACCENTED, _PLAIN)), r"\p{Mn}", "")


def ascii_folded(text: Column) -> Column:
    """Lower case, Latin letters without accents and as ASCII; one letter stays one word's part."""
    out = F.lower(F.translate(text, _LATIN, _ASCII))
    for letter, spelled in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    # ASCII texts have nothing to fold: they need not go letter by letter through the tables.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(out)


def terms(text: Column) -> Column:
    """The terms that the text index holds: folded words, in order, repeats kept."""
    return F.regexp_extract_all(ascii_folded(text), F.lit(WORD), F.lit(1))


def query_terms(query: Column) -> Column:
    """The terms of a query: expanded, without stop words, each once, at most ``MAX_QUERY_TERMS``."""
    stops = F.array(*(F.lit(w) for w in sorted(QUERY_STOP_WORDS)))
    kept = F.filter(expand(query), lambda t: ~F.array_contains(stops, fold(t)))
    return F.slice(F.array_distinct(F.transform(kept, F.lower)), 1, MAX_QUERY_TERMS)


def index_terms(query: Column) -> Column:
    """The terms of a query as the text index spells them."""
    return F.array_distinct(F.transform(query_terms(query), ascii_folded))


def text_query(query: Column) -> Column:
    return F.array_join(query_terms(query), " ")


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Lines of a text; one empty line at the very end does not count."""
    lines = F.split(normalize_newlines(text), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def is_blank(line: Column) -> Column:
    return F.regexp_replace(line, r"[\s\x{85}\x{a0}\x{1c}-\x{1f}]+", "") == ""


def embedding_text(rel_path: Column, symbol: Column, text: Column) -> Column:
    """What an embedder sees of a chunk: path, symbol (if any), an empty line, the text; capped."""
    head = F.when(F.coalesce(symbol, F.lit("")) == "", rel_path).otherwise(F.concat_ws("\n", rel_path, symbol))
    return F.substring(F.concat(head, F.lit("\n\n"), text), 1, EMBEDDING_CHARS)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of a hash over parts that a NUL character separates."""
    return F.substring(F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)), 256), 1, length)


def chunk_id(file_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s-%05d", file_id, ordinal)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no repeated or trailing ones, no ``.`` parts."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    without_dots = F.regexp_replace(slashed, r"(?<=^|/)\./", "")
    return F.when(without_dots == "/", without_dots).otherwise(F.regexp_replace(without_dots, r"/$", ""))


def is_within(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies under it, part by part."""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, r"/$", ""), F.lit("/")))


def relative_path(path: Column, root: Column) -> Column:
    return F.when(is_within(path, root) & (path != root), F.substring(path, F.length(F.regexp_replace(root, r"/$", "")) + 2, F.length(path)))


def join_path(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat_ws("/", base, name))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def preview(text: Column, lines: int = 4, width: int = 110) -> Column:
    """The first lines of a hit, each cut to a width."""
    return F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.substring(x, 1, width))
