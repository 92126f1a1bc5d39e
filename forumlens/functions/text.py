"""Text as column expressions: cleaners, links, tokenizers, assembly.

A cleaner is a list of passes (pattern, replacement); the patterns keep to what Java's and RE2's regular expressions
both understand, so `as_sql` can state the same cleaner for another engine. Null texts stay null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Passes = Sequence[tuple[str, str]]

def _any(parts: dict[str, str]) -> str:
    """One pattern for several kinds of noise."""
    return "(?i)" + "|".join(parts.values())


#: What carries no meaning in a text, by kind: of addresses, and of markup.
_ADDRESS = {"scheme": r"https?://", "www": r"\bwww\d?\.", "page": r"\.html?\b", "domain": r"\.(?:com|org|net)\b", "index": r"/index\.\w{3,4}", "ruler": r"\n-{2,}"}
_SYNTAX = {
    "mention": r"\b[ru]/", "wiki": r"/?wiki/", "query": r"\?\w+=", "parameter": r"&\w+=", "escape": r"%[0-9A-F]{2}", "path": r"[#/_]+", "dashes": r"-{2,}", "tag": r"</?[a-z][^<>\n]*>",
    "spoiler": r">!|!<",
}
_ENTITY = r"&#?[a-zA-Z0-9]{2,6};"
_FLAIR_NOISE = {"marker": r"post[_ -]flair", "emote": r":\w+:", "domain": r"\.com\b", "quote": r"\"|\|", "bracket": r"[:_()\[\]/^*\\-]", "entity": _ENTITY}
_LONG_ID = r"\b[0-9a-f]{8}-[0-9a-f-]{27}\b|\b[0-9a-f]{24,}\b|\b\d{5,}\b"
_SPACES: Passes = [(r" {2,}", " "), (r"\n\s*\n\s*\n+", "\n\n")]

#: Document title and body: leading brackets, media links, ids, hosts, markup, leftovers, spaces, blank lines.
DOCUMENT: Passes = [
    (r"^[(\[](\w+(?:[ |/+&'.,:;-]+\w+){0,3})[)\]]", "$1, "),
    (r"!?\[([^\[\]\n]{1,80})\]\([^()\s]{3,200}(?:\s+[\"'][^\"'\n]*[\"'])?\)", "$1"),
    (_ENTITY + "|" + _LONG_ID, " "),
    (_any(_ADDRESS), ""),
    (_any(_SYNTAX), " "),
    (r"[|()\[\]<>^~`*=\\]+|:-+:?|[.,!?]{4,}", " "),
    *_SPACES,
]
#: Replies: as documents, but without the passes for leading brackets and ids.
REPLY: Passes = [DOCUMENT[1], (DOCUMENT[3][0], " "), *DOCUMENT[4:]]
#: Descriptions: hosts, entities, markup, spaces, blank lines.
DESCRIPTION: Passes = [(DOCUMENT[3][0], ""), (_ENTITY + r"|[|()\[\]#/_]+", " "), (r"[*^~`>]+", ""), (r" {2,}", " "), (r"\n *\n *\n[ \n]*", "\n\n")]
#: Flairs: markers, brackets and separators.
FLAIR: Passes = [(_any(_FLAIR_NOISE), " "), (r"- ", " "), (r"\s{2,}", " ")]
#: Text read from images.
OCR: Passes = [(r"(?i)https?://\S+|www\.\S+", " "), (r"[|()\[\]<>^~`*=_\\]+|\d{5,}", " "), (r" {2,}", " ")]
#: Link paths: parameters, slashes, ids, separators.
PATH: Passes = [(r"[?#&].*$", ""), (r"/+", " "), (r"(?i)\.\w{3,4}$|" + _LONG_ID + r"|\b[a-z]+\d+[a-z]+\w*\b", ""), (r"[-_+=]", " "), (r" {2,}", " ")]

PASSES = {"document": DOCUMENT, "reply": REPLY, "description": DESCRIPTION, "flair": FLAIR, "ocr": OCR, "path": PATH}


def cleaned(column: Column, passes: Passes) -> Column:
    """All passes in one projection, then trimmed of outer spaces."""
    for pattern, replacement in passes:
        column = F.regexp_replace(column, pattern, replacement)
    return F.trim(column)


def as_sql(column: str, passes: Passes) -> str:
    """The same cleaner as an SQL expression with RE2 regular expressions."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in passes:
        column = f"regexp_replace({column}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
        if "\n" in replacement:
            column = column.replace(quote(replacement), "chr(10) || chr(10)")
    return f"trim({column})"


def clean_document(c: Column) -> Column:
    return cleaned(c, DOCUMENT)


def clean_reply(c: Column) -> Column:
    return cleaned(c, REPLY)


def clean_description(c: Column) -> Column:
    """Null becomes the empty string."""
    return cleaned(F.coalesce(c, F.lit("")), DESCRIPTION)


def clean_flair(c: Column) -> Column:
    return cleaned(c, FLAIR)


HOST = r"https?://(?:www\.)?([^/?#\s]+)"
PATH_PART = r"https?://[^/\s]+/([^\s]*)"


def url_domain(url: Column, own_media: Sequence[str] = (), item_id: Column | None = None) -> Column:
    """The host without `www.`; null for null, for hosts of own media (they carry no meaning), for links to the item itself, and where there is no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))
    skip = host.isin(*own_media) if own_media else F.lit(False)
    if item_id is not None:
        bare = F.element_at(F.split(item_id, "_"), -1)
        skip = skip | F.coalesce((bare != "") & F.contains(url, bare), F.lit(False))
    return F.when(url.isNotNull() & ~F.coalesce(skip, F.lit(False)), host)


def url_path_words(url: Column) -> Column:
    """The readable part of the path; null where there is no path."""
    return cleaned(F.nullif(F.regexp_extract(url, PATH_PART, 1), F.lit("")), PATH)


def url_text(domain: Column, path: Column, rules: Sequence[tuple[Sequence[str], str]], least_words: int = 3) -> Column:
    """Words for a link by its domain.

    `rules` are (domains, what): 'name' gives the site's name only, 'first' adds the first word of the path, 'path' the
    whole path. Other domains get their path if it has at least `least_words` words, else the domain alone.
    """
    name = F.regexp_replace(domain, r"^(?:m|mobile|open|i)\.|\.(?:com|tv|org|net)$", "")
    shown = F.coalesce(path, F.lit(""))
    out = F.when(domain.isNull(), F.lit(None).cast("string"))
    for domains, what in rules:
        text = {"name": name, "first": F.trim(F.concat(name, F.lit(" "), F.split(shown, " ").getItem(0))), "path": F.trim(F.concat(name, F.lit(" "), shown))}[what]
        out = out.when(domain.isin(*domains), text)
    return out.when(word_count(shown) >= least_words, F.concat(domain, F.lit(" "), shown)).otherwise(domain)


def head_and_tail(c: Column, limit: int = 1010, head: int = 720, tail: int = 290) -> Column:
    """Texts of `limit` characters and more keep their head and tail; null becomes empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.char_length(text) >= limit, F.concat(F.left(text, F.lit(head)), F.lit(".\n\n"), F.right(text, F.lit(tail)))).otherwise(text)


def assemble(flair: Column, flag: Column, note: str, link: Column, body: Column, image_text: Column, image_limit: int = 300) -> Column:
    """Flair, note (where flagged), link words, body and image text, one per line; parts that are null leave no gap in words."""
    empty = F.lit("")
    line = lambda x: F.coalesce(F.concat(F.lit("\n"), x), empty)
    return F.trim(
        F.concat(
            F.coalesce(flair, empty), F.when(F.coalesce(flag, F.lit(False)), F.lit("\n" + note)).otherwise(empty), line(link),
            F.lit("\n"), head_and_tail(body), F.lit("\n"), F.coalesce(F.left(image_text, F.lit(image_limit)), empty),
        )
    )


def distinct_join(arrays: Sequence[Column], separator: str, strip_prefix: str = "^[ru]/") -> Column:
    """Distinct non-empty strings of several arrays in order of first appearance, joined; null arrays count as empty."""
    both = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))
    bare = F.transform(both, lambda s: F.trim(F.regexp_replace(s, strip_prefix, "")))
    return F.array_join(F.array_distinct(F.filter(bare, lambda s: s != "")), separator)


def word_count(c: Column, pattern: str = r"\w+") -> Column:
    """Number of matches; null for null."""
    return F.regexp_count(c, F.lit(pattern))


def linked_names(c: Column) -> Column:
    """Names written as r/name, lower-cased, in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\br/(\w{2,21})"), 1), lambda x: F.lower(x))


#: Parts that tokenizers are composed of, in classes that regular-expression engines agree on.
_LETTER, _SIGN = r"\p{L}\p{M}\p{N}_", r"\p{Z}\s!-/:-@\[-`{-~"
_WORD, _SYMBOL, _PLAIN = f"[{_LETTER}]{{2,}}", f"[^{_LETTER}{_SIGN}]", r"[\p{L}\p{M}]{2,}"
_ACRONYM = r"(?U)\b\w(?:\.\w){1,2}"
#: Tokenizers by name: words; also one- to three-letter acronyms with points; also symbols such as emoji; letters only.
TOKENIZERS = {"words": _WORD, "words_acronyms": f"(?U)\\b\\w\\w+\\b|{_ACRONYM}", "words_emoji": f"{_WORD}|{_SYMBOL}", "words_acronyms_emoji": f"(?U)\\b\\w\\w+\\b|{_ACRONYM}|{_SYMBOL}", "letters": _PLAIN}
#: Those whose patterns another SQL engine understands too.
SQL_TOKENIZERS = ("words", "words_emoji", "letters")


def tokens_sql(column: str, tokenizer: str) -> str:
    return f"regexp_extract_all(lower({column}), '{TOKENIZERS[tokenizer]}')"


def tokens(c: Column, tokenizer: str = "words", lower: bool = True, drop_digits: bool = False) -> Column:
    """The tokens of a text; an unknown tokenizer is an error. Null gives null, a text without tokens an empty array."""
    text = F.lower(c) if lower else c
    text = F.regexp_replace(text, r"\d", "") if drop_digits else text
    if tokenizer == "split":
        return F.filter(F.split(text, r"\s+"), lambda s: s != "")
    return F.regexp_extract_all(text, F.lit(TOKENIZERS[tokenizer]), 0)


def normalised_words(c: Column, ascii_only: bool = False) -> Column:
    """Lower-case words with punctuation as space and no empty words."""
    pattern = r"[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{M}\p{N}]+"
    return F.filter(F.split(F.regexp_replace(F.lower(c), pattern, " "), " "), lambda s: s != "")


def ngrams(words: Column, least: int = 1, most: int = 3) -> Column:
    """All n-grams of `least`..`most` words, joined by a space.

    An n-gram is the shorter one before it and the next word, zipped: `words` is evaluated a few times per row, never
    once per n-gram.
    """
    size, grams, out = F.size(words), words, [words] if least <= 1 else []
    for n in range(2, most + 1):
        left = F.slice(grams, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
        grams = F.zip_with(left, F.slice(words, F.lit(n), F.greatest(size, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= least:
            out.append(grams)
    return F.concat(*out)


def ngram_size(gram: Column) -> Column:
    return F.regexp_count(gram, F.lit(" ")) + 1
