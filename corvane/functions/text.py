"""Text functions: folding, query tokens, slugs, titles, citations. All of them are column expressions."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that have a canonical decomposition, and what is left of them without marks, one for one."""
    accented, plain = [], []
    for c in map(chr, chain(range(0xC0, 0xD800), range(0xF900, 0x30000))):
        if not unicodedata.decomposition(c) or c != c.lower():
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        bare = unicodedata.normalize("NFC", bare)  # syllables stay whole
        if len(bare) == 1 and bare != c:
            accented.append(c)
            plain.append(bare)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _plain_letters()

#: Words without content, Portuguese and some English: fixed values.
STOPWORDS = (
    "ao aos as os um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para pra "
    "com sem sob sobre entre ate apos ante ou mas que se como quando onde quem qual quais porque pq "
    "seu sua seus suas meu minha nosso nossa este esta estes estas esse essa esses essas isso isto "
    "aquele aquela aquilo ser sao foi foram sendo estar estao esteve tem ter tinha havia haver "
    "fazer faz feito usar usa usado funciona funcionar deve pode posso quero preciso queria "
    "mais menos muito pouco todo toda todos todas ja nao sim so tambem entao assim aqui agora hoje "
    "the of in to for and or is are how what where when why does did an"
).split()

#: File extensions that make a citation in backquotes a code file: fixed values.
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "sql", "prisma", "zmodel", "sh", "ps1", "yaml", "yml", "toml")

TERM = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without accents; texts of ASCII alone take the short way."""
    low = F.lower(text)
    marks = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"\p{M}", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), marks).otherwise(low)


def terms(text: Column) -> Column:
    """Index terms in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Content tokens of a query; if no token is left, all of two characters or more."""
    every = F.filter(F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    content = F.filter(every, lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(every)


def expanded(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """Tokens and their synonyms, each once, tokens first."""
    if not synonyms:
        return F.array_distinct(tokens)
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tokens, more))


def slug(text: Column) -> Column:
    """Letters and digits joined by dashes, 60 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def headline(text: Column) -> Column:
    """The first sentence, cut at a word to 110 characters and an ellipsis."""
    first = F.get(F.split(text, r"(?<=[.!?])\s", 2), F.lit(0))
    short = F.concat(F.regexp_replace(F.substring(first, 1, 110), r"\s+\S*\z", ""), F.lit("…"))
    return F.when(F.length(first) <= 110, first).otherwise(short)


def cited_files(text: Column) -> Column:
    """Code files named in backquotes, without line numbers and leading slash, each once."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]{3,120})`"), F.lit(1)), lambda s: F.regexp_replace(F.trim(s), r":\d+(-\d+)?$", ""))
    code = F.filter(spans, lambda s: s.rlike(rf"(?i)\.({'|'.join(CODE_EXTENSIONS)})$") & ~s.rlike(r"\s"))
    return F.array_distinct(F.transform(code, lambda s: F.regexp_replace(s, r"^\.?/", "")))


def cited_numbers(text: Column) -> Column:
    """Numbers of three to five digits after a hash sign, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#(\d{3,5})\b"), F.lit(1)), lambda n: n.cast("int")))


def explicit_number(text: Column, branch: Column) -> Column:
    """The number that a document says it belongs to: a card line, a closing word, or its branch."""
    pick = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    card = pick(text, r"\*\*Card:\*\*\s*#(\d{1,5})")
    closing = pick(text, r"(?i)\b(?:closes|fixes|resolves)\s+#(\d{1,5})\b")
    return F.coalesce(card, closing, pick(branch, r"/(\d{3,5})-")).cast("int")


def style(query: Column) -> Column:
    """natural for questions and queries of more than five words, else keywords."""
    return F.when(query.contains("?") | (F.size(F.split(F.trim(query), r"\s+")) > 5), "natural").otherwise("keywords")


def last_two(path: Column) -> Column:
    """The last two segments of a path in lower case, whichever slash it has."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def candidates(argument: Column) -> Column:
    """What an argument can name: its first token bare of quotes and trailing marks, then its path segments, deepest first."""
    token = F.get(F.split(F.trim(F.coalesce(argument, F.lit(""))), r"\s+"), F.lit(0))
    token = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "^[\"']+", ""), "[\"']+$", ""), r"[/\\.,;:]+$", "")
    parts = F.filter(F.split(F.replace(token, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    return F.when(token == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(token), F.reverse(parts))))


def collapse_key(text: Column) -> Column:
    """The folded first 300 characters with white space closed up."""
    return F.trim(F.regexp_replace(fold(F.substring(text, 1, 300)), r"\s+", " "))


def is_empty_answer(answer: Column) -> Column:
    return answer.rlike("^(Nenhum resultado|Query vazia|Nenhuma)")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def github_label(key: Column) -> Column:
    """How a card or pull request is shown by its key: [card #7], [pr #7]; null for any other key."""
    kind, number = F.regexp_extract(key, r"^(card|pr):[^#]*#(\d+)$", 1), F.regexp_extract(key, r"^(card|pr):[^#]*#(\d+)$", 2)
    return F.when(kind != "", F.concat(F.lit("["), kind, F.lit(" #"), number, F.lit("]")))
