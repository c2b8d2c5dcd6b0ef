"""Text expressions: Column in, Column out, all evaluated in the JVM.

Character classes are written out instead of using Java's regex flags, so that they mean what they
mean for Unicode strings in Python and run unchanged on other engines.
"""
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Whitespace as Python's str.split() and str.strip() see it.
WHITESPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITESPACE_CHARS = "".join(map(chr, WHITESPACE_CODES))
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

COMMUNITY_MENTION = rf"(?=/?[rR]/)(?<![{WORD}/])/?[rR]/[A-Za-z0-9_]{{2,21}}(?![{WORD}])"
SELF_REFERENCE = rf"(?i)(?<![{WORD}])this[{WS}]+(?:sub|subreddit)(?![{WORD}])"
URL = rf"https?://[^{WS}]+"
EXTERNAL_LINK = (
    r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+")

BOT_AUTHORS = (
    "automoderator", "remindmebot", "sneakpeekbot", "wikitextbot",
    "repostsleuthbot", "savevideo", "stabbot", "linkifybot", "b0trank",
    "converter-bot", "same_subreddit_bot", "totesmessenger")
REMOVED_BODIES = ("", "[deleted]", "[removed]")

FRANCHISE_TOKENS = {
    "marvel": r"marvel|avenger|thanos|mcu|spider|iron ?man|deadpool|stan lee|"
              r"captain america|thor|loki|hulk|wanda|x-?men",
    "harrypotter": r"potter|hogwarts|hermione|voldemort|snape|weasley|dumbledore|"
                   r"gryffindor|slytherin|hufflepuff|ravenclaw|wizarding|dobby|hagrid",
}
# --- end of fixed values ------------------------------------------------------


def any_token(patterns):
    """One alternation out of a label -> pattern mapping."""
    return "|".join(patterns.values())


def strip(text):
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def or_empty(text):
    return F.coalesce(text, F.lit(""))


def is_blank(text):
    return strip(or_empty(text)) == ""


def one_space(text):
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def spaced_word_count(text):
    """Words of text whose runs of whitespace are single spaces already."""
    n_spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(n_spaces + 1)


def word_count(text):
    return F.size(F.filter(F.split(one_space(text), " "), lambda w: w != ""))


def count_mentions(text):
    return F.regexp_count(text, F.lit(COMMUNITY_MENTION))


def drop_mentions(text):
    return F.regexp_replace(text, COMMUNITY_MENTION, " ")


def count_self_references(text):
    """Call on text whose mentions are gone: removing one can create a self reference."""
    return F.regexp_count(text, F.lit(SELF_REFERENCE))


def drop_self_references(text):
    return F.regexp_replace(text, SELF_REFERENCE, " ")


def strip_leakage(text):
    return drop_self_references(drop_mentions(text))


def normalise(text):
    """Links and runs of whitespace become one space, ends trimmed."""
    return one_space(F.regexp_replace(text, URL, " "))


def title_key(title):
    return F.trim(F.regexp_replace(F.lower(or_empty(title)), "[^a-z0-9]+", " "))


def title_body(title, body):
    return strip(F.concat(or_empty(title), F.lit(" "), or_empty(body)))


def is_bot(author):
    name = F.lower(or_empty(author))
    return name.isin(*BOT_AUTHORS) | name.endswith("bot")


def comment_class(comment):
    """First match wins: deleted, bot, moderator, else kept."""
    body = strip(or_empty(comment["body"]))
    official = (F.coalesce(comment["is_stickied"], F.lit(False))
                | (or_empty(comment["distinguished"]) != ""))
    return (F.when(body.isin(*REMOVED_BODIES), "deleted_or_removed")
            .when(is_bot(comment["author"]), "bot")
            .when(official, "moderator_or_stickied")
            .otherwise("kept"))


def kept_comments(comments):
    """Stripped bodies of the comments written by the community itself, in order."""
    own = F.filter(comments, lambda c: comment_class(c) == "kept")
    return F.transform(own, lambda c: strip(or_empty(c["body"])))


def join_parts(*parts):
    """Non-empty strings and the strings of array columns, joined by a space."""
    return F.array_join(F.filter(F.concat(*parts), lambda p: p != ""), " ")


def strip_tokens(text, pattern):
    return F.regexp_replace(text, f"(?i){pattern}", " ")


def has_token(text, pattern):
    return F.coalesce(F.regexp_like(text, F.lit(f"(?i){pattern}")), F.lit(False))


def keyword_rule(text, patterns, fallback):
    """The label whose pattern alone matches; none or several give the fallback."""
    hits = {label: has_token(text, pattern) for label, pattern in patterns.items()}
    n_hits = sum((hit.cast("int") for hit in hits.values()), F.lit(0))
    rule = F.when(n_hits != 1, F.lit(fallback))
    for label, hit in hits.items():
        rule = rule.when(hit, F.lit(label))
    return rule


def external_links(title, text):
    joined = F.concat(or_empty(title), F.lit(" "), or_empty(text))
    return F.regexp_count(joined, F.lit(EXTERNAL_LINK))


def truncated(text, limit=1200, mark=" [...]"):
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def removal_marker(text):
    return F.when(text.isin("[removed]", "[deleted]"), text).otherwise("")


def letter_tokens(text):
    return F.regexp_extract_all(or_empty(text), F.lit(r"\p{L}+"), F.lit(0))


def content_tokens(text, stop_words):
    """Letter-only tokens that are not stop words; the case of survivors is kept."""
    stop = F.array(*[F.lit(w.lower()) for w in stop_words]).cast("array<string>")
    return F.filter(letter_tokens(text), lambda t: ~F.array_contains(stop, F.lower(t)))


def tokens(text):
    """Lowercased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def with_bigrams(words):
    """The words followed by every adjacent pair joined with a space."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))),
                       F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)
