"""SQL building blocks for the equivalent queries: the same derived inputs, and text rules."""
from tidewatch.functions.text import (
    BOT_AUTHORS, EXTERNAL_LINK, FRANCHISE_TOKENS, WHITESPACE_CODES, WORD, WS)

SPACES = "(" + " || ".join(f"chr({code})" for code in WHITESPACE_CODES) + ")"
# No look-behind here: the character before a mention is captured and put back.
MENTION = rf"(^|[^{WORD}/])/?[rR]/[A-Za-z0-9_]{{2,21}}\b"
SELF = rf"(?i)\bthis[{WS}]+(?:sub|subreddit)\b"


def count(text, pattern):
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


def word_count(text):
    return count(text, f"[^{WS}]+")


def unmentioned(text):
    return rf"regexp_replace({text}, '{MENTION}', '\1 ', 'g')"


def unleaked(text):
    return f"regexp_replace({unmentioned(text)}, '{SELF}', ' ', 'g')"


def normalised(text):
    links = f"regexp_replace({text}, 'https?://[^{WS}]+', ' ', 'g')"
    return f"trim(regexp_replace({links}, '[{WS}]+', ' ', 'g'))"


def stripped(text):
    return f"trim({text}, {SPACES})"


def title_key(title):
    return f"trim(regexp_replace(lower(coalesce({title}, '')), '[^a-z0-9]+', ' ', 'g'))"


def is_bot(author):
    names = ", ".join(f"'{n}'" for n in BOT_AUTHORS)
    name = f"lower(coalesce({author}, ''))"
    return f"({name} IN ({names}) OR {name} LIKE '%bot')"


def has_token(text, pattern):
    return f"coalesce(regexp_matches({text}, '(?i){pattern}'), false)"


POSTS = """posts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.source AS subreddit, d.lang,
         split_part(d.text, chr(10), 1) AS title,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) ||
           CASE WHEN d.doc_id % 7 = 0 THEN ' crossposting from r/' || d.source
                WHEN d.doc_id % 11 = 0 THEN ' love this sub'
                WHEN d.doc_id % 13 = 0 THEN ' see http://x.example/' || d.doc_id
                ELSE '' END AS body,
         epoch_us(e.ts) / 1e6 AS created_utc,
         CASE WHEN d.doc_id % 17 = 0 THEN 0.0
              ELSE epoch_us(e.ts) / 1e6 + (d.doc_id % 10) * 1800 END AS snapshot_utc,
         d.doc_id % 97 AS score, (d.doc_id % 100) / 100.0 AS upvote_ratio,
         CASE WHEN d.doc_id % 3 = 0 THEN d.lang END AS flair, d.doc_id % 4 <> 0 AS is_self
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

COMMENTS = f"""comments AS (
  SELECT conv_id AS doc_id, turn,
         {stripped("CASE WHEN turn % 7 = 6 THEN '[removed]' ELSE text END")} AS body,
         CASE WHEN role = 'system' THEN 'AutoModerator' WHEN turn % 5 = 4 THEN 'helper_bot'
              ELSE 'u' || turn END AS author,
         turn = 0 AS is_stickied
  FROM conversations),
classed AS (
  SELECT *, CASE WHEN body IN ('', '[deleted]', '[removed]') THEN 'deleted_or_removed'
                 WHEN {is_bot("author")} THEN 'bot'
                 WHEN is_stickied THEN 'moderator_or_stickied'
                 ELSE 'kept' END AS class
  FROM comments)"""

STATUS = """status AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN doc_id % 29 = 0 THEN 'quarantined' WHEN toxic = 1 THEN 'moderator'
              WHEN quality = 0 THEN 'deleted' END AS removed_by_category
  FROM labels WHERE doc_id % 23 <> 0)"""

SCORED = """scored AS (
  SELECT *, CAST(CASE WHEN correct THEN quality ELSE 1 - quality END AS VARCHAR) AS predicted
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, quality, CAST(quality AS VARCHAR) AS truth,
               0.5 + (doc_id * 7919 % 4999) / 10000.0::DOUBLE AS confidence,
               doc_id * 31 % 100 <= (0.5 + (doc_id * 7919 % 4999) / 10000.0::DOUBLE) * 100
                 AS correct
        FROM labels))"""

ANSWERS = """answers AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'a' AS annotator,
         CASE WHEN doc_id % 5 = 0 THEN 'unsure'
              WHEN doc_id % 9 = 0 THEN CAST(1 - quality AS VARCHAR)
              ELSE CAST(quality AS VARCHAR) END AS answer, 1.0::DOUBLE + doc_id % 13 AS seconds
  FROM labels
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), 'b',
         CASE WHEN doc_id % 6 = 0 THEN 'unsure' ELSE CAST(1 - toxic AS VARCHAR) END,
         1.0::DOUBLE + doc_id % 13
  FROM labels)"""


def joined(comments=False):
    """Posts with the text parts put together, before cleaning."""
    if not comments:
        return POSTS + """,
joined AS (
  SELECT *, concat_ws(' ', nullif(title, ''), nullif(body, '')) AS raw_text FROM posts)"""
    return f"""{POSTS}, {COMMENTS},
kept_comments AS (
  SELECT doc_id, string_agg(body, ' ' ORDER BY turn) AS kept_text, count(*) AS n_kept
  FROM classed WHERE class = 'kept' GROUP BY doc_id),
joined AS (
  SELECT p.*, coalesce(k.n_kept, 0) AS n_comments_kept,
         concat_ws(' ', nullif(title, ''), nullif(body, ''), kept_text) AS raw_text
  FROM posts p LEFT JOIN kept_comments k USING (doc_id))"""


def deduplicated(comments=False):
    return joined(comments) + f""",
keyed AS (SELECT *, {title_key("title")} AS title_key FROM joined),
flagged AS (
  SELECT *, min(subreddit) OVER w <> max(subreddit) OVER w AS conflict,
         row_number() OVER (PARTITION BY title_key
                            ORDER BY snapshot_utc, created_utc, id) AS nth
  FROM keyed WINDOW w AS (PARTITION BY title_key)),
kept AS (SELECT * FROM flagged WHERE NOT conflict AND nth = 1)"""


def tagged(comments=False, order="created_utc DESC, md5(id), id"):
    return deduplicated(comments) + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY {order}) AS rn,
         greatest(1, CAST(round_even(count(*) OVER (PARTITION BY subreddit) * 0.2, 0) AS BIGINT))
           AS n_test
  FROM kept),
tagged AS (
  SELECT *, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS split,
         {normalised(unleaked("raw_text"))} AS text FROM ranked),
worded AS (SELECT *, {word_count("text")} AS n_words FROM tagged),
final AS (SELECT * FROM worded WHERE NOT (split = 'train' AND n_words < 3))"""
