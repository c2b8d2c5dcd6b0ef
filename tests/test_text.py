import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.operators.prepare import parsed_comments
from tidewatch.schemas import COMMENTS


def evaluate(spark, function, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(function(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()[0]


def comment(body, author="someone", stickied=False, distinguished=None):
    return (body, 1, author, stickied, distinguished)


def test_comment_classes_and_kept_bodies(spark):
    comments = [comment("\tthe spring tide \n"), comment("Beep", author="TideTableBOT"),
                comment("read me", stickied=True), comment("locked", distinguished="admin"),
                comment(" [removed] ")]
    df = spark.createDataFrame([(comments,)], "c array<struct<body:string,score:bigint,"
                               "author:string,is_stickied:boolean,distinguished:string>>")
    row = df.select(F.transform("c", tx.comment_class).alias("k"),
                    tx.kept_comments(F.col("c")).alias("kept")).first()
    assert row.kept == ["the spring tide"]
    assert row.k == ["kept", "bot", "moderator_or_stickied", "moderator_or_stickied",
                     "deleted_or_removed"]


@pytest.mark.parametrize("author, bot", [
    ("automoderator", True), ("TideTableBOT", True), ("robot", True), ("bottle", False),
    ("bot_keeper", False), ("", False), (None, False)])
def test_is_bot(spark, author, bot):
    assert evaluate(spark, tx.is_bot, author) is bot


@pytest.mark.parametrize("text, mentions, own", [
    ("/R/Knots beats r/buoys_2, r/knots", 3, 0),
    ("does this  subreddit know? a subreddit might", 0, 1),
    ("is this /r/knots sub open", 1, 1),
    ("knots and buoys", 0, 0),
    ("r/x is too short, r/" + "a" * 23 + " too long", 0, 0),
    ("ér/marvel and x/r/marvel are no mentions", 0, 0),
    ("THIS SUBREDDIT and this subs", 0, 1)])
def test_leakage(spark, text, mentions, own):
    assert evaluate(spark, tx.count_mentions, text) == mentions
    left = evaluate(spark, tx.drop_mentions, text)
    assert evaluate(spark, tx.count_self_references, left) == own
    assert evaluate(spark, tx.count_mentions, evaluate(spark, tx.strip_leakage, text)) == 0


def test_franchise_words_stay(spark):
    assert evaluate(spark, tx.strip_leakage, "Thanos sails") == "Thanos sails"


@pytest.mark.parametrize("text, n", [
    ("", 0), ("  ", 0), ("one", 1), (" a\tb\n c d\x1ce ", 5)])
def test_word_count_splits_like_python(spark, text, n):
    assert evaluate(spark, tx.word_count, text) == n == len(text.split())


def test_normalise_and_title_key(spark):
    assert evaluate(spark, tx.normalise, " see\nhttps://x.y/z?q  now ") == "see now"
    assert evaluate(spark, tx.title_key, "¡Ebb & flow-2!") == \
        evaluate(spark, tx.title_key, "ebb\tflow 2") == "ebb flow 2"
    assert evaluate(spark, tx.title_key, None) == evaluate(spark, tx.title_key, "¿?") == ""


@pytest.mark.parametrize("text, label", [
    ("THANOS on deck", "marvel"), ("moored off hogwarts", "harrypotter"),
    ("slack water", "harrypotter"), ("Hogwarts, then Thanos", "harrypotter")])
def test_keyword_rule(spark, text, label):
    rule = lambda t: tx.keyword_rule(t, tx.FRANCHISE_TOKENS, "harrypotter")
    assert evaluate(spark, rule, text) == label


def test_tokens_and_bigrams(spark):
    words = evaluate(spark, lambda t: tx.with_bigrams(tx.tokens(t)), "Été: a b2 it's x_y")
    assert words == ["été", "b2", "it", "x_y", "été b2", "b2 it", "it x_y"]
    assert evaluate(spark, lambda t: tx.with_bigrams(tx.tokens(t)), "a") == []
    assert evaluate(spark, lambda t: tx.with_bigrams(tx.tokens(t)), "ab") == ["ab"]


def test_small_rules(spark):
    assert evaluate(spark, tx.external_links, "see http://a.b", "and https://c.d e") == 2
    assert evaluate(spark, tx.removal_marker, "[removed]") == "[removed]"
    assert evaluate(spark, tx.removal_marker, "text") == ""
    long = evaluate(spark, tx.truncated, "x" * 1201)
    assert long == "x" * 1200 + " [...]"
    assert evaluate(spark, tx.truncated, "x" * 1200) == "x" * 1200
    kept = evaluate(spark, lambda t: tx.content_tokens(t, ["the"]), "The Cat, 2 don't")
    assert kept == ["Cat", "don", "t"]


@pytest.mark.parametrize("stored", [None, "", "[]", "not json"])
def test_unreadable_comments_are_no_comments(spark, stored):
    assert evaluate(spark, parsed_comments, stored) == []
    assert COMMENTS.elementType.names[0] == "body"
