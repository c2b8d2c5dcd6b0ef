"""Secrets in texts: three fixed patterns, and candidate strings of high sliding-window entropy.

All column functions, row by row: no shuffle, no Python. Matches are found by marking them with a
character that no pattern can match and splitting there, so that positions are running lengths in
code points. The entropy of a window moves along a candidate by incremental counts: one character
leaves, one enters, and the sum of c*log2(c) over the counts changes by their two terms. The counts
of a class's characters lie packed in a few longs, so that a step adds and subtracts two numbers;
the sum is kept in whole units of 2^-40, so that it does not drift however long the candidate is.

A candidate is a maximal run of a class's characters. A window of it counts when it reaches the
class's entropy and shares no character with a blocked place: a match of the fixed patterns, a span
of a class before, or a match of the allow list inside the run. Blocked places cut a run; each piece
between them with a window that counts gives one span, from the first such window to the end of the
last.

Defined cases: null text is empty and gives no span, counts 0 and the hash of the empty string. Very
long texts and candidates take the same path. Repeated rows give repeated results; other columns are
not looked at.
"""
import math
import re

from pyspark.sql import functions as F

from tidewatch.llm.shared import bound, text_of

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# Fixed patterns: kind, pattern, which group and how many characters of it a match must have.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = ("AKIA[A-Z0-9]+", 0, 18)
HEX = ("[0-9a-f]+", 0, 16)

# Classes of candidates: kind, characters, least length, window, least entropy in bits.
CLASSES = (("entropy_hex", "0-9A-Fa-f", 20, 16, 3.0), ("entropy_base64", "A-Za-z0-9+/_=-", 24, 24, 4.0))

# Places of a candidate that match one of these are not reported; the first matches only whole runs,
# which are words joined by hyphens, underscores or slashes.
ALLOWED = ("^[A-Z]?[a-z]*+(?:[-_/][A-Z]?[a-z]*+)*+$", "(?i)example", "(?i)placeholder", "(?i)abcdefgh",
           "01234567", "(.)\\1{5,}")

_MARK, _OTHER = "\u0001", "\u0002"


def _parts(text, pattern):
    """Alternately what lies between matches and the matches; the mark in a text becomes another
    control character, which is as long and as little part of any pattern."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    return F.split(marked, _MARK, -1)


_SPAN = "struct<s:int,k:int,e:int,t:string>"


def _matches(text, kind, pattern, keep):
    """Spans (start, kind's number, end, text) of the matches that `keep` accepts, in order."""
    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(state, part):
        end = (state["at"] + F.length(part)).cast("int")
        span = F.struct(state["at"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e"), part.alias("t"))
        out = F.when(state["inside"] & keep(part), F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), out.alias("out"))

    found = F.aggregate(_parts(text, pattern), start, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def pattern_spans(text):
    """Spans of the three fixed patterns. For hex and access a run's minimal length may stand in the
    pattern itself, since a match is a whole run; a failing assignment uses up its characters."""
    pattern, group, least = ASSIGN
    assign = _matches(text, "assign", pattern,
                      lambda p: F.length(F.regexp_extract(p, pattern, group)) >= least)
    access = _matches(text, "access", f"AKIA[A-Z0-9]{{{ACCESS[2] - 4},}}", lambda p: F.lit(True))
    hexes = _matches(text, "hex", f"[0-9a-f]{{{HEX[2]},}}", lambda p: F.lit(True))
    return assign, access, hexes


def _blocked(run, taken, allowed):
    """Places of a run where no window may lie, as disjoint ascending (s, e) within the run."""
    places = F.transform(F.filter(taken, lambda t: (t["s"] < run["e"]) & (run["s"] < t["e"])), lambda t: F.struct(
        (t["s"] - run["s"]).alias("s"), (t["e"] - run["s"]).alias("e")))
    for pattern in allowed:
        found = _matches(run["t"], KINDS[0], pattern, lambda p: F.lit(True))
        places = F.concat(places, F.transform(found, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))))
    none = F.from_json(F.lit("[]"), "array<struct<s:int,e:int>>")
    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out"))

    def done(state):
        return F.array_append(state["out"], F.struct(state["s"].alias("s"), state["e"].alias("e")))

    def merge(state, place):
        apart = place["s"] > state["e"]
        return F.struct(F.when(apart, place["s"]).otherwise(state["s"]).alias("s"),
                        F.greatest(state["e"], place["e"]).alias("e"),
                        F.when(apart, done(state)).otherwise(state["out"]).alias("out"))

    return F.filter(F.aggregate(F.array_sort(places), start, merge, done), lambda b: b["e"] > 0)


_UNIT = 1 << 40


def entropy_ranges(text, blocked, characters, window, least):
    """(first, last) of every unblocked piece of `text` that has a window with at least that entropy:
    where the first such window starts and the last one ends.

    The state is the packed counts, the sum of c*log2(c), the number of unblocked characters up to
    here, the next blocked place, and the range of the piece."""
    alphabet = "".join(c for c in map(chr, range(128)) if re.fullmatch(f"[{characters}]", c))
    bits = window.bit_length()
    a_long = 63 // bits
    names = [f"n{i}" for i in range(-(-len(alphabet) // a_long))]
    terms = F.array(*[F.lit(round(n * math.log2(n) * _UNIT) if n else 0).cast("long") for n in range(window + 1)])
    limit = round(((math.log2(window) - least) * window + 1e-9) * _UNIT)   # of the sum, for a window that counts
    none = F.from_json(F.lit("[]"), "array<struct<first:int,last:int>>")

    def slot(character):
        at = F.call_function("instr", F.lit(alphabet), character) - 1
        shift = (at % a_long * bits).cast("int")
        return F.struct(F.floor(at / a_long).cast("int").alias("n"), shift.alias("shift"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    def held(state, place):
        packed = state[names[0]]
        for i, name in enumerate(names[1:], 1):
            packed = F.when(place["n"] == i, state[name]).otherwise(packed)
        return F.call_function("shiftright", packed, place["shift"]).bitwiseAND((1 << bits) - 1).cast("int")

    def term(n):
        return F.element_at(terms, n + 1)

    def ended(state):
        span = F.struct(state["first"].alias("first"), state["last"].alias("last"))
        return F.when(state["first"] >= 0, F.array_append(state["out"], span)).otherwise(state["out"])

    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in (*names, "sum")], F.lit(0).alias("clear"),
                     F.lit(0).alias("next"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), none.alias("out"))

    def counted(slots, state, i):
        """What enters and leaves at character `i`, with the counts that they change."""
        leaves, enters = F.element_at(slots, F.greatest(i - window, F.lit(1))), F.element_at(slots, i)
        return F.struct(leaves.alias("leaves"), enters.alias("enters"), (i > window).alias("full"),
                        held(state, leaves).alias("had"), held(state, enters).alias("has"),
                        F.get(blocked, state["next"]).alias("block"))

    def moved(state, now):
        out = F.when(now["full"], term(now["had"]) - term(now["had"] - 1)).otherwise(F.lit(0).cast("long"))
        same = now["full"] & (now["leaves"]["n"] == now["enters"]["n"]) & (now["leaves"]["shift"] == now["enters"]["shift"])
        before = now["has"] - F.when(same, 1).otherwise(0)
        return state["sum"] - out + term(before + 1) - term(before)

    def step(slots, state, i):
        def change(now):
            inside = F.coalesce((now["block"]["s"] < i) & (i <= now["block"]["e"]), F.lit(False))
            through = F.coalesce(now["block"]["e"] == i, F.lit(False))
            known = F.struct(moved(state, now).alias("sum"), inside.alias("inside"),
                             F.when(inside, 0).otherwise(state["clear"] + 1).alias("clear"))

            def result(here):
                hit = (here["clear"] >= window) & (here["sum"] <= limit)
                packed = [(state[name]
                           + F.when(now["enters"]["n"] == k, now["enters"]["one"]).otherwise(0)
                           - F.when(now["full"] & (now["leaves"]["n"] == k), now["leaves"]["one"]).otherwise(0)
                           ).alias(name) for k, name in enumerate(names)]
                first = F.when(hit & (state["first"] < 0), i - window).otherwise(state["first"])
                return F.struct(
                    *packed, here["sum"].alias("sum"), here["clear"].alias("clear"),
                    (state["next"] + F.when(through, 1).otherwise(0)).alias("next"),
                    F.when(here["inside"], -1).otherwise(first).alias("first"),
                    F.when(here["inside"], -1).when(hit, i).otherwise(state["last"]).alias("last"),
                    F.when(here["inside"], ended(state)).otherwise(state["out"]).alias("out"))
            return bound(known, result)
        return bound(counted(slots, state, i), change)

    def over(slots):
        return F.aggregate(F.sequence(F.lit(1), F.size(slots)), start, lambda state, i: step(slots, state, i), ended)

    return bound(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), slot), over)


def entropy_spans(text, taken, kind, characters, shortest, window, least, allowed=ALLOWED):
    """Spans of one class of candidates that overlap none of `taken`."""
    runs = _matches(text, kind, f"[{characters}]{{{shortest},}}", lambda p: F.lit(True))
    with_blocks = F.transform(runs, lambda r: F.struct(r.alias("run"), _blocked(r, taken, allowed).alias("blocked")))
    spans = F.transform(with_blocks, lambda x: F.transform(
        entropy_ranges(x["run"]["t"], x["blocked"], characters, window, least), lambda g: F.struct(
            (x["run"]["s"] + g["first"]).cast("int").alias("s"), x["run"]["k"].alias("k"),
            (x["run"]["s"] + g["last"]).cast("int").alias("e"),
            F.substring(x["run"]["t"], g["first"] + 1, g["last"] - g["first"]).alias("t"))))
    return F.flatten(spans)


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs, classes=CLASSES, allowed=ALLOWED):
    """A row per row of `docs`: doc_id, assign, access, hex and added (arrays of spans with start s,
    end e and text t)."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    text = F.col("_text")
    assign, access, hexes = pattern_spans(text)
    rows = rows.select("doc_id", "_text", assign.alias("assign"), access.alias("access"), hexes.alias("hex"))
    rows = rows.withColumn("added", F.concat("assign", "access", "hex"))
    for kind, *settings in classes:
        rows = rows.withColumn("added", F.concat("added", entropy_spans(
            text, F.col("added"), kind, *settings, allowed=allowed)))
    own = F.slice("added", F.size("assign") + F.size("access") + F.size("hex") + 1, F.size("added") + 1)
    return rows.select("doc_id", "assign", "access", "hex", own.alias("added"))


def report(found):
    """Counts and span lists of `find_secrets`."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "added")).alias("spans"))
