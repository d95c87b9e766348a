"""Personal data by bootstrapped contexts, in DataFrame functions only.

**Seeds.** E-mail addresses, IP addresses, card numbers and phone numbers that
stand in the text in full form (``KINDS``): leftmost matches that do not
overlap, kind by kind, of which those that fail the kind's test go.

**Patterns and instances.** A pattern is a lexical context: the two words before
an identifier, in lower case.  An instance is an identifier's text: a seed, or
a candidate, which is a word of 4 to 64 characters with four digits or an ``@``
that is sought in the text with the seeds blanked out.  Patterns and instances
are the two sides of a graph; an edge is an occurrence of the instance behind
the pattern.

**Scores.** Seeds have score 1.  A pattern's score is the summed score of its
instances' occurrences over all places of the corpus where its two words are
followed by a word, whatever that is; an instance's is, towards each pattern,
that of its best other pattern.  Both are taken in turn, ``rounds`` times, in whole millionths, so
they do not depend on the order of rows.  Patterns with fewer than
``min_instances`` different instances score 0: they can neither gain trust nor give it.

**Discovery.** Candidates behind a pattern of score ``min_score`` or more are
added, with the kind that most of the pattern's score came from.

Every step is an expression over one text or a join and an aggregate of edges;
hot patterns and instances are combined before their shuffle.  Places are
counted from all words of all texts; a bitmap of fixed size (2 MB) lets only
words pass that may belong to a pattern, and a join decides.

Defined cases: a null or empty text has no spans; kinds may overlap each other,
and what a blanked seed leaves of an overlapping one can be a candidate; a match
that starts inside a longer run of its own characters is never tried (it could
not be leftmost); matching takes time in proportion to the text and no stack;
repeated rows are documents of their own; rows come in any order; other columns
are ignored.  Positions are code points, from 0, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.scratch import stage

# Possessive repeats: each class excludes what follows it, so nothing is ever tried again, and no stack is used.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD_WITH_DIGIT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
DIGITS = r"@|[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9]"
#: Stands for a seed in a blanked text; no word of a pattern holds it.
BLANK = "\ue000"
#: Characters before an identifier that its context is read from.
REACH = 100
CONTEXT = r"(?:^|\s)(\S+)\s+(\S+)\s+[^\s\p{L}\p{N}]*$"
BITS = 24
MILLION = 1_000_000


@dataclass(frozen=True)
class Bootstrap:
    """Parameters of the bootstrap."""

    rounds: int = 3
    min_instances: int = 3
    min_score: int = 800_000


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a number passes the check of its last digit."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    places = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(
        i % 2 == 1, F.element_at(doubled, d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(hit: Column) -> Column:
    return _let(digits_of(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


#: Kinds in their order: name, pattern, a cheap test whether a text can hold one, the test of a match.
KINDS = (
    ("email", EMAIL, lambda text: text.contains("@"), lambda hit: F.lit(True)),
    ("ip", IP, lambda text: text.rlike(r"[0-9]\.[0-9]"),
     lambda hit: ~F.exists(F.split(hit, r"\."), lambda part: ~part.rlike(r"^0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])$"))),
    ("card", CARD, lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _card),
    ("phone", PHONE, lambda text: text.contains("+"), lambda hit: F.length(digits_of(hit)).between(10, 15)),
)
NAMES = tuple(k[0] for k in KINDS)

_SPANS = "array<struct<start:long,kind:int,end:long,text:string,context:string>>"


def sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, in blocks of the root of their number."""
    def walk(a: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(a))).cast("int")
        add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / side).cast("int")), lambda b: add(F.slice(a, b * side + 1, side)))
        return _let(blocks, lambda t: _let(F.transform(t, lambda _, b: add(F.slice(t, F.lit(1), b))), lambda tops: F.transform(
            a, lambda _, i: F.element_at(tops, F.floor(i / side).cast("int") + 1)
            + add(F.slice(a, F.floor(i / side).cast("int") * side + 1, i % side)))))
    return F.when(F.size(sizes) == 0, F.array().cast("array<long>")).otherwise(walk(sizes))


def context_before(gap: Column) -> Column:
    """The last two words before an identifier, from the text that ends there; null if it has none."""
    def read(tail: Column) -> Column:
        return F.when(tail.rlike(CONTEXT) & ~tail.contains(BLANK), F.lower(F.concat(
            F.regexp_extract(tail, CONTEXT, 1), F.lit(" "), F.regexp_extract(tail, CONTEXT, 2))))
    return _let(F.substring(gap, -REACH, REACH), read)


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))


def matches(text: Column, pattern: str, kind: int, may: Column, valid) -> Column:
    """The valid matches as spans, in order."""
    def spans(p: Column) -> Column:
        gaps, hits = p["gaps"], p["hits"]
        steps = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(gaps, i))).cast("long"))
        return F.filter(F.transform(F.arrays_zip(sums_before(steps).alias("at"), hits.alias("hit")), lambda x, i: _let(
            x["at"] + F.length(F.get(gaps, i)), lambda start: F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"),
                context_before(F.get(gaps, i)).alias("context")))), lambda s: valid(s["text"]))
    return F.when(may, _let(_parts(text, pattern), spans)).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def _blank(valid):
    def blank(p: Column) -> Column:
        pieces = F.transform(p["hits"], lambda h, i: F.concat(
            F.get(p["gaps"], i), F.when(valid(h), F.repeat(F.lit(BLANK), F.length(h))).otherwise(h)))
        return F.concat(F.array_join(pieces, ""), F.element_at(p["gaps"], -1))
    return blank


def blanked(text: Column) -> Column:
    """The text with its seeds blanked out, kind after kind, each character by one."""
    for _, pattern, may, valid in KINDS:
        text = F.when(may(text), _let(_parts(text, pattern), _blank(valid))).otherwise(text)
    return text


def _core(span: Column) -> Column:
    """A candidate without the punctuation around it."""
    lead = F.regexp_extract(span["text"], r"^[^0-9A-Za-z+@]*+", 0)
    core = F.regexp_replace(F.substring(span["text"], F.length(lead) + 1, F.length(span["text"])), r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "")
    start = span["start"] + F.length(lead)
    return F.struct(start.alias("start"), span["kind"].alias("kind"), (start + F.length(core)).alias("end"), core.alias("text"),
                    span["context"].alias("context"))


def candidates(text: Column) -> Column:
    """Words with four digits or an ``@`` outside the seeds."""
    found = matches(text, WORD_WITH_DIGIT, -1, text.rlike(DIGITS), lambda _: F.lit(True))
    return F.filter(F.transform(F.filter(found, lambda s: ~s["text"].contains(BLANK)), _core), lambda s: F.length(s["text"]).between(4, 64)
                    & (s["text"].contains("@") | (F.length(digits_of(s["text"])) >= 4)) & s["context"].isNotNull())


def occurrences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's seeds and candidates, with a number of its row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seeds = F.concat(*[matches(text, pattern, k, may(text), valid) for k, (_, pattern, may, valid) in enumerate(KINDS)])
    some = text.rlike("[0-9@]")      # a text without a digit and an @ has neither
    none = F.array().cast(_SPANS)
    seeded = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"),
                         F.when(some, seeds).otherwise(none).alias("seeds"))
    left = F.when(F.size("seeds") == 0, F.col("text")).otherwise(blanked(F.col("text")))
    return seeded.select("doc_id", "row", "seeds", candidates(left).alias("candidates"))


def _place(mark: Column) -> tuple[Column, Column]:
    """Word and bit of a 64-bit hash in the bitmap."""
    return (F.shiftrightunsigned(mark, 64 - BITS + 6).cast("int"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mark, 64 - BITS).bitwiseAND(F.lit(63).cast("long")).cast("int")))


def places(documents: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, places): how often a pattern's two words are followed by a word, over all texts."""
    word, bit = _place(F.xxhash64(F.substring_index("context", " ", 1), F.substring_index("context", " ", -1)))
    held = patterns.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # one row of 2 ** (BITS - 6) numbers, whatever the data
    bitmap = (documents.sparkSession.range(1 << (BITS - 6)).select(F.col("id").cast("int").alias("word"))
                       .join(held, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b"))
                       .select(F.col("b.bits").alias("bits")))

    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" \t\n\x0b\f\r")), r"\s+")
    pairs = documents.select(words.alias("words")).where(F.size("words") > 2).join(F.broadcast(bitmap)).select("bits", F.inline(F.arrays_zip(
        F.slice("words", F.lit(1), F.size("words") - 2).alias("a"), F.slice("words", F.lit(2), F.size("words") - 2).alias("b"))))
    at, mask = _place(F.xxhash64("a", "b"))
    found = pairs.where(F.get("bits", at).bitwiseAND(mask) != 0).select(F.concat_ws(" ", "a", "b").alias("context"))
    return (found.groupBy("context").agg(F.count(F.lit(1)).alias("places"))
                 .join(patterns.select("context"), "context"))


def bootstrap(edges: DataFrame, patterns: DataFrame, params: Bootstrap = Bootstrap()) -> DataFrame:
    """(context, kind, score) of the patterns after all rounds.

    ``edges``: context, instance, kind (-1 for a candidate), n occurrences; ``patterns``: context, places.
    """
    seeds = edges.where(F.col("kind") >= 0).select("context", "kind", (F.col("n") * MILLION).alias("gain"))
    open_edges = edges.where(F.col("kind") < 0).drop("kind")
    scored = None
    for turn in range(params.rounds):
        gained = seeds
        if scored is not None:
            # what an instance gives a pattern comes from its best other pattern, so no pattern supports itself
            rated = open_edges.join(scored.where(F.col("score") > 0), "context")
            rate = F.struct("score", (-F.col("kind")).alias("order"), "context")
            first = rated.groupBy("instance").agg(F.max(rate).alias("first"))
            others = (rated.join(first, "instance").where(F.col("context") != F.col("first.context"))
                           .groupBy("instance").agg(F.max(rate).alias("second")))
            best = F.when(F.col("first.context") != F.col("context"), F.col("first")).otherwise(F.col("second"))
            given = (open_edges.join(first.join(others, "instance", "left"), "instance").withColumn("best", best)
                               .where(F.col("best").isNotNull()))
            gained = seeds.unionByName(given.select("context", (-F.col("best.order")).alias("kind"), (F.col("n") * F.col("best.score")).alias("gain")))
        by_kind = gained.groupBy("context", "kind").agg(F.sum("gain").alias("gain"))
        scored = stage(by_kind.groupBy("context").agg(F.sum("gain").alias("gain"), F.max_by("kind", F.struct("gain", -F.col("kind"))).alias("kind"))
                              .join(patterns, "context").select("context", "kind", F.expr("gain DIV places").alias("score")), f"patterns{turn}")
    return scored


def find(documents: DataFrame, params: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's doc_id, seeds and found: arrays of spans (start, kind, end, text, context)."""
    rows = stage(occurrences(documents, id_col, text_col), "occurrences")
    one = F.struct(F.col("s.context").alias("context"), F.lower("s.text").alias("instance"), F.col("s.kind").alias("kind"))
    edges = stage(rows.select(F.explode(F.concat("seeds", "candidates")).alias("s")).select(one.alias("e")).select("e.*")
                      .where(F.col("context").isNotNull()).groupBy("context", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "edges")
    wide = edges.groupBy("context").agg(F.count_distinct("instance").alias("instances"), F.sum("n").alias("n")).where(F.col("instances") >= params.min_instances)
    wide = stage(wide.select("context", "n"), "contexts")
    seen = places(documents, wide, text_col)
    # a context cut by punctuation can stand behind an identifier more often than before a word
    patterns = stage(wide.join(seen, "context", "left").select("context", F.greatest("n", F.coalesce("places", F.lit(0))).alias("places")), "places")
    trusted = bootstrap(edges.join(patterns.select("context"), "context"), patterns, params).where(F.col("score") >= params.min_score)
    found = (rows.select("row", F.explode("candidates").alias("s")).withColumn("context", F.col("s.context"))
                 .join(trusted.select("context", F.col("kind").alias("as")), "context")
                 .select("row", F.struct("s.start", F.col("as").alias("kind"), "s.end", "s.text", "s.context").alias("s"))
                 .groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("found")))
    return rows.join(found, "row", "left").select("doc_id", "seeds", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
