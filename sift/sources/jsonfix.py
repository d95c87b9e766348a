"""Malformed scanner JSON as a bulk job.

One pass over the texts, routed by CASE expressions:
1. valid texts are read as they are;
2. the others are trimmed natively: start of the JSON inside prose, cut at a
   truncation marker, back to the last complete object, re-close;
3. those still not valid go through one Arrow-batched ``pandas_udf`` that
   escapes stray quotes inside strings (the only Python; other rows are nulls);
4. what is still not valid is ``failed``, with a reason.

An array is read as strings first and its elements one by one, so an element
that is no object costs only itself (it stays in its place as a null item).
Objects are read as ``map<string,string>``, so that the strict filter can test
key *presence* (a present null counts as present) before typing; of a key given
twice the last value counts, and ``NaN`` and ``Infinity`` are values.  A string
element whose content is itself a JSON object cannot be told from that object.
A single string of more than 20 million characters is beyond the engine's JSON
reader; such a text fails with the reason ``unreadable``.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
ENVELOPE_START = '{"items"'
ARRAY_START = "[{"
TRUNCATION_MARKERS = ("... [TRUNCATED", "...[TRUNCATED", "…[TRUNCATED", "… [TRUNCATED")
REQUIRED_FIELDS = ("title", "url", "source_tier", "source_name")
STRUCTURAL_AFTER_QUOTE = ":,}]"       # a quote followed by one of these closes a string
# ---------------------------------------------------------------------------

ITEMS_TYPE = "array<map<string,string>>"
ENVELOPE_TYPE = "struct<items:string,meta:string>"
#: JSON as the reference's parser accepts it.
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
NO_JSON, UNREADABLE = "no_json", "unreadable"

_INNER = re.compile(r'["\\]')
_SPACE = re.compile(r"[ \t\n\r]*")


def escape_stray_quotes(text: str) -> str:
    """Escape a double quote inside a string unless the next non-blank
    character ends a JSON value (or the text ends there)."""
    out: list[str] = []
    pos, n, inside = 0, len(text), False
    while pos < n:
        if not inside:
            q = text.find('"', pos)
            if q < 0:
                out.append(text[pos:])
                break
            out.append(text[pos:q + 1])
            pos, inside = q + 1, True
            continue
        m = _INNER.search(text, pos)
        if m is None:
            out.append(text[pos:])
            break
        j = m.start()
        out.append(text[pos:j])
        if text[j] == "\\":
            out.append(text[j:j + 2])
            pos = j + 2
            continue
        after = _SPACE.match(text, j + 1).end()
        if after >= n or text[after] in STRUCTURAL_AFTER_QUOTE:
            out.append('"')
            inside = False
        else:
            out.append('\\"')
        pos = j + 1
    return "".join(out)


# ship this module's helpers by value so executors need not import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _repair_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else escape_stray_quotes(t))


# Marked non-deterministic so the optimizer never copies the call into a
# pushed-down filter or evaluates it twice.
_repair_quotes = F.pandas_udf(_repair_batch, T.StringType()).asNondeterministic()


def is_json(text: Column) -> Column:
    """Whole-text JSON validity.

    The reader stops after the first complete value and ignores what follows,
    so the text must also read as the one element of an array and as the value
    of an object: trailing data, or a bracket closing the wrapper early, breaks
    one of the two.
    """
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", JSON_OPTIONS)
    value = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", JSON_OPTIONS)
    return F.coalesce((F.size(element) == 1) & F.map_contains_key(value, F.lit("v")) & (F.size(value) == 1), F.lit(False))


def _last_wins(item: Column) -> Column:
    """The map with one entry per key, the last one given."""
    entries = F.map_entries(item)
    latest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    repeated = F.size(F.array_distinct(F.map_keys(item))) < F.size(item)
    return F.when(repeated, F.map_from_entries(latest)).otherwise(item)


def _objects(array_text: Column) -> Column:
    """The elements of a JSON array text as maps, null for those that are no object."""
    elements = F.from_json(array_text, "array<string>", JSON_OPTIONS)
    maps = F.transform(elements, lambda e: F.when(F.ltrim(e).startswith("{"), F.from_json(e, "map<string,string>", JSON_OPTIONS)))
    return F.transform(maps, _last_wins)


def _extract(df: DataFrame, text_col: str, out: str = "_p") -> DataFrame:
    """Adds ``out`` = struct(kind, items, meta) for texts known to be valid JSON.

    Valid JSON that is neither an array nor an object yields no items, as in
    the reference.
    """
    text = F.col(text_col)
    no_items = F.array().cast(ITEMS_TYPE)
    staged = df.withColumn("_first", F.regexp_extract(text, r"^[ \t\n\r]*(.)", 1))
    first = F.col("_first")
    staged = staged.withColumn("_env", F.when(first == "{", F.from_json(text, ENVELOPE_TYPE, JSON_OPTIONS)))
    staged = staged.withColumn("_list", F.when(first == "[", text).otherwise(F.col("_env.items")))
    staged = staged.withColumn("_meta", F.from_json(F.col("_env.meta"), "map<string,string>", JSON_OPTIONS))
    meta = F.col("_meta")
    number = lambda key: meta[key].try_cast("int")  # noqa: E731  - a number may come as text
    return staged.withColumn(out, F.struct(
        F.when(first == "[", F.lit("array")).when(first == "{", F.lit("envelope")).otherwise(F.lit("scalar")).alias("kind"),
        F.coalesce(_objects(F.col("_list")), no_items).alias("items"),
        F.when(meta.isNotNull(), F.struct(
            number("scanned").alias("scanned"), meta["state_of_world"].alias("state_of_world"),
            meta["action_items"].alias("action_items"), number("sweep_num").alias("sweep_num"))).alias("meta"),
    )).drop("_first", "_env", "_list", "_meta")


def trim_envelope(df: DataFrame, raw_col: str, out: str = "_t") -> DataFrame:
    """Native part of the repair: JSON start inside prose, truncation cut and
    re-closing.  ``out`` is null when the text holds no '{' or '['."""
    raw = F.col(raw_col)

    def pos(c: Column) -> Column:          # 1-based position or null
        return F.nullif(c, F.lit(0))

    env, arr = pos(F.instr(raw, ENVELOPE_START)), pos(F.instr(raw, ARRAY_START))
    start = F.coalesce(F.when(env <= F.coalesce(arr, env), env), arr,
                       F.least(pos(F.instr(raw, "{")), pos(F.instr(raw, "["))))
    d = df.withColumn("_start", start)
    rest = F.substring(raw, F.col("_start"), F.length(raw))
    d = d.withColumn("_rest", rest)
    rest = F.col("_rest")
    # the first marker of the list that occurs wins (list order, not position)
    d = d.withColumn("_cut", F.coalesce(*[pos(F.instr(rest, m)) for m in TRUNCATION_MARKERS]))
    head = F.substring(rest, 1, F.col("_cut") - 1)
    to_brace = F.regexp_extract(head, r"(?s)^(.*\})", 1)
    d = d.withColumn("_head", F.when(to_brace != "", to_brace).otherwise(head))
    head = F.col("_head")
    envelope_close = ((F.substring(rest, 1, 1) == "{") & ~F.substring(head, 1, 20).contains('["items"')) \
        | F.ltrim(head).startswith(ENVELOPE_START)
    closed = F.concat(head, F.when(envelope_close, F.lit("]}")).otherwise(F.lit("]")))
    d = d.withColumn(out, F.when(F.col("_cut").isNotNull(), closed).otherwise(rest))
    return d.drop("_start", "_rest", "_cut", "_head")


def recover(texts: DataFrame, id_col: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """Parse every text; adds ``outcome`` (clean / trimmed / quotes / failed),
    ``reason`` (of a failure), ``kind``, ``items`` and ``meta``.

    Each step works on the rows that need it and sees nulls for the others, so
    there is one scan and the optimizer has no filter to push a parse into.
    """
    raw = F.col(raw_col)
    df = texts.withColumn("_ok", is_json(raw))
    df = df.withColumn("_bad", F.when(~F.col("_ok"), raw))
    df = trim_envelope(df, "_bad").withColumn("_t_ok", is_json(F.col("_t")))
    df = df.withColumn("_q", _repair_quotes(F.when(~F.col("_t_ok"), F.col("_t"))))
    df = df.withColumn("outcome", F.when(F.col("_ok"), F.lit("clean")).when(F.col("_t_ok"), F.lit("trimmed"))
                                   .when(is_json(F.col("_q")), F.lit("quotes")).otherwise(F.lit("failed")))
    outcome = F.col("outcome")
    df = (df.withColumn("reason", F.when((outcome == "failed") & F.col("_t").isNull(), F.lit(NO_JSON))
                                   .when(outcome == "failed", F.lit(UNREADABLE)))
            .withColumn("_src", F.when(outcome == "clean", raw).when(outcome == "trimmed", F.col("_t"))
                                 .when(outcome == "quotes", F.col("_q"))))
    df = _extract(df, "_src").withColumn("_p", F.when(outcome != "failed", F.col("_p")))
    return df.drop("_ok", "_bad", "_t", "_t_ok", "_q", "_src").select(
        "*", F.col("_p.kind").alias("kind"), F.col("_p.items").alias("items"), F.col("_p.meta").alias("meta")).drop("_p")


def _complete(item: Column) -> Column:
    """Has the item every required key?  What is no object has none."""
    has = [F.map_contains_key(item, F.lit(k)) for k in REQUIRED_FIELDS]
    return F.coalesce(has[0] & has[1] & has[2] & has[3], F.lit(False))


def items_of(recovered: DataFrame, id_col: str = "msg_id", strict: bool = False) -> DataFrame:
    """Exploded items (``item_pos``, ``item`` map, ``complete``); with
    ``strict`` the ones missing a required key are dropped (A11)."""
    # the outer form keeps the optimizer from inferring a size(items) > 0
    # filter and re-running the JSON parse inside the scan filter
    out = (recovered.select(id_col, "outcome", F.posexplode_outer("items").alias("item_pos", "item"))
                    .where(F.col("item_pos").isNotNull()))
    out = out.withColumn("complete", _complete(F.col("item")))
    return out.where(F.col("complete")) if strict else out


def write_strict(recovered: DataFrame, path: str, id_col: str = "msg_id") -> dict[str, int]:
    """A11 + A14: the complete items as JSON lines, and the counts of kept and
    dropped items as a side output of the same job (an ``Observation``; nothing is read twice)."""
    counts = Observation("strict items")
    items = items_of(recovered, id_col).observe(
        counts, F.count_if(F.col("complete")).alias("kept"), F.count_if(~F.col("complete")).alias("dropped"))
    items.where(F.col("complete")).select(id_col, "item_pos", "item").write.mode("overwrite").json(path)
    return counts.get


def recovery_stats(recovered: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Per outcome, texts, items extracted and items a strict run drops; one aggregate over the texts."""
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    n_dropped = F.coalesce(F.size(F.filter("items", lambda i: ~_complete(i))), F.lit(0)).cast("long")
    return (recovered.select("outcome", F.when(F.col("items").isNull(), 0).otherwise(n_items).alias("n"),
                             F.when(F.col("items").isNull(), 0).otherwise(n_dropped).alias("d"))
                     .groupBy("outcome").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_items"), F.sum("d").alias("n_dropped")))


def unwrap(recovered: DataFrame, scanned: int | None = None, state_of_world: str | None = None,
           action_items: str | None = None, sweep_num: int | None = None) -> DataFrame:
    """Run settings per text — an argument beats meta, meta beats the
    default; empty or zero counts as not given, as in the reference."""
    m = F.col("meta")

    def pick(arg, meta_field, default):
        given = F.lit(arg) if arg else None
        meta = F.nullif(m[meta_field], F.lit(0 if isinstance(default, int) else ""))
        return F.coalesce(*(x for x in (given, meta) if x is not None), F.lit(default))

    return recovered.select(
        "*",
        pick(scanned, "scanned", 0).alias("scanned"),
        pick(state_of_world, "state_of_world", "").alias("state_of_world"),
        pick(action_items, "action_items", "").alias("action_items"),
        F.coalesce(*(x for x in ((F.lit(sweep_num) if sweep_num else None), F.nullif(m["sweep_num"], F.lit(0)))
                     if x is not None), F.lit(None).cast("int")).alias("sweep_num"))
