"""Answers of models as JSON: a reply that is none may still hold an object, in fences or between sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import let


def first_object(reply: Column) -> Column:
    """The text from the first brace to the one that closes it, fences at the ends of lines left out; null if there is none.

    One pass over tokens without nested repetition, so that long strings cost time in proportion: a quote opens or closes a string
    unless a backslash stands before it, and braces in strings don't count.
    """
    bare = F.regexp_replace(F.trim(reply), r"(?m)^\s*```(?:json)?|```\s*$", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(False).alias("quoted"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(t == "{", 1).when(t == "}", -1).otherwise(0)
        now = F.struct(depth.alias("depth"), (s["chars"] + F.length(t)).alias("chars"), (s["quoted"] != (t == '"')).alias("quoted"), (depth == 0).alias("done"))
        return F.when(s["done"], s).otherwise(now)

    def closed(rest: Column) -> Column:
        tokens = F.regexp_extract_all(rest, F.lit(r'((?s:\\.?)|["{}]|[^"{}\\]+)'), F.lit(1))
        return F.substring(rest, F.lit(1), F.aggregate(tokens, start, step, lambda s: F.when(s["done"], s["chars"])))

    # let: else each use of the text would take the fences out again
    return let(let(bare, lambda b: F.when(F.contains(b, F.lit("{")), F.substring(b, F.instr(b, "{"), F.length(b)))), closed)


def value(reply: Column) -> Column:
    """A reply as a variant: all of it if it is JSON, else its first object; null if neither can be read. What follows the object is dropped."""
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(first_object(reply)))


def object_text(reply: Column) -> Column:
    """The text of the object that value() reads; null if there is none."""
    whole = F.try_parse_json(reply)
    return F.when(whole.isNotNull(), F.when(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.trim(reply))).otherwise(F.when(F.try_parse_json(first_object(reply)).isNotNull(), first_object(reply)))


def fields_of(v: Column, fields: dict[str, str]) -> Column:
    """A struct of a variant's fields, each with its type; null where a value is absent or of another type."""
    return F.struct(*(F.try_variant_get(v, f"$['{n}']", kind).alias(n) for n, kind in fields.items()))


def parsed(reply: Column, fields: dict[str, str]) -> Column:
    """A struct of the fields, each with its type; null where a value is absent or of another type. A reply that can't be read gives null."""
    return let(value(reply), lambda v: F.when(v.isNotNull(), fields_of(v, fields)))


def field(reply: Column, name: str, v: Column | None = None) -> Column:
    """A field of the reply's object, or the reply itself; v is value(reply), where it is known."""
    return F.coalesce(F.try_variant_get(value(reply) if v is None else v, f"$['{name}']", "string"), reply)


def target(fields: dict[str, Column]) -> Column:
    """A training target; keys in the given order."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def complete(got: Column, fields: dict[str, str]) -> Column:
    """Whether a struct has all fields."""
    out = got.isNotNull()
    for n in fields:
        out = out & got[n].isNotNull()
    return F.coalesce(out, F.lit(False))


def valid(reply: Column, fields: dict[str, str]) -> Column:
    """Whether a reply's object has all fields, with values of their types."""
    return let(parsed(reply, fields), lambda got: complete(got, fields))


def attempted(replies: list[Column], fields: dict[str, str], text: str | None = None, unusable=None) -> Column:
    """value (a struct of the fields), error and attempts of several replies to one question, in the order in which they were asked for.

    The first reply whose object has all fields counts, so the first may be greedy and the next a sampled retry; unusable, a test of
    the field `text`, makes a reply count as failed, too. If none counts, value is null and error tells why the last failed. A null
    reply was never given, and is no attempt.
    """
    def judged(asked: Column):
        return lambda got: told(got, asked)  # one argument: a second would be the index

    def told(got: Column, asked: Column) -> Column:
        error = F.when(got.isNull(), "no JSON object in reply").when(~complete(got, fields), "a field is missing")
        if text is not None and unusable is not None:
            error = error.when(unusable(got[text]), "degenerate text")
        return let(error, lambda e: F.struct(F.when(e.isNull(), got).alias("value"), e.alias("error"), asked.alias("attempts")))

    tried, asked = [], F.lit(0)
    for r in replies:
        asked = asked + r.isNotNull().cast("int")
        tried.append(F.when(r.isNotNull(), let(parsed(r, fields), judged(asked))))
    given = F.array_compact(F.array(*tried))
    return let(given, lambda all_: F.coalesce(F.get(F.filter(all_, lambda t: t["error"].isNull()), F.lit(0)), F.element_at(all_, -1)))
