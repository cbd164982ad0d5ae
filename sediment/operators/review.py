"""Review texts from document sections, and the rules that annotations and attributes must keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, first_paragraph, rstrip, strip

# Terms that mark an event, and extensions of media types.
EVENT_TERMS = [
    "acquisition", "agreement", "approval", "award", "backlog", "buyback", "chief executive", "chief financial", "contract", "credit facility",
    "customer", "debt", "dividend", "earnings", "guidance", "impairment", "investigation", "launch", "layoff", "litigation",
    "merger", "offering", "order", "regulatory", "repurchase", "restructuring", "results", "revenue", "split",
]
EXTENSIONS = {"application/json": ".json", "application/xml": ".xml", "text/html": ".html", "text/plain": ".txt", "text/xml": ".xml"}
SEPARATOR = "\n\n---\n\n"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: inside lambdas Spark computes an expression again wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def term_score(text: Column, terms: list[str] = EVENT_TERMS) -> Column:
    """How often the terms stand in the text, case aside; occurrences of one term don't overlap."""
    freed = lambda low, t: F.octet_length(low) - F.octet_length(F.replace(low, F.lit(t), F.lit("")))
    one = lambda low, t: F.when(F.contains(low, F.lit(t)), freed(low, t) / F.lit(len(t.encode()))).otherwise(0.0)
    return bound(F.lower(text), lambda low: F.when(low.isNotNull(), sum((one(low, t) for t in terms), F.lit(0.0)).cast("long")))


def top_sections(sections: Column, n: int = 6, terms: list[str] = EVENT_TERMS) -> Column:
    """The n sections (array of struct heading, text, is_table, is_boilerplate) with the highest scores, ties by place.

    Tables and blank sections don't count, boilerplate only where there is nothing else. Scores read the first 2000
    characters of a text."""
    usable = F.filter(sections, lambda s: ~F.coalesce(s["is_table"], F.lit(False)) & (F.ltrim(s["text"], F.lit(WHITE)) != ""))
    score = lambda s: term_score(F.concat(F.coalesce(s["heading"], F.lit("")), F.lit(" "), F.substring(s["text"], 1, 2000)), terms)
    named = lambda s, *names: [s[c].alias(c) for c in names]
    ranked = F.transform(usable, lambda s, i: F.struct(F.coalesce(s["is_boilerplate"], F.lit(False)).alias("last"), (-score(s)).alias("rank"), i.alias("place"), *named(s, "heading", "text")))
    first = F.slice(F.sort_array(ranked), 1, n)  # boilerplate stands behind the others, if there are any
    return bound(first, lambda a: F.transform(F.filter(a, lambda s: s["last"] == F.get(a, F.lit(0))["last"]), lambda s: F.struct(*named(s, "rank", "place", "heading", "text"))))


def review_text(ranked: Column, budget: int = 12_000) -> Column:
    """Headings and texts of the ranked sections, parted by a rule, cut where the budget of characters ends."""
    block = lambda s: F.concat(F.when(strip(F.coalesce(s["heading"], F.lit(""))) != "", F.concat(strip(s["heading"]), F.lit("\n\n"))).otherwise(""), strip(s["text"]))

    def add(acc: Column, s: Column) -> Column:
        head = F.when(acc == "", F.lit("")).otherwise(F.concat(acc, F.lit(SEPARATOR)))
        return F.when(F.length(acc) >= budget, acc).otherwise(F.concat(head, rstrip(F.substring(block(s), F.lit(1), F.greatest(F.lit(budget) - F.length(head), F.lit(0))))))

    return F.aggregate(ranked, F.lit(""), add)


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def extension(kind: Column, url: Column) -> Column:
    """By media type, else the path's own suffix of at most ten characters, else .bin."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), kind)
    suffix = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"(\.[^./]+)$", 1))
    return F.coalesce(known, F.when(F.length(suffix).between(2, 10), suffix), F.lit(".bin"))


def iso_date(text: Column) -> Column:
    """Whether the text is a date of ISO 8601: with or without dashes, by month and day or by week (and day)."""
    plain = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = plain.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain)).isNotNull()
    week = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?$"
    n = F.regexp_extract(text, week, 3).try_cast("int")
    last = F.make_date(F.regexp_extract(text, week, 1).try_cast("int"), F.lit(12), F.lit(28))  # always in the year's last week
    by_week = text.rlike(week) & n.between(1, F.weekofyear(last))
    return ~F.startswith(text, F.lit("0000")) & (day | by_week)


def valid_attribute(kind: Column, value: Column, allowed: Column) -> Column:
    """Whether a JSON value is of the kind: string, number (finite, no boolean), boolean, date, enum or string_list."""
    text = F.when(value.rlike(r'^"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0])
    items = F.when(value.rlike(r"^\["), F.from_json(value, "array<string>"))
    quoted = value.rlike(r'^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    ok = (
        F.when(kind == "string", strip(text) != "")
        .when(kind == "number", value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & (F.abs(value.try_cast("double")) < float("inf")))
        .when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "date", iso_date(text))
        .when(kind == "enum", F.array_contains(allowed, text))
        .when(kind == "string_list", quoted & F.forall(items, lambda i: strip(i) != ""))
    )
    return F.coalesce(ok, F.lit(False))


def attribute_errors(given: Column, allowed: Column, required: Column) -> Column:
    """struct(unknown, missing) of attribute names; an attribute without a value is missing."""
    names = F.map_keys(given)
    valued = F.map_keys(F.map_filter(given, lambda _, v: v.isNotNull()))
    return F.struct(F.sort_array(F.array_except(names, allowed)).alias("unknown"), F.sort_array(F.array_except(required, valued)).alias("missing"))


def incompatible(labelled: DataFrame, pairs: DataFrame, key: str, labels: str, channels: str) -> DataFrame:
    """(key, left, right): labels of one record that exclude each other (pairs: left, right in both orders).

    Guidance labels with non-empty, disjoint financial channels (map label to array) are let through."""
    a = labelled.select(key, F.col(channels).alias("_c"), F.explode(labels).alias("left"))
    b = labelled.select(F.col(key).alias("_k"), F.explode(labels).alias("right"))
    both = a.join(b, F.col(key) == F.col("_k")).where("left < right").join(F.broadcast(pairs.select("left", "right")), ["left", "right"])
    x, y = F.try_element_at("_c", F.col("left")), F.try_element_at("_c", F.col("right"))
    free = F.col("left").startswith("guidance.") & F.col("right").startswith("guidance.") & (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    return both.where(~F.coalesce(free, F.lit(False))).select(key, "left", "right")


def tokens_over(spans: DataFrame, offsets: str, start: str, stop: str) -> DataFrame:
    """spans with first and last + 1 of the tokens (array of struct start, stop) that overlap the half-open span."""
    hit = F.filter(F.transform(offsets, lambda t, i: F.struct(i.alias("i"), t["start"].alias("a"), t["stop"].alias("b"))), lambda t: (t["b"] > t["a"]) & (t["a"] < F.col(stop)) & (t["b"] > F.col(start)))
    return spans.withColumn("_h", hit).withColumn("first_token", F.get("_h", F.lit(0))["i"]).withColumn("stop_token", F.try_element_at("_h", F.lit(-1))["i"] + 1).drop("_h")


def review_with_spans(ranked: Column, budget: int = 12_000, quote: int = 600, spans: int = 4) -> Column:
    """struct(text, spans): the review text of the ranked sections, and where the first paragraphs of sections stand in it
    (at most `quote` characters each, at most `spans` of them, only those that the budget leaves whole)."""
    heading = lambda s: strip(F.coalesce(s["heading"], F.lit("")))
    lead = lambda s: F.when(heading(s) != "", F.concat(heading(s), F.lit("\n\n"))).otherwise("")
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start int, stop int, text string>>").alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        head = F.when(acc["text"] == "", F.lit("")).otherwise(F.concat(acc["text"], F.lit(SEPARATOR)))

        def cut(p: Column) -> Column:
            block = rstrip(F.substring(F.concat(p["lead"], p["body"]), F.lit(1), F.greatest(F.lit(budget) - F.length(p["head"]), F.lit(0))))
            said = rstrip(F.substring(first_paragraph(p["body"]), 1, quote))
            return F.struct(F.concat(p["head"], block).alias("text"), (F.length(p["head"]) + F.length(p["lead"])).alias("at"), said.alias("said"))

        def grown(p: Column) -> Column:
            stop = p["at"] + F.length(p["said"])
            fits = (p["said"] != "") & (stop <= F.length(p["text"]))
            one = F.array(F.struct(p["at"].alias("start"), stop.alias("stop"), p["said"].alias("text")))
            return F.struct(p["text"].alias("text"), F.when(fits, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        parts = F.struct(head.alias("head"), lead(s).alias("lead"), strip(s["text"]).alias("body"))
        return F.when(F.length(acc["text"]) >= budget, acc).otherwise(bound(bound(parts, cut), grown))

    return F.aggregate(ranked, empty, add, lambda acc: F.struct(acc["text"].alias("text"), F.slice(acc["spans"], 1, spans).alias("spans")))
