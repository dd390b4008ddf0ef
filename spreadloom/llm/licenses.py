"""License scan by ordered signature rules, with DataFrame functions only.

Text is seen as lower-case words (A-Z) of letters, digits and non-ASCII characters between single spaces. A gate lets
through documents with any licensing word; a keyword lets through a rule; its regular expression then finds all places.
Places are sorted by where they start, wider ones first, and one sweep drops those that lie in an earlier one of the same
or a higher priority.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadloom.llm.signatures import BASE, GATE, RULES

RULE_TYPE = "struct<id int, kw string, rx string, label string, priority int, confidence double, base boolean>"
#: Fields in the order that the sweep takes places in: start, end from the right, priority from above, rule.
PLACE = "struct<s:bigint,minus_e:bigint,minus_priority:int,id:int,label:string,confidence:double,base:boolean>"
#: Elements that a sweep takes in before it puts what came out aside.
SWEEP = 64


def rules() -> list[dict]:
    """All rules in order of priority: the base phrases first."""
    made = [{"kw": p, "rx": p, "label": label, "priority": 100, "confidence": 1.0, "base": True} for p, label in BASE.items()]
    made += [{"kw": kw, "rx": rx, "label": label, "priority": priority, "confidence": confidence, "base": False} for label, kw, rx, priority, confidence in RULES]
    made = sorted(made, key=lambda r: -r["priority"])
    return [r | {"id": k, "rx": f" (?:{r['rx']})(?= )"} for k, r in enumerate(made)]


def swept(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item)`` gives for each item in order, as it hands its state on: (new state, array of results).

    Appending to an array copies it, so results are gathered in runs of SWEEP items and the runs put together at the end.
    """
    none = F.array().cast(f"array<{kind}>")
    n = F.ceil(F.size(items) / F.lit(SWEEP)).cast("int")
    run = lambda k: F.slice(items, k * SWEEP + 1, F.lit(SWEEP))

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], out).alias("out"))

    def many(acc: Column, k: Column) -> Column:
        part = F.aggregate(run(k), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["state"].alias("state"), F.concat(acc["outs"], F.array(p["out"])).alias("outs")))[0]

    runs = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(runs, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), many)["outs"])


def places(norm: Column) -> Column:
    """All places of all rules in a normalised text: an array of structs with start and end words."""
    table = rules()
    keywords = F.array(*[F.lit(k) for k in sorted({r["kw"] for r in table})])
    all_rules = F.from_json(F.lit(json.dumps(table)), f"array<{RULE_TYPE}>")
    present = F.filter(keywords, lambda k: F.contains(norm, F.concat(F.lit(" "), k)))
    # The keywords are looked for once; as a lambda's variable they are not evaluated again for each rule.
    found = F.flatten(F.transform(F.array(present), lambda p: F.filter(all_rules, lambda r: F.array_contains(p, r["kw"]))))

    def spaces(c: Column) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")

    def of(r: Column) -> Column:
        parts = F.arrays_zip(F.call_function("split", norm, r["rx"]).alias("p"), F.regexp_extract_all(norm, r["rx"], F.lit(0)).alias("m"))
        parts = F.filter(parts, lambda z: z["m"].isNotNull())

        def step(at: Column, z: Column) -> tuple[Column, Column]:
            s = at + spaces(z["p"])
            e = s + spaces(z["m"])
            place = F.struct(s.alias("s"), (-e).alias("minus_e"), (-r["priority"]).alias("minus_priority"), r["id"].alias("id"), r["label"].alias("label"), r["confidence"].alias("confidence"), r["base"].alias("base"))
            return e, F.array(place)

        return F.transform(F.array(parts), lambda ps: swept(ps, F.lit(0).cast("long"), PLACE, step))[0]

    return F.flatten(F.transform(found, of))


def standing(all_places: Column) -> Column:
    """The places that lie in no other one of the same or a higher priority; base places always stand."""
    levels = sorted({r["priority"] for r in rules()}, reverse=True)
    ends = F.array(*[F.lit(-1).cast("long") for _ in levels])  # the furthest end so far, of each priority and those above
    level = F.array(*[F.lit(-p) for p in levels])

    def step(far: Column, d: Column) -> tuple[Column, Column]:
        e, k = -d["minus_e"], F.array_position(level, d["minus_priority"])
        new = F.transform(far, lambda x, i: F.when(i + 1 >= k, F.greatest(x, e)).otherwise(x))
        falls = ~d["base"] & (F.get(far, (k - 1).cast("int")) >= e)
        return new, F.when(falls, F.array().cast(f"array<{PLACE}>")).otherwise(F.array(d))

    return F.transform(F.array(F.array_sort(all_places)), lambda ps: swept(ps, ends, PLACE, step))[0]


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest of their start
    words. labels has the base ones and those of the detections that stay. score is the best confidence, or 0. A null
    or empty text has no words and empty labels. Rows stand for themselves: nothing is shuffled or joined.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    rows = docs.select(*carry, F.concat(F.lit(" "), plain, F.lit(" ")).alias("__plain")).withColumn("__low", F.lower("__plain"))
    # As a lambda's variable the lower-case text is made once, not for each keyword and rule.
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    none = F.array().cast(f"array<{PLACE}>")
    n_words = F.when(F.length("__plain") <= 2, 0).otherwise(F.length("__plain") - F.length(F.replace("__plain", F.lit(" "), F.lit(""))) - 1)
    looked = rows.select(*carry, n_words.cast("long").alias("n_words"), F.when(reduce(or_, [F.contains("__low", F.lit(x)) for x in GATE]), F.transform(F.array(F.translate("__plain", upper, lower)), places)[0]).otherwise(none).alias("__all"))
    base = F.filter("__all", lambda d: d["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    out = looked.withColumn("__standing", standing(F.col("__all"))).withColumn("__base", base)
    told = F.transform("__standing", lambda d: F.struct(d["s"].alias("s"), (-d["minus_e"]).alias("e"), d["id"].alias("id"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"), d["confidence"].alias("confidence"), d["base"].alias("base")))
    out = out.withColumn("detections", told)
    return out.select(
        *carry, "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(F.transform("__base", lambda d: d["s"])).alias("first_word"), F.array_max(F.transform("__base", lambda d: d["s"])).alias("last_word"),
        names(F.col("__base")).alias("base_labels"), names(F.col("detections")).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"), "detections",
    )
